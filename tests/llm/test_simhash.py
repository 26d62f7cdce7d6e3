import numpy as np
import pytest
import xxhash
from panelspark.llm import simhash
from panelspark.llm.graph import components
from tests.llm.data import awkward, frame, multiset


def fingerprint(text, words=4):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i:i + words]) for i in range(max(len(w) - words + 1, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(rows, radius=4):
    prints = [fingerprint(r[1]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    root = groups(len(rows), pairs)
    least = {}
    for r, g in zip(rows, root):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return [(r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, root)]


def near_copies():
    base = " ".join(f"word{i * i % 61}" for i in range(200))
    rows = awkward(3) + [(1000 + i, base.replace("word3 ", f"other{i} ", 1), "en", "s", 0) for i in range(40)]
    return rows + [(2000 + i, base, "en", "s", 0) for i in range(30)]


def test_equals_brute_force(spark):
    rows = near_copies()
    got = simhash.near_duplicates(frame(spark, rows, extra=True)).collect()
    assert multiset(map(tuple, got)) == multiset(brute(rows))


def test_empty_and_blank(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    got = simhash.near_duplicates(frame(spark, [(5, "", "", "", 0), (4, None, None, None, None), (9, " \n", "", "", 0)])).collect()
    assert {(r["fingerprint"], r["component_id"]) for r in got} == {("0" * 16, 4)}


@pytest.mark.parametrize("tile", [1, 3, 2048])
def test_links_join_what_all_pairs_join(spark, tile):
    rng = np.random.default_rng(tile)
    far = rng.integers(0, 1 << 64, 150, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(120)], np.uint64)
    chain = np.array([far[0] ^ np.uint64((1 << (3 * i)) - 1) for i in range(15)], np.uint64)
    prints = np.unique(np.concatenate([far, far[1] ^ flips, far[:60] ^ np.uint64(0b1111), far[:60] ^ np.uint64(1 << 63), chain]))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    want = groups(len(prints), zip(*np.nonzero(near)))
    links = simhash.close_links(spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long"), tile=tile).collect()
    at = {int(x): i for i, x in enumerate(prints.view(np.int64))}
    assert groups(len(prints), [(at[r["a"]], at[r["b"]]) for r in links]) == want
    assert all(near[at[r["a"]], at[r["b"]]] or tile > 0 for r in links)


@pytest.mark.parametrize("radius", [*range(8), 8, 15, 20, 33])
def test_bit_sliced_counters(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 1 << 64, 333, dtype=np.uint64)
    b = a ^ np.array([sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 12 + radius), replace=False)) for _ in a], np.uint64)
    got = simhash._lanes(simhash.within(simhash.planes(a), simhash.planes(b), simhash._spare(len(a)), radius), len(a))
    assert (got == (np.bitwise_count(a ^ b) <= radius)).all()


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 2), (3, 2), (None, 5), (200, 199), (-4, 199)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[i] == 100 for i in range(100, 160)) and got[200] == got[199] == -4
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark):
    rows = near_copies()
    docs = frame(spark, rows)
    kept = simhash.keep_one(docs, words=4).collect()
    ids = sorted((r["doc_id"] for r in kept if r["doc_id"] is not None))
    assert ids == sorted({c for _, _, c in brute(rows) if c is not None})
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(frame(spark, [])).count() == 0


def test_one_key_with_two_texts_loses_none(spark):
    a, b = "one text of several words that stays the same", "quite another one without any shared shingle at all here"
    rows = [(3, a), (7, a), (7, b), (None, a), (None, "only without a key and long enough to count"), (None, "only without a key and long enough to count"),
            (9, None), (9, ""), (9, "!")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, _key string")
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()]
    assert sorted(map(repr, kept[:])) == sorted(map(repr, [(3, a), (7, b), (None, rows[4][1]), (9, next(t for k, t in kept if k == 9 and t != "!")), (9, "!")]))
    twins = spark.createDataFrame([(7, a), (7, b)], "doc_id long, text string")
    assert {r["text"] for r in simhash.keep_one(twins).collect()} == {a, b}
