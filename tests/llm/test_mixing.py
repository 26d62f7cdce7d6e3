import math
from hashlib import md5

from panelspark.llm import mixing
from panelspark.llm.common import word_count
from pyspark.sql import functions as F
from tests.llm.data import awkward, frame, multiset


def words(text):
    return len((text or "").encode().split())


def water(sizes, weights, budget=1.5, cap=2):
    """Clamp and share again until no source is above its cap."""
    full, total = set(), budget * sum(sizes)
    while True:
        rest = total - sum(cap * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        target = [cap * sizes[i] if i in full else weights[i] * rest / weight for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in full and target[i] >= cap * sizes[i]}
        if not over:
            return target
        full |= over
        if len(full) == len(sizes):
            return [cap * s for s in sizes]


def brute(rows, seed=42):
    names = sorted({r[3] for r in rows if r[3] is not None}, key=lambda s: s.encode()) + ([None] if any(r[3] is None for r in rows) else [])
    sizes = [sum(words(r[1]) for r in rows if r[3] == s) for s in names]
    target = dict(zip(names, water(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))])))
    out = []
    for s, total in zip(names, sizes):
        mine = sorted(((md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), words(r[1]), r[0]) for r in rows if r[3] == s), key=lambda x: x[:2])
        whole = math.floor(target[s] / total) if total else 0
        extra, before = target[s] - whole * total, 0
        for _, n, doc in mine:
            out.append((doc, n, total, round(float(target[s]), 6), n * (whole + (2 * before + n <= 2 * extra))))
            before += n
    return out


def mixed(docs):
    return mixing.mix(docs, word_count("text"), mixing.cycle_weights(3, 1, 2))


def test_equals_brute_force_on_awkward_rows(spark):
    rows = awkward()
    got = mixed(frame(spark, rows, extra=True)).select("doc_id", "size", "source_size", F.round("target", 6), "taken").collect()
    assert multiset(map(tuple, got)) == multiset(brute(rows))


def test_targets_near_and_capped(spark):
    rows = [(i, "w " * (1 + i % 50), "en", f"s{min(i % 9, 4)}", 0) for i in range(900)]
    out = mixed(frame(spark, rows)).cache()
    for r in out.groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"), F.first("source_size").alias("s"), F.max("size").alias("m")).collect():
        assert abs(r["n"] - r["t"]) <= r["m"] / 2 + 1 and r["t"] <= 2 * r["s"] + 1e-6
    assert out.where("taken > 2 * size").count() == 0
    assert multiset(out.collect()) == multiset(mixed(frame(spark, rows)).collect())


def test_clamped_excess_is_shared_again(spark):
    rows = [(1, "a " * 10, "en", "a", 0), (2, "b " * 1000, "en", "b", 0), (3, "c " * 1000, "en", "c", 0)]
    got = {r["source"]: r["target"] for r in mixed(frame(spark, rows)).collect()}
    assert got["a"] == 20 and abs(got["b"] - (3015 - 20) / 3) < 1e-9 and abs(got["c"] - (3015 - 20) * 2 / 3) < 1e-9


def test_repeat_rows_and_empty(spark):
    docs = frame(spark, awkward(2))
    out = mixed(docs)
    copies = mixing.repeat_rows(out)
    assert copies.columns == docs.columns
    assert copies.select(F.sum(word_count("text"))).first()[0] == out.select(F.sum("taken")).first()[0]
    assert mixed(frame(spark, [])).count() == 0
