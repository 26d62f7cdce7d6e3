import random

import pytest
from panelspark.llm import nearcopies
from tests.llm.data import awkward, frame, multiset


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + words]) for i in range(max(len(w) - words + 1, 1))) if w else frozenset()


def alike(a, b):
    return (len(a & b) / len(a | b) if a | b else 1.0) if a != b else 1.0


def check(rows, kept, similarity=0.8, missed=0):
    """No two kept rows are near copies (but for ``missed``), and each row that went is one of a kept row."""
    assert not set(multiset(kept)) - set(multiset(rows))
    sets = [shingles(r[1]) for r in kept]
    both = [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j]) >= similarity]
    assert len(both) <= missed
    for r in rows:
        mine = shingles(r[1])
        assert any(alike(mine, s) >= similarity for s in sets)


def families(seed, n=25):
    """Texts with versions of 1 to 30 changed words, chains of versions and a template with a changing half."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    rows, key = [], 0
    for _ in range(n):
        base = [word() for _ in range(rng.randrange(3, 300))]
        for _ in range(rng.randrange(1, 7)):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + max(1, len(base) // 20))):
                text[rng.randrange(len(text))] = word()
            rows.append((key, " ".join(text), "en", "s", 0))
            key += 1
    chain = [word() for _ in range(200)]
    for _ in range(30):
        chain[rng.randrange(200)] = word()
        rows.append((key, " ".join(chain), "en", "s", 0))
        key += 1
    template = [word() for _ in range(150)]
    for _ in range(40):
        rows.append((key, " ".join(template + [word() for _ in range(25 + rng.randrange(20))]), "en", "s", 0))
        key += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_rows_cover_all_and_are_not_alike(spark, seed):
    rows = families(seed)
    rng = random.Random(seed)
    rng.shuffle(rows)
    kept = [tuple(r) for r in nearcopies.keep_dissimilar(frame(spark, rows)).collect()]
    check(rows, kept, missed=1)
    assert len(kept) < len(rows)


def test_pairs_at_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.85 on their own: at least 0.97 of them lose one text."""
    rng = random.Random(5)
    rows, pairs = [], 0
    while pairs < 200:
        a = [f"v{rng.randrange(10**6)}" for _ in range(120)]
        b = list(a)
        for p in rng.sample(range(120), rng.randrange(2, 6)):
            b[p] = f"v{rng.randrange(10**6)}"
        a, b = " ".join(a), " ".join(b)
        if 0.8 <= alike(shingles(a), shingles(b)) <= 0.85:
            rows += [(2 * pairs, a, "en", "s", 0), (2 * pairs + 1, b, "en", "s", 0)]
            pairs += 1
    kept = nearcopies.keep_dissimilar(frame(spark, rows)).collect()
    assert 200 <= len(kept) <= 206 and {r["doc_id"] // 2 for r in kept} == set(range(200))


def test_awkward_rows_and_clashing_columns(spark):
    rows = awkward()
    docs = frame(spark, rows, extra=True)
    kept = nearcopies.keep_dissimilar(docs)
    assert kept.columns == docs.columns
    check(rows, [tuple(r)[:5] for r in kept.collect()])


def test_one_key_with_two_texts_and_no_words(spark):
    a, b = "one text of several words that stays the same", "quite another one without any shared shingle at all here"
    rows = [(3, a), (7, a.upper()), (7, b), (None, a), (None, "only without a key and long enough to count"), (9, None), (8, ""), (None, " "), (9, "!")]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, _key string, node int")
    kept = [(r["doc_id"], r["text"]) for r in nearcopies.keep_dissimilar(docs).collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, [(3, a), (7, b), (None, rows[4][1]), (8, ""), (9, "!")]))


def test_empty_table_and_wrong_similarity(spark):
    assert nearcopies.keep_dissimilar(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        nearcopies.keep_dissimilar(frame(spark, []), similarity=0)
