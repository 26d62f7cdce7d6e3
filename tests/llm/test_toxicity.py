import random
import zlib

import numpy as np
import pytest
from panelspark.llm import toxicity
from pyspark.sql import functions as F
from tests.llm.data import awkward, frame

BAD = ["idiot", "moron", "scum"]


def corpus(n=1500, seed=5):
    rng = random.Random(seed)
    syllables = ["er", "an", "tion", "the", "sto", "hea", "bl", "ou", "re"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 120))]
        toxic = rng.random() < 0.15
        for _ in range(rng.randrange(1, 5) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(toxic)))
    return rows, labels


def brute_ngrams(text):
    """Distinct (length, n-gram) pairs of a padded, lower-cased text."""
    s = " " + "".join(c if ord(c) >= 32 else " " for c in (text or "").lower()) + " "
    return {s[i:i + n] for n in toxicity.ORDERS for i in range(len(s) - n + 1)}


def test_ngrams_are_those_of_each_text():
    texts = [r[1] for r in awkward()[:40]] + [None, "", "ab", "ÄÖ"]
    who, bucket = toxicity.ngrams(texts)
    alone = {}
    for i, t in enumerate(texts):
        mine = set(bucket[who == i].tolist())
        w, b = toxicity.ngrams([t])
        assert mine == set(b.tolist()) and len(mine) <= len(brute_ngrams(t))
        alone[i] = mine
    same = toxicity.ngrams(["xabc", "abcx"])
    assert len(set(same[1][same[0] == 0].tolist()) & set(same[1][same[0] == 1].tolist())) >= 1


def test_long_texts_in_pieces(monkeypatch):
    texts = ["", "ab", "the idiot said so " * 40, "x" * 333, None, "naïve Ünï " * 50]
    whole = toxicity.distinct(texts)
    who, bucket = toxicity.ngrams(texts)
    assert whole.tolist() == sorted({(int(w) << toxicity.BITS) | int(b) for w, b in zip(who, bucket)})
    for piece in (16, 100, 257):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert toxicity.distinct(texts).tolist() == whole.tolist()


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = frame(spark, rows + awkward()[-8:-4], extra=False)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.classify(docs, table.where(~toxicity.held_out("doc_id"))).withColumn("held", toxicity.held_out("doc_id")).collect()
    truth = dict(labels)
    held = [r for r in out if r["held"] and r["doc_id"] in truth and r["doc_id"] < 1500]
    assert len(held) > 250 and all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held"] for r in out if r["doc_id"] is not None)
    hits = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert hits / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    clean = [r for r in held if truth[r["doc_id"]] == 0]
    assert sum(r["predicted"] for r in clean) / len(clean) < 0.03


def test_score_is_the_sum_over_distinct_ngrams():
    rng = np.random.default_rng(0)
    model = toxicity.Model(np.where(rng.random(1 << toxicity.BITS) < 0.3, rng.normal(size=1 << toxicity.BITS), 0) / 20, -0.5)
    texts = ["some Text here here here", "", None, "a" * 5000, "Über"]
    for t, s in zip(texts, model.score(texts)):
        total = sum(model.weights[b] for b in set(toxicity.ngrams([t])[1].tolist()))
        assert abs(s - 1 / (1 + np.exp(-total + 0.5))) < 1e-9


@pytest.mark.parametrize("labels, expected", [([], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0), (None, 1), (3, None)], 0.0)])
def test_one_class_or_no_labels(spark, labels, expected):
    rows = awkward()
    out = toxicity.classify(frame(spark, rows, extra=True), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(rows) and all(abs(r["score"] - expected) < 1e-6 for r in out)


def test_both_classes_without_documents_and_empty_table(spark):
    labels = spark.createDataFrame([(10_000, 1), (10_001, 0), (10_002, 0)], "doc_id long, toxic int")
    assert toxicity.classify(frame(spark, awkward()), labels).where(F.col("score").isNull()).count() == 0
    rows, known = corpus(200)
    assert toxicity.classify(frame(spark, []), spark.createDataFrame(known, "doc_id long, toxic int")).count() == 0
