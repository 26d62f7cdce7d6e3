"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import chunks, column_like, cut_lineage, fixed_schema

#: Lengths of the n-grams in characters and the number of buckets (as a power of two) they are hashed into.
ORDERS, BITS = (3, 4, 5), 18
#: Characters whose n-grams are held at once.
PIECE = 1 << 18
#: Labelled rows of each class that the model is fitted on, the first by a hash of their key; the only sample taken.
SAMPLE_PER_CLASS = 4096
#: N-gram buckets that enter the model, those with the strongest two-class difference.
FEATURES = 4096


def _grams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Piece number and bucket of every n-gram of some strings, repeats included."""
    letters = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    letters[letters < 32] = 32
    size = np.array([len(t) for t in pieces], np.int64)
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
    left = (np.repeat(np.cumsum(size), size) - np.arange(len(letters))).astype(np.int32)
    who, bucket, code = [], [], letters
    for n in range(2, max(ORDERS) + 1):
        code = code[:-1] * np.uint32(0x01000193) + letters[n - 1:] * np.uint32(0x9E3779B1) if len(code) > 1 else code[:0]
        if n in ORDERS:
            inside = left[:len(code)] >= n
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA77) + np.uint32(n)
            mixed = ((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS)
            who.append(owner[:len(code)][inside])
            bucket.append(mixed[inside].astype(np.int32))
    return np.concatenate(who), np.concatenate(bucket)


def _padded(text: str | None) -> str:
    return f" {(text or '').lower()} "


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every character n-gram, repeats included.

    Texts are lower-cased, controls and white space are spaces, and a space stands at either end, so word
    borders are part of the n-grams.  NULL is the empty text, whose only characters are the two spaces.
    """
    return _grams([_padded(t) for t in texts])


def distinct(texts: list[str | None], use: np.ndarray | None = None) -> np.ndarray:
    """Sorted (text number << BITS | bucket) of the distinct buckets of each text, those with ``use`` only.

    About ``PIECE`` characters are handled at once; a longer text goes through in pieces that overlap by an n-gram.
    """
    out, pieces, owners, held, step = [np.zeros(0, np.int64)], [], [], 0, PIECE - max(ORDERS) + 1

    def flush() -> None:
        who, bucket = _grams(pieces)
        if use is not None:
            keep = use[bucket]
            who, bucket = who[keep], bucket[keep]
        out.append(np.unique((np.array(owners, np.int64)[who] << BITS) | bucket))

    for i, text in enumerate(texts):
        line = _padded(text)
        for at in range(0, max(len(line) - max(ORDERS) + 1, 1), step):
            pieces.append(line[at:at + PIECE])
            owners.append(i)
            held += len(pieces[-1])
            if held >= PIECE:
                flush()
                pieces, owners, held = [], [], 0
    if pieces:
        flush()
    # Pieces of one text may share buckets.
    return np.unique(np.concatenate(out))


@dataclass(frozen=True)
class Model:
    """Weight of every bucket (0 for those that did not enter) and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        once = distinct(texts, self.weights != 0)
        total = np.bincount(once >> BITS, self.weights[once & ((1 << BITS) - 1)], len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.intercept, -50, 50)))


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class in which a bucket occurs, summed over the task."""
    seen = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for part in chunks(batch, size=4 * PIECE):
            once = distinct(part.column("text").to_pylist())
            label = part.column("toxic").to_numpy()[once >> BITS]
            for k in (0, 1):
                seen[k] += np.bincount(once[label == k] & ((1 << BITS) - 1), minlength=1 << BITS)
    used = np.flatnonzero(seen.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[0][used]), pa.array(seen[1][used])], schema=fixed_schema("bucket long, clean long, toxic long"))


def _selected(order: np.ndarray):
    """Batches of (toxic, weight, text) to the places of the chosen buckets that occur."""
    place = np.full(1 << BITS, -1, np.int64)
    place[order] = np.arange(len(order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, size=4 * PIECE):
                once = distinct(part.column("text").to_pylist(), place >= 0)
                once = np.sort((once >> BITS << BITS) | place[once & ((1 << BITS) - 1)])
                ends = np.searchsorted(once >> BITS, np.arange(len(part) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((once & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), part.column("weight"), lists], names=["toxic", "weight", "places"])
    return run


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
        per_class: int = SAMPLE_PER_CLASS, features: int = FEATURES) -> Model:
    """The classifier from labelled rows: ``labels`` has ``key`` and ``label`` (0 or 1; NULLs are left out, a key
    labelled twice is toxic if any label says so).

    It is fitted on the documents of at most ``per_class`` keys of each class, weighted back to the class sizes.  Their texts are
    found by a broadcast join of that bounded key list.  Buckets are counted by class in the tasks and summed; each
    feature is presence times log-count ratio.  Without both classes the model is the share of toxic labels, 0 without any.
    """
    known = labels.select(column_like(labels, key).alias("_key"), column_like(labels, label).cast("int").alias("toxic")).where("_key IS NOT NULL AND toxic IN (0, 1)")
    known = cut_lineage(known.groupBy("_key").agg(F.max("toxic").alias("toxic")), "labelled_keys")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(1 << BITS), 30.0 if 1 in sizes else -30.0)
    draw = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("_key"), "_key").limit(per_class)
            .withColumn("weight", F.lit(sizes[k] / min(per_class, sizes[k]))) for k in (0, 1)]
    chosen = F.broadcast(draw[0].unionByName(draw[1]))
    sample = cut_lineage(docs.select(column_like(docs, key).alias("_key"), column_like(docs, text).alias("text")).join(chosen, "_key")
                         .select("toxic", "weight", "text").repartition(max(1, docs.sparkSession.sparkContext.defaultParallelism)), "labelled_texts")
    counted = sample.select("toxic", "text").mapInArrow(_class_counts, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # One row per bucket at most, 2**BITS of them whatever the input.
    table = counted.toPandas()
    if table.empty:
        return Model(np.zeros(1 << BITS), float(np.log((sizes[1] + 0.5) / (sizes[0] + 0.5))))
    clean, toxic = (table[c].to_numpy(float) for c in ("clean", "toxic"))
    n0, n1 = (min(per_class, sizes[k]) for k in (0, 1))
    ratio = np.log((toxic + 1) / (n1 + 2)) - np.log((clean + 1) / (n0 + 2))
    spread = 1 / np.sqrt(1 / (toxic + 1) + 1 / (clean + 1))
    order = np.lexsort((table["bucket"], -np.abs(ratio) * spread))[:features]
    buckets, scale = table["bucket"].to_numpy()[order], ratio[order]
    width = len(buckets)
    # At most two samples of rows pass here, as sparse vectors.
    vector = F.udf(lambda places: Vectors.sparse(width, [int(i) for i in places], [float(scale[i]) for i in places]), VectorUDT())
    places = cut_lineage(sample.mapInArrow(_selected(buckets), "toxic int, weight double, places array<int>"), "toxic_places")
    rows = cut_lineage(places.select(F.col("toxic").cast("double").alias("label"), "weight", vector("places").alias("features")), "toxic_features")
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=0.002, maxIter=40, standardization=False, aggregationDepth=2).fit(rows)
    weights = np.zeros(1 << BITS)
    weights[buckets] = model.coefficients.toArray() * scale
    return Model(weights, float(model.intercept))


def scorer(model: Model) -> Column:
    """User function from a text column to its score between 0 and 1; whole texts, NULL as the empty text."""
    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], names=["text"])
        parts = [model.score(part.column("text").to_pylist()) for part in chunks(batch, size=4 * PIECE)]
        return pa.array(np.concatenate([np.zeros(0), *parts]))
    return score


def held_out(key: str) -> Column:
    """True for the quarter of keys that labels are never learned from; a NULL key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``threshold`` on); the model learns from ``labels`` as given.

    Scoring reads only the text and moves no rows.  NULL and empty texts get the score of an empty text; equal texts
    get equal scores; input columns named as a result column are replaced.
    """
    model = fit(docs, labels, key=key, text=text)
    rest = [column_like(docs, c) for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*rest, scorer(model)(column_like(docs, text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
