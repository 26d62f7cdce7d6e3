"""Hard-negative mining with score bounds along a spanning tree of the anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import column_like, fixed_schema, scratch_folder
from panelspark.llm.files import open_store

#: Anchors of one tree, which a task answers together, and rows that it looks at at once.
TREE, ROWS = 256, 4096
#: Anchors that the others are put beside before they are cut into trees, and of how many (the first by a hash of their id) they are drawn.
LANDMARKS, SAMPLE = 32, 2048


def usable(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """``_key``, ``_label``, integer vector ``_v`` (floor of scale times each component) and its squared norm, of the rows that take part.

    Rows with a NULL key, label or vector, or a NULL, NaN or infinite component, take no part.
    """
    x = column_like(vectors, vector)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(column_like(vectors, key).isNotNull() & column_like(vectors, label).isNotNull() & x.isNotNull() & whole)
    named = kept.select(column_like(kept, key).cast("long").alias("_key"), column_like(kept, label).cast("long").alias("_label"),
                        F.transform(column_like(kept, vector), lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("_v"))
    return named.withColumn("_square", F.aggregate("_v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers; shorter ones are filled with zeros."""
    size = column.value_lengths().to_numpy()
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy()
    return out


def spanning_tree(x: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Order of a least spanning tree from row 0 on, the parent of each row and the length of the edge to it."""
    x = x.astype(float)
    n = len(x)
    parent, edge, nearest = np.zeros(n, int), np.zeros(n), np.full(n, np.inf)
    order, outside, at = [0], np.ones(n, bool), 0
    outside[0] = False
    while len(order) < n:
        away = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = outside & (away < nearest)
        nearest[closer], parent[closer] = away[closer], at
        at = int(np.where(outside, nearest, np.inf).argmin())
        edge[at], outside[at] = nearest[at], False
        order.append(at)
    return order, parent, edge


class Block:
    """Rows looked at at once, with scores or bounds of scores for every anchor of a tree."""

    def __init__(self, batch: pa.RecordBatch, width: int, exact: bool, anchors: int) -> None:
        self.key, self.label = batch.column("_key").to_numpy(), batch.column("_label").to_numpy()
        self.x = matrix(batch.column("_v"), width)
        if exact:
            self.x = self.x.astype(float)
        self.norm = np.sqrt(batch.column("_square").to_numpy())
        self.low, self.high = np.zeros((anchors, len(batch))), np.zeros((anchors, len(batch)))

    def bound(self, at: int, parent: int, edge: float, size: float) -> None:
        """A score differs from the parent anchor's by at most the edge times the norm of the row; with room for rounding."""
        reach = (edge * (1 + 1e-9) + 1e-12 * size) * self.norm + 1e-6
        self.low[at], self.high[at] = self.low[parent] - reach, self.high[parent] + reach

    def score(self, at: int, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores of some rows, which from then on stand for their bounds."""
        score = self.x[rows] @ anchor if 2 * len(rows) < len(self.x) else (self.x @ anchor)[rows]
        room = 0.0 if self.x.dtype == float else 1e-12 * np.abs(score.astype(float))
        self.low[at, rows], self.high[at, rows] = score - room, score + room
        return score.astype(np.int64)


class Best:
    """The first ``k`` by score, then by smaller key."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.key = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        return int(self.score[-1]) if len(self.score) == self.k else -np.inf

    def offer(self, score: np.ndarray, key: np.ndarray) -> None:
        good = score >= self.least
        score, key = np.concatenate([self.score, score[good]]), np.concatenate([self.key, key[good]])
        order = np.lexsort((key, -score))[:self.k]
        self.score, self.key = score[order], key[order]


class Mining:
    """Answers a tree of anchors over blocks of rows."""

    def __init__(self, key: np.ndarray, label: np.ndarray, x: np.ndarray, exact: bool, positives: int, negatives: int, share: tuple[int, int]) -> None:
        self.key, self.label, self.positives, self.negatives, self.share = key, label, positives, negatives, share
        self.x = x.astype(float) if exact else x
        self.order, self.parent, self.edge = spanning_tree(x)
        self.size = np.sqrt((x.astype(float) ** 2).sum(axis=1)).max(initial=0.0)
        self.near = [Best(positives) for _ in key]
        self.hard: list[list[tuple[int, int, Best]]] = []
        self.scored = 0

    def walk(self, block: Block) -> Iterator[int]:
        """Anchors from the root on, each with its bounds set; at the root all rows are scored."""
        for at in self.order:
            if at == self.order[0]:
                block.score(at, self.x[at], np.arange(len(block.key)))
                self.scored += len(block.key)
            else:
                block.bound(at, self.parent[at], self.edge[at], self.size)
            yield at

    def look(self, block: Block, at: int, rows: np.ndarray) -> np.ndarray:
        self.scored += len(rows)
        return block.score(at, self.x[at], rows)

    def find_positives(self, block: Block) -> None:
        for at in self.walk(block):
            best = self.near[at]
            rows = np.flatnonzero((block.label == self.label[at]) & (block.key != self.key[at]))
            least = best.least
            if len(rows) > self.positives:
                # So many rows surely reach the last of the largest lower bounds.
                least = max(least, np.partition(block.low[at, rows], -self.positives)[-self.positives])
            rows = rows[block.high[at, rows] >= least]
            if len(rows):
                best.offer(self.look(block, at, rows), block.key[rows])

    def set_windows(self) -> None:
        """For each positive of score p the whole numbers n with p <= 2 n and 100 n <= 95 p, or as ``share`` says."""
        low, high = self.share
        self.hard = [[(-(-p * low // 100), p * high // 100, Best(self.negatives)) for p in best.score.tolist()] for best in self.near]

    def find_negatives(self, block: Block) -> None:
        for at in self.walk(block):
            open_ = [w for w in self.hard[at] if w[0] <= w[1]]
            if not open_:
                continue
            bottom, top = min(max(low, best.least) for low, _, best in open_), max(high for _, high, _ in open_)
            rows = np.flatnonzero((block.high[at] >= bottom) & (block.low[at] <= top) & (block.label != self.label[at]) & (block.key != self.key[at]))
            if not len(rows):
                continue
            score = self.look(block, at, rows)
            for low, high, best in open_:
                good = (score >= max(low, best.least)) & (score <= high)
                if good.any():
                    best.offer(score[good], block.key[rows[good]])

    def found(self) -> list[tuple[int, int, int, int, int, int]]:
        return [(anchor, positive, rank, negative, p, n)
                for anchor, best, windows in zip(self.key.tolist(), self.near, self.hard)
                for positive, p, (_, _, hard) in zip(best.key.tolist(), best.score.tolist(), windows)
                for rank, (negative, n) in enumerate(zip(hard.key.tolist(), hard.score.tolist()), 1)]


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
STORED = ["_key", "_label", "_v", "_square"]


def hard_negatives(vectors: DataFrame, anchors: DataFrame, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score`` for the rows of ``anchors``.

    A score is the integer inner product with the anchor; higher ones come first, ties by smaller key.  An anchor's positives are the first ``positives`` other rows of
    its label, and its negatives for each the first ``negatives`` rows of other labels with low <= 100 * negative / positive <= high (percent, whole).  Exact;
    fewer where there are fewer, and none for a positive score below 0.  Keys are whole numbers; rows of the anchor's own key are never found, repeated rows are found as
    often as they occur, and a repeated anchor answers again.  Rows that ``usable`` leaves out take no part; vectors of different length are compared as if
    filled with zeros; scores beyond 64 bits are not supported.

    Neighbouring anchors form trees, and a task answers one tree: it reads the stored rows block by block, scores them at the root, bounds the scores of every
    further anchor by those of its parent, and scores again only rows whose bounds reach into the window that still counts.  A first pass reads
    rows of the anchors' own labels, a second one all rows.
    """
    spark = vectors.sparkSession
    folder = scratch_folder(spark, "labelled_rows")
    rows = usable(vectors, key, vector, label, scale)
    # Rows of one label and like norms lie together, and a common label is spread over many files.
    rows.repartitionByRange("_label", "_square", "_key").sortWithinPartitions("_label", "_square", "_key").write.parquet(folder)
    rows = spark.read.parquet(folder)
    asked = usable(anchors, key, vector, label, scale)
    facts = rows.select(F.size("_v").alias("w"), F.array_max(F.transform("_v", F.abs)).alias("m")).unionByName(
        asked.select(F.size("_v").alias("w"), F.array_max(F.transform("_v", F.abs)).alias("m"))).agg(F.max("w"), F.max("m")).first()
    width, largest = int(facts[0] or 0), int(facts[1] or 0)
    exact = largest * largest * max(width, 1) < 1 << 53
    drawn = asked.orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE).select("_v").collect()
    points = matrix(pa.array([r[0] for r in drawn], pa.list_(pa.int64())), width).astype(float)
    marks = points[np.linspace(0, len(points) - 1, min(LANDMARKS, len(points))).astype(int)]

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest landmark and the distance to it."""
        for batch in batches:
            x = matrix(batch.column("_v"), width).astype(float)
            away = np.stack([((x - m) ** 2).sum(axis=1) for m in marks], axis=1) if len(marks) else np.zeros((len(x), 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in STORED), pa.array(away.argmin(axis=1).astype(np.int64)), pa.array(away.min(axis=1))],
                                             names=[*STORED, "_mark", "_away"])
    placed_folder = scratch_folder(spark, "anchors")
    asked.mapInArrow(beside, "_key long, _label long, _v array<long>, _square double, _mark long, _away double").write.parquet(placed_folder)
    placed = spark.read.parquet(placed_folder)

    def stored(labels: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        table = pyarrow.dataset.dataset(path, filesystem=store, format="parquet")
        wanted = None if labels is None else pc.field("_label").isin(labels.tolist())
        yield from table.to_batches(columns=STORED, filter=wanted, batch_size=ROWS, batch_readahead=1, fragment_readahead=1, use_threads=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), TREE):
                part = batch.slice(first, TREE)
                own = part.column("_label").to_numpy()
                mining = Mining(part.column("_key").to_numpy(), own, matrix(part.column("_v"), width), exact, positives, negatives, (low, high))
                for block in stored(np.unique(own)):
                    if len(block):
                        mining.find_positives(Block(block, width, exact, len(part)))
                mining.set_windows()
                for block in stored():
                    if len(block):
                        mining.find_negatives(Block(block, width, exact, len(part)))
                schema = fixed_schema(RESULT)
                found = mining.found()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)] if found else [pa.array([], f.type) for f in schema], schema=schema)
    # Anchors are few bytes and much work: their number, not their size, decides the number of tasks.
    tasks = max(1, -(-placed.count() // TREE))
    return placed.repartitionByRange(tasks, "_label", "_mark", "_away", "_key").sortWithinPartitions("_label", "_mark", "_away", "_key").mapInArrow(run, RESULT)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS same,
    list_sum(list_transform(range(1, len(v.e) + 1), lambda i: a.e[i] * v.e[i]))::BIGINT AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""
