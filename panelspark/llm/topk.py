"""Exact top-k search by integer inner product with a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import column_like, cut_lineage, fixed_schema, scratch_folder
from panelspark.llm.files import mapped, pack, write_file

#: Pivots, and the rows (the first by a hash of their id) that they are fitted on; every row is indexed.
PIVOTS, PIVOT_SAMPLE = 64, 4096
#: Rows of an annulus that are scored at once, and queries that a task answers at once.
ANNULUS, QUERIES = 1024, 256


def scaled(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``_key`` and integer vector ``_v`` (floor of scale times each component) of the rows that take part.

    Rows without a key, NULL vectors and vectors with a NULL, NaN or infinite component take no part.
    """
    x = column_like(vectors, vector)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.where(column_like(vectors, key).isNotNull() & x.isNotNull() & whole)
            .select(column_like(vectors, key).alias("_key"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("_v")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    values, size = column.flatten().to_numpy().astype(np.int64), column.value_lengths().to_numpy()
    if len(size) and (size == width).all():
        return values.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


@dataclass
class Space:
    """Pivots in the space where inner product order is distance order.

    A row x is moved to (x, sqrt(M^2 - |x|^2)) with M the largest norm, a query q to (q, 0); then
    |q - x|^2 = |q|^2 + M^2 - 2 qx, so the nearest rows are those of largest product.
    """

    pivots: np.ndarray
    most: float  # M^2
    width: int
    exact: bool  # products fit the 53 bits of a double

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.c_[x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))]

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x.astype(float), np.zeros(len(x))]

    def distances(self, moved: np.ndarray) -> np.ndarray:
        square = (moved * moved).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * moved @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def products(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.exact:
            return (q.astype(float) @ x.astype(float).T).astype(np.int64)
        return q.astype(np.int64) @ x.astype(np.int64).T

    @property
    def slack(self) -> float:
        """Above the rounding errors of squared distances, so no row is lost to them."""
        return 1e-9 * (1 + 4 * self.most)


def fit_space(rows: DataFrame, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> Space:
    """Norm bound and width from all rows, pivots by a few k-means rounds over a bounded sample."""
    squares = F.aggregate("_v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    largest = F.array_max(F.transform("_v", F.abs))
    facts = rows.agg(F.max(squares), F.max(F.size("_v")), F.max(largest)).first()
    most, width, top = float(facts[0] or 0.0), int(facts[1] or 0), int(facts[2] or 0)
    space = Space(np.zeros((1, width + 1)), most, width, top * top * max(width, 1) < 1 << 53)
    drawn = rows.orderBy(F.xxhash64("_key"), "_key").limit(sample).collect()
    if drawn:
        points = space.rows(_matrix(pa.array([r["_v"] for r in drawn], pa.list_(pa.int64())), width))
        centres = np.unique(points, axis=0)
        centres = centres[np.linspace(0, len(centres) - 1, min(pivots, len(centres))).astype(int)]
        for _ in range(4):
            space.pivots = centres
            near = space.distances(points).argmin(axis=1)
            size = np.bincount(near, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, near, points)
            centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
        space.pivots = centres
    return space


PLACED = "_key long, pivot int, distance double, _v array<long>"


def place(rows: DataFrame, space: Space, queries: bool = False) -> DataFrame:
    """Rows with their nearest pivot and the distance to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("_v"), space.width)
            away = space.distances(space.queries(x) if queries else space.rows(x))
            near = away.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(x)), near]), batch.column("_v")],
                                             schema=fixed_schema(PLACED))
    return rows.mapInArrow(run, PLACED)


SEGMENTS = "file string, pivot int, first int, last int, nearest double, farthest double"


def build(rows: DataFrame, space: Space) -> tuple[str, list[tuple]]:
    """The index: files of rows in the order (pivot, distance, key), range-partitioned, so neither a crowded pivot nor a
    very common vector stays in one task.  Returns the folder and one line per file and pivot."""
    folder = scratch_folder(rows.sparkSession, "pivot_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3), space.width)) for b in batches if len(b)]
        if not parts:
            return
        key, pivot, distance, x = (np.concatenate(p) for p in zip(*parts))
        small = np.abs(x).max(initial=0) < 1 << 15
        name = write_file(folder, "annuli", pack({"key": key, "distance": distance, "x": x.astype(np.int16 if small else np.int64).ravel()}, {}))
        edge = np.flatnonzero(np.diff(pivot, prepend=-1))
        last = np.r_[edge[1:], len(pivot)]
        columns = [[name] * len(edge), pivot[edge], edge, last, distance[edge], distance[last - 1]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fixed_schema(SEGMENTS))], schema=fixed_schema(SEGMENTS))
    placed = cut_lineage(place(rows, space), "placed")
    dealt = placed.repartitionByRange("pivot", "distance", "_key").sortWithinPartitions("pivot", "distance", "_key")
    return folder, [tuple(r) for r in cut_lineage(dealt.mapInArrow(run, SEGMENTS), "segments").collect()]


def _best(query: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of every query: largest score, then least key."""
    order = np.lexsort((key, -score, query))
    query, score, key = query[order], score[order], key[order]
    edge = np.flatnonzero(np.diff(query, prepend=-1))
    rank = np.arange(len(query)) - np.repeat(edge, np.diff(np.r_[edge, len(query)]))
    keep = rank < k
    return query[keep], score[keep], key[keep]


def answer(space: Space, opened: dict, segments: list[tuple], key: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best rows of a block of queries.

    Segments are taken by how near their annulus comes to any of the queries; inside one, annuli of rows expand from the
    queries' own distance.  A row at distance d of a pivot is at least |d - d(query, pivot)| from the query, so once that exceeds the distance that the
    k-th best product stands for, the rest of the segment, and at last of the index, is left.
    """
    n = len(key)
    away = space.distances(space.queries(x))
    norm = (x.astype(float) ** 2).sum(axis=1)
    least, least_key = np.full(n, np.iinfo(np.int64).min), np.full(n, np.iinfo(np.int64).max)
    have = [np.zeros(0, np.int64)] * 3

    def reach() -> np.ndarray:
        """Largest distance at which a row can still matter, for each query."""
        open_end = least == np.iinfo(np.int64).min
        square = np.maximum(norm + space.most - 2.0 * least, 0) + space.slack
        return np.where(open_end, np.inf, np.sqrt(square))

    def gaps(pivot: int, low: np.ndarray, top: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(away[:, pivot][:, None] - top, low - away[:, pivot][:, None]), 0)

    ahead = [(gaps(s[1], np.array([s[4]]), np.array([s[5]])).min(), s) for s in segments]
    for nearest, (file, pivot, first, last, _, _) in sorted(ahead, key=lambda a: a[0]):
        if nearest > reach().max():
            break
        arrays = opened[file]
        cuts = np.arange(first, last, ANNULUS)
        ends = np.minimum(cuts + ANNULUS, last)
        gap = gaps(pivot, arrays["distance"][cuts], arrays["distance"][ends - 1])
        for b in np.argsort(gap.min(axis=0), kind="stable"):
            radius = reach()
            if gap[:, b].min() > radius.max():
                break
            active = np.flatnonzero(gap[:, b] <= radius)
            if not len(active):
                continue
            rows = slice(cuts[b], ends[b])
            names = arrays["key"][rows]
            score = space.products(x[active], arrays["x"].reshape(-1, space.width)[rows])
            floor, name = least[active][:, None], least_key[active][:, None]
            q, r = np.nonzero(((score > floor) | ((score == floor) & (names < name))) & (names != key[active][:, None]))
            if not len(q):
                continue
            have = list(_best(*(np.concatenate(p) for p in zip(have, (active[q], score[q, r], names[r]))), k))
            full = np.bincount(have[0], minlength=n) == k
            end = np.searchsorted(have[0], np.flatnonzero(full), side="right") - 1
            least[full], least_key[full] = have[1][end], have[2][end]
    return have[0], have[1], have[2]


RESULT = "query_id long, rank int, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, *, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: the ``k`` rows of ``vectors`` of largest inner product for each row of ``queries``.

    Exact, with ties to the smaller key; all rows if there are fewer.  A query never finds rows of its own key.  Rows that ``scaled`` leaves
    out are neither queries nor found; vectors of different length are compared as if filled with zeros; repeated rows are
    found as often as they occur, and a repeated query answers each time.  Tasks are blocks of neighbouring queries that map
    the index files; nothing is shuffled between queries and rows.
    """
    rows = scaled(vectors, key, vector, scale)
    asked = scaled(queries, key, vector, scale)
    space = fit_space(rows.unionByName(asked.select("_key", "_v")))
    folder, segments = build(rows, space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {}
        for batch in batches:
            for at in range(0, len(batch), QUERIES):
                part = batch.slice(at, QUERIES)
                for name in {s[0] for s in segments} - set(opened):
                    opened[name] = mapped(folder, name)[0]
                name = part.column("_key").to_numpy()
                # Repeated keys stay apart while answering.
                q, score, found = answer(space, opened, segments, name, _matrix(part.column("_v"), space.width), k)
                edge = np.flatnonzero(np.diff(q, prepend=-1))
                rank = np.arange(len(q)) - np.repeat(edge, np.diff(np.r_[edge, len(q)])) + 1
                yield pa.RecordBatch.from_arrays([pa.array(name[q]), pa.array(rank.astype(np.int32)), pa.array(found), pa.array(score)], schema=fixed_schema(RESULT))
    near = cut_lineage(place(asked, space, queries=True), "placed_queries")
    # Queries are few bytes and much work: their number, not their size, decides the number of tasks.
    tasks = max(1, -(-near.count() // QUERIES))
    dealt = near.repartitionByRange(tasks, "pivot", "distance", "_key")
    return dealt.sortWithinPartitions("pivot", "distance", "_key").mapInArrow(run, RESULT)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_sum(list_transform(range(1, len(qe) + 1), lambda i: qe[i] * e[i]))::BIGINT AS score FROM q JOIN v ON vec_id <> query_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
