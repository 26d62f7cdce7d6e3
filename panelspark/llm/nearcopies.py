"""One text of every neighbourhood of near copies: min-hash buckets, bit-sliced SimHash comparison, exact shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import CHUNK_BYTES, column_like, cut_lineage, fixed_schema, mix64, utf8
from panelspark.llm.simhash import _lanes, _spare, majority, planes, shingle_hashes, within

#: Buckets of a text, and least hashes that must agree in one: at similarity 0.8 a pair shares a bucket with probability 0.998.
BANDS, ROWS = 16, 5
#: Fingerprint bits that may differ: sets of similarity 0.8 differ in 9.7 of 64 on average, with a deviation of 2.9.
RADIUS = 20
#: Leaders of a bucket that a round looks at; the number doubles from one on and stays here.
LEADERS = 256
#: Pairs compared in one block of lanes.
LANES = 1 << 15

_random = np.random.default_rng(8)
_FLIP = _random.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_TIMES = _random.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(raw: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of concatenated texts, sorted inside each, and their number per text."""
    found, counts = shingle_hashes(raw, ends, words)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[fresh], np.bincount(owner[fresh], minlength=len(counts))


def _least(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A key per text with shingles and band, from the least of its hashes under ``ROWS`` functions."""
    full = counts > 0
    edge = (np.cumsum(counts) - counts)[full]
    keys = np.zeros((int(full.sum()), BANDS), np.uint64)
    turned = np.empty_like(found)
    for i in range(BANDS * ROWS):
        np.multiply(np.bitwise_xor(found, _FLIP[i], out=turned), _TIMES[i], out=turned)
        least = np.minimum.reduceat(turned, edge) if len(edge) else np.zeros(0, np.uint64)
        keys[:, i // ROWS] = mix64(keys[:, i // ROWS] + least + np.uint64(i + 1))
    return keys


def _slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    raw, ends = utf8(column)
    at = 0
    while at < len(column):
        to = int(np.clip(np.searchsorted(ends, ends[at] + CHUNK_BYTES, side="right") - 1, at + 1, len(column)))
        yield raw[ends[at]:ends[to]], ends[at:to + 1] - ends[at]
        at = to


def described(text: Column, words: int) -> Column:
    """``node`` (a hash of the set of shingles, 0 if empty), ``fp`` (SimHash of the set), ``n`` (its size) and ``keys`` (its buckets)."""
    @F.arrow_udf("struct<node: long, fp: long, n: long, keys: array<long>>")
    def compute(column: pa.Array) -> pa.Array:
        nodes, prints, sizes, keys = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for raw, ends in _slices(column):
            found, counts = shingle_sets(raw, ends, words)
            stop = np.cumsum(counts)
            nodes += [xxhash.xxh64_intdigest(found[e - k:e].tobytes(), 42) if k else 0 for e, k in zip(stop.tolist(), counts.tolist())]
            prints.append(majority(found, counts))
            sizes.append(counts.astype(np.int64))
            keys.append(_least(found, counts).ravel())
        size = np.concatenate(sizes)
        ends = np.r_[0, np.cumsum(np.where(size > 0, BANDS, 0))].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))
        return pa.StructArray.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(np.concatenate(prints).view(np.int64)), pa.array(size), lists],
                                          ["node", "fp", "n", "keys"])
    return compute(text)


def _set_of(text: Column, words: int) -> Column:
    @F.arrow_udf("array<long>")
    def compute(column: pa.Array) -> pa.Array:
        found, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for raw, ends in _slices(column):
            part, size = shingle_sets(raw, ends, words)
            found.append(part)
            counts.append(size)
        ends = np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
    return compute(text)


def _close(radius: int):
    """Arrow batches of (node, fp, leader, lfp) to the pairs at ``radius`` bits or fewer."""
    schema = fixed_schema("node long, leader long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), LANES):
                part = batch.slice(at, LANES)
                node, mine, leader, other = (part.column(i).to_numpy() for i in range(4))
                near = _lanes(within(planes(mine.view(np.uint64)), planes(other.view(np.uint64)), _spare(len(mine)), radius), len(mine))
                yield pa.RecordBatch.from_arrays([pa.array(node[near]), pa.array(leader[near])], schema=schema)
    return run


def removed_nodes(buckets: DataFrame, sets: DataFrame, similarity: float, radius: int = RADIUS) -> DataFrame:
    """Nodes of ``buckets`` (``key``, ``node``, ``fp``, ``n``) that go because a lesser node that stays is similar.

    Nodes are taken in the order of their ids, which are hashes, so chains of near copies have no long order.  A round takes the least nodes of every bucket
    as its leaders.  A node that leads in all its buckets is ready: all lesser nodes it could be similar to are leaders as well.  Pairs of a node and a lesser leader, one
    of them ready, are compared by fingerprints and then by their shingle ``sets`` (``node``, ``grams``).  A ready node without a
    similar lesser one stays, nodes similar to one that stays go, and both leave their buckets.  The least node left is always
    ready, so this ends with no pair left out.  A bucket of copies needs one leader; one of texts that only resemble each other needs more, so
    the number of leaders doubles by the round.  Rounds are stored tables; only whether anything is left reaches the driver.
    """
    left, gone, leaders = buckets, [], 1
    while not left.isEmpty():
        place = F.row_number().over(Window.partitionBy("key").orderBy("node"))
        # A filter on a row number is applied before the shuffle as well, so a hot bucket sends few rows.
        lead = cut_lineage(left.select("key", "node", "fp", "n", place.alias("_place")).where(F.col("_place") <= leaders).drop("_place"), "leaders")
        everywhere = left.groupBy("node").agg(F.count(F.lit(1)).alias("all"))
        ready = cut_lineage(lead.groupBy("node").agg(F.count(F.lit(1)).alias("times")).join(everywhere, "node").where("times = all").select("node"), "ready")
        marked = lead.join(ready.withColumn("ready", F.lit(True)), "node", "left")
        other = cut_lineage(marked.select("key", F.col("node").alias("leader"), F.col("fp").alias("lfp"), F.col("n").alias("ln"), F.coalesce("ready", F.lit(False)).alias("lready")), "marked_leaders")
        both = left.join(other, "key").where((F.col("leader") < F.col("node")) & (F.least("n", "ln") >= similarity * F.greatest("n", "ln")))
        waiting = both.where("lready").select("node", "fp", "leader", "lfp").unionByName(
            both.where("NOT lready").join(ready, "node", "left_semi").select("node", "fp", "leader", "lfp")).distinct()
        near = cut_lineage(waiting.mapInArrow(_close(radius), "node long, leader long"), "near_pairs")
        wanted = sets.join(near.select(F.col("leader").alias("node")).distinct(), "node", "left_semi")
        met = near.join(sets, "node").withColumnRenamed("grams", "mine").join(wanted.select(F.col("node").alias("leader"), F.col("grams").alias("other")), "leader")
        shared = F.size(F.array_intersect("mine", "other"))
        similar = cut_lineage(met.where(shared >= similarity * (F.size("mine") + F.size("other") - shared)).select("node", "leader"), "similar_pairs")
        stays = cut_lineage(ready.join(similar, "node", "left_anti"), "staying")
        goes = cut_lineage(similar.join(stays.withColumnRenamed("node", "leader"), "leader", "left_semi").select("node").distinct(), "going")
        gone.append(goes)
        decided = stays.unionByName(goes)
        left = cut_lineage(left.join(decided, "node", "left_anti"), "buckets_left")
        sets = cut_lineage(sets.join(decided, "node", "left_anti"), "sets_left")
        leaders = min(2 * leaders, LEADERS)
    out = buckets.select("node").limit(0)
    for goes in gone:
        out = out.unionByName(goes)
    return out


def keep_dissimilar(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs`` of which no two are near copies; every row that goes is a near copy of one that stays.

    Near copies have sets of ``words``-word shingles (A-Z lower-cased, single spaces; fewer words: the whole sequence) of Jaccard similarity
    ``similarity`` or more.  Texts of equal sets are one node, of which the row of least key stays (NULL keys last), then of least text hash, then any of equal rows; texts
    without words, NULL included, are one node.  Of different sets the one of least hash stays.

    Sets that share a min-hash bucket are compared: ``BANDS`` buckets of ``ROWS`` hashes find a pair of similarity 0.8 with probability
    0.998, more alike ones more surely, and the radius of the fingerprints loses 0.0002.  Every pair found is verified on the sets, so unlike texts are
    never taken for copies (64-bit hashes of shingles, sets and texts count as equal if they are).  An empty table gives an empty table.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    name, body = column_like(docs, key).alias("_key"), column_like(docs, text)
    same = F.xxhash64(body.isNull(), body).alias("_text")
    rows = cut_lineage(docs.select(name, same, described(body, words).alias("d")).select("_key", "_text", "d.*"), "described")
    order = F.struct(F.col("_key").isNull().alias("last"), F.col("_key").alias("key"), F.col("_text").alias("text"))
    nodes = cut_lineage(rows.groupBy("node").agg(F.min(order).alias("first"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("keys").alias("keys")), "nodes")
    dealt = nodes.select(F.posexplode("keys").alias("band", "least"), "node", "fp", "n").select(F.xxhash64("band", "least").alias("key"), "node", "fp", "n")
    shared = dealt.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key")
    buckets = cut_lineage(dealt.join(cut_lineage(shared, "shared_buckets"), "key", "left_semi"), "buckets")
    # The set of a node is taken from the text that represents it; only texts that share a bucket are read again.
    chosen = cut_lineage(nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.col("first.key").alias("_k"), F.col("first.text").alias("_t")), "candidates")
    again = docs.select(name, same, body.alias("_body")).join(chosen, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_text") == F.col("_t")))
    sets = cut_lineage(again.select("node", _set_of(F.col("_body"), words).alias("grams")).dropDuplicates(["node"]), "shingle_sets")
    gone = removed_nodes(buckets, sets, similarity)
    kept = cut_lineage(nodes.join(gone, "node", "left_anti").select(F.col("first.key").alias("_kept_key"), F.col("first.text").alias("_kept_text")), "kept")
    whole = docs.select(F.struct(*[column_like(docs, c) for c in docs.columns]).alias("_row"), name, same)
    found = whole.join(kept, F.col("_key").eqNullSafe(F.col("_kept_key")) & (F.col("_text") == F.col("_kept_text")), "left_semi")
    return found.dropDuplicates(["_key", "_text"]).select("_row.*")
