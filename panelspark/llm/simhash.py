"""SimHash near-dedup with bit-sliced comparison of the candidates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import column_like, cut_lineage, fixed_schema, lower_ascii, utf8, words_in, CHUNK_BYTES, SPACE
from panelspark.llm.graph import components

#: Widths of the six blocks of a fingerprint; two fingerprints at 4 bits or fewer agree in two blocks at least.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Members of a bucket that one task compares with each other or with as many others.
TILE = 2048
#: Buckets up to this size are compared side by side in one block of lanes.
SMALL = 8
#: Lanes of such a block, and shingles whose bits are counted at once.
LANES, COUNTED = 1 << 15, 1 << 17


def shingle_hashes(raw: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of concatenated texts, and the number of shingles of each text."""
    first, last, counts = words_in(raw, ends)
    low, solid = lower_ascii(raw), ~SPACE[raw]
    keep = solid.copy()
    follow = last[last < len(raw)]
    keep[follow] = True
    place = np.cumsum(keep)
    text = np.where(solid, low, np.uint8(32))[keep].tobytes()
    begin, stop = place[first] - 1, place[last - 1]
    inside = np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
    size = np.minimum(np.repeat(counts, counts), words)
    start = np.flatnonzero(inside <= np.repeat(counts, counts) - size)
    lo, hi = begin[start], stop[start + size[start] - 1]
    digest = xxhash.xxh64_intdigest
    found = np.fromiter((digest(text[s:e], 42) for s, e in zip(lo.tolist(), hi.tolist())), np.uint64, len(lo))
    return found, np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each text from its shingle hashes: a bit is set if over half of them have it."""
    sums = np.zeros((len(counts), 64), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(hashes), COUNTED):
        part, who = hashes[at:at + COUNTED], owner[at:at + COUNTED]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.flatnonzero(np.diff(who, prepend=-1))
        sums[who[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(text: Column, words: int = 4) -> Column:
    """64-bit SimHash of a text column as a signed long; 0 for texts without words and for NULL.

    A-Z is lower-cased, words are joined by single spaces to shingles of ``words`` words, repeats included; a
    text with fewer words is one shingle.
    """
    @F.arrow_udf("long")
    def compute(column: pa.Array) -> pa.Array:
        raw, ends = utf8(column)
        out, at = [np.zeros(0, np.uint64)], 0
        while at < len(column):
            to = int(np.clip(np.searchsorted(ends, ends[at] + CHUNK_BYTES, side="right") - 1, at + 1, len(column)))
            out.append(majority(*shingle_hashes(raw[ends[at]:ends[to]], ends[at:to + 1] - ends[at], words)))
            at = to
        return pa.array(np.concatenate(out).view(np.int64))
    return compute(text)


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of every fingerprint, 64 lanes to a word; lanes beyond the last are 0."""
    bits = np.zeros((-(-len(prints) // 64) * 64, 64), np.uint8)
    bits[:len(prints)] = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry of three bits in every lane."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def within(left: np.ndarray, right: np.ndarray, dead: np.ndarray, radius: int) -> np.ndarray:
    """Lanes (as bits) whose fingerprints differ in ``radius`` bits or fewer; radius at most 63.

    ``left`` and ``right`` are planes that broadcast against each other.  Differences are counted in three
    bit-sliced counters (more for a radius above 7), four planes at a time; the block is abandoned once every lane is beyond the radius.
    """
    over = dead.copy()
    counters = [np.zeros_like(over) for _ in range(max(3, radius.bit_length()))]
    far = over
    for b in range(0, 64, 4):
        x = [left[b + j] ^ right[b + j] for j in range(4)]
        counters[0], t = _add(counters[0], x[0], x[1])
        counters[0], u = _add(counters[0], x[2], x[3])
        counters[1], carry = _add(counters[1], t, u)
        for c in range(2, len(counters)):
            counters[c], carry = counters[c] ^ carry, counters[c] & carry
        over |= carry
        if b % 8 == 4:
            above, equal = np.zeros_like(over), ~np.zeros_like(over)
            for c in reversed(range(len(counters))):
                if radius >> c & 1:
                    equal = equal & counters[c]
                else:
                    above, equal = above | (equal & counters[c]), equal & ~counters[c]
            far = over | above
            if bool(np.all(far == ~np.uint64(0))):
                break
    return ~far


def _lanes(bits: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bits.view(np.uint8), bitorder="little")[:n].astype(bool)


def link_small(prints: np.ndarray, start: np.ndarray, length: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links inside many small buckets at once: in round r every lane meets the r-th member of its bucket."""
    links = []
    order = np.argsort(length, kind="stable")
    start, length = start[order], length[order]
    lanes_before = np.cumsum(length) - length
    for block in range(int(lanes_before[-1] // LANES) + 1 if len(length) else 0):
        pick = (lanes_before // LANES) == block
        s, k = start[pick], length[pick]
        if not len(s):
            continue
        base = np.repeat(s, k)
        inside = np.arange(len(base)) - np.repeat(np.cumsum(k) - k, k)
        room = np.repeat(k, k)
        for r in range(int(k.max()) - 1):
            use = (room > r + 1) & (inside > r)
            lane, query = (base + inside)[use], (base + r)[use]
            mine = planes(prints[lane])
            near = _lanes(within(mine, planes(prints[query]), _spare(len(lane)), radius), len(lane))
            links.append((prints[query[near]], prints[lane[near]]))
    return links


def _spare(n: int) -> np.ndarray:
    """Lanes of the last word that hold nothing, as bits."""
    out = np.zeros(-(-n // 64) * 64, np.uint8)
    out[n:] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def link_large(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the members of one bucket as all its close pairs would, one per member at most."""
    n = len(prints)
    stored, spare = planes(prints), _spare(n)
    label = np.arange(n)
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.astype(np.uint64) * ~np.uint64(0)
    for at in range(0, n, 64):
        queries = bits[:, at:at + 64, None]
        hits = within(stored[:, None, :], queries, np.repeat(spare[None], queries.shape[1], 0), radius)
        for j in np.flatnonzero((hits != 0).any(axis=1)):
            met = label[_lanes(hits[j], n)]
            least = met.min()
            if met.max() != least:
                label[np.isin(label, met)] = least
    child = np.flatnonzero(label != np.arange(n))
    return prints[label[child]], prints[child]


def _link_runs(radius: int):
    """Arrow batches of (key, tile, fp), sorted by bucket, to links between different fingerprints."""
    schema = fixed_schema("a long, b long")

    def solve(key: np.ndarray, tile: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]) if len(key) else np.zeros(0, np.int64)
        length = np.diff(np.r_[edge, len(key)])
        few = (length > 1) & (length <= SMALL)
        found = link_small(prints, edge[few], length[few], radius)
        found += [link_large(prints[s:s + k], radius) for s, k in zip(edge[length > SMALL], length[length > SMALL])]
        a, b = (np.concatenate([x[i] for x in found] + [np.zeros(0, np.uint64)]).view(np.int64) for i in (0, 1))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)]
        for batch in batches:
            new = [batch.column(i).to_numpy() for i in range(3)]
            new[2] = new[2].view(np.uint64)
            key, tile, prints = (np.concatenate(x) for x in zip(rest, new))
            # The last bucket may go on in the next batch; a bucket has two tiles of members at most.
            cut = int(np.flatnonzero((key != key[-1]) | (tile != tile[-1]))[-1]) + 1 if len(key) and (key[0] != key[-1] or tile[0] != tile[-1]) else 0
            if cut:
                yield solve(key[:cut], tile[:cut], prints[:cut])
            rest = [key[cut:], tile[cut:], prints[cut:]]
        yield solve(*rest)
    return run


def close_links(prints: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Links ``a``, ``b`` between the distinct fingerprints in column ``fp`` that join the same groups as all pairs
    at ``radius`` bits or fewer (at most 4) would.

    Fingerprints meet in the buckets of every two of six blocks of bits.  A bucket above ``tile``
    members is split into tiles, and each pair of tiles is a task of its own, so a hot bucket spreads out and
    nothing is capped; a task writes one link per member at most.
    """
    if not 0 <= radius <= 4:
        raise ValueError("two equal blocks of six are only certain up to 4 differing bits")
    shifts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]

    def part(i: int) -> Column:
        return F.shiftright("fp", shifts[i]).bitwiseAND(F.lit((1 << BLOCKS[i]) - 1))

    keys = [F.shiftleft(part(i), BLOCKS[j]).bitwiseOR(part(j)) + F.lit(t << 24) for t, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = cut_lineage(rows.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles")), "large_buckets")
    split = rows.join(large, "key", "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    others = F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
    met = split.withColumn("mine", F.coalesce(mine, F.lit(0))).withColumn("other", F.explode(others))
    dealt = met.select("key", (F.least("mine", "other").cast("long") * F.lit(1 << 31) + F.greatest("mine", "other")).alias("tile"), "fp")
    return dealt.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(_link_runs(radius), "a long, b long")


def grouped(prints: DataFrame, radius: int) -> DataFrame:
    """``fp``, ``label`` (the least fingerprint it reaches) and ``component_id`` (the least key) of the fingerprints in ``prints`` (``_key``, ``fp``)."""
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("_key").alias("least")), "distinct_fingerprints")
    labels = components(close_links(nodes.select("fp"), radius))
    named = cut_lineage(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled")
    ids = cut_lineage(named.groupBy("label").agg(F.min("least").alias("component_id")), "component_ids")
    return cut_lineage(named.select("fp", "label").join(ids, "label").select("fp", "label", "component_id"), "components")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` for every row.

    Fingerprints at ``radius`` differing bits or fewer are linked, and a component is what such links reach; its id is its
    least key, itself included.  Equal fingerprints are one node, so copies cost one row each.  NULL and empty texts
    have fingerprint zero, linked like any other.  Rows with a NULL key take part; a component of only such
    rows has a NULL id.  Equal rows stay separate rows; an empty table gives an empty table.
    """
    prints = cut_lineage(docs.select(column_like(docs, key).alias("_key"), fingerprint(column_like(docs, text), words).alias("fp")), "fingerprints")
    by_print = grouped(prints, radius).select("fp", "component_id")
    return prints.join(by_print, "fp").select(F.col("_key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """The row of the least key of every component, with all columns of ``docs``.

    Of rows that share that key the one of least fingerprint stays, then of least text hash, then any of equal rows; a key whose texts are in
    several components can stay in each.  A component of rows with NULL keys only keeps one row of each
    fingerprint; beside keyed rows NULL keys go.  Texts of equal 64-bit hash count as equal.
    """
    name, body = column_like(docs, key).alias("_key"), column_like(docs, text)
    same = F.xxhash64(body.isNull(), body).alias("_text")
    prints = cut_lineage(docs.select(name, fingerprint(body, words).alias("fp"), same), "fingerprints")
    members = prints.join(grouped(prints, radius), "fp")
    first = members.where("_key IS NOT NULL").groupBy("label").agg(F.min(F.struct("_key", "fp", "_text")).alias("m")).select("m._key", "m._text")
    loose = members.where("component_id IS NULL").groupBy("fp").agg(F.max("_key").alias("_key"), F.min("_text").alias("_text")).select("_key", "_text")
    chosen = cut_lineage(first.unionByName(loose), "kept").select(F.col("_key").alias("_kept_key"), F.col("_text").alias("_kept_text"))
    rows = docs.select(F.struct(*[column_like(docs, c) for c in docs.columns]).alias("_row"), name, same)
    kept = rows.join(chosen, F.col("_key").eqNullSafe(F.col("_kept_key")) & (F.col("_text") == F.col("_kept_text")), "left_semi")
    return kept.dropDuplicates(["_key", "_text"]).select("_row.*")
