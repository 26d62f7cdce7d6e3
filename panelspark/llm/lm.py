"""Language-model scoring with an n-gram trie of Elias-Fano levels.

Level 1 has the words in the order of their hashes; a word's rank is its id.  Level 2 has, for each context word, the ids of the
words that follow it.  Both levels are files of consecutive id ranges in the shared folder, which every task maps.
The order is two: a third level would go beyond the CPU budget of the check (see README).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import chunks, column_like, cut_lineage, fixed_schema, lower_ascii, scratch_folder, utf8, word_hashes, words_in
from panelspark.llm.eliasfano import EliasFano, encode
from panelspark.llm.files import mapped, pack, write_file

#: The end of a text as a token; no word has this hash but by a 64-bit accident.
END = np.uint64(0x5E2D58D8B3BCDEE8)
#: Bigram tokens per file of level 2.
FILE_TOKENS = 1 << 20
#: Smallest stored log10 and the step between codes of one byte.
FLOOR, STEP = -10.2, 0.04
#: Text that is counted or scored at once: the larger, the fewer of its words and pairs are looked up again, and the fewer blocks meet each file.
BLOCK_BYTES = 4 << 20
#: Distinct pairs a task holds before it hands them on.
HELD = 1 << 22


def tokens(part: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and the number of tokens of each text."""
    raw, ends = utf8(part.column(text))
    raw = lower_ascii(raw)
    first, last, counts = words_in(raw, ends)
    out = np.full(len(first) + len(counts), END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = word_hashes(raw, first, last)
    return out, counts + 1


def _signed(x: np.ndarray) -> np.ndarray:
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64) ^ np.uint64(1 << 63)


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        return np.unique(keys, return_counts=True)
    found, where = np.unique(keys, return_inverse=True)
    return found, np.bincount(where, weights, len(found)).astype(np.int64)


COUNTS = "key long, n long"


def _batch(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + (1 << 18)]), pa.array(n[at:at + (1 << 18)])], schema=fixed_schema(COUNTS))


class _Tally:
    """Counts of a task, merged before they leave it."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(_counted(keys))
        self.held += len(self.parts[-1][0])
        if self.held > HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield from _batch(*_counted(*(np.concatenate(x) for x in zip(*self.parts))))
        self.parts, self.held = [], 0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally()
    for batch in batches:
        for part in chunks(batch, "text", BLOCK_BYTES):
            yield from tally.add(_signed(tokens(part, "text")[0]))
    yield from tally.flush()


FILES = "file string, first long, last long, n long, tokens long, head long, tail long"


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and sums of a partition that arrives sorted by key."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, n = (np.concatenate(x) for x in zip(*parts))
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[edge], np.add.reduceat(n, edge) if len(key) else n


def _write_words(folder: str):
    """A sorted partition of word counts as a file: hashes and running counts, both Elias-Fano."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = _sorted_runs(batches)
        if not len(key):
            return
        hashes = _unsigned(key)
        total = np.r_[0, np.cumsum(n)].astype(np.uint64)
        parts = {f"hash_{k}": v for k, v in encode(hashes - hashes[0]).items()} | {f"count_{k}": v for k, v in encode(total).items()}
        name = write_file(folder, "words", pack(parts, {"first": int(hashes[0])}))
        row = [name, int(key[0]), int(key[-1]), len(key), int(total[-1]), 0, 0]
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, fixed_schema(FILES))], schema=fixed_schema(FILES))
    return run


@dataclass
class Words:
    """Level 1: ids and counts of words."""

    folder: str
    files: list[tuple[str, int, int, int]]  # name, first key, words, tokens

    def open(self) -> Words:
        self.first = _unsigned(np.array([f[1] for f in self.files], np.int64)) if self.files else np.zeros(0, np.uint64)
        self.base = np.r_[0, np.cumsum([f[2] for f in self.files])].astype(np.int64)
        self.levels = []
        for name, *_ in self.files:
            arrays, _ = mapped(self.folder, name)
            self.levels.append(tuple(EliasFano({k[len(p) + 1:]: v for k, v in arrays.items() if k.startswith(p)}) for p in ("hash", "count")))
        return self

    @property
    def size(self) -> int:
        return sum(f[2] for f in self.files)

    @property
    def tokens(self) -> int:
        return sum(f[3] for f in self.files)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Id of each of some sorted hashes, -1 for unknown words."""
        out = np.full(len(hashes), -1, np.int64)
        bounds = np.searchsorted(hashes, self.first)
        for k, (begin, end) in enumerate(zip(bounds, np.r_[bounds[1:], len(hashes)])):
            if begin < end:
                level, goal = self.levels[k][0], hashes[begin:end] - self.first[k]
                at = level.successor(goal)
                hit = at < len(level)
                hit[hit] = level.access(at[hit]) == goal[hit]
                out[begin:end][hit] = at[hit] + self.base[k]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Count of each of some sorted ids; 0 for -1."""
        out = np.zeros(len(ids), np.int64)
        bounds = np.searchsorted(ids, self.base)
        for k, level in enumerate(self.levels):
            begin, end = bounds[k], bounds[k + 1]
            if begin < end:
                at = ids[begin:end] - self.base[k]
                out[begin:end] = (level[1].access(at + 1) - level[1].access(at)).astype(np.int64)
        return out

    def before(self, ids: np.ndarray) -> np.ndarray:
        """Tokens of all words of smaller id, for sorted ids."""
        out = np.zeros(len(ids), np.int64)
        tokens_before = np.r_[0, np.cumsum([f[3] for f in self.files])]
        bounds = np.searchsorted(ids, self.base)
        for k, level in enumerate(self.levels):
            begin, end = bounds[k], bounds[k + 1]
            if begin < end:
                out[begin:end] = level[1].access(ids[begin:end] - self.base[k]).astype(np.int64) + tokens_before[k]
        return out

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and counts of the distinct hashes, and where each hash is among them."""
        distinct, where = np.unique(hashes, return_inverse=True)
        ids = self.ids(distinct)
        counts = np.zeros(len(ids), np.int64)
        known = np.flatnonzero(ids >= 0)
        counts[known] = self.counts(ids[known])
        return ids, counts, where


def _contexts(ids: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """Id of the token before each token; a text begins after an end."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    if len(out):
        out[np.cumsum(counts) - counts] = end
    return out


def _count_pairs(words: Words, files: int):
    """Bigram counts of a task, dealt to files of consecutive keys by the running count of their contexts.

    The place of a hot context is spread by the id of the next word, so its pairs go to many files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, tally = words.open(), _Tally()
        vocabulary, total = level.size, max(level.tokens, 1)
        end = int(level.ids(np.array([END]))[0])

        def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
            key = batch.column(0).to_numpy()
            context, word = key >> 32, key & 0xFFFFFFFF
            some, where = np.unique(context, return_inverse=True)
            begin, size = level.before(some)[where], level.counts(some)[where]
            place = (begin + size * (word / vocabulary)) * (files / total)
            to = np.minimum(place.astype(np.int64), files - 1).astype(np.int32)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(to)], names=["key", "n", "file"])

        for batch in batches:
            for part in chunks(batch, "text", BLOCK_BYTES):
                hashes, counts = tokens(part, "text")
                distinct, _, where = level.lookup(hashes)
                ids = distinct[where]
                yield from map(deal, tally.add((_contexts(ids, counts, end) << 32) | ids))
        yield from map(deal, tally.flush())
    return run


def _write_pairs(folder: str, words: Words, discount: float):
    """A sorted partition of bigram counts as a file of level 2.

    Pointers (monotone, Elias-Fano) give the first successor of each context; successors are the next words' ids, raised by
    the last value of the context before, which makes the whole sequence monotone (Elias-Fano again).  One byte per successor
    is the quantised log10 of its discounted probability.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = _sorted_runs(batches)
        if not len(key):
            return
        context, word = key >> 32, key & 0xFFFFFFFF
        lead = int(context[0])
        pointers = np.searchsorted(context, np.arange(lead, int(context[-1]) + 2))
        starts = pointers[:-1][np.diff(pointers) > 0]
        lasts = word[np.r_[starts[1:], len(word)] - 1]
        raised = word + np.repeat(np.r_[0, np.cumsum(lasts)[:-1]], np.diff(np.r_[starts, len(word)]))
        some, where = np.unique(context, return_inverse=True)
        seen = words.open().counts(some)[where]
        code = np.clip(np.rint((np.log10((n - discount) / seen) - FLOOR) / STEP), 0, 255).astype(np.uint8)
        parts = {f"pointer_{k}": v for k, v in encode(pointers).items()} | {f"next_{k}": v for k, v in encode(raised).items()}
        name = write_file(folder, "pairs", pack(parts | {"code": code}, {"lead": lead}))
        row = [name, int(key[0]), int(key[-1]), len(key), int(n.sum()), int(pointers[1]), len(key) - int(pointers[-2])]
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, fixed_schema(FILES))], schema=fixed_schema(FILES))
    return run


@dataclass
class Pairs:
    """Level 2: successors of contexts."""

    folder: str
    files: list[tuple[str, int, int, int, int]]  # name, first key, last key, successors of the first and of the last context

    def open(self) -> Pairs:
        self.first = np.array([f[1] for f in self.files], np.int64)
        self.levels = []
        # A context whose successors go over several files: its number of successors in all of them.
        self.spread: dict[int, int] = {}
        for name, first, last, head, tail in self.files:
            arrays, facts = mapped(self.folder, name)
            parts = [EliasFano({k[len(p) + 1:]: v for k, v in arrays.items() if k.startswith(p)}) for p in ("pointer", "next")]
            self.levels.append((*parts, arrays["code"], facts["lead"]))
            self.spread[first >> 32] = self.spread.get(first >> 32, 0) + head
            if last >> 32 != first >> 32:
                self.spread[last >> 32] = self.spread.get(last >> 32, 0) + tail
        return self

    def successors(self, contexts: np.ndarray) -> np.ndarray:
        """Number of distinct successors of sorted context ids."""
        out = np.zeros(len(contexts), np.int64)
        bounds = np.searchsorted(contexts << 32, self.first)
        for k, (begin, end) in enumerate(zip(bounds, np.r_[bounds[1:], len(contexts)])):
            if begin < end:
                pointer, _, _, lead = self.levels[k]
                at = contexts[begin:end] - lead
                fit = (at >= 0) & (at + 1 < len(pointer))
                out[begin:end][fit] = (pointer.access(at[fit] + 1) - pointer.access(at[fit])).astype(np.int64)
        for i in np.flatnonzero(np.isin(contexts, np.fromiter(self.spread, np.int64, len(self.spread)))):
            out[i] = self.spread[int(contexts[i])]
        return out

    def discounted(self, keys: np.ndarray) -> np.ndarray:
        """Stored probability of sorted distinct (context, word) keys, 0 where the pair was not seen."""
        out = np.zeros(len(keys))
        bounds = np.searchsorted(keys, self.first)
        for k, (begin, end) in enumerate(zip(bounds, np.r_[bounds[1:], len(keys)])):
            if begin >= end:
                continue
            pointer, following, code, lead = self.levels[k]
            context, word = (keys[begin:end] >> 32) - lead, (keys[begin:end] & 0xFFFFFFFF).astype(np.uint64)
            fit = np.flatnonzero((context >= 0) & (context + 1 < len(pointer)))
            lo, hi = pointer.access(context[fit]).astype(np.int64), pointer.access(context[fit] + 1).astype(np.int64)
            base = np.where(lo > 0, following.access(np.maximum(lo - 1, 0)), np.uint64(0))
            goal = base + word[fit]
            at = following.successor(goal, lo, hi)
            hit = at < hi
            hit[hit] = following.access(at[hit]) == goal[hit]
            out[begin + fit[hit]] = 10.0 ** (FLOOR + STEP * code[at[hit]])
        return out


@dataclass
class Trie:
    words: Words
    pairs: Pairs
    discount: float

    def score(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and model score of each text of a block of tokens."""
        level, total, size = self.words, self.words.tokens, self.words.size
        ids, seen, where = level.lookup(hashes)
        token, count = ids[where], seen[where]
        single = (count + 0.5) / (total + 0.5 * (size + 1))
        end = int(level.ids(np.array([END]))[0])
        context = _contexts(token, counts, end)
        # Counts of the contexts: those of the tokens before, and of the end.
        context_count = _contexts(count, counts, int(level.counts(np.array([end]))[0]) if end >= 0 else 0)
        some, place = np.unique(context, return_inverse=True)
        followers = np.where(some >= 0, self.pairs.successors(some), 0)[place]
        both = np.flatnonzero((context >= 0) & (token >= 0))
        key, pair = np.unique((context[both] << 32) | token[both], return_inverse=True)
        direct = np.zeros(len(token))
        direct[both] = self.pairs.discounted(key)[pair]
        rest = np.where(followers > 0, self.discount * followers / np.maximum(context_count, 1), 1.0)
        full = np.minimum(direct + rest * single, 1.0)
        owner = np.repeat(np.arange(len(counts)), counts)
        sums = [np.bincount(owner, x, len(counts)) for x in (count > 0, np.log10(single), np.log10(full))]
        return sums[0].astype(np.int64), sums[1], sums[2]


def build(docs: DataFrame, *, text: str = "text", file_tokens: int = FILE_TOKENS) -> Trie:
    """The trie of all texts of ``docs``: counts are summed in the tasks, then by key, over every row.

    Word counts are range-partitioned by hash, pairs by the running count of their contexts, and each partition
    becomes one file; the driver only gets one line per file.  Pair probabilities are discounted by n1 / (n1 + 2 n2)
    over words (their counts of one and two), at least 0.5, and the mass taken off is spread by the smoothed word probabilities.
    """
    spark = docs.sparkSession
    folder = scratch_folder(spark, "ngrams")
    rows = docs.select(column_like(docs, text).alias("text"))
    counts = rows.mapInArrow(_count_words, COUNTS).groupBy("key").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts, "word_counts")
    few = counts.agg(F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long")), F.sum("n")).first()
    once, twice, total = (x or 0 for x in few)
    discount = max(0.5, once / (once + 2 * twice)) if once else 0.5
    made = counts.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_write_words(folder), FILES)
    words = Words(folder, [(r["file"], r["first"], r["n"], r["tokens"]) for r in cut_lineage(made, "word_files").orderBy("first").collect()])
    files = max(1, -(-total // file_tokens))
    pairs = rows.mapInArrow(_count_pairs(words, files), "key long, n long, file int")
    dealt = pairs.repartitionById(files, F.col("file")).select("key", "n").sortWithinPartitions("key")
    written = cut_lineage(dealt.mapInArrow(_write_pairs(folder, words, discount), FILES), "pair_files").orderBy("first").collect()
    return Trie(words, Pairs(folder, [(r["file"], r["first"], r["last"], r["head"], r["tail"]) for r in written]), discount)


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, trie: Trie, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row; no shuffle.

    Tokens are lower-cased words and one end per text.  The base is add-half word probabilities; the score is the
    interpolated bigram probability, a text beginning after an end.  NULL is the empty text: one end.  Without any training text
    every token has probability 1 / 1, so scores are 0.  Equal rows stay separate rows.
    """
    rows = docs.select(column_like(docs, key).alias("_key"), column_like(docs, text).alias("_text"))
    total = trie.words.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie.words.open()
        trie.pairs.open()
        for batch in batches:
            for part in chunks(batch, "_text", BLOCK_BYTES):
                hashes, counts = tokens(part, "_text")
                known, base, full = trie.score(hashes, counts)
                columns = [pa.array(counts), pa.array(known), pa.array(np.full(len(counts), total)), pa.array(base), pa.array(full)]
                yield pa.RecordBatch.from_arrays([part.column("_key"), *columns], names=["_key", *fixed_schema(SCORES).names])
    out = rows.mapInArrow(run, f"_key {docs.schema[key].dataType.simpleString()}, {SCORES}")
    return out.withColumnRenamed("_key", key)


def held_out(key: str) -> Column:
    """True for the fifth of keys that the model never learns from; a NULL key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % 5 == 1
