"""Grouping of spelling variants with an index of variable-length grams."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import column_like, cut_lineage, fixed_schema, mix64, utf8

#: Code points and occurrences that a word needs.
SHORTEST, OCCURRENCES = 7, 2
#: A run whose hash this divides loses one letter.
LOSES = 31
#: A form occurs at least this many times as often as its word.
RATIO = 10
#: Shortest and longest gram; a gram that begins in more than this share of the words is made longer by a letter.
SHORT, LONG, COMMON = 2, 3, 0.001
#: Grams in more than this share of the words have a place of their own in the order of lists, the others come before them.
ORDERED = 0.0001
#: Lists are of words that share so many grams; a list of more than LIST words is split by a further one, at most until MOST are shared.
SHARED, MOST, LIST = 2, 3, 128
#: Letters that are compared at once.
COMPARED = 1 << 23
#: Distinct words that a task counts before it hands them on.
COUNTED = 1 << 18
LETTERS = "a-zÀ-ÿ"


def count_words(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n`` of the words of whole texts: maximal runs of letters, A-Z lower-cased, some of which lose a letter.

    Let h be the CRC-32 of ``<key>:<run>``; where 31 divides h, the run's code point h modulo its length goes.  Runs count once per occurrence; a NULL
    text has none and a NULL key is written as nothing.  Only words long and frequent enough are returned.  Counts are summed in tasks before the shuffle.
    """
    runs = re.compile(f"[{LETTERS}]{{{SHORTEST},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = fixed_schema("word string, c long")
        total: Counter[str] = Counter()

        def handed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], schema=schema)
            total.clear()
            return out
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1)):
                before = zlib.crc32(f"{name.as_py() or ''}:".encode())
                for word, n in Counter(runs.findall((value.as_py() or "").encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), before)
                    if h % LOSES == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < SHORTEST:
                            continue
                    total[word] += n
                if len(total) >= COUNTED:
                    yield handed_on()
        yield handed_on()
    named = docs.select(column_like(docs, key).cast("string").alias("_key"), column_like(docs, text).alias("_text"))
    counts = named.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("n"))
    return counts.where(F.col("n") >= OCCURRENCES)


@dataclass
class Grams:
    """The gram dictionary: a gram is made longer, letter by letter, while it is one of the common ones."""

    common: frozenset[str]
    short: int = SHORT
    long: int = LONG

    def __post_init__(self) -> None:
        #: What can stand before the last letter of a gram that began further left.
        self.ends = {g[i:] for g in self.common for i in range(1, len(g))}

    def decompose(self, word: str) -> list[tuple[int, str]]:
        """Place and gram for every place, without the grams that an earlier one covers."""
        out, end = [], 0
        for p in range(len(word) - self.short + 1):
            q = self.short
            while q < self.long and p + q < len(word) and word[p:p + q] in self.common:
                q += 1
            if p + q > end:
                end = p + q
                out.append((p, word[p:end]))
        return out

    def affected(self, word: str, grams: list[tuple[int, str]]) -> int:
        """The most grams that one edit can take away or change.

        An edit lies between ``word[:left]`` and ``word[right:]``.  Beside the grams across it, it can change those on its left from the first on that could
        go on past it, and those on its right that a longer gram from further left could cover.
        """
        most = 0
        spans = [(p, p + len(g)) for p, g in grams]
        for left in range(len(word) + 1):
            first = left
            for size in range(self.short, min(self.long, left + 1)):
                if not all(word[left - size:left - size + q] in self.common for q in range(self.short, size + 1)):
                    continue
                first = left - size
            for right in (left, left + 1):
                if right > len(word):
                    continue
                n = 0
                for p, end in spans:
                    if end <= left:
                        n += p >= first
                    elif p < right:
                        n += 1
                    elif end - right < self.long:
                        n += word[right:end - 1] in self.ends
                    else:
                        break
                most = max(most, n)
        return most


def gram_dictionary(words: DataFrame, n_words: int) -> Grams:
    """The common grams of the words.  There are at most (letters of a word) / COMMON of each length, whatever the number of words."""
    size = F.length("word")
    starts = [F.transform(F.sequence(F.lit(1), size - q + 1), lambda i, q=q: F.substring("word", i, q)) for q in range(SHORT, LONG)]
    pieces = words.select(F.explode(F.array_distinct(F.concat(*starts))).alias("gram"))
    return Grams(frozenset(r[0] for r in pieces.groupBy("gram").count().where(F.col("count") > COMMON * n_words).select("gram").collect()))


DECOMPOSED = "word string, n long, kind string, gram array<string>, place array<int>, least int"


def decomposed(words: DataFrame, grams: Grams) -> DataFrame:
    """Grams of every word and the ``least`` number of them that a word one edit away has too.

    Words that are sure of fewer than ``MOST`` variable grams are decomposed once more, with grams of the shortest length alone (``kind`` "s"): two such words
    meet there, every other pair meets among the variable grams.
    """
    plain = Grams(frozenset())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("kind", pa.string()), ("gram", pa.list_(pa.string())), ("place", pa.list_(pa.int32())), ("least", pa.int32())])
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, book in (("v", grams), ("s", plain)):
                    found = book.decompose(word)
                    least = len(found) - book.affected(word, found)
                    rows.append((word, n, kind, [g for _, g in found], [p for p, _ in found], least))
                    if least >= MOST:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)
    return words.select("word", "n").mapInArrow(run, DECOMPOSED)


def hashed(texts: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t.encode()) for t in texts], np.uint64)


def list_rows(first: np.ndarray, gram: np.ndarray, place: np.ndarray, least: np.ndarray, head: np.ndarray, longer: np.ndarray, shared: int,
              inside: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows and keys of the lists that words are in, and whether for words of their own length (else for those of one letter more).

    Word ``i`` has the grams ``first[i]`` to ``first[i + 1]`` (hashes and places), rarest first; ``head`` and ``longer`` are hashes of its own length and one more.  Of two
    words that share ``t`` grams, in any one order of grams the first shared one is among the first ``m - t + 1`` of either, the second among the first
    ``m - t + 2``, and so on.  A gram on the right of an added letter stands one place later in the longer word.  ``inside`` holds the lists, by one gram less, that are split.
    """
    m = np.diff(first)
    for size, sure in set(zip(m.tolist(), np.maximum(least, 1).tolist())):
        rows = np.flatnonzero((m == size) & (np.maximum(least, 1) == sure))
        chosen = [c for c in combinations(range(min(size, size - sure + shared)), shared) if all(i <= size - sure + j for j, i in enumerate(c))]
        if not chosen:
            continue
        at = first[rows][:, None, None] + np.array(chosen)[None]
        names, places = gram[at], place[at]
        # How many of the chosen grams stand further left.
        left = (places[..., :, None] > places[..., None, :]).sum(axis=-1)
        for own, start, kept in [(True, head, shared)] + [(False, longer, k) for k in range(shared + 1)]:
            key = np.broadcast_to(start[rows][:, None], at.shape[:2])
            good = np.ones(at.shape[:2], bool)
            for j in range(shared):
                if j == shared - 1 and inside is not None:
                    good = np.isin(key, inside)
                key = mix64(key * np.uint64(3) + mix64(names[..., j] + (places[..., j] + (left[..., j] >= kept)).astype(np.uint64)))
            r, c = np.nonzero(good)
            yield rows[r], key[r, c], own


ROWS = "key long, word string, n long, own boolean"


def lists(words: DataFrame, shared: int, frequency: dict[str, int]) -> DataFrame:
    """Rows of the gram lists: each word under the keys of ``list_rows``; ``words`` has ``inside`` where longer lists are split."""
    split = "inside" in words.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 8192):
                part = batch.slice(at, 8192)
                grams = part.column("gram").flatten().dictionary_encode()
                names = grams.dictionary.to_pylist()
                rank = np.empty(len(names), np.int64)
                rank[sorted(range(len(names)), key=lambda i: (frequency.get(names[i], 0), names[i]))] = np.arange(len(names))
                which, place = grams.indices.to_numpy(), part.column("place").flatten().to_numpy().astype(np.int64)
                m = part.column("gram").value_lengths().to_numpy()
                order = np.lexsort((place, rank[which], np.repeat(np.arange(len(part)), m)))
                kinds, sizes = part.column("kind").to_pylist(), pc.utf8_length(part.column("word")).to_pylist()
                head, longer = (hashed([f"{k}{n + more}" for k, n in zip(kinds, sizes)]) for more in (0, 1))
                inside = part.column("inside").flatten().to_numpy().view(np.uint64) if split else None
                for rows, key, own in list_rows(np.append(0, np.cumsum(m)), hashed(names)[which][order], place[order], part.column("least").to_numpy(), head, longer, shared, inside):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column("word").take(pa.array(rows)), part.column("n").take(pa.array(rows)),
                                                      pa.array(np.full(len(rows), own))], schema=fixed_schema(ROWS))
    # A gram can be in two of the chosen places, so a key can occur twice for a word.
    return words.mapInArrow(run, ROWS)


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words in a row, where each starts and how many it has."""
    raw, _ = utf8(words)
    size = pc.utf8_length(words).to_numpy().astype(np.int64)
    return np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32), np.cumsum(size) - size, size


def one_edit(points: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which words ``a`` become the words ``b``, as long or one longer, by exactly one other or added code point."""
    good = np.zeros(len(a), bool)
    for n in set(size[b].tolist()):
        rows = np.flatnonzero(size[b] == n)
        step = max(1, COMPARED // n)
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            wide = points[start[b[some]][:, None] + np.arange(n)]
            longer = size[a[some]] < n
            like = some[~longer]
            good[like] = (points[start[a[like]][:, None] + np.arange(n)] != wide[~longer]).sum(axis=1) == 1
            less = some[longer]
            short, wide = points[start[a[less]][:, None] + np.arange(n - 1)], wide[longer]
            before = np.logical_and.accumulate(short == wide[:, :-1], axis=1).sum(axis=1)
            after = np.logical_and.accumulate((short == wide[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            good[less] = before + after >= n - 1
    return good


MET = "key long, a string, n_a long, b string, n_b long"


def meet(rows: DataFrame) -> DataFrame:
    """Near words among the rows of lists; and each row of a list that is too long, with its ``key``, and 1 as ``n_b`` if it is of the list's own length.

    Rows are sorted by list, so a task holds no more than a batch and ``LIST`` rows, whatever the length of a list.
    """
    schema = fixed_schema(MET)

    def long(part: pa.RecordBatch, rows: np.ndarray | slice) -> pa.RecordBatch:
        key, word, n, own = part.columns
        if not isinstance(rows, slice):
            key, word, n, own = (c.take(pa.array(rows)) for c in (key, word, n, own))
        return pa.RecordBatch.from_arrays([key, word, n, pa.nulls(len(key), pa.string()), own.cast(pa.int64())], schema=schema)

    def answers(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """``part`` holds whole lists."""
        if not len(part):
            return
        key, own = part.column("key").to_numpy(), part.column("own").to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if key[0] > np.iinfo(np.int64).min else key[0] + 1))
        length = np.diff(np.append(edge, len(key)))
        if (length > LIST).any():
            yield long(part, np.flatnonzero(np.repeat(length > LIST, length)))
        mine = np.flatnonzero(own & np.repeat((length > 1) & (length <= LIST), length))
        if not len(mine):
            return
        which = np.searchsorted(edge, mine, side="right") - 1
        others = length[which]
        b = np.repeat(mine, others)
        a = np.repeat(edge[which], others) + np.arange(int(others.sum())) - np.repeat(np.cumsum(others) - others, others)
        pairs = ~own[a] | (a < b)
        a, b = a[pairs], b[pairs]
        good = one_edit(*letters_of(part.column("word")), a, b)
        a, b = pa.array(a[good]), pa.array(b[good])
        word, n = part.column("word"), part.column("n")
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), word.take(a), n.take(a), word.take(b), n.take(b)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, skipped = None, None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
                rest = None
            if not len(batch):
                continue
            key = batch.column("key").to_numpy()
            if skipped is not None:
                same = int(np.searchsorted(key, skipped, side="right"))
                if same:
                    yield long(batch.slice(0, same), slice(None))
                batch, key = batch.slice(same), key[same:]
                if not len(batch):
                    continue
                skipped = None
            last = int(np.searchsorted(key, key[-1], side="left"))
            yield from answers(batch.slice(0, last))
            rest = batch.slice(last)
            if len(rest) > LIST:
                yield long(rest, slice(None))
                rest, skipped = None, key[-1]
        if rest is not None:
            yield from answers(rest)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, MET)


def near_words(words: DataFrame) -> DataFrame:
    """Pairs of ``words`` (``word``, ``n``, distinct words of at least seven code points) that differ by exactly one added, lost or other code point, as ``a``, ``n_a``, ``b``, ``n_b``, each pair once.

    Words meet in lists of the grams that a pair must share: only the first grams of each word in the order of rarity, by place and length.  A list of more
    than ``LIST`` words is split by the next shared gram, up to ``MOST`` grams; what is too long even then is joined.  What meets is verified.  No pair is lost: see ``Grams.affected``.
    """
    words = cut_lineage(words.select("word", "n"), "words")
    n_words = words.count()
    table = cut_lineage(decomposed(words, gram_dictionary(words, n_words)), "grams")
    counts = table.select(F.explode("gram").alias("gram")).groupBy("gram").count().where(F.col("count") > ORDERED * n_words)
    # At most (grams of a word) / ORDERED rows.
    frequency = {r[0]: r[1] for r in counts.collect()}
    pairs, now = [], table
    for shared in range(SHARED, MOST + 1):
        met = cut_lineage(meet(lists(now, shared, frequency)), "near")
        pairs.append(met.where("key IS NULL").drop("key"))
        long = met.where("key IS NOT NULL").select("key", "a", "n_a", "n_b")
        if long.isEmpty():
            break
        if shared < MOST:
            # A word is in few lists: those of its first grams.
            now = table.join(long.groupBy(F.col("a").alias("word")).agg(F.collect_set("key").alias("inside")), "word")
        else:
            own = long.where("n_b = 1").select("key", F.col("a").alias("b"), F.col("n_a").alias("n"))
            both = long.join(own, "key").where("(n_b = 0 OR a < b) AND levenshtein(a, b, 1) = 1")
            pairs.append(both.select("a", "n_a", "b", F.col("n").alias("n_b")))
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    least, most = (F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a")))
    n_least, n_most = (F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)) for x, y in (("n_a", "n_b"), ("n_b", "n_a")))
    return out.select(least.alias("a"), n_least.alias("n_a"), most.alias("b"), n_most.alias("n_b")).distinct()


def group_variants(words: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for every word of ``words`` (``word``, ``n``).

    ``form`` is the near word of largest ``n`` (of equals the least in code-point order) if it occurs at least ten times as often, else NULL; ``root`` is where
    forms lead in the end, the word itself if it has none; ``n_near`` counts near words.  No words, no rows.
    """
    words = cut_lineage(words.select("word", "n"), "counted")
    near = cut_lineage(near_words(words), "pairs")
    sides = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("c")).unionByName(
        near.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("c")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("c")).alias("less"), F.col("other"))).alias("top"))
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("top.other").alias("top"), (-F.col("top.less")).alias("top_n"))
    often = F.col("top_n") >= RATIO * F.col("n")
    known = cut_lineage(known.select("word", F.when(often, F.col("top")).alias("form"), "n", "n_near", F.when(often, F.col("top_n")).alias("form_n")), "forms")
    # Counts grow tenfold a step, so paths have under twenty steps and each round doubles what is covered.
    ways = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ways = cut_lineage(ways, "roots")
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if ways.join(ahead, "root", "left_semi").isEmpty():
            break
        ways = ways.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return known.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``group_variants`` of the words that ``count_words`` finds in whole texts; nulls as there, repeated rows count as often as they occur, other columns do not matter."""
    return group_variants(count_words(docs, key=key, text=text))


def oracle() -> str:
    """The same words in DuckDB: CRC-32 byte by byte, near words through the words with one letter left out."""
    return f"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{LETTERS}]+')) AS run
  FROM documents),
g AS (SELECT d, run, count(*) AS c, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(d || ':' || run, ''), lambda x:
    CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195::BIGINT, ord(x) - 64] END))),
  lambda s, b: list_reduce([xor(s, b), 0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))) AS state
  FROM r WHERE length(run) >= {SHORTEST} GROUP BY d, run),
h AS (SELECT run, c, xor(state, 4294967295) AS h FROM g),
k AS (SELECT CASE WHEN h % {LOSES} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM k WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(c) >= {OCCURRENCES}),
x AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, w.word FROM x JOIN w ON x.rest = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.rest = w.word),
t AS (SELECT p.a AS word, count(*) AS n_near, arg_min(p.b, (-w.n, p.b)) AS top, max(w.n) AS top_n FROM p JOIN w ON w.word = p.b GROUP BY p.a),
f AS MATERIALIZED (SELECT w.word, CASE WHEN top_n >= {RATIO} * n THEN top END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top_n >= {RATIO} * n THEN top_n END AS form_n
  FROM w LEFT JOIN t USING (word)),
s AS (SELECT word, word AS root FROM f UNION SELECT s.word, f.form FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM f JOIN s USING (word) WHERE s.root IN (SELECT word FROM f WHERE form IS NULL)
"""
