"""Byte-pair encoding and decoding with forced boundaries."""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import Recent, column_like, fixed_schema, gather, kept_in_worker

# The public pre-tokeniser pattern of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of which a Python process remembers the ids; beyond that the older half goes.
REMEMBERED = 1 << 19
#: Bits of an id in a number that holds two, or a rank and an id; what stands for no merge, and for a certain cut.
BITS = 20
MASK, NONE, CUT = (1 << BITS) - 1, 1 << 60, 1 << 61


def byte_letters() -> dict[str, int]:
    """Letter of every byte in byte-level vocabulary files: printable Latin-1 stands for itself, the other bytes
    follow from code point 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and cut table of a byte-level BPE file, built once per Python process."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        letters = byte_letters()
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] is not None:
            raise ValueError("a byte-level BPE file without normaliser is asked for")

        def as_bytes(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.ids = {as_bytes(token): i for token, i in model["vocab"].items()}
        tokens = {i: token for token, i in self.ids.items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens |= {i: text.encode() for text, i in self.added.items()}
        self.tokens = [tokens.get(i) for i in range(max(tokens) + 1)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: Rank and result of every merge as one number, by its two ids as one number.
        self.merges: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            a, b = as_bytes(a), as_bytes(b)
            self.merges[self.ids[a] << BITS | self.ids[b]] = rank << BITS | self.ids[a + b]
        #: Byte pairs that occur inside a token; between any other two bytes a cut is certain.
        self.joined = {token[i:i + 2] for token in self.ids for i in range(len(token) - 1)}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.first = [CUT if bytes([a, b]) not in self.joined else self.merges.get(self.byte_ids[a] << BITS | self.byte_ids[b], NONE) for a in range(256) for b in range(256)]
        self.pieces = regex.compile(PIECES)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        #: Ids of recent words, and the same as text.
        self.words = Recent(REMEMBERED)
        self.buffer = np.frombuffer(b"".join(t or b"" for t in self.tokens), np.uint8)
        self.starts = np.cumsum([0] + [len(t or b"") for t in self.tokens])

    def cut(self, word: bytes) -> list[bytes]:
        """``word`` in fragments that no token reaches across."""
        out, first = [], 0
        for i in range(1, len(word)):
            if self.first[word[i - 1] << 8 | word[i]] == CUT:
                out.append(word[first:i])
                first = i
        out.append(word[first:])
        return out

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: the leftmost pair of least rank is merged until none is left."""
        ids = [self.byte_ids[b] for b in fragment]
        first, merges = self.first, self.merges
        ranks = [first[a << 8 | b] for a, b in zip(fragment, fragment[1:])]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            now = ids[i] = least & MASK
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = merges.get(now << BITS | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = merges.get(ids[i - 1] << BITS | now, NONE)
        return ids

    def merge_long(self, fragment: bytes) -> list[int]:
        """As ``merge`` for a long fragment, with a heap and linked neighbours instead of scans."""
        from heapq import heapify, heappop, heappush

        ids: list[int] = [self.byte_ids[b] for b in fragment]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.merges.get(ids[i] << BITS | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            merged, i, a, b = heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = merged & MASK, False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.merges.get(ids[i] << BITS | ids[k])) is not None:
                    heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := self.merges.get(ids[h] << BITS | ids[i])) is not None:
                heappush(heap, (r, h, ids[h], ids[i]))
        return [p for p, ok in zip(ids, alive) if ok]

    def word(self, word: str) -> tuple[tuple[int, ...], str]:
        found = self.words.get(word)
        if found is None:
            ids = [i for part in self.cut(word.encode()) for i in (self.merge(part) if len(part) <= 64 else self.merge_long(part))]
            found = tuple(ids), ",".join(map(str, ids))
            if len(word) <= 64:
                self.words.put(word, found)
        return found

    def parts(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """Ids of the words of a whole text, also as decimal text; the strings of added tokens become their ids."""
        if any(x in text for x in self.added):
            out = []
            for i, part in enumerate(self.special.split(text)):
                out += [((self.added[part],), str(self.added[part]))] if i % 2 else map(self.word, self.pieces.findall(part))
            return out
        words = self.pieces.findall(text)
        found = list(map(self.words.young.get, words))
        if None in found:
            found = [x or self.word(w) for x, w in zip(found, words)]
        return found

    def encode(self, text: str) -> list[int]:
        return [i for ids, _ in self.parts(text) for i in ids]

    def decode_rows(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 texts of lists of ids in a row; bytes that are no UTF-8 become U+FFFD."""
        at = self.starts[ids]
        size = self.starts[ids + 1] - at
        data = gather(self.buffer, at, size).tobytes()
        ends = np.append(0, np.cumsum(size))[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends, ends[1:])]

    def decode(self, ids: list[int]) -> str:
        """Text of a list of ids, added tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


def opened(content: str) -> Vocabulary:
    """The vocabulary, built once per Python process."""
    return kept_in_worker(("bpe", hashlib.sha256(content.encode()).digest()), lambda: Vocabulary(content))


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, vocabulary: str, *, text: str = "text", digests: bool = False, round_trip: bool = False) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``n_tokens`` and ``ids``; or digests instead of the ids.

    ``vocabulary`` is the content of a byte-level BPE file (1.6 MB; it is part of each task's closure).  Whole texts are encoded: the
    pre-tokeniser's words are cut between byte pairs that occur inside no token, which no merge can cross, the
    fragments are encoded by themselves and their ids are put in a row; a process remembers recent words.  With
    ``digests``, ``ids_sha256`` is that of the decimal ids joined by commas; with ``round_trip`` the ids are decoded and
    ``decoded_sha256`` is that of the text.  NULL is the empty text, with no ids.  One row in, one row out, no shuffle;
    input columns named as a result column are replaced.
    """
    added = ["n_tokens long"] + (["ids_sha256 string"] if digests else ["ids array<int>"]) + (["decoded_sha256 string"] if round_trip else [])
    names = [x.split()[0] for x in added]
    rest = [column_like(docs, c) for c in docs.columns if c not in (*names, text)]
    kinds = fixed_schema(", ".join(added))

    def part(words: Vocabulary, texts: pa.Array) -> pa.Array:
        rows = [words.parts(value.as_py() or "") for value in texts]
        lists = [[ids for ids, _ in row] for row in rows]
        ids = np.fromiter(chain.from_iterable(chain.from_iterable(lists)), np.int64)
        offsets = np.cumsum([0] + [sum(map(len, row)) for row in lists])
        cells = [pa.array(np.diff(offsets))]
        if digests:
            cells.append(pa.array([hashlib.sha256(",".join([text for _, text in row]).encode()).hexdigest() for row in rows], pa.string()))
        else:
            cells.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))))
        if round_trip:
            cells.append(pa.array([hashlib.sha256(x).hexdigest() for x in words.decode_rows(ids, offsets)], pa.string()))
        return pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(cells, kinds)], names=names)

    @F.arrow_udf(f"struct<{', '.join(x.replace(' ', ':', 1) for x in added)}>")
    def coded(column: pa.Array) -> pa.Array:
        words, parts = opened(vocabulary), []
        for at in range(0, len(column), 256):
            parts.append(part(words, column[at:at + 256]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(kinds)))
    return docs.select(*rest, coded(column_like(docs, text)).alias("_coded")).select(*[F.col(f"`{c}`") for c in docs.columns if c not in (*names, text)], "_coded.*")


def decode(rows: DataFrame, vocabulary: str, *, ids: str = "ids") -> DataFrame:
    """The columns of ``rows`` with ``text`` decoded from the ``ids`` column; NULL ids give NULL text, an unknown id fails."""
    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        words = opened(vocabulary)
        return pa.array([None if x.as_py() is None else words.decode(x.as_py()) for x in column], pa.string())
    return rows.select(*[column_like(rows, c) for c in rows.columns if c not in ("text", ids)], text(column_like(rows, ids)).alias("text"))


def default_vocabulary(spark: SparkSession) -> str:
    """The installed public 50k vocabulary, read on the driver; ``panelspark.bpe.vocabulary`` names another file."""
    path = spark.conf.get("panelspark.bpe.vocabulary", None)
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return read_vocabulary(path)
