"""SentencePiece BPE encoding and decoding with a table of the last token of every prefix."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import Recent, column_like, fixed_schema, gather, kept_in_worker, utf8

#: Text that a task handles at once; a longer single text is a chunk of its own.
CHUNK = 2 << 20
#: Fragments, and pairs of tokens, of which a Python process remembers the answer; beyond that the older half goes.
REMEMBERED, REMEMBERED_PAIRS = 1 << 18, 1 << 20
SPACE = "▁"
# Fixed values of the model file: numbers of its message fields, and kinds of pieces.
PIECE, TRAINER, NORMALIZER, DENORMALIZER = 1, 2, 3, 5
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL_TYPE, SUFFIX_SPACES, BYTE_FALLBACK, BEGIN_ID, END_ID = 3, 24, 35, 41, 42
CHARS_MAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
BPE = 2


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of every field of a serialised protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value
    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            size = varint() if size is None else size
            value = message[at:at + size]
            at += size
        yield tag >> 3, value


class Pieces:
    """Pieces of a model file, the automaton that finds them and the tables of both directions."""

    def __init__(self, content: bytes) -> None:
        names, scores, kinds, trainer, normalizer = [], [], [], {}, {}
        for number, value in fields(content):
            if number == PIECE:
                piece = dict(fields(value))
                names.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == TRAINER:
                trainer = dict(fields(value))
            elif number == NORMALIZER:
                normalizer = dict(fields(value))
            elif number == DENORMALIZER and dict(fields(value)).get(CHARS_MAP):
                raise ValueError("a model with a denormaliser is not supported")
        plain = (trainer.get(MODEL_TYPE, 1) == BPE and trainer.get(BYTE_FALLBACK) and not trainer.get(SUFFIX_SPACES) and not normalizer.get(CHARS_MAP)
                 and normalizer.get(DUMMY_PREFIX, 1) and not normalizer.get(REMOVE_SPACES, 1) and normalizer.get(ESCAPE_SPACES, 1))
        if not plain or USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError("a BPE model with byte fallback, a leading space and no normalisation or pieces of the user is asked for")
        self.begin, self.end = trainer.get(BEGIN_ID, 1), trainer.get(END_ID, 2)
        self.bytes_first = names.index("<0x00>")
        self.ids = {name: i for i, name in enumerate(names) if kinds[i] == NORMAL}
        #: The greater the score, the earlier a merge.
        self.rank = {name: -scores[i] for name, i in self.ids.items()}
        if any(SPACE in name.lstrip(SPACE) for name in self.ids):
            raise ValueError("pieces with a space behind other letters are not supported")
        #: A piece that merging builds, with the two parts of its last merge; single letters have none.
        self.parts: dict[str, tuple[str, str] | None] = {letter: None for name in self.ids for letter in name}
        for name in self.ids:
            if len(name) > 1 and len(merged := self.merge(name, keep=2)) == 2:
                self.parts[name] = (merged[0], merged[1])
        for name, both in self.parts.items():
            if both and any(self.rank.get(x, -np.inf) > self.rank[name] for x in both if len(x) > 1):
                raise ValueError("a piece that is merged before its parts: the last token of a prefix would not be unique")
        self.names = list(self.parts)
        self.automaton = ahocorasick.Automaton()
        for n, name in enumerate(self.names):
            self.automaton.add_word(name, (n, len(name)))
        self.automaton.make_automaton()
        #: Ids of a token: its own, or those of its bytes where a letter has no piece.
        self.token_ids = [(self.ids[name],) if name in self.ids else self.byte_ids(name) for name in self.names]
        self.whole = {name: n for n, name in enumerate(self.names)}
        self.tails: dict[int, list[tuple[str, float]]] = {}
        self.heads: dict[int, list[tuple[str, float]]] = {}
        self.pairs, self.known = Recent(REMEMBERED_PAIRS), Recent(REMEMBERED)
        #: Bytes of every id as the decoder writes them, in one buffer with offsets.
        written = [b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else bytes([i - self.bytes_first]) if kind == BYTE else name.replace(SPACE, " ").encode()
                   for i, (name, kind) in enumerate(zip(names, kinds))]
        self.kinds = np.array(kinds)
        self.written = written
        self.starts = np.cumsum([0] + [len(x) for x in written])
        self.buffer = np.frombuffer(b"".join(written), np.uint8)

    def byte_ids(self, text: str) -> tuple[int, ...]:
        return tuple(self.bytes_first + b for b in text.encode())

    def merge(self, text: str, keep: int = 1) -> list[str]:
        """``text`` merged pair by pair, the earliest pair first and the leftmost of equals, down to ``keep`` parts."""
        parts = list(text)
        ranks = [self.rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:])]
        while len(parts) > keep and (least := min(ranks)) < np.inf:
            i = ranks.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = self.rank.get(parts[i] + parts[i + 1], np.inf)
            if i:
                ranks[i - 1] = self.rank.get(parts[i - 1] + parts[i], np.inf)
        return parts

    def spine(self, token: int, side: int) -> list[tuple[str, float]]:
        """What stands at one edge of a token while it is built: from its letter up, each with the rank of the merge that takes it."""
        up, name, taken = [], self.names[token], np.inf
        while True:
            up.append((name, taken))
            both = self.parts[name]
            if both is None:
                return up[::-1]
            taken, name = self.rank[name], both[side]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of two tokens gives these two again: no pair across their border has its turn while it stands there."""
        left = self.tails.get(a) or self.tails.setdefault(a, self.spine(a, 1))
        right = self.heads.get(b) or self.heads.setdefault(b, self.spine(b, 0))
        i = j = 0
        while True:
            x, goes_left = left[i]
            y, goes_right = right[j]
            across = self.rank.get(x + y)
            if across is not None and across < goes_left and across <= goes_right:
                return False
            if goes_left == np.inf and goes_right == np.inf:
                return True
            if goes_left <= goes_right:
                i += 1
            else:
                j += 1

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            found = self.compatible(a, b)
            self.pairs.put(key, found)
        return found

    def fragment(self, text: str) -> tuple[int, ...]:
        """Ids of a text that starts with its spaces and has none behind them.

        ``last`` holds the one token that the encoding of each prefix ends with: of the tokens that the automaton finds to end there, the
        one that goes with the last token of the prefix before it.  -1 is a letter of no piece, which no merge touches.
        """
        n = self.whole.get(text)
        if n is not None:
            return self.token_ids[n]
        last, sizes, answers = [-1] * (len(text) + 1), [1] * (len(text) + 1), self.pairs.young
        for at, (token, size) in self.automaton.iter(text):
            if last[at + 1] >= 0:
                continue
            before = last[at + 1 - size] if size <= at else -1
            if before >= 0:
                good = answers.get(before << 32 | token)
                if not (self.fits(before, token) if good is None else good):
                    continue
            last[at + 1], sizes[at + 1] = token, size
        found, at = [], len(text)
        while at:
            found.append(self.token_ids[last[at]] if last[at] >= 0 else self.byte_ids(text[at - 1]))
            at -= sizes[at]
        return tuple(i for ids in reversed(found) for i in ids)

    def encode_chunk(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, without begin and end, and n + 1 offsets.

        A space behind another letter is inside no piece, so a text is cut before every run of spaces and only the distinct
        fragments that the process does not remember are encoded.
        """
        full = np.diff(ends) > 0
        # A space goes before each text that is not empty; the letter of escaped spaces is a space as well.
        texts = [b" " + raw[a:b].tobytes().replace(SPACE.encode(), b" ") for a, b in zip(ends[:-1][full], ends[1:][full])]
        data = b"".join(texts)
        begins = np.cumsum([0] + [len(x) for x in texts])
        solid = np.frombuffer(data, np.uint8) != 32
        first = ~solid
        first[1:] &= solid[:-1]
        first[begins[:-1]] = True
        cut = np.append(np.flatnonzero(first), len(data))
        bounds = np.searchsorted(cut, begins)
        parts = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        ids, sizes = [], []
        for key in parts.dictionary.to_pylist():
            found = self.known.get(key)
            if found is None:
                found = self.fragment(key.decode().replace(" ", SPACE))
                if len(key) <= 64:
                    self.known.put(key, found)
            ids += found
            sizes.append(len(found))
        size = np.array(sizes, np.int64)
        which = parts.indices.to_numpy()
        counts = size[which]
        out = gather(np.array(ids, np.uint32), (np.cumsum(size) - size)[which], counts)
        total = np.append(0, np.cumsum(counts))[bounds]
        offsets = np.zeros(len(ends), np.int64)
        offsets[1:][full] = np.diff(total)
        return out, np.cumsum(offsets)

    def encode(self, text: str) -> list[int]:
        """Ids of one text, begin and end included."""
        raw = np.frombuffer(text.encode(), np.uint8)
        return [self.begin, *self.encode_chunk(raw, np.array([0, len(raw)]))[0].tolist(), self.end]

    def decode_chunk(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 texts of lists of ids in a row."""
        at = self.starts[ids]
        size = self.starts[ids.astype(np.int64) + 1] - at
        data = gather(self.buffer, at, size).tobytes()
        ends = np.append(0, np.cumsum(size))[offsets]
        fallback = np.append(0, np.cumsum(self.kinds[ids] == BYTE))[offsets]
        out = []
        for n, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            text = data[a:b]
            if fallback[n + 1] > fallback[n]:
                try:
                    # A begin or end amid the text parts bytes that would make one letter together.
                    if (self.kinds[ids[offsets[n] + 1:offsets[n + 1] - 1]] == CONTROL).any():
                        raise UnicodeDecodeError("utf-8", text, 0, 0, "parted")
                    text.decode()
                except UnicodeDecodeError:
                    out.append(self.decode(ids[offsets[n]:offsets[n + 1]].tolist()).encode())
                    continue
            first = next((i for i in ids[offsets[n]:offsets[n + 1]].tolist() if self.kinds[i] != CONTROL), None)
            out.append(text[1:] if first is not None and self.kinds[first] == NORMAL and text[:1] == b" " else text)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of any list of ids: the space before the text goes, bytes that are no UTF-8 become U+FFFD one by one."""
        out, run, fresh = "", b"", True
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                run += self.written[i]
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out += run[:size].decode()
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out += "�"
                run = run[size:]
            if i is None:
                break
            fresh = fresh and not out
            text = self.written[i].decode()
            if fresh and self.kinds[i] == NORMAL and text[:1] == " ":
                text, fresh = text[1:], False
            out += text
        return out


def opened(content: bytes) -> Pieces:
    """The model, built once per Python process."""
    return kept_in_worker(("pieces", hashlib.sha256(content).digest()), lambda: Pieces(content))


def encode(docs: DataFrame, model: bytes, *, text: str = "text", digests: bool = False, round_trip: bool = False) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``n_tokens`` and ``ids`` (begin and end included); or digests instead of the ids.

    ``model`` is the content of a SentencePiece file of the BPE kind with byte fallback (0.5 MB; it is part of each task's closure).  Whole texts
    are encoded, without sampling: each prefix of a fragment has one last token, found by an automaton and a test of the pair, and ids are read
    off backwards, so the time is linear in the length.  With ``digests``, ``ids_sha256`` is that of the ids as little-endian unsigned 32-bit integers; with
    ``round_trip`` the ids are decoded and ``decoded_sha256`` is that of the text.  NULL is the empty text, with the two ids of begin and end.
    The letter U+2581 is a space to the model and comes back as one.  One row in, one row out, no shuffle; input columns named as a result column are replaced.
    """
    added = ["n_tokens long"] + (["ids_sha256 string"] if digests else ["ids array<int>"]) + (["decoded_sha256 string"] if round_trip else [])
    names = [x.split()[0] for x in added]
    kinds = fixed_schema(", ".join(added))

    def part(pieces: Pieces, raw: np.ndarray, ends: np.ndarray) -> pa.Array:
        ids, offsets = pieces.encode_chunk(raw, ends)
        whole = np.insert(ids, np.repeat(offsets, 2)[1:-1], np.tile([pieces.end, pieces.begin], len(offsets))[1:-1]) if len(ends) > 1 else ids
        offsets = offsets + 2 * np.arange(len(offsets))
        cells = [pa.array(np.diff(offsets))]
        if digests:
            little, edges = memoryview(whole.astype("<u4").tobytes()), (4 * offsets).tolist()
            cells.append(pa.array([hashlib.sha256(little[a:b]).hexdigest() for a, b in zip(edges, edges[1:])], pa.string()))
        else:
            cells.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(whole.astype(np.int32))))
        if round_trip:
            cells.append(pa.array([hashlib.sha256(x).hexdigest() for x in pieces.decode_chunk(whole, offsets)], pa.string()))
        return pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(cells, kinds)], names=names)

    @F.arrow_udf(f"struct<{', '.join(x.replace(' ', ':', 1) for x in added)}>")
    def coded(column: pa.Array) -> pa.Array:
        pieces, done = opened(model), []
        raw, ends = utf8(column)
        first = 0
        while first < len(column):
            last = min(max(int(np.searchsorted(ends, ends[first] + CHUNK, side="right")) - 1, first + 1), len(column))
            done.append(part(pieces, raw[ends[first]:ends[last]], ends[first:last + 1] - ends[first]))
            first = last
        return pa.concat_arrays(done) if done else pa.array([], pa.struct(list(kinds)))
    rest = [c for c in docs.columns if c not in (*names, text)]
    quoted = ["`" + c.replace("`", "``") + "`" for c in rest]
    return docs.select(*[column_like(docs, c) for c in rest], coded(column_like(docs, text)).alias("_coded")).select(*quoted, "_coded.*")


def decode(rows: DataFrame, model: bytes, *, ids: str = "ids") -> DataFrame:
    """The columns of ``rows`` with ``text`` decoded from the ``ids`` column; NULL ids give NULL text, an unknown id fails."""
    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        pieces = opened(model)
        return pa.array([None if x.as_py() is None else pieces.decode(x.as_py()) for x in column], pa.string())
    return rows.select(*[column_like(rows, c) for c in rows.columns if c not in ("text", ids)], text(column_like(rows, ids)).alias("text"))


def default_model(spark: SparkSession) -> bytes:
    """The installed public 32k model, read on the driver; ``panelspark.pieces.model`` names another file."""
    path = spark.conf.get("panelspark.pieces.model", None)
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        return file.read()
