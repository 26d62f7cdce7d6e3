"""Media columns: content-addressed payloads in tar shards, metadata from header-only range reads."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import column_like, cut_lineage, fixed_schema
from panelspark.llm.files import open_store

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY, DEPTH, ROW = 0, 8, 64
#: Signature, and the length, name, 13 bytes and checksum of the header chunk.
HEADER_BYTES = 33
#: Bytes after which a task begins its next tar shard.
SHARD_BYTES = 256 << 20


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def to_payload(text: str | None) -> bytes:
    """UTF-8 of the text with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def to_png(payload: bytes) -> bytes:
    """The payload as 8-bit grey samples of an image 64 wide; lossless, the same bytes for the same payload."""
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    header = struct.pack(">IIBBBBB", ROW, height, DEPTH, GREY, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first bytes of an image."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not an image of this store")
    return struct.unpack(">IIBB", head[16:26])


def from_png(image: bytes) -> bytes:
    """The payload of a stored image; a damaged image fails."""
    _, height, _, _ = read_header(image[:HEADER_BYTES])
    at, data = HEADER_BYTES, []
    while image[at + 4:at + 8] != b"IEND":
        size = struct.unpack(">I", image[at:at + 4])[0]
        body = image[at + 4:at + 8 + size]
        if zlib.crc32(body) != struct.unpack(">I", image[at + 8 + size:at + 12 + size])[0]:
            raise ValueError("damaged image")
        data.append(body[4:])
        at += size + 12
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, ROW + 1)[:, 1:].tobytes()


class _Shards:
    """Tar files that a task appends to; each attempt has names of its own."""

    def __init__(self, folder: str) -> None:
        self.store, self.path = open_store(folder)
        self.store.create_dir(self.path, recursive=True)
        self.out, self.name, self.at = None, "", 0

    def append(self, digest: str, body: bytes) -> tuple[str, int]:
        if self.out is None or self.at > SHARD_BYTES:
            self.close()
            self.name, self.at = f"{uuid4().hex}.tar", 0
            self.out = self.store.open_output_stream(f"{self.path}/{self.name}")
        info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
        info.size = len(body)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + body + bytes(-len(body) % 512))
        begin = self.at + len(head)
        self.at = begin + len(body) + -len(body) % 512
        return self.name, begin

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


STORED = "_n_bytes long, digest binary, shard string, offset long, length long"


def store(docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``_key``, ``_n_bytes`` of its text, and ``digest``, ``shard``, ``offset`` and ``length`` of its image.

    Each task writes the images of its rows to tar shards below ``folder``, each distinct image once; the
    address of an image is its SHA-256.  A copy that several tasks met is stored by each of them, at most once per task, and
    any of the places holds the same bytes.  The rows are a table of their own before anything reads them, so images
    are not written again.  NULL is the empty text: 64 zero bytes.
    """
    rows = docs.select(column_like(docs, key).alias("_key"), column_like(docs, text).alias("_text"))
    schema = fixed_schema(STORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, known = _Shards(folder), {}
        for batch in batches:
            found = []
            for value in batch.column("_text"):
                payload = to_payload(value.as_py())
                content = hashlib.sha256(payload).digest()
                if content not in known:
                    image = to_png(payload)
                    digest = hashlib.sha256(image).digest()
                    known[content] = (digest, *shards.append(digest.hex(), image), len(image))
                found.append((len((value.as_py() or "").encode()), *known[content]))
            columns = list(zip(*found)) if found else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), *(pa.array(c, f.type) for c, f in zip(columns, schema))], names=["_key", *schema.names])
        shards.close()
    kind = docs.schema[key].dataType.simpleString()
    return cut_lineage(rows.mapInArrow(run, f"_key {kind}, {STORED}"), "media_rows")


def _ranges(folder: str, batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Bytes of each row's range, or its first ``limit`` bytes; one shard is open at a time."""
    place, path = open_store(folder)
    name, source = None, None
    for batch in batches:
        out = []
        for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length"))):
            if shard != name:
                if source is not None:
                    source.close()
                name, source = shard, place.open_input_file(f"{path}/{shard}")
            out.append(source.read_at(min(length, limit or length), offset))
        yield batch, out
    if source is not None:
        source.close()


def header_columns(places: DataFrame, folder: str) -> DataFrame:
    """``places`` (with ``shard``, ``offset``, ``length``) with ``width``, ``height``, ``depth`` and ``colour``, from 33 bytes of each image."""
    rest = places.schema.simpleString()[len("struct<"):-1].replace(":", " ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, heads in _ranges(folder, batches, HEADER_BYTES):
            columns = list(zip(*map(read_header, heads))) if heads else [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], names=[*batch.schema.names, "width", "height", "depth", "colour"])
    return places.mapInArrow(run, f"{rest}, width long, height long, depth long, colour long")


def describe(payload: bytes) -> str:
    """Feature of the samples: mean, deviation, largest sample, distinct samples and steps between neighbours."""
    samples = np.frombuffer(payload, np.uint8)
    steps = np.abs(np.diff(samples.astype(np.int16))).sum()
    return f"mean={samples.mean():.4f};std={samples.std():.4f};max={samples.max()};kinds={len(np.unique(samples))};steps={steps}"


READ = "payload_bytes long, payload_sha256 binary, tail_crc32 long, feature string"


def payload_columns(places: DataFrame, folder: str) -> DataFrame:
    """``places`` with the size, SHA-256, checksum of the last 64 bytes and feature of each payload, all from the stored bytes.

    An image whose bytes do not have the address it is stored under fails.
    """
    rest = places.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    schema = fixed_schema(READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, images in _ranges(folder, batches, None):
            found = []
            for image, digest in zip(images, batch.column("digest").to_pylist()):
                if hashlib.sha256(image).digest() != digest:
                    raise ValueError("an image does not have its address")
                payload = from_png(image)
                found.append((len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-ROW:]), describe(payload)))
            columns = list(zip(*found)) if found else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, f.type) for c, f in zip(columns, schema))], names=[*batch.schema.names, *schema.names])
    return places.mapInArrow(run, f"{rest}, {READ}")


def media_columns(docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its key and the columns that reading its stored image back gives.

    Every digest is read once: its first place stands for all, so a group of copies costs one read.  Equal texts have
    equal values; rows with a NULL key and equal rows stay rows of their own; an empty table gives an empty table.
    """
    rows = store(docs, folder, key=key, text=text)
    one = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.shard", "p.offset", "p.length")
    places = one.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    read = cut_lineage(payload_columns(header_columns(places, folder), folder), "media_columns")
    joined = rows.select("_key", "_n_bytes", "digest").join(read.drop("shard", "offset"), "digest")
    return joined.select(F.col("_key").alias(key), F.col("_n_bytes").alias("n_bytes"), "payload_bytes", F.lower(F.hex("payload_sha256")).alias("payload_sha256"),
                         "tail_crc32", F.col("length").alias("media_bytes"), F.lower(F.hex("digest")).alias("media_sha256"), "feature", "width", "height", "depth", "colour")
