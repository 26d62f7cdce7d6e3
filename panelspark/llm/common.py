"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import cut_lineage, scratch_folder

__all__ = ["BATCH_BYTES", "CHUNK_BYTES", "WORD", "Recent", "bounded_batches", "chunks", "column_like", "cut_lineage", "documents", "fixed_schema", "gather", "kept_in_worker", "lower_ascii", "mix64",
           "scratch_folder", "table", "utf8", "word_count", "words_in"]

#: A word: anything but the six white-space bytes of ASCII.
WORD = r"[^\x20\x09-\x0D]+"
#: Text that a task handles at once; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes that Spark sends to a Python worker at once, in the JVM and in Python; a longer single row is a batch of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes (by default only their rows are), unless they already are tighter."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "documents").select(*columns)


def word_count(text: str) -> Column:
    """Number of words of a text column, 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def fixed_schema(schema: str) -> pa.Schema:
    """``"a long, b string"`` as the Arrow schema that Spark expects back."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
             "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(","))])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text or binary column and its n + 1 offsets; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, wide)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of text, so that memory does not follow the batch size."""
    _, ends = utf8(batch.column(text))
    first = 0
    while first < len(batch):
        last = int(np.searchsorted(ends, ends[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(batch))
        yield batch.slice(first, last - first)
        first = last


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return LOWER[raw]


def words_in(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in concatenated texts, and the number of words of each text.

    A word never crosses the border of two texts.
    """
    n = len(raw)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(ends) - 1, np.int64)
    solid = ~SPACE[raw]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    borders = ends[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    starts[borders] = solid[borders]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    stops[borders - 1] = solid[borders - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    counts = np.diff(np.searchsorted(first, ends))
    return first, last, counts


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 one); wraps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One random odd base for polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def powers_of_base(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base, and of its inverse, for hashes of spans from one running sum."""
    return _powers(BASE, n), _powers(INVERSE, n)


def word_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: differences of one running polynomial sum, so no word becomes an object."""
    letters = mix64(np.arange(1, 257, dtype=np.uint64))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(letters[raw] * _powers(BASE, len(raw)), out=total[1:])
    spread = _powers(INVERSE, len(raw) + 1)
    return mix64((total[last] - total[first]) * spread[first] + (last - first).astype(np.uint64))


def column_like(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return df["`" + name.replace("`", "``") + "`"]


def kept_in_worker(key: object, make: Callable[[], Any]) -> Any:
    """An object that a Python process builds once and keeps for later tasks, whose functions are unpickled anew."""
    kept = vars(sys.modules.setdefault("panelspark_kept", ModuleType("panelspark_kept"))).setdefault("objects", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


class Recent:
    """A dictionary of two generations: when the younger is full it becomes the older, whose unused entries go."""

    def __init__(self, size: int) -> None:
        self.young, self.old, self.size = {}, {}, size // 2

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value


def gather(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size[i]`` values from ``at[i]`` on, for all i in a row."""
    before = np.cumsum(size) - size
    return values[np.repeat(at - before, size) + np.arange(int(size.sum()))]
