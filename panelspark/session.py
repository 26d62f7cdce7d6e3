"""Session helpers: scans with missing-value normalisation, staging, size checks."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP_BYTES_CONF = "panelspark.maxGroupBytes"
DEFAULT_GROUP_BYTES = 256 * 1024 * 1024


def input_bytes(df: DataFrame) -> int:
    """Bytes of the stored relations under ``df``, from their file sizes (no job, no planning)."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def group_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_BYTES_CONF, str(DEFAULT_GROUP_BYTES)))


def fits_one_task(df: DataFrame) -> bool:
    """True when all input under ``df`` together is small enough for one task."""
    return input_bytes(df) <= group_limit(df.sparkSession)


def groups_fit(df: DataFrame, by: list[str], columns: list[str], row_bytes: int = 0) -> bool:
    """True when every group of ``by`` is small enough for one task, so that a plain window over it is safe.

    Small input has small groups; otherwise the rows of the largest group are counted, which reads the
    grouping columns alone.  A row counts with the width of ``columns``, ``row_bytes`` at least.  Above the
    limit the callers switch to a plan that splits every group.
    """
    if fits_one_task(df):
        return True
    if not by:
        return False
    largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows")).first()[0] or 0
    width = max(row_bytes, df.select(*dict.fromkeys(columns))._jdf.schema().defaultSize())
    return largest * width <= group_limit(df.sparkSession)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one the cluster names in ``spark.checkpoint.dir``; a private
    folder only in local mode, where nothing else is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="panelspark-")
    return f"{shared.rstrip('/')}/panelspark-{uuid4().hex}/{name}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a Parquet table in the shared folder and read it back.

    It survives the loss of executors, later stages read only the columns they use, and the
    optimizer sees its true size.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def missing_to_null(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """NaN and infinities become NULL in every float column, so operators see one kind of missing."""
    columns = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)) and field.name not in skip:
            c = F.col(f"`{field.name}`")
            columns[field.name] = F.when(F.abs(c) < float("inf"), c)
    return df.withColumns(columns) if columns else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
