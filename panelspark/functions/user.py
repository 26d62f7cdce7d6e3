"""User functions over the panel: rolling aggregates and per-ticker maps in Arrow."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.contract import DATE, TICKER
from panelspark.functions.rolling import last_rows


def rolling_apply(fn: Callable[[np.ndarray], float], n: int, min_periods: int | None = None) -> Callable[[str], Column]:
    """Column function: ``fn`` over the last n rows of the ticker as an array, missing values left out.

    Prefer the built-in rolling functions; this one sends each frame to Python.
    """
    need = n if min_periods is None else min_periods

    @F.pandas_udf(T.DoubleType())
    def apply(frames: pd.Series) -> pd.Series:
        return frames.map(lambda x: fn(np.asarray(x, dtype=float)) if len(x) >= need else None).astype(float)

    def column(name: str) -> Column:
        value = apply(F.collect_list(F.col(name).cast("double")).over(last_rows(n)))
        return F.when(F.count(name).over(last_rows(n)) >= need, value)
    return column


def per_ticker(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` over each ticker's rows in date order; a ticker has at most one row per calendar day."""
    return df.groupBy(TICKER).applyInPandas(lambda rows: fn(rows.sort_values(DATE, ignore_index=True)), schema)
