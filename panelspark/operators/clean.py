"""Outlier flags, modelling cleanup and missing-value reports.  Values are never modified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.contract import DATE, KEY, SPLIT, TICKER, TRAIN, VOLUME
from panelspark.functions import rolling as R
from panelspark.functions.crosssection import with_group_medians
from panelspark.functions.scalar import all_of, any_of, flag

# Outlier thresholds.
HAMPEL_WINDOW, HAMPEL_MIN, HAMPEL_SIGMAS = 63, 20, 6.0
CROSS_SIGMAS, MAD_SCALE = 5.0, 1.4826
ELEVATED, EXTREME = 0.04, 0.08
QUASI_CONSTANT_SHARE = 0.99
SEVERITIES = ("normal", "elevated", "extreme", "data_error")


def data_errors(df: DataFrame, returns: str) -> DataFrame:
    """Negative volume, or a return that is present but not finite.  Runs on the raw column."""
    negative = flag(F.col(VOLUME) < 0)
    x = F.col(returns)
    # NaN is a missing return here; only infinities are invalid.
    infinite = flag(F.abs(x) == float("inf"))
    return df.withColumns({
        "data_error_flag": negative | infinite,
        "data_error_reason": F.concat_ws("|", F.when(negative, "NEGATIVE_VOLUME"), F.when(infinite, "INVALID_RETURN"))})


def hampel_flags(df: DataFrame, returns: str) -> DataFrame:
    """Per ticker: distance from the rolling median above 6 robust sigmas (rolling MAD)."""
    df = df.withColumn("_med", R.median(returns, HAMPEL_WINDOW, HAMPEL_MIN))
    df = df.withColumn("_dev", F.abs(F.col(returns) - F.col("_med")))
    df = df.withColumn("_sigma", MAD_SCALE * R.median("_dev", HAMPEL_WINDOW, HAMPEL_MIN))
    hit = (F.col("_sigma") > 0) & (F.col("_dev") > HAMPEL_SIGMAS * F.col("_sigma"))
    return df.withColumn("ticker_return_extreme_flag", flag(hit)).drop("_med", "_dev", "_sigma")


def cross_section_flags(df: DataFrame, returns: str, split: bool | None = None) -> DataFrame:
    """Per date: deviation from the median above 5 robust sigmas; with MAD 0, any deviation of a
    return of at least 8 %."""
    x = F.col(returns)
    df = with_group_medians(df, [DATE], {"_med": returns}, split)
    df = df.withColumn("_dev", F.abs(x - F.col("_med")))
    df = with_group_medians(df, [DATE], {"_mad": "_dev"}, split)
    sigma = MAD_SCALE * F.col("_mad")
    hit = flag((sigma > 0) & (F.col("_dev") > CROSS_SIGMAS * sigma)) | flag(
        (sigma == 0) & (F.col("_dev") > 0) & (F.abs(x) >= EXTREME))
    return df.withColumn("cross_section_return_extreme_flag", hit).drop("_med", "_dev", "_mad")


def severity(returns: str) -> Column:
    size = F.abs(F.col(returns))
    return (F.when(F.col("data_error_flag"), "data_error")
            .when(F.col("is_outlier_flag") & (size >= EXTREME), "extreme")
            .when(F.col("is_outlier_flag") & (size >= ELEVATED), "elevated").otherwise("normal"))


def apply_outlier_flags(df: DataFrame, returns: str | None = "stock_open_log_return") -> DataFrame:
    """All flags, severity and reason.  Without a return column only data errors are flagged."""
    if returns is None or returns not in df.columns:
        df = df.withColumn("data_error_flag", flag(F.col(VOLUME) < 0))
        return df.withColumns({
            "ticker_return_extreme_flag": F.lit(False), "cross_section_return_extreme_flag": F.lit(False),
            "is_outlier_flag": F.col("data_error_flag"),
            "outlier_severity": F.when(F.col("data_error_flag"), "data_error").otherwise("normal"),
            "outlier_reason": F.when(F.col("data_error_flag"), "NEGATIVE_VOLUME").otherwise("")})
    df = data_errors(df, returns)
    clean = "_clean_return"
    df = df.withColumn(clean, F.when(F.abs(F.col(returns)) < float("inf"), F.col(returns)))
    df = cross_section_flags(hampel_flags(df, clean), clean)
    df = df.withColumn("is_outlier_flag", F.col("data_error_flag") | F.col("ticker_return_extreme_flag")
                       | F.col("cross_section_return_extreme_flag"))
    reason = F.concat_ws("|", F.nullif("data_error_reason", F.lit("")),
                         F.when(F.col("ticker_return_extreme_flag"), "TICKER_RETURN_EXTREME"),
                         F.when(F.col("cross_section_return_extreme_flag"), "CROSS_SECTION_RETURN_EXTREME"))
    return df.withColumns({"outlier_severity": severity(clean), "outlier_reason": reason}).drop("data_error_reason", clean)


def outlier_summaries(flagged: DataFrame, returns: str) -> dict[str, DataFrame]:
    """Data behind the outlier charts: daily rate, count per severity, return histogram by flag."""
    spark = flagged.sparkSession
    levels = spark.createDataFrame([(s,) for s in SEVERITIES], "outlier_severity string")
    counts = flagged.groupBy("outlier_severity").agg(F.count("*").alias("rows"))
    x = F.col(returns)
    return {
        "daily_rate": flagged.groupBy(DATE).agg(F.avg(F.col("is_outlier_flag").cast("double")).alias("outlier_rate")),
        "severity_counts": levels.join(counts, "outlier_severity", "left").select(
            "outlier_severity", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows")),
        "return_histogram": (flagged.where(x.isNotNull())
                             .groupBy("is_outlier_flag", F.width_bucket(x, F.lit(-5.0), F.lit(5.0), F.lit(50)).alias("bucket"))
                             .agg(F.count("*").alias("rows")))}


# --- column-level cleanup: each needs one aggregation over the frame ---------------------------


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: rows, non-missing, missing."""
    names = columns or df.columns
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(c).alias("non_missing")) for c in names])
    return (counts.select(F.inline(pairs)).withColumn("missing", F.col("rows") - F.col("non_missing")))


def missing_report(df: DataFrame) -> DataFrame:
    return (column_stats(df).where("missing > 0")
            .select("column", "missing", (100.0 * F.col("missing") / F.col("rows")).alias("percent")))


def missing_report_by_ticker(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if c not in KEY]
    nulls = sum((F.col(c).isNull().cast("bigint") for c in names), F.lit(0))
    return df.groupBy(TICKER).agg((100.0 * F.sum(nulls) / (F.count("*") * len(names))).alias("percent"))


def drop_rows_missing(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    names = df.columns if required is None else [c for c in required if c in df.columns]
    return df.dropna(subset=names) if names else df


def _counts(df: DataFrame) -> dict[str, tuple[int, int]]:
    """column -> (rows, non-missing); one row per column comes back to the driver."""
    return {x["column"]: (x["rows"], x["non_missing"]) for x in column_stats(df).collect()}


def drop_columns_with_missing(df: DataFrame, protected: tuple[str, ...] = ()) -> DataFrame:
    counts = _counts(df)
    return df.drop(*[c for c, (n, known) in counts.items() if known < n and c not in protected])


def drop_fully_missing(df: DataFrame, protected: tuple[str, ...] = ()) -> DataFrame:
    counts = _counts(df)
    return df.drop(*[c for c, (_, known) in counts.items() if known == 0 and c not in protected])


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: whether it is constant (missing counts as a value), and the share of
    its most frequent value.

    Values are counted per (column, value) first, so a value that fills the whole column is
    already one partial count per task before any shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(
        (F.count("*") <= 1).alias("constant"), (F.max("n") / F.sum("n")).alias("dominant_share"),
        F.coalesce(F.bool_and(F.col("value").isin("0", "1", "0.0", "1.0", "false", "true")), F.lit(False)).alias("binary"))


def uninformative_columns(df: DataFrame, columns: list[str], threshold: float = QUASI_CONSTANT_SHARE) -> list[str]:
    """Constant columns and those one value (or missing) fills to ``threshold`` or more.

    Two aggregations and no shuffle of values: a value that fills more than half of the known rows is
    their median under any order, so the median of the value's hash names the only candidate, whose
    rows the second pass counts exactly.  0/1 indicators only go when constant.
    """
    def digest(c: str) -> Column:
        # 52 bits, which the approximate median keeps exactly.
        return F.shiftrightunsigned(F.xxhash64(c), 12)
    textual = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    binary = {c: F.bool_and(F.col(c).cast("double").isin(0.0, 1.0)) if c not in textual else F.lit(False) for c in columns}
    first = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.struct(F.count(c).alias("known"), F.max(F.when(F.col(c).isNotNull(), digest(c))).alias("high"),
                 F.min(F.when(F.col(c).isNotNull(), digest(c))).alias("least"),
                 F.percentile_approx(F.when(F.col(c).isNotNull(), digest(c)), 0.5, 1000).alias("candidate"), binary[c].alias("binary")).alias(f"c{i}")
        for i, c in enumerate(columns)]).first()
    n = first["n"]
    stats = {c: first[f"c{i}"] for i, c in enumerate(columns)}
    constant = [c for c, x in stats.items() if x["known"] == 0 or (x["known"] == n and x["least"] == x["high"])]
    rest = [c for c in columns if c not in constant and not stats[c]["binary"]]
    if not rest:
        return constant
    second = df.agg(*[F.count_if(F.col(c).isNotNull() & (digest(c) == F.lit(stats[c]["candidate"]))).alias(f"c{i}") for i, c in enumerate(rest)]).first()
    return constant + [c for i, c in enumerate(rest) if max(second[f"c{i}"], n - stats[c]["known"]) >= threshold * n]


def drop_uninformative(df: DataFrame, threshold: float = QUASI_CONSTANT_SHARE) -> DataFrame:
    """Drop constant columns and those one value dominates; 0/1 indicators stay unless constant."""
    return df.drop(*uninformative_columns(df, [c for c in df.columns if c not in KEY], threshold))


DIAGNOSTICS = ("data_error_flag", "is_outlier_flag", "outlier_severity", "outlier_reason")


def drop_data_errors(df: DataFrame) -> DataFrame:
    """Rows without data errors; extreme flags as tinyint, diagnostics gone."""
    if "data_error_flag" in df.columns:
        df = df.where(~F.col("data_error_flag"))
    flags = [c for c in ("ticker_return_extreme_flag", "cross_section_return_extreme_flag") if c in df.columns]
    return df.withColumns({c: F.col(c).cast("tinyint") for c in flags}).drop(*DIAGNOSTICS)


def finalize_modeling_dataset(df: DataFrame) -> DataFrame:
    return drop_uninformative(drop_data_errors(df))


# --- validation: raises with what is wrong --------------------------------------------------------


def require_columns(df: DataFrame, required: tuple[str, ...]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    repeated = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if repeated:
        raise ValueError(f"duplicate column names: {', '.join(repeated)}")


def duplicate_keys(df: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def require_unique_keys(df: DataFrame, keys: tuple[str, ...] = KEY) -> None:
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"duplicate rows for {keys}")


def require_complete(df: DataFrame, columns: tuple[str, ...] | None = None) -> None:
    names = df.columns if columns is None else [c for c in columns if c in df.columns]
    bad = {c: n - known for c, (n, known) in _counts(df.select(*names)).items() if known < n}
    if bad:
        raise ValueError("missing values remain: " + ", ".join(f"{c}={n}" for c, n in bad.items()))


def require_train_only(df: DataFrame, split: str = SPLIT, context: str = "fit") -> DataFrame:
    """Fail when a row outside the train split reaches a fit."""
    other = df.where(~F.col(split).eqNullSafe(TRAIN)).select(split).limit(1).collect()
    if other:
        raise ValueError(f"{context}: expected only train rows, found {other[0][0]!r}")
    return df


# --- ingestion trims --------------------------------------------------------------------------------

RAW_PRICES = ("open", "high", "low", "close", "adj_close", "volume")
SPARSE_COMPANY = ("beta", "market_cap", "trailing_p_e", "price_to_book", "book_value", "trailing_eps", "profit_margins",
                  "return_on_equity", "enterprise_value", "revenue_growth", "current_ratio", "company_name", "sector", "industry")


def drop_high_missing_tickers(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Drop tickers with more than ``threshold`` percent missing price cells."""
    prices = [c for c in RAW_PRICES if c in df.columns] or [c for c in df.columns if c not in KEY]
    nulls = sum((F.col(c).isNull().cast("bigint") for c in prices), F.lit(0))
    bad = (df.groupBy(TICKER).agg((100.0 * F.sum(nulls) / (F.count("*") * len(prices))).alias("_pct"))
           .where(F.col("_pct") > threshold).select(TICKER))
    return df.join(bad, TICKER, "left_anti")


def trim_leading_incomplete_dates(df: DataFrame, ignore: tuple[str, ...] = (*KEY, *RAW_PRICES, *SPARSE_COMPANY)) -> DataFrame:
    """Drop the earliest dates until the first one with no missing feature; none complete, none kept."""
    features = [c for c in df.columns if c not in ignore]
    if not features:
        return df
    whole = all_of([F.col(c).isNotNull() for c in features])
    per_date = df.groupBy(DATE).agg(F.bool_and(whole).alias("_whole"))
    first = per_date.where("_whole").agg(F.min(DATE))
    return df.where(F.col(DATE) >= first.scalar())


def exclude_period(df: DataFrame, start: str, end: str, bridge: int) -> DataFrame:
    """Drop [start, end] and the last ``bridge`` distinct dates before it, whose labels reach in."""
    from panelspark.operators.calendars import day_window, distinct_dates
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    before = distinct_dates(df).where(F.col(DATE) < s)
    bridged = before.withColumn("_k", F.row_number().over(day_window(F.col(DATE).desc()))).where(F.col("_k") <= bridge).select(DATE)
    return df.where(~F.col(DATE).between(s, e)).join(F.broadcast(bridged), DATE, "left_anti")


def not_missing(columns: list[str]) -> Column:
    return ~any_of([F.col(c).isNull() for c in columns])
