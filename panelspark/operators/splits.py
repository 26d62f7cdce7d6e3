"""Splits, folds, windows and samples as small date tables joined to the panel.

Every frame built here has one row per date (times a fixed number of folds), so its ordered
windows and broadcasts are bounded by the calendar; the panel itself is only ever joined.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.contract import DATE, EXECUTION_LAG, KEY, LABEL_EMBARGO, SPLIT, TEST, TICKER, TRAIN, VAL
from panelspark.functions.crosssection import with_text_position
from panelspark.operators.calendars import business_days_before, day_window, distinct_dates, session_index

VAL_FRACTION = 0.30


def _split_name(position: Column, count: Column, embargo: int, val_fraction: float) -> Column:
    """Split of the position-th of ``count`` eligible dates (1-based)."""
    cut = count - F.greatest(F.lit(1), F.bround(F.lit(val_fraction) * count, 0))
    contiguous = F.when(position <= cut, TRAIN).otherwise(VAL)
    purged = F.when(position <= cut - embargo, TRAIN).when(position > cut, VAL)
    return F.when(cut <= embargo, contiguous).otherwise(purged)


def assign_splits(df: DataFrame, test_start: str, embargo: int = LABEL_EMBARGO, val_fraction: float = VAL_FRACTION,
                  scope: str = "global") -> DataFrame:
    """Add ``dataset_split``; purged rows go.  ``scope='ticker'`` cuts inside each ticker's history."""
    start = F.lit(test_start).cast("date")
    cutoff = business_days_before(start, embargo)
    by = [TICKER] if scope == "ticker" else []
    dates = df.select(*by, DATE).distinct()
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    eligible = F.when(F.col(DATE) < cutoff, F.lit(1))
    position = F.count(eligible).over(group.orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0))
    dates = dates.withColumns({"_position": position, "_count": F.count(eligible).over(group)})
    name = F.when(F.col(DATE) >= start, TEST).when(
        F.col(DATE) < cutoff, _split_name(F.col("_position"), F.col("_count"), embargo, val_fraction))
    table = dates.select(*by, DATE, name.alias(SPLIT)).where(F.col(SPLIT).isNotNull())
    return df.join(table if by else F.broadcast(table), [*by, DATE])


def chunk_dates(dates: DataFrame, k: int, name: str = "chunk") -> DataFrame:
    """k near-equal runs of the ordered dates, the first n mod k one longer; plus a 1-based index."""
    w = day_window()
    return dates.select(DATE, F.ntile(k).over(w).alias(name), F.row_number().over(w).alias("index"))


def selection_folds(train_dates: DataFrame, k: int, embargo: int = LABEL_EMBARGO) -> DataFrame:
    """(fold, role, date): fold i validates chunk i + 1 of k + 1 and trains on all earlier dates
    but the last ``embargo``."""
    chunks = chunk_dates(train_dates, k + 1)
    starts = chunks.where("chunk > 1").groupBy((F.col("chunk") - 1).alias("fold")).agg(F.min("index").alias("start"))
    validation = chunks.where("chunk > 1").select((F.col("chunk") - 1).alias("fold"), F.lit("validation").alias("role"), DATE)
    train = (chunks.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k)))).join(F.broadcast(starts), "fold")
             .where(F.col("index") < F.col("start") - embargo).select("fold", F.lit("train").alias("role"), DATE))
    return train.unionByName(validation)


def walk_forward_folds(dates: DataFrame, k: int, embargo: int = LABEL_EMBARGO) -> DataFrame:
    """(fold, role, date) from (date, dataset_split): chunks of the validation dates, each with all
    train dates and earlier validation dates but the last ``embargo`` of them."""
    chunks = chunk_dates(dates.where(F.col(SPLIT) == VAL).select(DATE), k, "fold").select(DATE, "fold")
    starts = chunks.groupBy("fold").agg(F.min(DATE).alias("start"))
    candidates = (dates.where(F.col(SPLIT).isin(TRAIN, VAL)).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
                  .join(F.broadcast(starts), "fold").where((F.col(SPLIT) == TRAIN) | (F.col(DATE) < F.col("start"))))
    newest = Window.partitionBy("fold").orderBy(F.col(DATE).desc())
    train = (candidates.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") > embargo)
             .select("fold", F.lit("train").alias("role"), DATE))
    return train.unionByName(chunks.select("fold", F.lit("validation").alias("role"), DATE))


def train_only_walk_forward_folds(train_dates: DataFrame, k: int, embargo: int = LABEL_EMBARGO) -> DataFrame:
    """Without validation rows the chunks come from the train dates themselves."""
    chunks = chunk_dates(train_dates, k, "fold")
    starts = chunks.groupBy("fold").agg(F.min("index").alias("start"))
    train = (chunks.drop("fold").withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k)))).join(F.broadcast(starts), "fold")
             .where(F.col("index") < F.col("start") - embargo).select("fold", F.lit("train").alias("role"), DATE))
    return train.unionByName(chunks.select("fold", F.lit("validation").alias("role"), DATE))


def meta_folds(oos_dates: DataFrame, k: int, embargo: int = LABEL_EMBARGO) -> DataFrame:
    """(fold, train_cutoff, date): cutoff = the date ``embargo`` + 1 before the fold; folds with too
    little history are skipped."""
    chunks = chunk_dates(oos_dates, k, "fold")
    starts = chunks.groupBy("fold").agg((F.min("index") - embargo - 1).alias("cutoff_index"))
    cutoffs = starts.join(chunks.select(F.col("index").alias("cutoff_index"), F.col(DATE).alias("train_cutoff")), "cutoff_index")
    return chunks.join(F.broadcast(cutoffs.drop("cutoff_index")), "fold").select("fold", "train_cutoff", DATE)


def require_two_sided(folds: DataFrame) -> DataFrame:
    """Fail when a fold lacks a train or a validation side."""
    sides = folds.groupBy("fold").agg(F.count_distinct("role").alias("sides")).where("sides < 2").limit(1).collect()
    if sides:
        raise ValueError(f"fold {sides[0]['fold']} has an empty train or validation side")
    return folds


def fold_rows(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Panel rows per fold and role; the fold table has dates x folds rows."""
    return panel.join(F.broadcast(folds), DATE)


def train_windows(train_dates: DataFrame, seed: int, tail_fraction: float = 0.67, random_windows: int = 1,
                  minimum_fraction: float = 0.60) -> DataFrame:
    """(window, start, end, dates): the full range, its recent tail and seeded random runs, without
    repeats.  Only the number of dates reaches the driver."""
    indexed = session_index(train_dates, start=1)
    n = indexed.count()
    rng = np.random.default_rng(seed)
    windows = {"full": (1, n)}
    tail = max(1, ceil(n * tail_fraction))
    if tail < n:
        windows["recent_tail"] = (n - tail + 1, n)
    for i in range(random_windows):
        size = max(1, ceil(n * float(rng.uniform(minimum_fraction, 0.95))))
        first = int(rng.integers(0, max(0, n - size) + 1)) + 1
        if size < n:
            windows[f"random_window_{i + 1}"] = (first, first + size - 1)
    unique = {bounds: name for name, bounds in reversed(windows.items())}
    rows = [(name, a, b) for (a, b), name in unique.items()]
    bounds = train_dates.sparkSession.createDataFrame(rows, "window string, first long, last long")
    ends = indexed.withColumnRenamed("session_index", "i")
    return (bounds.join(ends.select(F.col("i").alias("first"), F.col(DATE).alias("start")), "first")
            .join(ends.select(F.col("i").alias("last"), F.col(DATE).alias("end")), "last")
            .select("window", "start", "end", (F.col("last") - F.col("first") + 1).alias("dates")))


def available_training_frame(df: DataFrame, prediction_date: str, embargo: int = LABEL_EMBARGO) -> DataFrame:
    """Rows whose label is known at the prediction date: date index <= its index - embargo."""
    indexed = session_index(distinct_dates(df))
    at = indexed.where(F.col(DATE) == F.lit(prediction_date).cast("date")).first()
    if at is None:
        raise ValueError(f"prediction date {prediction_date} is not in the data")
    if at["session_index"] < embargo:
        raise ValueError("not enough dates before the prediction date for the label embargo")
    allowed = indexed.where(F.col("session_index") <= at["session_index"] - embargo).select(DATE)
    return df.join(F.broadcast(allowed), DATE, "left_semi")


def date_share(dates: DataFrame, fraction: float, side: str) -> DataFrame:
    """(date, inside): whether a date belongs to the first / last ceil(fraction * n) dates, at least one."""
    w, whole = day_window(), Window.partitionBy(F.lit(0))
    size = F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.count("*").over(whole)))
    position, count = F.row_number().over(w), F.count("*").over(whole)
    inside = position <= size if side == "first" else position > count - size
    return dates.select(DATE, inside.alias("inside"))


def early_stopping_split(df: DataFrame, fraction: float = 0.15) -> DataFrame:
    """Add ``eval_row``: rows on the last ceil(fraction * n) dates, always leaving one date to fit;
    with fewer than 3 dates nothing is held out."""
    whole = Window.partitionBy(F.lit(0))
    n = F.count("*").over(whole)
    size = F.least(F.greatest(F.lit(1), F.ceil(F.lit(fraction) * n)), n - 1)
    marks = distinct_dates(df).select(DATE, ((n >= 3) & (F.row_number().over(day_window()) > n - size)).alias("eval_row"))
    return df.join(F.broadcast(marks), DATE)


def execution_dates(dates: DataFrame, lag: int = EXECUTION_LAG) -> DataFrame:
    """(signal_date, execution_date): the lag-th next date; the last ``lag`` dates drop out."""
    return (dates.select(F.col(DATE).alias("signal_date"), F.lead(DATE, lag).over(day_window()).alias("execution_date"))
            .where(F.col("execution_date").isNotNull()))


def shift_to_execution(predictions: DataFrame, lag: int = EXECUTION_LAG) -> DataFrame:
    """Move predictions to their execution date, keeping ``signal_date``."""
    moves = execution_dates(distinct_dates(predictions), lag)
    return (predictions.withColumnRenamed(DATE, "signal_date").join(F.broadcast(moves), "signal_date")
            .withColumnRenamed("execution_date", DATE))


def train_and_test(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(SPLIT) == TRAIN), df.where(F.col(SPLIT) == TEST)


# --- samples ------------------------------------------------------------------------------------------


def spaced_positions(count: Column, samples: Column) -> Column:
    """Array of distinct evenly spaced 0-based positions, truncated, both ends included."""
    step = F.try_divide((count - 1).cast("double"), (samples - 1).cast("double"))
    inner = F.transform(F.sequence(F.lit(0).cast("bigint"), samples.cast("bigint") - 1),
                        lambda i: F.when(i == samples - 1, count - 1).otherwise(F.floor(i * F.coalesce(step, F.lit(0.0)))))
    single = F.array(F.lit(0).cast("bigint"))
    return F.array_distinct(F.when(samples <= 1, single).otherwise(inner.cast("array<bigint>")))


def temporal_date_sample(train_dates: DataFrame, fraction: float, minimum: int) -> DataFrame:
    """Evenly spaced distinct train dates: max(minimum, ceil(fraction * n)) of them at most."""
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    wanted = F.least(n, F.greatest(F.lit(minimum), F.ceil(F.lit(fraction) * n)))
    indexed = train_dates.select(DATE, (F.row_number().over(day_window()) - 1).cast("bigint").alias("_i"),
                                 n.alias("_n"), wanted.alias("_wanted"))
    positions = indexed.agg(F.max("_n").alias("n"), F.max("_wanted").alias("w")).select(
        F.explode(spaced_positions(F.col("n"), F.col("w"))).alias("_i"))
    return indexed.join(F.broadcast(positions), "_i", "left_semi").select(DATE)


def seeded_row_sample(df: DataFrame, rows: int, seed: int, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Uniform sample without replacement: the ``rows`` smallest keyed hashes.

    A threshold on the hash, ten standard deviations above the wanted count, leaves only about
    ``rows`` candidates on the whole cluster before they are ordered.
    """
    total = df.count()
    if total <= rows:
        return df
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    marked = df.withColumn("_draw", draw)
    share = (rows + 10 * sqrt(rows) + 100) / total
    if share < 1.0:
        marked = marked.where(F.col("_draw") < format(int(share * 16**12), "012x"))
    return marked.orderBy("_draw").limit(rows).drop("_draw")


def temporal_row_sample(df: DataFrame, rows: int, minimum_dates: int = 1) -> DataFrame:
    """Rows spread over evenly spaced dates: equal quota per date, evenly spaced inside the date."""
    per_date = df.groupBy(DATE).agg(F.count("*").alias("_available"))
    whole = Window.partitionBy(F.lit(0))
    typical = F.greatest(F.lit(1), F.floor(F.percentile("_available", F.lit(0.5)).over(whole)))
    n = F.count("*").over(whole)
    wanted = F.least(n, F.greatest(F.lit(minimum_dates), F.ceil(F.lit(float(rows)) / typical)))
    marked = per_date.select(DATE, "_available", (F.row_number().over(day_window()) - 1).cast("bigint").alias("_i"),
                             n.alias("_n"), wanted.alias("_wanted"))
    chosen = marked.agg(F.max("_n").alias("n"), F.max("_wanted").alias("w")).select(
        spaced_positions(F.col("n"), F.col("w")).alias("_p")).select(F.size("_p").alias("_dates"), F.posexplode("_p").alias("_offset", "_i"))
    quota = F.floor(F.lit(rows) / F.col("_dates")) + F.when(F.col("_offset") < F.lit(rows) % F.col("_dates"), 1).otherwise(0)
    plan = marked.join(F.broadcast(chosen), "_i").select(
        DATE, F.explode(spaced_positions(F.col("_available"), F.least("_available", F.greatest(F.lit(1), quota)))).alias("_row"))
    placed = with_text_position(df.join(F.broadcast(plan.select(DATE).distinct()), DATE, "left_semi"), [DATE], TICKER, "_pos")
    return placed.withColumn("_row", F.col("_pos") - 1).join(plan, [DATE, "_row"], "left_semi").drop("_pos", "_row")
