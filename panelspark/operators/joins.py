"""Point-in-time, interval and event joins, all built on equi joins and bounded windows.

Ordered windows run per ticker over DATE-grain rows (bounded by the calendar).  Interval
expansion replaces range joins: an interval is unrolled into its days, then matched by
equality, so no nested-loop join appears in any plan.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.contract import DATE, KEY, TICKER
from panelspark.operators.calendars import distinct_dates, session_index, sessions_until

FAR = 252.0
FOREVER = 2**31 - 2  # the last day of an open validity, in days since 1970


def merge_date_frames(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, DATE, "full_outer"), frames)


def attach_date_features(panel: DataFrame, date_frame: DataFrame) -> DataFrame:
    """Many-to-one on date; the right side has one row per day."""
    return panel.join(F.broadcast(date_frame), DATE, "left")


def asof_backward(left: DataFrame, right: DataFrame, by: str = TICKER, on: str = DATE) -> DataFrame:
    """Latest right row with ``on`` <= the left one, per key, exact matches allowed.

    The whole matched row is carried, NULLs included.  Several right rows on one (key, date)
    are reduced to the last by all columns before the window, so a key holds at most two rows
    per calendar day there.
    """
    values = [c for c in right.columns if c not in (by, on)]
    payload = F.struct(*values)
    tagged_right = (right.groupBy(by, on).agg(F.max(payload).alias("_r"))
                    .select(by, on, F.lit(0).alias("_side"), "_r",
                            F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_l")))
    tagged_left = left.select(by, on, F.lit(1).alias("_side"),
                              F.lit(None).cast(right.select(payload).schema[0].dataType).alias("_r"),
                              F.struct(*left.columns).alias("_l"))
    w = Window.partitionBy(by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    matched = tagged_right.unionByName(tagged_left).withColumn("_m", F.last("_r", True).over(w))
    return (matched.where(F.col("_side") == 1)
            .select("_l.*", *[F.col("_m")[v].alias(v) for v in values]))


def expand_intervals(intervals: DataFrame, sessions: DataFrame, start: str = "start_date", end: str = "end_date",
                     key: str = TICKER) -> DataFrame:
    """Distinct (date, key) for every session inside an interval.

    Intervals are clipped to the first and last session before they are unrolled, so an open end costs no
    more days than the calendar has, and those of one key are merged, so a day is unrolled once and the days
    need no shuffle.
    """
    dates = distinct_dates(sessions)
    first, last = (dates.agg(f(DATE)).scalar() for f in (F.min, F.max))
    clipped = (intervals.where(F.col(start) <= F.col(end))
               .select(key, F.greatest(F.col(start), first).alias("_from"), F.least(F.col(end), last).alias("_to"))
               .where(F.col("_from") <= F.col("_to")))
    merged = merge_intervals(clipped, key, "_from", "_to")
    days = merged.select(key, F.explode(F.sequence("_from", "_to")).alias(DATE))
    return days.join(F.broadcast(dates), DATE, "left_semi").select(DATE, key)


def intersect_intervals(membership: DataFrame, specs: DataFrame, pipeline_end: Column, group: str = "stock_cash",
                        max_spread: float | None = None) -> DataFrame:
    """Membership x instrument validity per ticker, clipped to the overlap; empty overlaps go."""
    chosen = specs.where((F.col("instrument_group") == group) & ~F.col("symbol").startswith("__default"))
    if max_spread is not None:
        chosen = chosen.where(F.col("spread_bps") <= max_spread)
    chosen = chosen.select(F.upper("symbol").alias("_symbol"), F.col("effective_from").alias("_from"),
                           F.coalesce("effective_to", pipeline_end).alias("_to"))
    return (membership.withColumn("_symbol", F.upper(TICKER)).join(chosen, "_symbol")
            .select(TICKER, F.greatest("start_date", "_from").alias("start_date"),
                    F.least("end_date", "_to").alias("end_date"))
            .where(F.col("start_date") <= F.col("end_date")).distinct())


def calendar_spine(prices: DataFrame, sessions: DataFrame, fill: list[str] | None = None) -> DataFrame:
    """Every ticker on every session between the panel's bounds, prices where known.

    The spine is an explode per ticker and a semi join on the session dates.  ``fill`` columns
    are carried forward without limit.
    """
    bounds = sessions.agg(F.min(DATE).alias("_s"), F.max(DATE).alias("_e")).first()
    spine = (prices.select(TICKER).distinct()
             .select(TICKER, F.explode(F.sequence(F.lit(bounds["_s"]), F.lit(bounds["_e"]))).alias(DATE))
             .join(F.broadcast(distinct_dates(sessions)), DATE, "left_semi"))
    out = spine.join(prices, list(KEY), "left")
    if fill:
        w = Window.partitionBy(TICKER).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({c: F.last(c, True).over(w) for c in fill})
    return out


def _standing(versions: pd.DataFrame) -> pd.DataFrame:
    """One symbol's versions -> the days from which another version stands (NULL start: none).

    Versions are stacked by start; the top one stands until it ends or a later one starts, and every version is pushed and
    popped once."""
    ordered = versions.sort_values(["_start", "_open"], ascending=[True, False])
    stack, changes = [], {}

    def settle(until: int) -> None:
        while stack and stack[-1][2] < until:
            day = stack.pop()[2] + 1
            while stack and stack[-1][2] < day:
                stack.pop()
            changes[day] = stack[-1] if stack else (None, None, None)

    for row in zip(ordered["_start"].tolist(), ordered["_open"].tolist(), ordered["_end"].tolist()):
        settle(row[0])
        stack.append(row)
        changes[row[0]] = row
    settle(FOREVER)
    return pd.DataFrame({
        "_symbol": versions["_symbol"].iloc[0], "_since": list(changes), "_start": pd.array([x[0] for x in changes.values()], "Int32"),
        "_open": pd.array([x[1] for x in changes.values()], "boolean")})


def validity_pieces(specs: DataFrame, fields: list[str]) -> DataFrame:
    """(_symbol, _since, _spec): each symbol's history cut once into pieces without overlap.

    On a day the valid version of latest start stands (equal starts: the one of latest end, an open end last; then the larger fields);
    ``_spec.found`` is false where none is valid.  Of versions with one start only the closed one of latest end and the open one
    can ever stand, so a symbol has at most two versions a day before its history is walked."""
    start, end = F.col("effective_from").cast("date"), F.col("effective_to").cast("date")
    values = F.struct(*fields)
    versions = (specs.where(start.isNotNull() & (end.isNull() | (start <= end)))
                .groupBy(F.upper("symbol").alias("_symbol"), F.unix_date(start).alias("_start"), end.isNull().alias("_open"))
                .agg(F.max(F.struct(F.unix_date(end).alias("end"), values.alias("values"))).alias("_best"))
                .select("_symbol", "_start", "_open", F.coalesce("_best.end", F.lit(FOREVER)).alias("_end"), F.col("_best.values").alias("_values"))
                .where(F.col("_symbol").isNotNull()))
    pieces = versions.drop("_values").groupBy("_symbol").applyInPandas(_standing, "_symbol string, _since int, _start int, _open boolean")
    return (pieces.join(versions.drop("_end"), ["_symbol", "_start", "_open"], "left")
            .select("_symbol", "_since", F.struct(F.col("_start").isNotNull().alias("found"), F.col("_values").alias("values")).alias("_spec")))


def validity_lookup(panel: DataFrame, specs: DataFrame, fields: list[str], default: dict[str, object] | None = None,
                    key: str = TICKER) -> DataFrame:
    """Most recent spec row valid on the row's date (equal validity: the larger fields win);
    ``default`` fills rows without one, and without a default a missing spec is an error (raised when the row is evaluated).

    Versions become pieces without overlap first, so a row meets one piece however many versions its symbol has."""
    pieces = validity_pieces(specs, fields)
    points = panel.select(*KEY, F.upper(key).alias("_symbol")).where("_symbol IS NOT NULL").distinct()
    marks = (points.withColumn("_since", F.unix_date(DATE))
             .unionByName(pieces.withColumn("_piece", F.lit(True)), allowMissingColumns=True))
    # On one day the piece comes before the rows that it covers.
    w = Window.partitionBy("_symbol").orderBy("_since", F.col("_piece").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    met = marks.withColumn("_spec", F.last("_spec", True).over(w)).where(F.col("_piece").isNull() & F.col("_spec.found"))
    out = panel.join(met.groupBy(*KEY).agg(F.max("_spec").alias("_spec")), list(KEY), "left")
    columns = {}
    for f in fields:
        found = F.col("_spec")["values"][f]
        if default is None:
            columns[f] = F.when(F.col("_spec").isNull(), F.raise_error(
                F.concat(F.lit("no instrument spec for "), F.col(key)))).otherwise(found)
        else:
            columns[f] = F.when(F.col("_spec").isNull(), F.lit(default[f])).otherwise(found)
    return out.withColumns(columns).drop("_spec")


def symbols_available(specs: DataFrame, start: Column, end: Column, group: str | None = None) -> DataFrame:
    chosen = specs.where(~F.col("symbol").startswith("__default") & (F.col("effective_from") <= end)
                         & (F.col("effective_to").isNull() | (F.col("effective_to") >= start)))
    if group is not None:
        chosen = chosen.where(F.col("instrument_group") == group)
    return chosen.select(F.upper("symbol").alias("symbol")).distinct()


def tradable_universe(frame: DataFrame, specs: DataFrame, trade_date: Column, group: str | None = None) -> DataFrame:
    """Distinct tickers with a spec valid on the trade date."""
    live = symbols_available(specs, trade_date, trade_date, group)
    return (frame.select(TICKER).distinct().withColumn("symbol", F.upper(TICKER))
            .join(live, "symbol", "left_semi").select(TICKER))


def effective_sessions(events: DataFrame, sessions: DataFrame, date: str = "announcement_date",
                       session: str = "announcement_session") -> DataFrame:
    """Add the 0-based ``session_index`` an event acts on: before_open the first session >= its
    date, after_close the first one > it.  Events beyond the calendar are dropped."""
    counts = sessions_until(events.select(F.col(date).alias(DATE)), sessions).withColumnRenamed(DATE, date)
    index = F.when(F.col(session) == "after_close", F.col("upto")).otherwise(F.col("before"))
    return (events.join(F.broadcast(counts), date).withColumn("session_index", index.cast("bigint"))
            .where(F.col("session_index") < F.col("total")).drop("upto", "before", "total"))


def event_neighbours(panel: DataFrame, events: DataFrame, index: str = "session_index") -> DataFrame:
    """Add ``next_distance`` / ``prev_distance``: sessions to the nearest event of the ticker on
    each side (0 on the session itself), NULL without one."""
    points = panel.select(TICKER, index).distinct().withColumn("_event", F.lit(None).cast("bigint"))
    marks = points.unionByName(events.select(TICKER, index).distinct().withColumn("_event", F.col(index)))
    marks = marks.groupBy(TICKER, index).agg(F.max("_event").alias("_event"))
    w = Window.partitionBy(TICKER).orderBy(index)
    near = marks.select(
        TICKER, index,
        (F.first("_event", True).over(w.rowsBetween(0, Window.unboundedFollowing)) - F.col(index)).cast("double").alias("next_distance"),
        (F.col(index) - F.last("_event", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("double").alias("prev_distance"))
    return panel.join(near, [TICKER, index], "left")


def shift_to_availability(observations: DataFrame, sessions: DataFrame, lag: Column | int, key: str = "series") -> DataFrame:
    """(key, date, value) at the lag-th session strictly after each ``obs_date``; observations
    landing on one session keep the latest, those beyond the calendar are dropped."""
    counts = sessions_until(observations.select(F.col("obs_date").alias(DATE)), sessions)
    counts = counts.select(F.col(DATE).alias("obs_date"), "upto")
    lag = F.lit(lag) if isinstance(lag, int) else lag
    placed = (observations.where(F.col("value").isNotNull()).join(F.broadcast(counts), "obs_date")
              .withColumn("session_index", (F.col("upto") + lag - 1).cast("bigint"))
              .join(F.broadcast(session_index(distinct_dates(sessions))), "session_index"))
    return placed.groupBy(key, DATE).agg(F.max_by("value", "obs_date").alias("value"))


def merge_intervals(intervals: DataFrame, key: str = TICKER, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Union of touching or overlapping intervals per key (gap of one day still touches).

    Equal intervals are reduced first, so a key holds at most one row per start date.
    """
    unique = intervals.groupBy(key, start).agg(F.max(end).alias(end))
    w = Window.partitionBy(key).orderBy(start)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = unique.withColumn("_new", F.when(F.col(start) <= F.date_add(reach, 1), 0).otherwise(1))
    marked = marked.withColumn("_island", F.sum("_new").over(w))
    return marked.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def snapshots_to_intervals(snapshots: DataFrame, final_end: Column, members: str = "tickers") -> DataFrame:
    """Dated comma-separated lists -> (ticker, start_date, end_date): a list holds until the day
    before the next one, the last until ``final_end``."""
    w = Window.partitionBy(F.lit(0)).orderBy(DATE)
    dates = distinct_dates(snapshots).select(
        DATE, F.coalesce(F.date_sub(F.lead(DATE).over(w), 1), final_end).alias("end_date"))
    return (snapshots.join(F.broadcast(dates), DATE)
            .select(F.explode(F.split(members, ",")).alias(TICKER), F.col(DATE).alias("start_date"), "end_date")
            .withColumn(TICKER, F.trim(TICKER)))


def aligned(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """One row with the number of key rows found on one side only; 0 means columns may be bound."""
    a = left.select(*keys).withColumn("_a", F.lit(1))
    b = right.select(*keys).withColumn("_b", F.lit(1))
    return a.join(b, list(keys), "full_outer").agg(
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"), F.count("*").alias("rows"))


def bind_columns(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Attach the right frame's columns; a key missing on either side is an error."""
    a = left.withColumn("_a", F.lit(1))
    b = right.withColumn("_b", F.lit(1))
    joined = a.join(b, list(keys), "full_outer")
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    guard = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("frames are not aligned on their keys")).cast("boolean"))
    return joined.where(guard).drop("_a", "_b")
