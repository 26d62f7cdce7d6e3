"""Cross-sections (all rows of one date, date x sector, ...) that survive a hot group.

Group means and deviations are partial aggregates joined back.  Ranks, medians and
cumulative sums need an order inside the group; ``cumulative_by_value`` splits every group
by ranges of the value, so no task ever holds a whole group, and copies of one
value are aggregated before they are ordered.  The split plans store the narrow frames they
read more than once.  When the largest group is below the size limit, a plain window is
cheaper at any number of groups and used instead; both give the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.contract import DATE, KEY
from panelspark.functions.scalar import clip, col, ratio
from panelspark.session import cut_lineage, groups_fit

BINS_PER_E_FOLD = 256
WIDE = 64
#: Bytes that exact percentiles hold for a value.
VALUE_BYTES = 128


def join_back(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Attach one row per group.  One row per date is bounded by the calendar, so it is
    broadcast; any other grouping is left to the optimizer's own size check."""
    return df.join(F.broadcast(small) if keys == [DATE] else small, keys, how)


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL, as in a window partition; still an equi-join."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    equal = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(named, equal, how).drop(*[f"_right_{k}" for k in keys])


def with_group_stats(df: DataFrame, keys: list[str], stats: dict[str, Column]) -> DataFrame:
    grouped = df.groupBy(*keys).agg(*[c.alias(name) for name, c in stats.items()])
    return join_back(df, grouped, keys)


def monotone_bin(c: Column) -> Column:
    """Integer that never decreases as ``c`` grows in sort order; ~0.4 % wide bins on a log scale.

    Infinities lie beyond all numbers and NaN above them; NULL has no bin.
    """
    c = c.cast("double")
    magnitude = F.floor(F.log(F.abs(c)) * BINS_PER_E_FOLD) + 800 * BINS_PER_E_FOLD
    finite = F.when(c > 0, magnitude).when(c < 0, -magnitude).when(c == 0, F.lit(0))
    return (F.when(F.isnan(c), F.lit(1 << 41)).when(c == float("inf"), F.lit(1 << 40)).when(c == float("-inf"), F.lit(-(1 << 40)))
            .otherwise(finite).cast("bigint"))


def cumulative_by_value(df: DataFrame, by: list[str], value: str, measures: dict[str, Column],
                        descending: bool = False, split: bool | None = None) -> DataFrame:
    """One row per (group, distinct value): each measure m as an aggregate, ``m_before`` its
    sum over all smaller (or larger) values of the group and ``m_total`` over the group."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    values = (df.where(F.col(value).isNotNull()).groupBy(*by, value)
              .agg(*[c.alias(m) for m, c in measures.items()]))
    if split is None:
        split = not by or not groups_fit(df, by, [*by, value])
    if not split:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return values.withColumns(
            {f"{m}_before": F.coalesce(F.sum(m).over(w), F.lit(0)) for m in measures}
            | {f"{m}_total": F.sum(m).over(Window.partitionBy(*by)) for m in measures})
    bin_order = F.col("_bin").desc() if descending else F.col("_bin").asc()
    # Ranges of (group, value) with borders drawn from the data, so values in a narrow band are spread like any others.
    values = cut_lineage(values.repartitionByRange(*[F.col(c) for c in by], F.col(value)).withColumn("_bin", F.spark_partition_id()), "values")
    # A group has at most one bin per partition, so this window stays small.
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy(bin_order).rowsBetween(Window.unboundedPreceding, -1)
    bins = values.groupBy(*by, "_bin").agg(*[F.sum(m).alias(m) for m in measures])
    bins = bins.select(
        *by, "_bin",
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_{m}_bin") for m in measures],
        *[F.sum(m).over(group).alias(f"{m}_total") for m in measures])
    inside = Window.partitionBy(*by, "_bin").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (join_groups(values, bins, [*by, "_bin"])
            .withColumns({f"{m}_before": F.col(f"_{m}_bin") + F.coalesce(F.sum(m).over(inside), F.lit(0))
                          for m in measures})
            .drop("_bin", *[f"_{m}_bin" for m in measures]))


def average_rank(c: Column, by: list) -> Column:
    """Rank inside the group, ties share their mean rank; NULL stays NULL.  Plain window."""
    w = Window.partitionBy(*by).orderBy(c.asc_nulls_last())
    # Equal values are the peers of a row in the order of its rank, so one sort gives both.
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(c.isNotNull(), F.rank().over(w) + (ties - 1) / 2.0)


def with_group_ranks(df: DataFrame, by: list[str], ranks: dict[str, str], pct: bool = True,
                     split: bool | None = None, row_key: tuple[str, ...] = KEY) -> DataFrame:
    """Add ``out`` = average-tie rank of column ``source`` inside the group, over the number of
    non-missing values when ``pct``.  ``ranks`` maps out -> source.

    Rows with a NULL in ``by`` are a group like any other.  Where ``row_key`` repeats, every row has the
    rank of its own values, because a rank follows from group and value.
    """
    if split is None:
        split = not groups_fit(df, by, [*row_key, *by, *ranks.values()])
    if not split:
        out = {}
        for name, source in ranks.items():
            rank = average_rank(F.col(source), by)
            out[name] = rank / F.count(source).over(Window.partitionBy(*by)) if pct else rank
        needed = list(dict.fromkeys([*row_key, *by, *ranks.values()]))
        if len(df.columns) <= len(needed) + WIDE:
            return df.withColumns(out)
        # Sort narrow rows once per ranked column, then attach the ranks to the wide ones.
        named = list(dict.fromkeys([*row_key, *by]))
        ranked = df.select(*needed).withColumns(out).select(*named, row_values(ranks).alias("_values"), *out)
        return join_groups(df.withColumn("_values", row_values(ranks)), ranked.dropDuplicates([*named, "_values"]), [*named, "_values"], "left").drop("_values")
    # All ranked columns go through one long pipeline: a fixed number of shuffles for any width.
    keys = list(dict.fromkeys([*row_key, *by]))
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.col(source).cast("double").alias("x"))
                      for name, source in ranks.items()])
    df = df.withColumn("_values", row_values(ranks))
    keys.append("_values")
    long = (df.select(*keys, F.explode(pairs).alias("_p"))
            .select(*keys, F.col("_p.name").alias("_name"), F.col("_p.x").alias("_x"))
            .where(F.col("_x").isNotNull()))
    long = cut_lineage(long, "long")
    cumulative = cumulative_by_value(long, [*by, "_name"], "_x", {"_n": F.count(F.lit(1))}, split=True)
    rank = F.col("_n_before") + (F.col("_n") + 1) / 2.0
    ranked = cumulative.select(*by, "_name", "_x",
                               (rank / F.col("_n_total") if pct else rank).alias("_rank"))
    wide = (join_groups(long, ranked, [*by, "_name", "_x"])
            .groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_rank"))).alias(name)
                                     for name in ranks]))
    return join_groups(df, wide, keys, "left").drop("_values")


def row_values(ranks: dict[str, str]) -> Column:
    """Tells rows with one key but different ranked values apart."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ranks.values()])


def group_quantiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float],
                    split: bool | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation) per group."""
    if split is None:
        split = not by or not groups_fit(df, by, [*by, value], VALUE_BYTES)
    if not split:
        # All quantiles of a group come from one set of its values.
        asked = F.percentile(value, F.array(*[F.lit(float(q)) for q in quantiles.values()])).alias("_q")
        return df.groupBy(*by).agg(asked).select(*by, *[F.col("_q")[i].alias(name) for i, name in enumerate(quantiles)])
    c = cumulative_by_value(df, by, value, {"_n": F.count(F.lit(1))}, split=True)
    first, last = F.col("_n_before"), F.col("_n_before") + F.col("_n") - 1
    aggregates = []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("_n_total") - 1)
        lower, upper = F.floor(position), F.ceil(position)
        a = F.max(F.when((first <= lower) & (lower <= last), F.col(value)))
        b = F.max(F.when((first <= upper) & (upper <= last), F.col(value)))
        weight = F.max(position - lower)
        aggregates.append((a + (b - a) * weight).alias(name))
    return c.groupBy(*by).agg(*aggregates)


def with_group_medians(df: DataFrame, by: list[str], medians: dict[str, str],
                       split: bool | None = None) -> DataFrame:
    for name, source in medians.items():
        df = join_back(df, group_quantiles(df, by, source, {name: 0.5}, split), by)
    return df


def with_zscores(df: DataFrame, by: list[str], zscores: dict[str, str], limit: float | None = None,
                 zero_std: str = "null") -> DataFrame:
    """Add (x - mean) / sample std per group; ``zero_std='zero'`` turns NULL into 0."""
    stats = {}
    for name, source in zscores.items():
        stats |= {f"_m_{name}": F.avg(source), f"_s_{name}": F.stddev_samp(source)}
    out = with_group_stats(df, by, stats)
    columns = {}
    for name, source in zscores.items():
        z = ratio(F.col(source) - F.col(f"_m_{name}"), F.col(f"_s_{name}"))
        z = clip(z, -limit, limit) if limit else z
        columns[name] = F.coalesce(z, F.lit(0.0)) if zero_std == "zero" else z
    return out.withColumns(columns).drop(*stats)


def with_top_bottom(df: DataFrame, by: list[str], value: str, fraction: float, tie: str = "ticker",
                    split: bool | None = None) -> DataFrame:
    """Add ``is_top`` / ``is_bottom``: the max(1, ceil(rows*fraction)) rows with the largest /
    smallest value of the group.  Equal values are taken in ``tie`` order on both sides, missing
    ones last.  Rows with a NULL in ``by`` are a group like any other."""
    if split is None:
        split = not groups_fit(df, by, df.columns)
    take = F.greatest(F.lit(1), F.ceil(F.col("_rows") * F.lit(float(fraction))))
    if not split:
        w = Window.partitionBy(*by)
        return (df.withColumn("_rows", F.count("*").over(w))
                .withColumns({"is_top": F.row_number().over(w.orderBy(F.col(value).desc_nulls_last(), tie)) <= take,
                              "is_bottom": F.row_number().over(w.orderBy(F.col(value).asc_nulls_last(), tie)) <= take})
                .drop("_rows"))
    # Per value: how many rows rank before it decides in / out; only the boundary value needs
    # its rows ordered, and those are split again by their tie text.
    df = cut_lineage(df, "ranked")
    sizes = df.groupBy(*by).agg(F.count("*").alias("_rows"), F.count(value).alias("_known"))
    c = cumulative_by_value(df, by, value, {"_n": F.count(F.lit(1))}, split=True)
    above = F.col("_n_total") - F.col("_n_before") - F.col("_n")
    c = join_groups(c, sizes, by).select(*by, value, (take - above).alias("_top_left"), (take - F.col("_n_before")).alias("_low_left"), F.col("_n"))
    known = df.where(F.col(value).isNotNull()).transform(join_groups, c, [*by, value])
    missing = join_groups(df.where(F.col(value).isNull()), sizes.select(
        *by, (take - F.col("_known")).alias("_top_left"), (take - F.col("_known")).alias("_low_left"), (F.col("_rows") - F.col("_known")).alias("_n")), by, "left")
    joined = known.unionByName(missing)
    tied_out = (F.col("_top_left") < F.col("_n")) & (F.col("_top_left") > 0)
    tied_low = (F.col("_low_left") < F.col("_n")) & (F.col("_low_left") > 0)
    edge = tied_out | tied_low
    edges = joined.where(edge).withColumn("_tied", F.coalesce(F.col(value).cast("string"), F.lit("missing")))
    edges = with_text_position(edges, [*by, "_tied"], tie, "_pos").drop("_tied")
    rest = joined.where(~edge).withColumn("_pos", F.lit(1).cast("bigint"))
    return (edges.unionByName(rest)
            .withColumns({"is_top": F.col("_pos") <= F.col("_top_left"), "is_bottom": F.col("_pos") <= F.col("_low_left")})
            .drop("_top_left", "_low_left", "_n", "_pos"))


def with_text_position(df: DataFrame, by: list[str], text: str, out: str, prefix: int = 3) -> DataFrame:
    """1-based position of each row in ``text`` order inside its group.

    The group is split by the first ``prefix`` characters that differ inside it (what all its texts
    share is skipped), so rows are numbered inside (group, prefix) and shifted by the count of all
    smaller prefixes.
    """
    shared = F.size(F.filter(F.sequence(F.lit(1), F.lit(64)),
                             lambda i: F.substring(F.col("_low"), F.lit(1), i) == F.substring(F.col("_high"), F.lit(1), i)))
    bounds = df.groupBy(*by).agg(F.min(text).alias("_low"), F.max(text).alias("_high"))
    skip = F.when(F.col("_low") == F.col("_high"), 0).otherwise(shared).alias("_skip")
    marked = join_groups(df, bounds.select(*by, skip), by) if by else df.withColumn("_skip", bounds.select(skip).scalar())
    marked = marked.withColumn("_prefix", F.substring(F.col(text), F.lit(1), F.col("_skip") + prefix)).drop("_skip")
    counts = marked.groupBy(*by, "_prefix").agg(F.count("*").alias("_count"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_prefix", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*by, "_prefix").orderBy(text)
    return (join_groups(marked, offsets, [*by, "_prefix"])
            .withColumn(out, F.row_number().over(inside) + F.col("_shift")).drop("_prefix", "_shift"))


def with_global_position(df: DataFrame, keys: list[tuple[str, bool]], out: str) -> DataFrame:
    """1-based position of each row in a total order over the whole frame, without one sort of
    everything in one task.

    Rows are split by a monotone bin of the first (numeric) key, numbered inside the bin and
    shifted by the count of all earlier bins.  ``keys`` are (column, ascending); NULL and NaN stand
    where a sort puts them.
    """
    name, ascending = keys[0]
    marked = df.withColumn("_bin", monotone_bin(F.col(name)))
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in keys]
    bin_order = F.col("_bin").asc() if ascending else F.col("_bin").desc()
    earlier = Window.partitionBy(F.lit(0)).orderBy(bin_order).rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy("_bin").agg(F.count("*").alias("_count"))
    shifts = counts.select("_bin", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_bin").orderBy(*order)
    return (join_groups(marked, shifts, ["_bin"]).withColumn(out, F.row_number().over(inside) + F.col("_shift"))
            .drop("_bin", "_shift"))
