"""Signal columns, refinement strategies, information coefficients and ablation metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.contract import DATE, KEY, PREDICTION, TICKER, WEEK_NET
from panelspark.functions.crosssection import (VALUE_BYTES, group_quantiles, join_back, with_group_ranks, with_group_stats,
                                               with_top_bottom, with_zscores)
from panelspark.functions.scalar import clip, piecewise_linear
from panelspark.session import cut_lineage, fits_one_task, groups_fit

PRIMARY = "primary_prediction"
META_PROBABILITY, META_CONFIDENCE = "meta_probability", "meta_confidence"
REFINED, REFINED_RETURN, EXPECTED_RETURN = "refined_prediction", "refined_expected_return_5d", "expected_return_5d"


def or_zero(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def primary_context(df: DataFrame, split: bool | None = None) -> DataFrame:
    """Primary prediction (missing = 0), its centred rank and z-score per date, size and sign."""
    df = df.withColumn(PRIMARY, or_zero(PREDICTION))
    df = with_zscores(df, [DATE], {f"{PRIMARY}_zscore_cs": PRIMARY}, zero_std="zero")
    df = with_group_ranks(df, [DATE], {f"{PRIMARY}_rank_cs": PRIMARY}, split=split)
    return df.withColumns({f"{PRIMARY}_rank_cs": F.col(f"{PRIMARY}_rank_cs") - 0.5,
                           f"{PRIMARY}_abs": F.abs(PRIMARY), f"{PRIMARY}_sign": F.signum(PRIMARY)})


# --- refinement strategies: name -> confidence column, given the meta probability -------------------

GATE = 0.5


def binary_gate(primary: Column, meta: Column, **_: float) -> Column:
    return F.when(meta >= GATE, meta).otherwise(0.0)


def candidate_only(primary: Column, meta: Column, **_: float) -> Column:
    return F.when(primary > 0, 1.0).otherwise(0.0)


def soft_shifted(primary: Column, meta: Column, soft_shifted_floor: float = 0.45, **_: float) -> Column:
    return clip((meta - soft_shifted_floor) / max(1.0 - soft_shifted_floor, 1e-8), 0.0, 1.0)


def full_confidence(primary: Column, meta: Column, **_: float) -> Column:
    return F.lit(1.0)


STRATEGIES: dict[str, Callable[..., Column]] = {
    "binary_gate": binary_gate, "candidate_only": candidate_only, "soft_shifted": soft_shifted,
    "rank_blend": full_confidence, "no_meta": full_confidence}


def _blend_scores(df: DataFrame) -> DataFrame:
    """Per-date z-scores of primary and meta, the deviation floored at 1e-8."""
    stats = {}
    for name, source in (("p", "_p"), ("m", "_meta")):
        stats |= {f"_mean_{name}": F.avg(source), f"_std_{name}": F.greatest(F.stddev_samp(source), F.lit(1e-8))}
    df = with_group_stats(df, [DATE], stats)

    def z(source, name):
        # greatest() ignores NULL, so a lone row would otherwise get the floor.
        return F.coalesce((F.col(source) - F.col(f"_mean_{name}")) / F.col(f"_std_{name}"), F.lit(0.0))
    return df.withColumns({"_z_p": z("_p", "p"), "_z_m": z("_meta", "m")}).drop(*stats)


def refine(df: DataFrame, strategy: str = "binary_gate", soft_shifted_floor: float = 0.45, rank_blend_lambda: float = 0.50) -> DataFrame:
    """Attach confidence, refined prediction and refined expected return of one strategy."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown refinement strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    source = PRIMARY if PRIMARY in df.columns else PREDICTION
    has_expected = EXPECTED_RETURN in df.columns
    df = df.withColumns({"_p": or_zero(source), "_meta": or_zero(META_PROBABILITY)})
    confidence = STRATEGIES[strategy](F.col("_p"), F.col("_meta"), soft_shifted_floor=soft_shifted_floor)
    expected = or_zero(EXPECTED_RETURN) if has_expected else None
    if strategy == "rank_blend":
        df = _blend_scores(df)
        refined, refined_return = F.col("_z_p") + rank_blend_lambda * F.col("_z_m"), expected
    else:
        refined = F.col("_p") * confidence
        refined_return = None if expected is None else expected * confidence
    out = df.withColumns({META_CONFIDENCE: confidence, REFINED: refined,
                          REFINED_RETURN: F.lit(0.0) if refined_return is None else refined_return})
    return out.drop("_p", "_meta", "_z_p", "_z_m")


def attach_expected_return(df: DataFrame, xs: list[float], ys: list[float], **strategy) -> DataFrame:
    """Expected return from calibrator knots of the primary prediction, then refined."""
    if PRIMARY not in df.columns:
        df = df.withColumn(PRIMARY, or_zero(PREDICTION))
    df = refine(df.withColumn(EXPECTED_RETURN, piecewise_linear(F.col(PRIMARY), xs, ys)), **strategy)
    return df.withColumn(EXPECTED_RETURN, F.col(REFINED_RETURN))


# --- information coefficients -----------------------------------------------------------------------


def corr_agg(x: str, y: str) -> Column:
    """Correlation over complete pairs as one partial aggregate; NULL for a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def with_side_ranks(df: DataFrame, prediction: str, target: str, by: list[str], split: bool | None = None,
                    row_key: tuple[str, ...] = KEY) -> DataFrame:
    """Each side ranked over its own non-missing values of the group."""
    return with_group_ranks(df, by, {"_rank_p": prediction, "_rank_t": target}, pct=False, split=split, row_key=row_key)


def daily_rank_ic(df: DataFrame, prediction: str, target: str, by: tuple[str, ...] = (DATE,), split: bool | None = None,
                  row_key: tuple[str, ...] = KEY) -> DataFrame:
    """Spearman IC per group with at least two rows; NULL when a side is constant."""
    ranked = with_side_ranks(df.select(*dict.fromkeys([*row_key, *by, prediction, target])), prediction, target, list(by), split, row_key)
    return (ranked.groupBy(*by).agg(F.count("*").alias("rows"), corr_agg("_rank_p", "_rank_t").alias("rank_ic"))
            .where("rows >= 2"))


def mean_daily_rank_ic(df: DataFrame, prediction: str, target: str, by: tuple[str, ...] = (), split: bool | None = None) -> DataFrame:
    """Mean of the valid daily ICs, 0 without any."""
    daily = daily_rank_ic(df, prediction, target, (*by, DATE), split, row_key=tuple(dict.fromkeys([*by, *KEY])))
    mean = F.coalesce(F.avg("rank_ic"), F.lit(0.0)).alias("mean_rank_ic")
    return daily.groupBy(*by).agg(mean) if by else daily.agg(mean)


def daily_signal_diagnostics(df: DataFrame, prediction: str, target: str, realized: str, top_fraction: float = 0.01,
                             by: tuple[str, ...] = (DATE,), split: bool | None = None, row_key: tuple[str, ...] = KEY) -> DataFrame:
    """Per group of at least two rows: rank IC, linear IC (missing = 0), mean realised return of the
    top minus the bottom names, rows."""
    names = list(dict.fromkeys([*row_key, *by, prediction, target, realized]))
    split = not groups_fit(df, list(by), names) if split is None else split
    narrow = cut_lineage(df.select(*names), "signals") if split else df.select(*names)
    ranked = with_side_ranks(narrow, prediction, target, list(by), split, row_key)
    marked = with_top_bottom(ranked, list(by), prediction, top_fraction, TICKER, split)
    top = F.avg(F.when(F.col("is_top"), F.col(realized)))
    bottom = F.avg(F.when(F.col("is_bottom"), F.col(realized)))
    return (marked.groupBy(*by).agg(
        F.coalesce(corr_agg("_rank_p", "_rank_t"), F.lit(0.0)).alias("rank_ic"),
        F.coalesce(corr_agg(prediction, target), F.lit(0.0)).alias("linear_ic"),
        (top - bottom).alias("top_bottom_spread"), F.count("*").cast("double").alias("cross_section_count"))
        .where("cross_section_count >= 2"))


def summarize_diagnostics(daily: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means, population deviations and the IC information ratio (0 when its deviation is ~0)."""
    std = F.coalesce(F.stddev_pop("rank_ic"), F.lit(0.0))
    mean = F.coalesce(F.avg("rank_ic"), F.lit(0.0))
    aggregates = [
        mean.alias("daily_rank_ic_mean"), std.alias("daily_rank_ic_std"),
        F.when(std <= 1e-12, 0.0).otherwise(F.try_divide(mean, std)).alias("daily_rank_ic_ir"),
        F.coalesce(F.avg("linear_ic"), F.lit(0.0)).alias("daily_linear_ic_mean"),
        F.coalesce(F.avg("top_bottom_spread"), F.lit(0.0)).alias("daily_top_bottom_spread_mean"),
        F.coalesce(F.stddev_pop("top_bottom_spread"), F.lit(0.0)).alias("daily_top_bottom_spread_std")]
    return daily.groupBy(*by).agg(*aggregates) if by else daily.agg(*aggregates)


# --- ablation -----------------------------------------------------------------------------------------

# The compared regimes.
REGIMES = (
    {"name": "baseline_hard_050", "strategy": "binary_gate"},
    {"name": "candidate_only", "strategy": "candidate_only"},
    {"name": "soft_shifted_045", "strategy": "soft_shifted", "soft_shifted_floor": 0.45},
    {"name": "rank_blend_025", "strategy": "rank_blend", "rank_blend_lambda": 0.25},
    {"name": "rank_blend_050", "strategy": "rank_blend", "rank_blend_lambda": 0.50},
    {"name": "rank_blend_100", "strategy": "rank_blend", "rank_blend_lambda": 1.00},
    {"name": "no_meta", "strategy": "no_meta"},
)
MINIMUM_NAMES = 5
QUINTILES = 5


def stack_regimes(df: DataFrame, target: str, regimes: tuple[dict, ...] = REGIMES) -> DataFrame:
    """One row per (regime, date, ticker) with the refined signal; every regime is a column
    expression over one scan, with a single pass for the per-date z-scores."""
    source = PRIMARY if PRIMARY in df.columns else PREDICTION
    df = _blend_scores(df.select(*KEY, target, or_zero(source).alias("_p"), or_zero(META_PROBABILITY).alias("_meta")))
    signals = []
    for regime in regimes:
        strategy = regime["strategy"]
        # Adding 0.0 below folds -0.0 into 0.0, so both count as one quantile edge.
        if strategy == "rank_blend":
            value = F.col("_z_p") + regime.get("rank_blend_lambda", 0.50) * F.col("_z_m")
        else:
            value = F.col("_p") * STRATEGIES[strategy](F.col("_p"), F.col("_meta"), soft_shifted_floor=regime.get("soft_shifted_floor", 0.45))
        signals.append(F.struct(F.lit(regime["name"]).alias("regime"), (value.cast("double") + 0.0).alias("refined")))
    return df.select(*KEY, F.col(target).alias("_target"), F.explode(F.array(*signals)).alias("_s")).select(
        "_s.regime", *KEY, "_s.refined", "_target")


def _screen_rank_ic(stacked: DataFrame, split: bool | None) -> DataFrame:
    by = ["regime", DATE]
    sizes = stacked.groupBy(*by).agg(F.count("*").alias("rows")).where(F.col("rows") >= MINIMUM_NAMES)
    whole = stacked.where(F.col("refined").isNotNull() & F.col("_target").isNotNull())
    ranked = with_side_ranks(whole, "refined", "_target", by, split, ("regime", *KEY))
    daily = ranked.groupBy(*by).agg(F.count("*").alias("known"), F.stddev_samp("refined").alias("_std"), corr_agg("_rank_p", "_rank_t").alias("_ic"))
    thin = F.col("known").isNull() | (F.col("known") < MINIMUM_NAMES) | (F.col("_std") < 1e-12)
    daily = sizes.join(daily, by, "left").withColumn("rank_ic", F.when(thin, 0.0).otherwise(F.col("_ic")))
    mean, std = F.coalesce(F.avg("rank_ic"), F.lit(0.0)), F.when(F.count("rank_ic") > 1, F.stddev_samp("rank_ic")).otherwise(1.0)
    return daily.groupBy("regime").agg(mean.alias("rank_ic"), std.alias("rank_ic_std"),
                                       F.when(std > 1e-12, mean / std).otherwise(0.0).alias("rank_ic_ir"))


def quintile_spread(stacked: DataFrame, split: bool | None = None, by: tuple[str, ...] = ("regime",)) -> DataFrame:
    """Mean target of the top minus the bottom quantile bucket per date, annualised in bps.

    Buckets are right-closed between the distinct quantile edges; repeated edges merge.
    """
    keys = [*by, DATE]
    whole = stacked.where(F.col("refined").isNotNull() & F.col("_target").isNotNull())
    counts = whole.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") >= MINIMUM_NAMES)
    edges = group_quantiles(whole, keys, "refined", {f"_e{i}": i / QUINTILES for i in range(QUINTILES + 1)}, split)
    edges = edges.select(*keys, F.array_distinct(F.array(*[F.col(f"_e{i}") for i in range(QUINTILES + 1)])).alias("_edges"))
    marked = join_back(whole, counts.join(edges, keys), keys, "inner")
    x = F.col("refined")
    bucket = F.greatest(F.size(F.filter("_edges", lambda e: e < x)), F.lit(1))
    means = marked.groupBy(*keys, bucket.alias("_bucket")).agg(F.avg("_target").alias("_mean"))
    daily = means.groupBy(*keys).agg(F.count("*").alias("_buckets"), (F.max_by("_mean", "_bucket") - F.min_by("_mean", "_bucket")).alias("_spread"))
    spread = F.coalesce(F.avg(F.when(F.col("_buckets") >= 2, F.col("_spread"))), F.lit(0.0)) * 252 * 10_000
    return daily.groupBy(*by).agg(spread.alias("q5_q1_spread_bps")) if by else daily.agg(spread.alias("q5_q1_spread_bps"))


def breadth_and_effective_n(stacked: DataFrame) -> DataFrame:
    """Mean per date of the non-zero names and of the inverse Herfindahl of absolute weights."""
    size = F.abs(F.coalesce("refined", F.lit(0.0)))
    total = F.sum(size)
    daily = stacked.groupBy("regime", DATE).agg(
        F.count_if(size > 1e-12).alias("_names"),
        F.when(total < 1e-12, 0.0).otherwise(F.try_divide(total * total, F.sum(size * size))).alias("_n"))
    return daily.groupBy("regime").agg(F.avg("_names").alias("breadth"), F.avg("_n").alias("effective_n"))


def ablation_screen(df: DataFrame, target: str = WEEK_NET, regimes: tuple[dict, ...] = REGIMES, split: bool | None = None) -> DataFrame:
    if not fits_one_task(df):
        # The screens read the panel several times; one row of it is stored, not one per regime.
        names = (*KEY, target, PRIMARY if PRIMARY in df.columns else PREDICTION, META_PROBABILITY)
        df = cut_lineage(df.select(*dict.fromkeys(names)), "signals")
    # A group of the screens is a date of one regime.
    split = not groups_fit(df, [DATE], df.columns, VALUE_BYTES) if split is None else split
    stacked = stack_regimes(df, target, regimes)
    stacked = cut_lineage(stacked, "regimes") if split else stacked
    return (_screen_rank_ic(stacked, split).join(quintile_spread(stacked, split), "regime")
            .join(breadth_and_effective_n(stacked), "regime"))


def select_regimes(screen: DataFrame, n_top: int = 2, forced: tuple[str, ...] = ("candidate_only", "no_meta")) -> DataFrame:
    """Best regimes by IC information ratio plus the forced baselines."""
    top = screen.orderBy(F.col("rank_ic_ir").desc(), "regime").limit(n_top).select("regime")
    return top.unionByName(screen.where(F.col("regime").isin(*forced)).select("regime")).distinct()


