"""Forward-return labels, cross-sectional label metrics, meta labels, registry-driven fill."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark import contract as K
from panelspark.contract import CLOSE, DATE, KEY, OPEN
from panelspark.functions import rolling as R
from panelspark.functions.crosssection import with_group_ranks, with_group_stats
from panelspark.functions.scalar import flag, log_ratio, ratio
from panelspark.operators.market import sector_key

META_CANDIDATE, META_LABEL = "meta_candidate", "meta_label"
PRIMARY = "primary_prediction"


def forward_returns(df: DataFrame, horizon: int = K.HOLD_PERIOD, lag: int = K.EXECUTION_LAG) -> DataFrame:
    """Entry at the open ``lag`` rows ahead; exits per horizon.  Net equals gross (zero cost)."""
    entry_open, entry_close = R.lead(OPEN, lag), R.lead(CLOSE, lag)
    gross = {
        "intraday": log_ratio(entry_close, entry_open),
        "overnight": log_ratio(R.lead(OPEN, lag + 1), entry_close),
        "short": log_ratio(R.lead(CLOSE, lag + 1), entry_open),
        "medium": log_ratio(R.lead(OPEN, lag + horizon), entry_open),
        "week": log_ratio(R.lead(CLOSE, lag + horizon), entry_open)}
    return df.withColumns({
        K.INTRADAY_GROSS: gross["intraday"], K.LEGACY_TARGET: gross["week"], K.INTRADAY_NET: gross["intraday"],
        K.OVERNIGHT_NET: gross["overnight"], K.SHORT_NET: gross["short"], K.MEDIUM_GROSS: gross["medium"],
        K.MEDIUM_NET: gross["medium"], K.WEEK_GROSS: gross["week"], K.WEEK_NET: gross["week"]})


def label_metrics(df: DataFrame, split: bool | None = None) -> DataFrame:
    """(date, ticker) + benchmark, excess, sector residual, z-score and centred rank of the
    intraday and week labels.  Missing z-scores and ranks become 0."""
    sources = {K.INTRADAY_NET: K.INTRADAY_METRICS, K.WEEK_NET: K.WEEK_METRICS}
    base = df.select(*KEY, sector_key().alias("_sector"), *sources) if K.SECTOR in df.columns else \
        df.select(*KEY, F.lit(K.MISSING_SECTOR).alias("_sector"), *sources)
    base = with_group_stats(base, [DATE], {f"_{kind}_{i}": fn(c) for i, c in enumerate(sources)
                                           for kind, fn in (("m", F.avg), ("s", F.stddev_samp))})
    base = with_group_stats(base, [DATE, "_sector"], {f"_g_{i}": F.avg(c) for i, c in enumerate(sources)})
    base = with_group_ranks(base, [DATE], {f"_r_{i}": c for i, c in enumerate(sources)}, split=split)
    columns: list[Column] = []
    for i, (source, (benchmark, excess, residual, zscore, rank)) in enumerate(sources.items()):
        x, m = F.col(source), F.col(f"_m_{i}")
        columns += [m.alias(benchmark), (x - m).alias(excess), (x - F.col(f"_g_{i}")).alias(residual),
                    F.coalesce(ratio(x - m, f"_s_{i}"), F.lit(0.0)).alias(zscore),
                    F.coalesce(F.col(f"_r_{i}") - 0.5, F.lit(0.0)).alias(rank)]
    return base.select(*KEY, *columns)


def apply_metric_panel(df: DataFrame, metrics: DataFrame) -> DataFrame:
    """Replace any metric columns by those of ``metrics`` (joined on the panel key)."""
    return df.drop(*[c for c in metrics.columns if c not in KEY]).join(metrics, list(KEY), "left")


def create_targets(df: DataFrame) -> DataFrame:
    labelled = forward_returns(df)
    return apply_metric_panel(labelled, label_metrics(labelled))


def meta_labels(df: DataFrame, threshold: float = 0.0, minimum: float = 0.010) -> DataFrame:
    """candidate = prediction > threshold; label = candidate and realised net return > minimum."""
    candidate = F.coalesce(F.col(PRIMARY), F.lit(0.0)) > threshold
    return df.withColumns({META_CANDIDATE: candidate.cast("bigint"),
                           META_LABEL: (candidate & flag(F.col(K.WEEK_NET) > minimum)).cast("bigint")})


def meta_candidates(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col(META_CANDIDATE), F.lit(0)) > 0.5)


def fill_limits(registry: DataFrame, name: str = "feature_name", limit: str = "safe_ffill_max_days") -> dict[str, int | None]:
    """Feature -> fill limit, one row per feature (bounded by the schema's width)."""
    return {x[name]: None if x[limit] is None else int(x[limit]) for x in registry.select(name, limit).collect()}


def forward_fill_by_registry(df: DataFrame, limits: dict[str, int | None], protected: tuple[str, ...] = KEY) -> DataFrame:
    """Limited forward fill inside each ticker; a feature without a limit, or with 0, stays."""
    fills = {c: R.forward_fill(c, n) for c, n in limits.items() if n and c in df.columns and c not in protected}
    return df.withColumns(fills) if fills else df


def schema_hash(names: list[str]) -> str:
    """SHA-256 of the names, one per line, in the given order."""
    return sha256("\n".join(names).encode()).hexdigest()
