"""Market-relative, cross-sectional, sector, regime and interaction features."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.contract import (CLOSE, DATE, DAYS_PER_YEAR, HIGH, HL_TEMP, INDUSTRY, INTERNAL, KEY, LOW,
                                 MISSING_SECTOR, OPEN, QUANT, SECTOR, TICKER)
from panelspark.functions import rolling as R
from panelspark.functions.crosssection import join_back, with_group_ranks, with_group_stats, with_zscores
from panelspark.functions.scalar import as_double, as_flag, flag, log_ratio, quoted, ratio, ratio_tiny
from panelspark.operators.calendars import distinct_dates, session_index
from panelspark.operators.joins import FAR, effective_sessions, event_neighbours, validity_lookup
from panelspark.operators.quant import DOLLARS, LOG_RETURN, MARKET_WINDOWS, RETURN

EX_SELF = f"{QUANT}universe_return_1d_ex_self"
CROSS_BASE = tuple(f"{QUANT}{x}" for x in (
    "momentum_21d", "momentum_63d", "trend_strength_63d", "realized_vol_21d", "amihud_illiquidity_21d",
    "log_dollar_volume", "drawdown_252d", "relative_strength_63d", "volume_ratio_21d"))
Z_LIMIT = 5.0


def daily_market_aggregates(df: DataFrame) -> DataFrame:
    """Per date: sum, count, positive count and sample deviation of returns, dollar volume."""
    x = F.col(RETURN)
    return df.groupBy(DATE).agg(
        F.coalesce(F.sum(x), F.lit(0.0)).alias("market_return_sum"), F.count(x).alias("market_return_count"),
        F.sum(as_double(x > 0)).alias("market_positive_count"),
        F.coalesce(F.sum(DOLLARS), F.lit(0.0)).alias("market_dollar_volume_sum"),
        F.stddev_samp(x).alias("market_return_std"))


def universe_relative(df: DataFrame) -> DataFrame:
    """Same-date market measures without the row itself."""
    out = join_back(df, daily_market_aggregates(df), [DATE])
    x, others = F.col(RETURN), F.col("market_return_count") - 1
    ex_self = ratio(F.col("market_return_sum") - x, others)
    out = out.withColumns({
        EX_SELF: ex_self,
        f"{QUANT}universe_positive_share_1d_ex_self": ratio(F.col("market_positive_count") - as_double(x > 0), others),
        f"{QUANT}universe_dispersion_1d": F.col("market_return_std"),
        f"{QUANT}volume_share_of_universe": ratio(DOLLARS, "market_dollar_volume_sum"),
        f"{QUANT}excess_return_1d": x - ex_self})
    return out.drop("market_return_sum", "market_return_count", "market_positive_count",
                    "market_dollar_volume_sum", "market_return_std")


def market_beta(df: DataFrame) -> DataFrame:
    """Rolling beta and correlation of a return to the market without itself, from frame sums."""
    t, before = f"{INTERNAL}mb_", df
    if f"{t}row" not in df.columns:
        df = df.withColumn(f"{t}row", F.row_number().over(R.ticker_window()))
    x, m = F.col(RETURN), F.col(EX_SELF)
    df = df.withColumns({f"{t}x": x, f"{t}m": m, f"{t}xm": x * m, f"{t}xx": x * x, f"{t}mm": m * m})
    df = R.with_frame_sums(df, [f"{t}{k}" for k in ("x", "m", "xm", "xx", "mm")], MARKET_WINDOWS, f"{t}row", t, same=(f"{t}m",))
    pairs, known, same = F.col(f"{t}{t}xm_known"), F.col(f"{t}{t}m_known"), F.col(f"{t}{t}m_same")
    out = {}
    for n in MARKET_WINDOWS:
        sx, sm, sxm, sxx, smm = (F.col(f"{t}{t}{k}_{n}") for k in ("x", "m", "xm", "xx", "mm"))
        deviation = R.std_from_sums(n, sm, smm, same)
        beta = ratio((sxm - sx * sm / n) / (n - 1), deviation * deviation)
        out[f"{QUANT}beta_{n}d"] = F.when((pairs >= n) & (known >= n), beta)
        out[f"{QUANT}correlation_to_universe_{n}d"] = F.when(pairs >= n, R.corr_from_sums(F.lit(float(n)), sx, sm, sxm, sxx, smm))
    kept = df.withColumns(out)
    return kept.drop(*[c for c in kept.columns if c not in before.columns and c not in out])


def idiosyncratic_volatility(df: DataFrame) -> DataFrame:
    """Deviation of r - beta_t * m, where beta_t is itself rolling."""
    residual = {f"{INTERNAL}idio_{n}": F.col(RETURN) - F.col(f"{QUANT}beta_{n}d") * F.col(EX_SELF) for n in MARKET_WINDOWS}
    df = df.withColumns(residual)
    return df.withColumns({f"{QUANT}idiosyncratic_vol_{n}d": R.std(f"{INTERNAL}idio_{n}", n) * sqrt(DAYS_PER_YEAR)
                           for n in MARKET_WINDOWS}).drop(*residual)


def relative_strength(df: DataFrame) -> DataFrame:
    market = f"{INTERNAL}market_log"
    df = df.withColumn(market, F.log1p(EX_SELF))
    return df.withColumns({f"{QUANT}relative_strength_{n}d": R.total(LOG_RETURN, n) - R.total(market, n)
                           for n in MARKET_WINDOWS}).drop(market)


def add_market_features(df: DataFrame) -> DataFrame:
    for step in (universe_relative, market_beta, idiosyncratic_volatility, relative_strength):
        df = step(df)
    return df


def add_cross_sectional_features(df: DataFrame, base: tuple[str, ...] = CROSS_BASE) -> DataFrame:
    """Per-date percent rank (average ties) and z-score clipped at +-5 of each base feature."""
    present = [c for c in base if c in df.columns]
    slugs = {c: c.removeprefix(QUANT) for c in present}
    df = with_zscores(df, [DATE], {f"{QUANT}cs_zscore_{slugs[c]}": c for c in present}, limit=Z_LIMIT)
    return with_group_ranks(df, [DATE], {f"{QUANT}cs_rank_{slugs[c]}": c for c in present})


def sector_key() -> Column:
    return F.coalesce(SECTOR, INDUSTRY, F.lit(MISSING_SECTOR))


# --- high-level family -----------------------------------------------------------------------


def _t(name: str) -> str:
    return f"{HL_TEMP}{name}"


def price_primitives(df: DataFrame) -> DataFrame:
    """Temporary inputs (``__hl_``): previous prices, log gap and intraday return, TR over close."""
    o, h, l, c = (F.col(x) for x in (OPEN, HIGH, LOW, CLOSE))
    prev = R.lag(CLOSE)
    true_range = F.greatest(h - l, F.abs(h - prev), F.abs(l - prev))
    df = df.withColumns({
        _t("prev_close"): prev, _t("prev_high"): R.lag(HIGH), _t("prev_low"): R.lag(LOW),
        _t("gap"): log_ratio(o, prev), _t("intraday"): log_ratio(c, o),
        _t("tr_pct"): ratio_tiny(true_range, F.abs(c)), _t("close_log_return"): log_ratio(c, prev)})
    out = {_t("atr_21"): R.mean(_t("tr_pct"), 21), _t("tr_std_21"): R.std(_t("tr_pct"), 21)}
    for n in (21, 63):
        out[_t(f"gap_vol_{n}")] = R.std(_t("gap"), n)
        out[_t(f"intraday_vol_{n}")] = R.std(_t("intraday"), n)
    for n in (5, 21, 63):
        known = f"{QUANT}realized_vol_{n}d"
        out[_t(f"vol_{n}")] = F.col(known) if f"{QUANT}realized_vol_21d" in df.columns else R.std(_t("close_log_return"), n)
    return df.withColumns(out)


COST_FIELDS = ("spread_bps", "slippage_bps", "long_swap_bps_daily", "short_swap_bps_daily")


def broker_cost_features(df: DataFrame, specs: DataFrame, default: dict[str, object] | None = None) -> DataFrame:
    """Spec columns valid on the date; the two expected-cost rates are constant zero by contract."""
    annual = f"{QUANT}realized_vol_21d" in df.columns
    out = validity_lookup(df, specs, list(COST_FIELDS), default)
    out = out.withColumnsRenamed({f: f"xtb_{f}" for f in COST_FIELDS})
    daily_vol = F.col(_t("vol_21")) / (sqrt(DAYS_PER_YEAR) if annual else 1.0)
    spread = F.col("xtb_spread_bps") / 10_000.0
    return out.withColumns({
        "xtb_swap_asymmetry": F.col("xtb_short_swap_bps_daily") - F.col("xtb_long_swap_bps_daily"),
        "xtb_expected_intraday_cost_rate": F.lit(0.0), "xtb_expected_overnight_cost_rate": F.lit(0.0),
        "xtb_spread_to_realized_vol_21d": ratio_tiny(spread, daily_vol),
        "xtb_spread_to_gap_abs": ratio_tiny(spread, F.abs(F.col(_t("gap"))))})


def sector_features(df: DataFrame, rsi: str = "__hl_rsi_14") -> DataFrame:
    by = [DATE, _t("sector")]
    df = df.withColumn(_t("sector"), sector_key())
    sources = {"gap_return": _t("gap"), "intraday_return": _t("intraday"), "rsi": rsi}
    df = with_group_stats(df, by, {_t(f"m_{k}"): F.avg(c) for k, c in sources.items()})
    df = df.withColumns({f"sector_relative_{k}": F.col(c) - F.col(_t(f"m_{k}")) for k, c in sources.items()})
    return with_group_ranks(df, by, {"sector_rsi_rank": rsi, "sector_gap_rank": _t("gap")})


def open_features(df: DataFrame) -> DataFrame:
    o, hi, lo = F.col(OPEN), F.col(_t("prev_high")), F.col(_t("prev_low"))
    atr = _t("atr_21")
    return df.withColumns({
        "open_above_prev_high_flag": as_flag(o > hi), "open_below_prev_low_flag": as_flag(o < lo),
        "open_in_prev_range_flag": as_flag((o >= lo) & (o <= hi)),
        "open_distance_to_prev_close_over_atr_21d": ratio_tiny(o - F.col(_t("prev_close")), atr),
        "open_distance_to_prev_high_over_atr_21d": ratio_tiny(o - hi, atr),
        "open_distance_to_prev_low_over_atr_21d": ratio_tiny(o - lo, atr)})


def regime_features(df: DataFrame) -> DataFrame:
    def r(a, b):
        return ratio_tiny(_t(a), _t(b))
    return df.withColumns({
        f"{QUANT}realized_vol_ratio_5d_21d": r("vol_5", "vol_21"),
        f"{QUANT}realized_vol_ratio_21d_63d": r("vol_21", "vol_63"),
        f"{QUANT}gap_vol_ratio_21d_63d": r("gap_vol_21", "gap_vol_63"),
        f"{QUANT}intraday_vol_ratio_21d_63d": r("intraday_vol_21", "intraday_vol_63"),
        f"{QUANT}true_range_zscore_21d": ratio_tiny(F.col(_t("tr_pct")) - F.col(_t("atr_21")), _t("tr_std_21"))})


def earnings_features(df: DataFrame, earnings: DataFrame) -> DataFrame:
    """Sessions to the next and since the last announcement; 252 where there is none."""
    index = session_index(distinct_dates(df))
    known = earnings.where(F.col("announcement_session") != "unknown")
    events = effective_sessions(known, index).select(TICKER, "session_index")
    out = event_neighbours(df.join(F.broadcast(index), DATE), events)
    to_next, since = F.coalesce("next_distance", F.lit(FAR)), F.coalesce("prev_distance", F.lit(FAR))
    return out.withColumns({
        "earnings_days_to_next": to_next, "earnings_days_since_last": since,
        "earnings_is_week": (to_next <= 5).cast("tinyint"),
        "earnings_proximity_bucket": F.when(to_next <= 1, 0).when(to_next <= 5, 1).when(to_next <= 10, 2)
        .otherwise(3).cast("bigint")}).drop("next_distance", "prev_distance", "session_index")


# Thresholds of the interaction flags.
RSI_HIGH, RSI_LOW, VOL_TENSION, OPEN_STRETCH, HIGH_COST = 70.0, 30.0, 1.0, 1.0, 0.25


def interaction_flags(df: DataFrame) -> DataFrame:
    def c(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("double")

    def on(name: str) -> Column:
        return flag(c(name) != 0)

    rsi, macd, gap = c("ta_momentum_rsi"), c("ta_trend_macd"), c(f"{QUANT}gap_return")
    s_gap, s_intraday = c("sector_relative_gap_return"), c("sector_relative_intraday_return")
    flags = {
        "rsi_overbought_macd_positive": (rsi > RSI_HIGH) & (macd > 0),
        "rsi_oversold_macd_negative": (rsi < RSI_LOW) & (macd < 0),
        "gap_up_breakout": on("open_above_prev_high_flag") & (gap > 0),
        "gap_down_breakdown": on("open_below_prev_low_flag") & (gap < 0),
        "sector_strength_confirmed": (s_gap > 0) & (s_intraday > 0),
        "sector_weakness_confirmed": (s_gap < 0) & (s_intraday < 0),
        "earnings_tension": (c("earnings_days_to_next") <= 5) & (c(f"{QUANT}realized_vol_ratio_5d_21d") > VOL_TENSION),
        "open_stretch_high_cost": (F.abs(c("open_distance_to_prev_close_over_atr_21d")) > OPEN_STRETCH)
        & (c("xtb_spread_to_gap_abs") > HIGH_COST),
        "trend_follow_through": (macd > 0) & (c(f"{QUANT}momentum_21d") > 0) & (s_intraday > 0),
        "mean_reversion_exhaustion": (rsi < RSI_LOW) & on("open_in_prev_range_flag") & (gap < 0)}
    return df.withColumns({f"signal_{name}_flag": as_flag(condition) for name, condition in flags.items()})


def drop_internal_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith((INTERNAL, HL_TEMP))])


# --- lag policy --------------------------------------------------------------------------------

# Lag windows by family and the quant columns that are never lagged.
STOCK_LOG_RETURNS = ("stock_open_log_return", "stock_high_log_return", "stock_low_log_return", "stock_close_log_return")
FULL_LAGS, SLOW_LAGS, SINCE_LAGS = (1, 5, 21), (1, 21), (1, 5)
NEVER_LAGGED = tuple(f"{QUANT}{x}" for x in (
    "day_of_week_sin", "day_of_week_cos", "month_of_year_sin", "month_of_year_cos", "day_of_month_sin",
    "day_of_month_cos", "day_of_year_sin", "day_of_year_cos", "is_month_start", "is_month_end", "is_quarter_start",
    "is_quarter_end", "days_in_sample", "dollar_volume", "adv_21d", "adv_63d", "adv_252d", "trend_strength_21d",
    "trend_strength_63d"))
FULL_LAG_PREFIXES = ("deep_", "xtb_", "sector_", "open_", "earnings_", "signal_", "cross_asset_")
SLOW_LAG_PREFIXES = ("company_", "sentiment_", "macro_")


def lag_windows(column: str) -> tuple[int, ...]:
    """Lags (in rows) a column gets, from its name alone."""
    if column in KEY or "_lag_" in column:
        return ()
    full = (column in STOCK_LOG_RETURNS
            or (column.startswith("ta_") and not column.startswith("ta_volume_"))
            or (column.startswith(QUANT) and column not in NEVER_LAGGED)
            or column.startswith(FULL_LAG_PREFIXES))
    if full:
        return FULL_LAGS
    if column.startswith(SLOW_LAG_PREFIXES):
        return SLOW_LAGS
    return SINCE_LAGS if column.startswith("calendar_") and "days_since_" in column else ()


def add_feature_lags(df: DataFrame, chunk: int = 400) -> DataFrame:
    """``<col>_lag_<k>d`` as float for every numeric column the policy names.  One window spec
    for all; very wide blocks are split to keep generated code small.  A block is stated as SQL
    text: hundreds of lags are one call instead of a dozen each."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    lags = [(c, k) for c in numeric for k in lag_windows(c)]
    df = df.drop(*{f"{c}_lag_{k}d" for c, k in lags}.intersection(df.columns))
    over = f"OVER (PARTITION BY {quoted(TICKER)} ORDER BY {quoted(DATE)})"
    for i in range(0, len(lags), chunk):
        df = df.selectExpr("*", *[f"CAST(lag({quoted(c)}, {k}) {over} AS FLOAT) AS {quoted(f'{c}_lag_{k}d')}" for c, k in lags[i:i + chunk]])
    return df
