"""Quant feature family: returns, bar shape, momentum, volatility, trend, liquidity.

Every function adds columns over one (ticker, date) window; chaining them keeps a single
exchange on ticker, since all windows share partition and order.
"""

from __future__ import annotations

from math import log as ln
from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.contract import CLOSE, DATE, DAYS_PER_YEAR, HIGH, INTERNAL, LOW, OPEN, QUANT, VOLUME
from panelspark.functions import rolling as R
from panelspark.functions.scalar import as_double, clip, differs, flag, ratio

# Window lengths in rows.
RETURN_WINDOWS = (5, 10, 21, 63, 126, 252)
VOLATILITY_WINDOWS = (5, 10, 21, 63, 126)
TREND_WINDOWS = (21, 63)
LIQUIDITY_WINDOWS = (21, 63, 252)
DRAWDOWN_WINDOWS = (63, 252)
MARKET_WINDOWS = (21, 63)

RETURN = f"{INTERNAL}return_1d"
LOG_RETURN = f"{INTERNAL}log_return_1d"
SIGNED_DOLLARS = f"{INTERNAL}signed_dollar_volume"
LOG_CLOSE = f"{INTERNAL}log_close"
ROW = f"{QUANT}days_in_sample"
DOLLARS = f"{QUANT}dollar_volume"
ANNUAL = sqrt(DAYS_PER_YEAR)


def returns(df: DataFrame) -> DataFrame:
    """Simple and log return, dollar volume and its signed form, row number in the sample."""
    c = F.col(CLOSE)
    return df.withColumns({
        LOG_CLOSE: F.log(c),
        ROW: F.row_number().over(R.ticker_window()).cast("bigint"),
        RETURN: R.pct_change(CLOSE),
        DOLLARS: c * F.col(VOLUME),
        SIGNED_DOLLARS: F.coalesce(F.signum(R.diff(CLOSE)), F.lit(0.0)) * c * F.col(VOLUME),
        LOG_RETURN: F.log(c) - F.log(R.lag(CLOSE)),
    })


def sample_position(df: DataFrame) -> DataFrame:
    gap = F.datediff(F.col(DATE), R.lag(DATE)).cast("double")
    return df.withColumns({f"{QUANT}calendar_gap_days": gap,
                           ROW: F.row_number().over(R.ticker_window()).cast("bigint")})


def bar_shape(df: DataFrame) -> DataFrame:
    o, h, l, c = (F.col(x) for x in (OPEN, HIGH, LOW, CLOSE))
    prev = R.lag(CLOSE)
    span = F.nullif(h - l, F.lit(0.0))
    true_range = F.greatest(F.abs(h - l), F.abs(h - prev), F.abs(l - prev))
    return df.withColumns({
        f"{QUANT}gap_return": ratio(o, prev) - 1.0,
        f"{QUANT}intraday_return": ratio(c, o) - 1.0,
        f"{QUANT}high_low_range_pct": ratio(h - l, c),
        f"{QUANT}true_range_pct": ratio(true_range, prev),
        f"{QUANT}close_location_value": ratio(2.0 * c - h - l, span),
        f"{QUANT}body_to_range": ratio(F.abs(c - o), span),
        f"{QUANT}upper_shadow_to_range": ratio(h - F.greatest(o, c), span),
        f"{QUANT}lower_shadow_to_range": ratio(F.least(o, c) - l, span),
    })


def momentum(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{QUANT}momentum_{n}d": R.diff(LOG_CLOSE, n) for n in RETURN_WINDOWS})


def _drop_new(df: DataFrame, before: DataFrame, keep: dict) -> DataFrame:
    """Drop helper columns added since ``before``."""
    return df.drop(*[c for c in df.columns if c not in before.columns and c not in keep])


def return_moments(df: DataFrame) -> DataFrame:
    """Volatility, skewness, kurtosis and lag-1 autocorrelation of returns.

    Powers become columns first, so every frame only adds numbers.  In a window whose pairs are
    complete, the sums of the lagged return are the sums of one row earlier.
    """
    t, before = f"{INTERNAL}rm_", df
    x = F.col(RETURN)
    df = df.withColumn(f"{t}x", x).withColumns({f"{t}lag": R.lag(RETURN), f"{t}2": x * x, f"{t}3": x * x * x, f"{t}4": x * x * x * x})
    df = df.withColumn(f"{t}ab", x * F.col(f"{t}lag"))
    names = [f"{t}{k}" for k in ("x", "2", "3", "4", "ab")]
    df = R.with_frame_sums(df, names, VOLATILITY_WINDOWS, ROW, t, same=(f"{t}x",))
    earlier = {f"{t}prev{k}_{n}": R.lag(f"{t}{t}{k}_{n}") for n in VOLATILITY_WINDOWS for k in ("x", "2")}
    df = df.withColumns(earlier)
    known, pairs, same = F.col(f"{t}{t}x_known"), F.col(f"{t}{t}ab_known"), F.col(f"{t}{t}x_same")
    out = {}
    for n in VOLATILITY_WINDOWS:
        s1, s2, s3, s4, sab = (F.col(f"{t}{t}{k}_{n}") for k in ("x", "2", "3", "4", "ab"))
        size, full = F.lit(float(n)), known >= n
        out |= {f"{QUANT}realized_vol_{n}d": F.when(full, R.std_from_sums(n, s1, s2, same) * ANNUAL),
                f"{QUANT}return_skew_{n}d": F.when(full, R.skew_from_sums(size, s1, s2, s3)),
                f"{QUANT}return_kurt_{n}d": F.when(full, R.kurt_from_sums(size, s1, s2, s3, s4)),
                f"{QUANT}return_autocorr_lag1_{n}d": F.when(pairs >= n, R.corr_from_sums(
                    size, s1, F.col(f"{t}prevx_{n}"), sab, s2, F.col(f"{t}prev2_{n}")))}
    return _drop_new(df.withColumns(out), before, out)


def trend(df: DataFrame) -> DataFrame:
    """OLS on the row index (annualised slope, R2), efficiency ratio, share of positive days."""
    t = f"{INTERNAL}tr_"
    y, x = F.col(LOG_CLOSE), F.col(ROW).cast("double")
    df = df.withColumns({f"{t}step": F.abs(R.diff(CLOSE)), f"{t}positive": as_double(F.col(RETURN) > 0)})
    shared = {}
    for n in TREND_WINDOWS:
        w = R.last_rows(n)
        # A full window has consecutive row numbers, whose variance is (n^2 - 1) / 12 wherever it lies.
        shared |= {f"{t}n_{n}": F.count(y).over(w), f"{t}cov_{n}": F.covar_pop(y, x).over(w), f"{t}var_{n}": F.var_pop(y).over(w),
                   f"{t}path_{n}": R.total(f"{t}step", n), f"{t}share_{n}": R.mean(f"{t}positive", n), f"{t}move_{n}": F.abs(R.diff(CLOSE, n))}
    df = df.withColumns(shared)
    out = {}
    for n in TREND_WINDOWS:
        spread = (n * n - 1) / 12.0
        full = F.col(f"{t}n_{n}") >= n
        covariance, variance = F.col(f"{t}cov_{n}"), F.col(f"{t}var_{n}")
        slope = F.when(full, F.expm1(covariance / spread * DAYS_PER_YEAR))
        r2 = F.when(full & (variance > 0), F.greatest(F.lit(0.0), covariance * covariance / (variance * spread)))
        out |= {f"{QUANT}trend_slope_{n}d": slope, f"{QUANT}trend_r2_{n}d": r2, f"{QUANT}trend_strength_{n}d": slope * r2,
                f"{QUANT}efficiency_ratio_{n}d": ratio(f"{t}move_{n}", f"{t}path_{n}"), f"{QUANT}positive_day_ratio_{n}d": F.col(f"{t}share_{n}")}
    return df.withColumns(out).drop(f"{t}step", f"{t}positive", *shared)


def one_sided_volatility(df: DataFrame) -> DataFrame:
    out = {}
    for n in MARKET_WINDOWS:
        down, up = F.pow(clip(F.col(RETURN), high=0), 2), F.pow(clip(F.col(RETURN), low=0), 2)
        out[f"{QUANT}downside_vol_{n}d"] = F.sqrt(R.mean(down, n) * DAYS_PER_YEAR)
        out[f"{QUANT}upside_vol_{n}d"] = F.sqrt(R.mean(up, n) * DAYS_PER_YEAR)
    return df.withColumns(out)


def drawdown(df: DataFrame) -> DataFrame:
    """Distance to the highest and lowest close.  The long window is made of whole short ones that end earlier."""
    t, before = f"{INTERNAL}dd_", df
    short, long = DRAWDOWN_WINDOWS
    w, folds = R.last_rows(short), long // short
    df = df.withColumns({f"{t}high_{short}": F.max(CLOSE).over(w), f"{t}low_{short}": F.min(CLOSE).over(w), f"{t}n_{short}": F.count(CLOSE).over(w)})

    def parts(k):
        return [F.col(f"{t}{k}_{short}"), *[R.lag(f"{t}{k}_{short}", i * short) for i in range(1, folds)]]
    df = df.withColumns({f"{t}high_{long}": F.greatest(*parts("high")), f"{t}low_{long}": F.least(*parts("low")),
                         f"{t}n_{long}": sum((F.coalesce(c, F.lit(0)) for c in parts("n")), F.lit(0))})
    out = {}
    for n in DRAWDOWN_WINDOWS:
        full = F.col(f"{t}n_{n}") >= n
        out[f"{QUANT}drawdown_{n}d"] = ratio(CLOSE, F.when(full, F.col(f"{t}high_{n}"))) - 1.0
        out[f"{QUANT}rebound_from_low_{n}d"] = ratio(CLOSE, F.when(full, F.col(f"{t}low_{n}"))) - 1.0
    return _drop_new(df.withColumns(out), before, out)


def range_volatility(df: DataFrame) -> DataFrame:
    """Parkinson, Garman-Klass, Rogers-Satchell and Yang-Zhang, annualised, variance >= 0."""
    t, before = f"{INTERNAL}rv_", df

    def log_of(a, b):
        return F.log(ratio(a, b))

    df = df.withColumns({f"{t}hl": log_of(HIGH, LOW), f"{t}co": log_of(CLOSE, OPEN),
                         f"{t}on": log_of(OPEN, R.lag(CLOSE)), f"{t}ho": log_of(HIGH, OPEN),
                         f"{t}lo": log_of(LOW, OPEN), f"{t}hc": log_of(HIGH, CLOSE), f"{t}lc": log_of(LOW, CLOSE)})
    hl2, co2 = F.pow(F.col(f"{t}hl"), 2), F.pow(F.col(f"{t}co"), 2)
    df = df.withColumns({
        f"{t}pk": hl2 / (4 * ln(2)),
        f"{t}gk": 0.5 * hl2 - (2 * ln(2) - 1) * co2,
        f"{t}rs": F.col(f"{t}hc") * F.col(f"{t}ho") + F.col(f"{t}lc") * F.col(f"{t}lo")})

    columns = [f"{t}{k}" for k in ("pk", "gk", "rs", "on", "co")]
    df = df.withColumns({f"{t}on2": F.pow(F.col(f"{t}on"), 2), f"{t}co2": co2})
    df = R.with_frame_sums(df, [*columns, f"{t}on2", f"{t}co2"], MARKET_WINDOWS, ROW, t, same=(f"{t}on", f"{t}co"))

    def annual(variance):
        return F.sqrt(clip(variance, low=0) * DAYS_PER_YEAR)

    out = {}
    for n in MARKET_WINDOWS:
        def mean(k):
            return F.when(F.col(f"{t}{t}{k}_known") >= n, F.col(f"{t}{t}{k}_{n}") / n)

        def variance(k):
            std = R.std_from_sums(n, F.col(f"{t}{t}{k}_{n}"), F.col(f"{t}{t}{k}2_{n}"), F.col(f"{t}{t}{k}_same"))
            return F.when(F.col(f"{t}{t}{k}_known") >= n, std * std)
        k = 0.34 / (1.34 + (n + 1) / (n - 1))
        out |= {f"{QUANT}parkinson_vol_{n}d": annual(mean("pk")), f"{QUANT}garman_klass_vol_{n}d": annual(mean("gk")),
                f"{QUANT}rogers_satchell_vol_{n}d": annual(mean("rs")),
                f"{QUANT}yang_zhang_vol_{n}d": annual(variance("on") + k * variance("co") + (1 - k) * mean("rs"))}
    return _drop_new(df.withColumns(out), before, out)


def liquidity(df: DataFrame) -> DataFrame:
    """Average volume and dollar volume, their ratios and z-scores, Amihud and signed volume.

    Each rolling mean and deviation is computed once and used by all measures that need it.
    """
    t, before = f"{INTERNAL}lq_", df
    v, d = F.col(VOLUME).cast("double"), F.col(DOLLARS)
    df = df.withColumns({f"{t}v": v, f"{t}d": d, f"{t}v2": v * v, f"{t}d2": d * d, f"{t}a": ratio(F.abs(F.col(RETURN)), DOLLARS),
                         f"{t}s": F.col(SIGNED_DOLLARS), f"{QUANT}log_dollar_volume": F.log1p(DOLLARS)})
    df = R.with_frame_sums(df, [f"{t}{k}" for k in ("v", "d", "v2", "d2", "a", "s")], LIQUIDITY_WINDOWS, ROW, t, same=(f"{t}v", f"{t}d"))
    out = {}
    for n in LIQUIDITY_WINDOWS:
        def mean(k):
            return F.when(F.col(f"{t}{t}{k}_known") >= n, F.col(f"{t}{t}{k}_{n}") / n)

        def std(k):
            value = R.std_from_sums(n, F.col(f"{t}{t}{k}_{n}"), F.col(f"{t}{t}{k}2_{n}"), F.col(f"{t}{t}{k}_same"))
            return F.when(F.col(f"{t}{t}{k}_known") >= n, value)
        volume, dollars = mean("v"), mean("d")
        out |= {f"{QUANT}adv_{n}d": dollars, f"{QUANT}volume_ratio_{n}d": ratio(VOLUME, volume) - 1.0,
                f"{QUANT}dollar_volume_ratio_{n}d": ratio(DOLLARS, dollars) - 1.0, f"{QUANT}volume_zscore_{n}d": ratio(v - volume, std("v")),
                f"{QUANT}dollar_volume_zscore_{n}d": ratio(d - dollars, std("d")), f"{QUANT}volume_cv_{n}d": ratio(std("v"), volume),
                f"{QUANT}amihud_illiquidity_{n}d": mean("a"), f"{QUANT}signed_dollar_volume_ratio_{n}d": ratio(mean("s"), dollars)}
    out_names = {*out, f"{QUANT}log_dollar_volume"}
    return _drop_new(df.withColumns(out), before, dict.fromkeys(out_names))


def add_quant_features(df: DataFrame) -> DataFrame:
    for step in (returns, sample_position, bar_shape, momentum, return_moments, trend, one_sided_volatility,
                 drawdown, range_volatility, liquidity):
        df = step(df)
    return df.drop(LOG_CLOSE)


# --- deep family: flags are 0.0 while a side is missing ----------------------------------

_C = "__deep_"


def price_context(df: DataFrame) -> DataFrame:
    """Shared inputs of the deep family, prefixed ``__deep_``.  ``prior_*`` look at rows before today."""
    o, h, l, c = (F.col(x) for x in (OPEN, HIGH, LOW, CLOSE))
    prev = R.lag(CLOSE)
    true_range = F.greatest(F.abs(h - l), F.abs(h - prev), F.abs(l - prev))
    df = df.withColumns({
        f"{_C}prev_close": prev, f"{_C}prev_high": R.lag(HIGH), f"{_C}prev_low": R.lag(LOW),
        f"{_C}ret": R.pct_change(CLOSE), f"{_C}gap": ratio(o, prev) - 1.0, f"{_C}intraday": ratio(c, o) - 1.0,
        f"{_C}tr_pct": ratio(true_range, prev), f"{_C}close_location": ratio(2.0 * c - h - l, h - l),
        f"{_C}row": F.row_number().over(R.ticker_window())})
    return df.withColumns({
        f"{_C}prev_ret": R.lag(f"{_C}ret"),
        f"{_C}avg_volume_21": R.mean(VOLUME, 21), f"{_C}ret_std_21": R.std(f"{_C}ret", 21),
        f"{_C}gap_std_63": R.std(f"{_C}gap", 63),
        f"{_C}prior_high_63": R.high(HIGH, 63, end=-1), f"{_C}prior_low_63": R.low(LOW, 63, end=-1),
        f"{_C}tr_median_63": R.median(f"{_C}tr_pct", 63, end=-1)})


def _ctx(name):
    return F.col(f"{_C}{name}")


def _deep_conditions():
    h, l, c = F.col(HIGH), F.col(LOW), F.col(CLOSE)
    gap, prev = _ctx("gap"), _ctx("prev_close")
    up, down = flag(h > _ctx("prior_high_63")), flag(l < _ctx("prior_low_63"))
    return {
        "inside": flag((h <= _ctx("prev_high")) & (l >= _ctx("prev_low"))),
        "outside": flag((h >= _ctx("prev_high")) & (l <= _ctx("prev_low"))),
        "gap_fill": flag((gap > 0) & (l <= prev)) | flag((gap < 0) & (h >= prev)),
        "up": up, "down": down,
        "fail_up": up & flag(c <= _ctx("prev_high")), "fail_down": down & flag(c >= _ctx("prev_low")),
        "big_gap_up": flag(gap > _ctx("gap_std_63")), "big_gap_down": flag(gap < -_ctx("gap_std_63")),
    }


def deep_events(df: DataFrame) -> DataFrame:
    k = _deep_conditions()
    e = "deep_event_"
    return df.withColumns({
        f"{e}inside_day_flag": k["inside"].cast("double"), f"{e}outside_day_flag": k["outside"].cast("double"),
        f"{e}gap_fill_flag": k["gap_fill"].cast("double"),
        f"{e}breakout_up_63d_flag": k["up"].cast("double"), f"{e}breakout_down_63d_flag": k["down"].cast("double"),
        f"{e}breakout_failure_up_63d_flag": k["fail_up"].cast("double"),
        f"{e}breakout_failure_down_63d_flag": k["fail_down"].cast("double")})


def deep_recency(df: DataFrame) -> DataFrame:
    k = _deep_conditions()
    names = {"breakout_up": "up", "breakout_down": "down", "large_gap_up": "big_gap_up", "large_gap_down": "big_gap_down"}
    return df.withColumns({f"deep_event_days_since_{name}_63d": R.days_since(k[key], _ctx("row"))
                           for name, key in names.items()})


def deep_path(df: DataFrame) -> DataFrame:
    sign, before = F.signum(_ctx("ret")), F.signum(_ctx("prev_ret"))
    gap, intraday = F.signum(_ctx("gap")), F.signum(_ctx("intraday"))
    zero = F.lit(0.0)
    moving = differs(gap, zero) & differs(intraday, zero)
    rates = {
        "sign_flip_rate": differs(sign, before) & differs(before, zero),
        "gap_intraday_agreement_rate": flag(gap == intraday) & moving,
        "gap_intraday_reversal_rate": differs(gap, intraday) & moving,
        "close_near_high_rate": flag(_ctx("close_location") > 0.6),
        "close_near_low_rate": flag(_ctx("close_location") < -0.6),
        "positive_tail_share": flag(_ctx("ret") > _ctx("ret_std_21")),
        "negative_tail_share": flag(_ctx("ret") < -_ctx("ret_std_21")),
    }
    return df.withColumns({f"deep_path_{name}_21d": R.mean(c.cast("double"), 21) for name, c in rates.items()})


def deep_sign_autocorrelation(df: DataFrame) -> DataFrame:
    return df.withColumn("deep_state_return_autocorr_sign_21d",
                         R.corr(F.signum(_ctx("ret")), F.signum(_ctx("prev_ret")), 21))


def deep_state_rates(df: DataFrame) -> DataFrame:
    k = _deep_conditions()
    s = "deep_state_"
    return df.withColumns({
        f"{s}range_expansion_rate_21d": R.mean(as_double(_ctx("tr_pct") > _ctx("tr_median_63")), 21),
        f"{s}gap_fill_rate_21d": R.mean(k["gap_fill"].cast("double"), 21),
        f"{s}breakout_up_rate_63d": R.mean(k["up"].cast("double"), 63),
        f"{s}breakout_failure_up_rate_63d": R.mean(k["fail_up"].cast("double"), 63)})


def deep_dominance(df: DataFrame) -> DataFrame:
    gap, intraday = F.abs(_ctx("gap")), F.abs(_ctx("intraday"))
    return df.withColumns({"deep_state_overnight_dominance_21d": R.mean(ratio(gap, intraday), 21),
                           "deep_state_intraday_dominance_21d": R.mean(ratio(intraday, gap), 21)})


def deep_volume_by_direction(df: DataFrame) -> DataFrame:
    """Non-null only when all 21 rows go the same way, as the masked mean needs 21 values."""
    def masked(condition):
        return ratio(R.mean(F.when(flag(condition), F.col(VOLUME)), 21), _ctx("avg_volume_21"))
    return df.withColumns({"deep_state_volume_on_up_days_ratio_21d": masked(_ctx("ret") > 0),
                           "deep_state_volume_on_down_days_ratio_21d": masked(_ctx("ret") < 0)})


def drop_context(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(_C)])


def add_deep_features(df: DataFrame) -> DataFrame:
    for step in (price_context, deep_events, deep_recency, deep_path, deep_sign_autocorrelation, deep_state_rates,
                 deep_dominance, deep_volume_by_direction):
        df = step(df)
    return drop_context(df)
