"""Registered queries for the quant and deep feature families."""

from __future__ import annotations

from math import log as ln
from math import sqrt

from panelspark.operators import quant as Q
from panelspark.plans.registry import BARS, D, PCT, WINDOWS, div, out, query, r, roll, roll2
from panelspark.plans.testbars import bars

# Returns frame in SQL: rn, pc (previous close), ret, lret, dv, sdv.
RETS = BARS + f""",
rets AS (SELECT *, row_number() OVER w AS rn, lag(c) OVER w AS pc, {PCT} AS ret, ln(c) AS lc,
  ln(c) - ln(lag(c) OVER w) AS lret, c * v AS dv, coalesce(sign(c - lag(c) OVER w), 0) * c * v AS sdv
  FROM bars {WINDOWS}),
rets2 AS (SELECT *, lag(ret) OVER w AS ret1, lag(h) OVER w AS ph, lag(l) OVER w AS pl,
  o / nullif(pc, 0) - 1 AS gap, c / nullif(o, 0) - 1 AS intr,
  greatest(abs(h - l), abs(h - pc), abs(l - pc)) / nullif(pc, 0) AS trp,
  (2 * c - h - l) / nullif(h - l, 0) AS clv FROM rets {WINDOWS})"""


@query("r106_internal_returns", f"""WITH {RETS} SELECT {D}, {r('ret', '_quant_internal_return_1d')},
  {r('lret', '_quant_internal_log_return_1d')}, {r('sdv', '_quant_internal_signed_dollar_volume', 4)} FROM rets""")
def _(spark, d):
    return out(Q.returns(bars(spark, d)), {Q.RETURN: 6, Q.LOG_RETURN: 6, Q.SIGNED_DOLLARS: 4})


@query("r107_sample_position", f"""WITH {BARS} SELECT {D},
  CAST(date - lag(date) OVER w AS DOUBLE) AS quant_calendar_gap_days, row_number() OVER w AS quant_days_in_sample
  FROM bars {WINDOWS}""")
def _(spark, d):
    return out(Q.sample_position(bars(spark, d)), keep=("date", "ticker", "quant_calendar_gap_days", Q.ROW))


SHAPE = ("gap_return intraday_return high_low_range_pct true_range_pct close_location_value body_to_range "
         "upper_shadow_to_range lower_shadow_to_range").split()


@query("r108_bar_shape", f"""WITH {RETS} SELECT {D}, {r('gap', 'quant_gap_return')},
  {r('intr', 'quant_intraday_return')}, {r(div('h - l', 'c'), 'quant_high_low_range_pct')},
  {r('trp', 'quant_true_range_pct')}, {r('clv', 'quant_close_location_value')},
  {r(div('abs(c - o)', 'h - l'), 'quant_body_to_range')},
  {r(div('h - greatest(o, c)', 'h - l'), 'quant_upper_shadow_to_range')},
  {r(div('least(o, c) - l', 'h - l'), 'quant_lower_shadow_to_range')} FROM rets2""")
def _(spark, d):
    return out(Q.bar_shape(bars(spark, d)), [f"quant_{x}" for x in SHAPE])


@query("r109_momentum", f"""WITH {RETS} SELECT {D}, {", ".join(
    r(f'lc - lag(lc, {n}) OVER w', f'quant_momentum_{n}d') for n in Q.RETURN_WINDOWS)} FROM rets {WINDOWS}""")
def _(spark, d):
    return out(Q.momentum(Q.returns(bars(spark, d))), [f"quant_momentum_{n}d" for n in Q.RETURN_WINDOWS])


@query("r110_return_moments", f"""WITH {RETS} SELECT {D}, {", ".join(
    r(roll('stddev_samp', 'ret', n) + f' * {sqrt(252)}', f'quant_realized_vol_{n}d', 5) + ', '
    + r(roll('skewness', 'ret', n), f'quant_return_skew_{n}d', 5) + ', '
    + r(roll('kurtosis', 'ret', n), f'quant_return_kurt_{n}d', 5) + ', '
    + r(roll2('corr', 'ret', 'ret1', n), f'quant_return_autocorr_lag1_{n}d', 5)
    for n in Q.VOLATILITY_WINDOWS)} FROM rets2 {WINDOWS}""")
def _(spark, d):
    names = [f"quant_{x}_{n}d" for n in Q.VOLATILITY_WINDOWS
             for x in ("realized_vol", "return_skew", "return_kurt", "return_autocorr_lag1")]
    return out(Q.return_moments(Q.returns(bars(spark, d))), names, digits=5)


def _trend_sql(n):
    full = f"count(lc) OVER w{n} >= {n}"
    slope = f"CASE WHEN {full} THEN exp(regr_slope(lc, rn) OVER w{n} * 252) - 1 END"
    r2 = (f"CASE WHEN {full} AND max(lc) OVER w{n} <> min(lc) OVER w{n} "
          f"THEN greatest(0, regr_r2(lc, rn) OVER w{n}) END")
    return ", ".join([f"{slope} AS s{n}", f"{r2} AS q{n}",
                      f"abs(c - lag(c, {n}) OVER w) / nullif({roll('sum', 'step', n)}, 0) AS e{n}",
                      f"{roll('avg', 'pos', n)} AS p{n}"])


# The annualised slope is exponential, so it is compared on a log scale.
@query("r111_trend", f"""WITH {RETS},
 t AS (SELECT *, abs(c - pc) AS step, CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END AS pos FROM rets),
 u AS (SELECT date, ticker, {", ".join(_trend_sql(n) for n in Q.TREND_WINDOWS)} FROM t {WINDOWS})
 SELECT {D}, {", ".join(r(f'sign(s{n}) * ln(1 + abs(s{n}))', f'quant_trend_slope_{n}d') + ', ' + r(f'q{n}', f'quant_trend_r2_{n}d') + ', '
                        + r(f'sign(s{n} * q{n}) * ln(1 + abs(s{n} * q{n}))', f'quant_trend_strength_{n}d') + ', '
                        + r(f'e{n}', f'quant_efficiency_ratio_{n}d') + ', ' + r(f'p{n}', f'quant_positive_day_ratio_{n}d')
                        for n in Q.TREND_WINDOWS)} FROM u""")
def _(spark, d):
    from pyspark.sql import functions as F
    df = Q.trend(Q.returns(bars(spark, d)))
    logs = {}
    for n in Q.TREND_WINDOWS:
        slope, strength = F.col(f"quant_trend_slope_{n}d"), F.col(f"quant_trend_strength_{n}d")
        logs[f"quant_trend_slope_{n}d"] = F.signum(slope) * F.log1p(F.abs(slope))
        logs[f"quant_trend_strength_{n}d"] = F.signum(strength) * F.log1p(F.abs(strength))
    names = [f"quant_{x}_{n}d" for n in Q.TREND_WINDOWS
             for x in ("trend_slope", "trend_r2", "trend_strength", "efficiency_ratio", "positive_day_ratio")]
    return out(df.withColumns(logs), names)


@query("r112_one_sided_volatility", f"""WITH {RETS}, t AS (SELECT *,
  CASE WHEN ret < 0 THEN ret * ret WHEN ret >= 0 THEN 0 END AS dn, CASE WHEN ret > 0 THEN ret * ret WHEN ret <= 0 THEN 0 END AS up
  FROM rets) SELECT {D}, {", ".join(r(f"sqrt(({roll('avg', 'dn', n)}) * 252)", f'quant_downside_vol_{n}d') + ', '
                                    + r(f"sqrt(({roll('avg', 'up', n)}) * 252)", f'quant_upside_vol_{n}d')
                                    for n in (21, 63))} FROM t {WINDOWS}""")
def _(spark, d):
    return out(Q.one_sided_volatility(Q.returns(bars(spark, d))),
               [f"quant_{x}_vol_{n}d" for n in (21, 63) for x in ("downside", "upside")])


@query("r113_drawdown", f"""WITH {BARS} SELECT {D}, {", ".join(
    r(f"c / nullif({roll('max', 'c', n)}, 0) - 1", f'quant_drawdown_{n}d') + ', '
    + r(f"c / nullif({roll('min', 'c', n)}, 0) - 1", f'quant_rebound_from_low_{n}d')
    for n in (63, 252))} FROM bars {WINDOWS}""")
def _(spark, d):
    return out(Q.drawdown(bars(spark, d)), [f"quant_{x}_{n}d" for n in (63, 252) for x in ("drawdown", "rebound_from_low")])


def _rv(n):
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    rs = f"({roll('avg', 'rs', n)})"
    yz = f"({roll('var_samp', 'lon', n)}) + {k} * ({roll('var_samp', 'lco', n)}) + {1 - k} * {rs}"
    def a(x):
        return f"CASE WHEN ({x}) IS NOT NULL THEN sqrt(greatest({x}, 0) * 252) END"
    return ", ".join([r(a(f"({roll('avg', 'pk', n)})"), f"quant_parkinson_vol_{n}d"),
                      r(a(f"({roll('avg', 'gk', n)})"), f"quant_garman_klass_vol_{n}d"),
                      r(a(rs), f"quant_rogers_satchell_vol_{n}d"), r(a(yz), f"quant_yang_zhang_vol_{n}d")])


@query("r114_range_volatility", f"""WITH {RETS},
  t AS (SELECT *, ln(h / l) AS lhl, ln(c / o) AS lco, ln(o / pc) AS lon FROM rets),
  u AS (SELECT *, lhl * lhl / {4 * ln(2)} AS pk, 0.5 * lhl * lhl - {2 * ln(2) - 1} * lco * lco AS gk,
    ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o) AS rs FROM t)
  SELECT {D}, {", ".join(_rv(n) for n in (21, 63))} FROM u {WINDOWS}""")
def _(spark, d):
    return out(Q.range_volatility(Q.returns(bars(spark, d))),
               [f"quant_{x}_vol_{n}d" for n in (21, 63)
                for x in ("parkinson", "garman_klass", "rogers_satchell", "yang_zhang")])


def _liq(n):
    v, dv = f"({roll('avg', 'v', n)})", f"({roll('avg', 'dv', n)})"
    sv, sd = f"({roll('stddev_samp', 'v', n)})", f"({roll('stddev_samp', 'dv', n)})"
    return ", ".join([r(dv, f"quant_adv_{n}d", 3), r(div('v', v) + " - 1", f"quant_volume_ratio_{n}d"),
                      r(div('dv', dv) + " - 1", f"quant_dollar_volume_ratio_{n}d"),
                      r(div(f"v - {v}", sv), f"quant_volume_zscore_{n}d"),
                      r(div(f"dv - {dv}", sd), f"quant_dollar_volume_zscore_{n}d"),
                      r(div(sv, v), f"quant_volume_cv_{n}d"),
                      r(f"1e6 * ({roll('avg', 'am', n)})", f"quant_amihud_illiquidity_{n}d"),
                      r(div(f"({roll('avg', 'sdv', n)})", dv), f"quant_signed_dollar_volume_ratio_{n}d")])


@query("r115_liquidity", f"""WITH {RETS}, t AS (SELECT *, abs(ret) / nullif(dv, 0) AS am FROM rets)
  SELECT {D}, {r('dv', 'quant_dollar_volume', 3)}, {r('ln(1 + dv)', 'quant_log_dollar_volume')},
  {", ".join(_liq(n) for n in Q.LIQUIDITY_WINDOWS)} FROM t {WINDOWS}""")
def _(spark, d):
    from pyspark.sql import functions as F
    df = Q.liquidity(Q.returns(bars(spark, d)))
    digits = {"quant_dollar_volume": 3, "quant_log_dollar_volume": 6}
    for n in Q.LIQUIDITY_WINDOWS:
        df = df.withColumn(f"quant_amihud_illiquidity_{n}d", F.col(f"quant_amihud_illiquidity_{n}d") * 1e6)
        digits |= {f"quant_adv_{n}d": 3} | {f"quant_{x}_{n}d": 6 for x in (
            "volume_ratio", "dollar_volume_ratio", "volume_zscore", "dollar_volume_zscore", "volume_cv",
            "amihud_illiquidity", "signed_dollar_volume_ratio")}
    return out(df, digits)


# --- deep family ----------------------------------------------------------------------------

DEEP = RETS + f""",
ctx AS (SELECT *, {roll('avg', 'v', 21)} AS av21, {roll('stddev_samp', 'ret', 21)} AS rs21,
  {roll('stddev_samp', 'gap', 63)} AS gs63,
  CASE WHEN count(h) OVER p63 >= 63 THEN max(h) OVER p63 END AS phi,
  CASE WHEN count(l) OVER p63 >= 63 THEN min(l) OVER p63 END AS plo,
  CASE WHEN count(trp) OVER p63 >= 63 THEN median(trp) OVER p63 END AS trm FROM rets2 {WINDOWS}),
fl AS (SELECT *, coalesce(h <= ph AND l >= pl, false) AS f_in, coalesce(h >= ph AND l <= pl, false) AS f_out,
  coalesce(gap > 0 AND l <= pc, false) OR coalesce(gap < 0 AND h >= pc, false) AS f_gf,
  coalesce(h > phi, false) AS f_up, coalesce(l < plo, false) AS f_dn,
  coalesce(h > phi AND c <= ph, false) AS f_fu, coalesce(l < plo AND c >= pl, false) AS f_fd,
  coalesce(gap > gs63, false) AS f_gu, coalesce(gap < -gs63, false) AS f_gd FROM ctx)"""


def _deep(spark, d):
    return Q.price_context(bars(spark, d))


@query("r116_price_context", f"""WITH {DEEP} SELECT {D}, {r('pc', 'prev_close')}, {r('ph', 'prev_high')}, {r('pl', 'prev_low')},
  {r('av21', 'avg_volume_21')}, {r('rs21', 'ret_std_21')}, {r('gs63', 'gap_std_63')}, {r('phi', 'prior_high_63')},
  {r('plo', 'prior_low_63')}, {r('trm', 'tr_median_63')}, {r('trp', 'tr_pct')}, {r('clv', 'close_location')} FROM fl""")
def _(spark, d):
    names = ("prev_close prev_high prev_low avg_volume_21 ret_std_21 gap_std_63 prior_high_63 prior_low_63 "
             "tr_median_63 tr_pct close_location").split()
    return out(_deep(spark, d).withColumnsRenamed({f"__deep_{x}": x for x in names}), names)


EVENTS = {"inside_day_flag": "f_in", "outside_day_flag": "f_out", "gap_fill_flag": "f_gf", "breakout_up_63d_flag": "f_up",
          "breakout_down_63d_flag": "f_dn", "breakout_failure_up_63d_flag": "f_fu",
          "breakout_failure_down_63d_flag": "f_fd"}


@query("r117_event_flags", f"""WITH {DEEP} SELECT {D}, {", ".join(
    f"CAST({s} AS INT)::DOUBLE AS deep_event_{n}" for n, s in EVENTS.items())} FROM fl""")
def _(spark, d):
    return out(Q.deep_events(_deep(spark, d)), [f"deep_event_{x}" for x in EVENTS])


RECENT = {"breakout_up": "f_up", "breakout_down": "f_dn", "large_gap_up": "f_gu", "large_gap_down": "f_gd"}


@query("r118_event_recency", f"""WITH {DEEP} SELECT {D}, {", ".join(
    f"CAST(rn - max(CASE WHEN {s} THEN rn END) OVER (PARTITION BY ticker ORDER BY date) AS DOUBLE) "
    f"AS deep_event_days_since_{n}_63d" for n, s in RECENT.items())} FROM fl""")
def _(spark, d):
    return out(Q.deep_recency(_deep(spark, d)), [f"deep_event_days_since_{x}_63d" for x in RECENT])


RATES = {"sign_flip_rate": "sign(ret) IS NOT NULL AND sign(ret) = sign(ret1) IS NOT TRUE",
         }
_NE0 = "(sign(gap) = 0) IS NOT TRUE AND (sign(intr) = 0) IS NOT TRUE"
RATES = {"sign_flip_rate": "(sign(ret) = sign(ret1)) IS NOT TRUE AND (sign(ret1) = 0) IS NOT TRUE",
         "gap_intraday_agreement_rate": f"(sign(gap) = sign(intr)) IS TRUE AND {_NE0}",
         "gap_intraday_reversal_rate": f"(sign(gap) = sign(intr)) IS NOT TRUE AND {_NE0}",
         "close_near_high_rate": "coalesce(clv > 0.6::DOUBLE, false)", "close_near_low_rate": "coalesce(clv < -0.6::DOUBLE, false)",
         "positive_tail_share": "coalesce(ret > rs21, false)", "negative_tail_share": "coalesce(ret < -rs21, false)"}


@query("r119_path_rates", f"""WITH {DEEP}, t AS (SELECT date, ticker, {", ".join(
    f"CASE WHEN {s} THEN 1.0::DOUBLE ELSE 0.0 END AS x{i}" for i, s in enumerate(RATES.values()))} FROM fl)
  SELECT {D}, {", ".join(r(roll('avg', f'x{i}', 21), f'deep_path_{n}_21d') for i, n in enumerate(RATES))} FROM t {WINDOWS}""")
def _(spark, d):
    return out(Q.deep_path(_deep(spark, d)), [f"deep_path_{x}_21d" for x in RATES])


@query("r120_sign_autocorrelation", f"""WITH {RETS}, t AS (SELECT *, CAST(sign(ret) AS DOUBLE) AS a, CAST(sign(ret1) AS DOUBLE) AS b FROM rets2)
  SELECT {D}, {r(roll2('corr', 'a', 'b', 21), 'deep_state_return_autocorr_sign_21d')} FROM t {WINDOWS}""")
def _(spark, d):
    return out(Q.deep_sign_autocorrelation(_deep(spark, d)), ["deep_state_return_autocorr_sign_21d"])


@query("r121_state_rates", f"""WITH {DEEP}, t AS (SELECT *, CASE WHEN coalesce(trp > trm, false) THEN 1.0::DOUBLE ELSE 0 END AS a,
  CASE WHEN f_gf THEN 1.0::DOUBLE ELSE 0 END AS b, CASE WHEN f_up THEN 1.0::DOUBLE ELSE 0 END AS u,
  CASE WHEN f_fu THEN 1.0::DOUBLE ELSE 0 END AS f FROM fl)
  SELECT {D}, {r(roll('avg', 'a', 21), 'deep_state_range_expansion_rate_21d')}, {r(roll('avg', 'b', 21), 'deep_state_gap_fill_rate_21d')},
  {r(roll('avg', 'u', 63), 'deep_state_breakout_up_rate_63d')}, {r(roll('avg', 'f', 63), 'deep_state_breakout_failure_up_rate_63d')}
  FROM t {WINDOWS}""")
def _(spark, d):
    return out(Q.deep_state_rates(_deep(spark, d)),
               [f"deep_state_{x}" for x in ("range_expansion_rate_21d", "gap_fill_rate_21d", "breakout_up_rate_63d",
                                            "breakout_failure_up_rate_63d")])


@query("r122_dominance", f"""WITH {RETS}, t AS (SELECT *, abs(gap) / nullif(abs(intr), 0) AS a, abs(intr) / nullif(abs(gap), 0) AS b FROM rets2)
  SELECT {D}, {r(roll('avg', 'a', 21), 'deep_state_overnight_dominance_21d', 4)},
  {r(roll('avg', 'b', 21), 'deep_state_intraday_dominance_21d', 4)} FROM t {WINDOWS}""")
def _(spark, d):
    return out(Q.deep_dominance(_deep(spark, d)),
               ["deep_state_overnight_dominance_21d", "deep_state_intraday_dominance_21d"], digits=4)


@query("r123_volume_by_direction", f"""WITH {DEEP}, t AS (SELECT *, CASE WHEN ret > 0 THEN v END AS a, CASE WHEN ret < 0 THEN v END AS b FROM fl)
  SELECT {D}, {r(div(f"({roll('avg', 'a', 21)})", 'av21'), 'deep_state_volume_on_up_days_ratio_21d')},
  {r(div(f"({roll('avg', 'b', 21)})", 'av21'), 'deep_state_volume_on_down_days_ratio_21d')} FROM t {WINDOWS}""")
def _(spark, d):
    return out(Q.deep_volume_by_direction(_deep(spark, d)),
               ["deep_state_volume_on_up_days_ratio_21d", "deep_state_volume_on_down_days_ratio_21d"])
