"""Registered queries: cleaning, labels, splits, folds, samples, window primitives."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import contract as K
from panelspark.contract import CLOSE, DATE, KEY, OPEN, SPLIT, TICKER, VOLUME
from panelspark.functions import crosssection as X
from panelspark.functions import rolling as R
from panelspark.functions import scalar as S
from panelspark.operators import calendars as C
from panelspark.operators import clean as CL
from panelspark.operators import labels as L
from panelspark.operators import market as M
from panelspark.operators import quant as Q
from panelspark.operators import splits as SP
from panelspark.plans.q_features import RETS
from panelspark.plans.q_market import rank_sql
from panelspark.plans.registry import BARS, D, PANEL, WINDOWS, div, out, query, r, roll, roll2
from panelspark.plans.testbars import bars, panel

TEST_START = "2000-01-01"

# --- window primitives -------------------------------------------------------------------------------


@query("r087_lag_lead_diff_pct_change", f"""WITH {BARS} SELECT {D}, {r('lag(c, 5) OVER w', 'lag_5')}, {r('lead(c, 2) OVER w', 'lead_2')},
  {r('c - lag(c, 3) OVER w', 'diff_3')}, {r('c / nullif(lag(c, 4) OVER w, 0) - 1', 'pct_change_4')} FROM bars {WINDOWS}""")
def _(spark, d):
    df = bars(spark, d).withColumns({"lag_5": R.lag(CLOSE, 5), "lead_2": R.lead(CLOSE, 2), "diff_3": R.diff(CLOSE, 3),
                                     "pct_change_4": R.pct_change(CLOSE, 4)})
    return out(df, ["lag_5", "lead_2", "diff_3", "pct_change_4"])


@query("r088_rolling_mean_sum_min_max", f"""WITH {BARS} SELECT {D}, {r(roll('avg', 'c', 21, 5), 'mean_21')}, {r(roll('sum', 'v', 10), 'sum_10')},
  {r(roll('min', 'l', 63), 'min_63')}, {r(roll('max', 'h', 63), 'max_63')} FROM bars {WINDOWS}""")
def _(spark, d):
    df = bars(spark, d).withColumns({"mean_21": R.mean(CLOSE, 21, 5), "sum_10": R.total(VOLUME, 10),
                                     "min_63": R.low(K.LOW, 63), "max_63": R.high(K.HIGH, 63)})
    return out(df, ["mean_21", "sum_10", "min_63", "max_63"])


def _simple(name, sql_expr, column, digits=6):
    @query(name, f"WITH {RETS} SELECT {D}, {r(sql_expr, 'value', digits)} FROM rets2 {WINDOWS}")
    def _(spark, d):
        df = Q.returns(bars(spark, d)).withColumns({"_lag": R.lag(Q.RETURN), "_step": F.abs(R.diff(CLOSE))})
        return out(df.withColumn("value", column()), ["value"], digits=digits)


_simple("r089_rolling_sample_std", roll("stddev_samp", "ret", 21), lambda: R.std(Q.RETURN, 21))
_simple("r089_rolling_sample_var", roll("var_samp", "lret", 63), lambda: R.var(Q.LOG_RETURN, 63))
_simple("r090_rolling_median", roll("median", "c", 63, 20), lambda: R.median(CLOSE, 63, 20))
_simple("r091_rolling_skew", roll("skewness", "ret", 21), lambda: R.skew(Q.RETURN, 21))
_simple("r091_rolling_excess_kurtosis", roll("kurtosis", "ret", 63), lambda: R.kurt(Q.RETURN, 63), 5)
_simple("r092_rolling_correlation", roll2("corr", "ret", "ret1", 63), lambda: R.corr(Q.RETURN, "_lag", 63))
_simple("r092_rolling_covariance", roll2("covar_samp", "lret", "ret1", 21), lambda: R.cov(Q.LOG_RETURN, "_lag", 21), 5)
_simple("r093_rolling_zscore", div(f"v - ({roll('avg', 'v', 21)})", f"({roll('stddev_samp', 'v', 21)})"), lambda: R.zscore(VOLUME, 21))
_simple("r101_row_number_in_sample", "rn", lambda: F.col(Q.ROW))


@query("r094_rolling_ols_slope", f"""WITH {RETS} SELECT {D}, {r('CASE WHEN count(lc) OVER w63 >= 63 THEN regr_slope(lc, rn) OVER w63 END', 'slope')} FROM rets {WINDOWS}""")
def _(spark, d):
    df = Q.trend(Q.returns(bars(spark, d)))
    return out(df.withColumn("slope", F.log1p("quant_trend_slope_63d") / 252), ["slope"])


@query("r095_rolling_ols_r2", f"""WITH {RETS} SELECT {D}, {r('CASE WHEN count(lc) OVER w21 >= 21 AND max(lc) OVER w21 <> min(lc) OVER w21 THEN greatest(0, regr_r2(lc, rn) OVER w21) END', 'quant_trend_r2_21d')} FROM rets {WINDOWS}""")
def _(spark, d):
    return out(Q.trend(Q.returns(bars(spark, d))), ["quant_trend_r2_21d"])


@query("r096_efficiency_ratio", f"""WITH {RETS}, t AS (SELECT *, abs(c - pc) AS step FROM rets)
  SELECT {D}, {r(f"abs(c - lag(c, 63) OVER w) / nullif({roll('sum', 'step', 63)}, 0)", 'quant_efficiency_ratio_63d')} FROM t {WINDOWS}""")
def _(spark, d):
    return out(Q.trend(Q.returns(bars(spark, d))), ["quant_efficiency_ratio_63d"])


@query("r097_days_since_last_true", f"""WITH {RETS} SELECT {D}, CAST(rn - max(CASE WHEN ret > 1 THEN rn END) OVER w AS DOUBLE) AS days_since FROM rets {WINDOWS}""")
def _(spark, d):
    df = Q.returns(bars(spark, d))
    return out(df.withColumn("days_since", R.days_since(S.flag(F.col(Q.RETURN) > 1), F.col(Q.ROW))), keep=("date", "ticker", "days_since"))


# A sparse series: the close of rows with volume above 40.
@query("r098_limited_forward_fill", f"""WITH {BARS}, t AS (SELECT *, CASE WHEN v > 40 THEN c END AS x FROM bars)
  SELECT {D}, {r('last_value(x IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS 5 PRECEDING)', 'filled_5')},
  {r('last_value(x IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)', 'filled')} FROM t""")
def _(spark, d):
    df = bars(spark, d).withColumn("x", F.when(F.col(VOLUME) > 40, F.col(CLOSE)))
    return out(df.withColumns({"filled_5": R.forward_fill("x", 5), "filled": R.forward_fill("x")}), ["filled_5", "filled"])


@query("r100_running_max_product_sum", f"""WITH {RETS} SELECT {D}, {r('max(c) OVER w', 'cummax')}, {r('sum(v) OVER w', 'cumsum')},
  {r('sum(lret) OVER w', 'log_cumprod')} FROM rets {WINDOWS}""")
def _(spark, d):
    from pyspark.sql import Window
    w = R.ticker_window().rowsBetween(Window.unboundedPreceding, 0)
    df = Q.returns(bars(spark, d)).withColumns({"cummax": F.max(CLOSE).over(w), "cumsum": F.sum(VOLUME).over(w),
                                                "log_cumprod": F.sum(F.log1p(Q.RETURN)).over(w)})
    return out(df, ["cummax", "cumsum", "log_cumprod"])


# --- cleaning ---------------------------------------------------------------------------------------------
# Raw input with errors: the return is infinite where volume is 1, the volume negative where it is 2.

RAW = RETS + """, raw AS (SELECT *, CASE WHEN v = 1 AND rn > 1 THEN 'Infinity'::DOUBLE ELSE ln(o / pc) END AS x,
  CASE WHEN v = 2 THEN -v ELSE v END AS vol FROM rets)"""


def _raw(spark, d):
    df = Q.returns(bars(spark, d))
    x = F.when((F.col(VOLUME) == 1) & (F.col(Q.ROW) > 1), F.lit(float("inf"))).otherwise(F.log(F.col(OPEN) / R.lag(CLOSE)))
    df = df.withColumn("stock_open_log_return", x)
    return df.withColumn(VOLUME, F.when(F.col(VOLUME) == 2, -F.col(VOLUME)).otherwise(F.col(VOLUME)))


FLAGS = RAW + f""", f0 AS (SELECT *, coalesce(vol < 0, false) AS neg, coalesce(isinf(x), false) AS inf, CASE WHEN NOT isinf(x) THEN x END AS y FROM raw),
f1 AS (SELECT *, {roll('median', 'y', 63, 20)} AS med, median(y) OVER (PARTITION BY date) AS dm FROM f0 {WINDOWS}),
f2 AS (SELECT *, abs(y - med) AS dev, abs(y - dm) AS dd FROM f1),
f3 AS (SELECT *, 1.4826::DOUBLE * ({roll('median', 'dev', 63, 20)}) AS sg, 1.4826::DOUBLE * median(dd) OVER (PARTITION BY date) AS ds FROM f2 {WINDOWS}),
f4 AS (SELECT *, coalesce(sg > 0 AND dev > 6 * sg, false) AS tk,
  coalesce(ds > 0 AND dd > 5 * ds, false) OR coalesce(ds = 0 AND dd > 0 AND abs(y) >= 0.08, false) AS cs FROM f3),
f5 AS (SELECT *, neg OR inf AS err, neg OR inf OR tk OR cs AS outl FROM f4),
flagged AS (SELECT *, CASE WHEN err THEN 'data_error' WHEN outl AND abs(y) >= 0.08 THEN 'extreme' WHEN outl AND abs(y) >= 0.04 THEN 'elevated' ELSE 'normal' END AS sev,
  concat_ws('|', CASE WHEN neg THEN 'NEGATIVE_VOLUME' END, CASE WHEN inf THEN 'INVALID_RETURN' END, CASE WHEN tk THEN 'TICKER_RETURN_EXTREME' END,
  CASE WHEN cs THEN 'CROSS_SECTION_RETURN_EXTREME' END) AS reason FROM f5)"""


def _int(df, *names):
    return df.withColumns({n: F.col(n).cast("int") for n in names})


@query("r156_data_error_flags", f"""WITH {FLAGS} SELECT {D}, err::INT AS data_error_flag,
  concat_ws('|', CASE WHEN neg THEN 'NEGATIVE_VOLUME' END, CASE WHEN inf THEN 'INVALID_RETURN' END) AS data_error_reason FROM flagged""")
def _(spark, d):
    df = CL.data_errors(_raw(spark, d), "stock_open_log_return")
    return out(_int(df, "data_error_flag"), keep=("date", "ticker", "data_error_flag", "data_error_reason"))


def _clean_raw(spark, d):
    df = _raw(spark, d)
    x = F.col("stock_open_log_return")
    return df.withColumn("y", F.when(F.abs(x) < float("inf"), x))


@query("r157_hampel_filter", f"WITH {FLAGS} SELECT {D}, tk::INT AS ticker_return_extreme_flag FROM flagged")
def _(spark, d):
    return out(_int(CL.hampel_flags(_clean_raw(spark, d), "y"), "ticker_return_extreme_flag"), keep=("date", "ticker", "ticker_return_extreme_flag"))


@query("r158_cross_section_mad_outlier", f"WITH {FLAGS} SELECT {D}, cs::INT AS cross_section_return_extreme_flag FROM flagged")
def _(spark, d):
    # The split plan: medians from aggregated values, no group in one task.
    return out(_int(CL.cross_section_flags(_clean_raw(spark, d), "y", split=True), "cross_section_return_extreme_flag"),
               keep=("date", "ticker", "cross_section_return_extreme_flag"))


@query("r159_outlier_severity", f"WITH {FLAGS} SELECT sev AS outlier_severity, count(*) AS rows, sum(outl::INT)::BIGINT AS flagged FROM flagged GROUP BY sev")
def _(spark, d):
    df = CL.apply_outlier_flags(_raw(spark, d))
    return df.groupBy("outlier_severity").agg(F.count("*").alias("rows"), F.count_if("is_outlier_flag").alias("flagged"))


@query("r160_apply_outlier_flags", f"""WITH {FLAGS} SELECT {D}, err::INT AS data_error_flag, tk::INT AS ticker_return_extreme_flag,
  cs::INT AS cross_section_return_extreme_flag, outl::INT AS is_outlier_flag, sev AS outlier_severity, reason AS outlier_reason FROM flagged""")
def _(spark, d):
    names = ("data_error_flag", "ticker_return_extreme_flag", "cross_section_return_extreme_flag", "is_outlier_flag")
    return out(_int(CL.apply_outlier_flags(_raw(spark, d)), *names), keep=("date", "ticker", *names, "outlier_severity", "outlier_reason"))


def _flagged(spark, d):
    return CL.apply_outlier_flags(_raw(spark, d))


@query("r078_outlier_daily_rate", f"WITH {FLAGS} SELECT CAST(date AS VARCHAR) AS date, {r('avg(outl::INT)', 'outlier_rate')} FROM flagged GROUP BY date")
def _(spark, d):
    return out(CL.outlier_summaries(_flagged(spark, d), "stock_open_log_return")["daily_rate"], ["outlier_rate"], keep=("date",))


@query("r078_outlier_severity_counts", f"""WITH {FLAGS} SELECT s.sev AS outlier_severity, count(f.sev) AS rows
  FROM (VALUES ('normal'), ('elevated'), ('extreme'), ('data_error')) s(sev) LEFT JOIN flagged f ON f.sev = s.sev GROUP BY s.sev""")
def _(spark, d):
    return CL.outlier_summaries(_flagged(spark, d), "stock_open_log_return")["severity_counts"]


@query("r078_outlier_return_histogram", f"""WITH {FLAGS} SELECT outl::INT AS is_outlier_flag,
  CASE WHEN x < -5 THEN 0 WHEN x >= 5 THEN 51 ELSE CAST(floor((x + 5) / 10 * 50) AS BIGINT) + 1 END AS bucket, count(*) AS rows
  FROM flagged WHERE x IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    df = CL.outlier_summaries(_flagged(spark, d), "stock_open_log_return")["return_histogram"]
    return _int(df, "is_outlier_flag")


@query("r038_drop_data_errors", f"""WITH {FLAGS} SELECT {D}, tk::INT AS ticker_return_extreme_flag, cs::INT AS cross_section_return_extreme_flag FROM flagged WHERE NOT err""")
def _(spark, d):
    df = CL.drop_data_errors(_flagged(spark, d))
    assert not set(CL.DIAGNOSTICS) & set(df.columns)
    return out(_int(df, "ticker_return_extreme_flag", "cross_section_return_extreme_flag"),
               keep=("date", "ticker", "ticker_return_extreme_flag", "cross_section_return_extreme_flag"))


# Columns of known character: constant, nearly constant, indicator, informative.
PROFILE = BARS + """, p AS (SELECT date, ticker, 7 AS fixed, CASE WHEN v > 90 THEN 2 ELSE 3 END AS nearly, CASE WHEN v > 90 THEN 1 ELSE 0 END AS indicator,
  CAST(v AS INT) AS volume FROM bars)"""


def _profiled(spark, d):
    v = F.col(VOLUME)
    return bars(spark, d).select(DATE, TICKER, F.lit(7).alias("fixed"), F.when(v > 90, 2).otherwise(3).alias("nearly"),
                                 F.when(v > 90, 1).otherwise(0).alias("indicator"), v.cast("int").alias("volume"))


def _profile_sql(c):
    return (f"SELECT '{c}' AS \"column\", max(n) / sum(n) AS s, count(*) AS k FROM (SELECT {c}, count(*) AS n FROM p GROUP BY 1)")


@query("r037_quasi_constant_profile", f"""WITH {PROFILE} SELECT "column", {r('s', 'dominant_share')}, (k <= 1)::INT AS constant
  FROM ({' UNION ALL '.join(_profile_sql(c) for c in ('fixed', 'nearly', 'indicator', 'volume'))})""")
def _(spark, d):
    df = CL.column_profile(_profiled(spark, d), ["fixed", "nearly", "indicator", "volume"])
    return out(_int(df, "constant"), ["dominant_share"], keep=("column", "constant"))


@query("r036_drop_constant_columns", f"""WITH {PROFILE} SELECT {D}, indicator, volume FROM p""")
def _(spark, d):
    """Constant and quasi-constant columns go, the 0/1 indicator stays."""
    kept = CL.drop_uninformative(_profiled(spark, d))
    # The second column is dominated only where few volumes exceed 90.
    assert "fixed" not in kept.columns
    return out(kept, keep=("date", "ticker", "indicator", "volume"))


@query("r035_drop_fully_missing", f"WITH {BARS} SELECT {D}, {r('c', CLOSE, 4)} FROM bars")
def _(spark, d):
    df = bars(spark, d).select(DATE, TICKER, CLOSE, F.lit(None).cast("double").alias("empty"))
    kept = CL.drop_fully_missing(df, KEY)
    return out(kept, [c for c in kept.columns if c not in KEY], digits=4)


@query("r034_drop_columns_with_missing", f"WITH {BARS} SELECT {D}, {r('c', CLOSE, 4)} FROM bars")
def _(spark, d):
    df = bars(spark, d).select(DATE, TICKER, CLOSE, F.when(F.col(VOLUME) > 10, F.col(CLOSE)).alias("holes"))
    kept = CL.drop_columns_with_missing(df, KEY)
    return out(kept, [c for c in kept.columns if c not in KEY], digits=4)


@query("r033_drop_rows_missing", f"WITH {RETS} SELECT {D}, {r('ret', 'x')} FROM rets WHERE ret IS NOT NULL AND v > 10")
def _(spark, d):
    df = Q.returns(bars(spark, d)).withColumns({"x": F.col(Q.RETURN), "holes": F.when(F.col(VOLUME) > 10, 1)})
    return out(CL.drop_rows_missing(df, ["x", "holes", "not_there"]), ["x"])


STATS = RETS + ", cs AS (SELECT date, ticker, ret, CASE WHEN v > 10 THEN v END AS holes FROM rets)"


def _stat_frame(spark, d):
    return Q.returns(bars(spark, d)).select(DATE, TICKER, F.col(Q.RETURN).alias("ret"), F.when(F.col(VOLUME) > 10, F.col(VOLUME)).alias("holes"))


@query("r076_column_statistics", f"""WITH {STATS} SELECT "column", rows, non_missing, rows - non_missing AS missing FROM (
  {' UNION ALL '.join(f"SELECT '{c}' AS column, count(*) AS rows, count({c}) AS non_missing FROM cs" for c in ('date', 'ticker', 'ret', 'holes'))})""")
def _(spark, d):
    return CL.column_stats(_stat_frame(spark, d))


@query("r046_missing_report", f"""WITH {STATS} SELECT "column", n AS missing, {r('100.0::DOUBLE * n / t', 'percent')} FROM (
  {' UNION ALL '.join(f"SELECT '{c}' AS column, count(*) - count({c}) AS n, count(*) AS t FROM cs" for c in ('ret', 'holes'))}) WHERE n > 0""")
def _(spark, d):
    return out(CL.missing_report(_stat_frame(spark, d)), ["percent"], keep=("column", "missing"))


@query("r046_missing_report_by_ticker", f"""WITH {STATS} SELECT ticker, {r('100.0::DOUBLE * (2 * count(*) - count(ret) - count(holes)) / (2 * count(*))', 'percent')} FROM cs GROUP BY ticker""")
def _(spark, d):
    return out(CL.missing_report_by_ticker(_stat_frame(spark, d)), ["percent"], keep=("ticker",))


@query("r040_duplicate_keys", """SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, count(*) AS copies
  FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, d):
    from panelspark.session import table
    raw = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias(DATE), F.col("l_suppkey").cast("string").alias(TICKER))
    panel_ = bars(spark, d)
    CL.require_columns(panel_, (*KEY, *K.PRICE_COLUMNS))
    CL.require_unique_keys(panel_)
    return out(CL.duplicate_keys(raw), keep=("date", "ticker", "copies"))


@query("r041_completeness_validation", f"""WITH {BARS} SELECT count(*) AS rows FROM bars""")
def _(spark, d):
    df = bars(spark, d)
    CL.require_complete(df)
    return df.agg(F.count("*").alias("rows"))


@query("r042_train_only_guard", f"""WITH {BARS} SELECT count(*) AS rows FROM bars WHERE date < DATE '1999-01-01'""")
def _(spark, d):
    df = bars(spark, d).withColumn(SPLIT, F.when(F.col(DATE) < "1999-01-01", "train").otherwise("test"))
    return CL.require_train_only(df.where(F.col(SPLIT) == "train")).agg(F.count("*").alias("rows"))


@query("r026_start_date_filter", f"WITH {BARS} SELECT {D}, {r('c', CLOSE, 4)} FROM bars WHERE date >= DATE '1997-01-01'")
def _(spark, d):
    return out(bars(spark, d).where(F.col(DATE) >= F.lit("1997-01-01").cast("date")), [CLOSE], digits=4)


@query("r027_period_exclusion", f"""WITH {BARS}, b AS (SELECT DISTINCT date FROM bars WHERE date < DATE '1998-02-01' ORDER BY date DESC LIMIT 6)
  SELECT {D} FROM bars WHERE NOT date BETWEEN DATE '1998-02-01' AND DATE '1998-12-31' AND date NOT IN (SELECT date FROM b)""")
def _(spark, d):
    return out(CL.exclude_period(bars(spark, d), "1998-02-01", "1998-12-31", 6))


@query("r043_safe_divide_variants", f"""WITH {BARS} SELECT {D}, {r('(c - o) / nullif(h - l, 0)', 'exact_zero')},
  {r('CASE WHEN abs(h - l) > 1e-12 THEN (c - o) / (h - l) END', 'near_zero')}, {r('CASE WHEN h <> l THEN (c - o) / (h - l) END', 'present')} FROM bars""")
def _(spark, d):
    n, den = F.col(CLOSE) - F.col(OPEN), F.col(K.HIGH) - F.col(K.LOW)
    df = bars(spark, d).withColumns({"exact_zero": S.ratio(n, den), "near_zero": S.ratio_tiny(n, den), "present": S.ratio_present(n, den)})
    return out(df, ["exact_zero", "near_zero", "present"])


@query("r044_safe_log_ratio", f"""WITH {BARS} SELECT {D}, {r('CASE WHEN h - o > 0 AND o - l > 0 THEN ln((h - o) / (o - l)) END', 'value')} FROM bars""")
def _(spark, d):
    df = bars(spark, d)
    return out(df.withColumn("value", S.log_ratio(F.col(K.HIGH) - F.col(OPEN), F.col(OPEN) - F.col(K.LOW))), ["value"])


# --- labels ---------------------------------------------------------------------------------------------------

LAB = PANEL + f""", lab AS (SELECT date, ticker, sector, industry, ln(lead(c, 1) OVER w / lead(o, 1) OVER w) AS intraday, ln(lead(o, 2) OVER w / lead(c, 1) OVER w) AS overnight,
  ln(lead(c, 2) OVER w / lead(o, 1) OVER w) AS short, ln(lead(o, 6) OVER w / lead(o, 1) OVER w) AS medium,
  ln(lead(c, 6) OVER w / lead(o, 1) OVER w) AS week FROM panel {WINDOWS})"""


@query("r161_forward_return_labels", f"""WITH {LAB} SELECT {D}, {r('intraday', K.INTRADAY_GROSS)}, {r('intraday', K.INTRADAY_NET)}, {r('overnight', K.OVERNIGHT_NET)},
  {r('short', K.SHORT_NET)}, {r('medium', K.MEDIUM_GROSS)}, {r('medium', K.MEDIUM_NET)}, {r('week', K.WEEK_GROSS)}, {r('week', K.WEEK_NET)}, {r('week', K.LEGACY_TARGET)} FROM lab""")
def _(spark, d):
    return out(L.forward_returns(panel(spark, d)), [K.INTRADAY_GROSS, K.INTRADAY_NET, K.OVERNIGHT_NET, K.SHORT_NET, K.MEDIUM_GROSS,
                                                    K.MEDIUM_NET, K.WEEK_GROSS, K.WEEK_NET, K.LEGACY_TARGET])


def _metric_sql(x, names):
    sk = "coalesce(sector, industry, '__missing_sector__')"
    return ", ".join([r(f"avg({x}) OVER (PARTITION BY date)", names[0]), r(f"{x} - avg({x}) OVER (PARTITION BY date)", names[1]),
                      r(f"{x} - avg({x}) OVER (PARTITION BY date, {sk})", names[2]),
                      r(f"coalesce(({x} - avg({x}) OVER (PARTITION BY date)) / nullif(stddev_samp({x}) OVER (PARTITION BY date), 0), 0)", names[3]),
                      r(f"coalesce({rank_sql(x, 'date')} - 0.5::DOUBLE, 0)", names[4])])


@query("r162_cross_sectional_label_metrics", f"""WITH {LAB} SELECT {D}, {_metric_sql('intraday', K.INTRADAY_METRICS)}, {_metric_sql('week', K.WEEK_METRICS)} FROM lab""")
def _(spark, d):
    return out(L.label_metrics(L.forward_returns(panel(spark, d))), [*K.INTRADAY_METRICS, *K.WEEK_METRICS])


@query("r067_metric_panel_join", f"""WITH {LAB} SELECT {D}, {r('week', K.WEEK_NET)}, {r('week - avg(week) OVER (PARTITION BY date)', K.WEEK_METRICS[1])} FROM lab""")
def _(spark, d):
    df = L.forward_returns(panel(spark, d)).withColumn(K.WEEK_METRICS[1], F.lit(0.0))
    return out(L.apply_metric_panel(df, L.label_metrics(df)), [K.WEEK_NET, K.WEEK_METRICS[1]])


@query("r163_meta_labels", f"""WITH {LAB}, m AS (SELECT panel.date, panel.ticker, ln(c / o) AS p, week FROM panel JOIN lab USING (date, ticker))
  SELECT {D}, CASE WHEN coalesce(p, 0) > 0 THEN 1 ELSE 0 END AS meta_candidate, CASE WHEN coalesce(p, 0) > 0 AND week > 0.01 THEN 1 ELSE 0 END AS meta_label
  FROM m WHERE coalesce(p, 0) > 0""")
def _(spark, d):
    df = L.forward_returns(panel(spark, d)).withColumn(L.PRIMARY, F.log(F.col(CLOSE) / F.col(OPEN)))
    return out(L.meta_candidates(L.meta_labels(df)), keep=("date", "ticker", "meta_candidate", "meta_label"))


@query("r174_registry_forward_fill", f"""WITH {BARS}, t AS (SELECT *, CASE WHEN v > 30 THEN c END AS a, CASE WHEN v > 30 THEN o END AS b, CASE WHEN v > 30 THEN h END AS e FROM bars)
  SELECT {D}, {r('last_value(a IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS 5 PRECEDING)', 'company_x')}, {r('b', 'quant_x')},
  {r('e', 'stock_x')} FROM t""")
def _(spark, d):
    keep = F.col(VOLUME) > 30
    df = bars(spark, d).withColumns({"company_x": F.when(keep, F.col(CLOSE)), "quant_x": F.when(keep, F.col(OPEN)), "stock_x": F.when(keep, F.col(K.HIGH))})
    registry = spark.createDataFrame([("company_x", 5), ("quant_x", 0), ("stock_x", None)], "feature_name string, safe_ffill_max_days int")
    return out(L.forward_fill_by_registry(df, L.fill_limits(registry)), ["company_x", "quant_x", "stock_x"])


# --- splits and folds ---------------------------------------------------------------------------------------------

SPLIT_SQL = BARS + """, el AS (SELECT date, row_number() OVER (ORDER BY date) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars WHERE date < DATE '1999-12-24')),
cut AS (SELECT *, n - greatest(1, CAST(round_even(0.3::DOUBLE * n, 0) AS BIGINT)) AS s FROM el),
spl AS (SELECT date, CASE WHEN s <= 6 THEN CASE WHEN rn <= s THEN 'train' ELSE 'val' END WHEN rn <= s - 6 THEN 'train' WHEN rn > s THEN 'val' END AS dataset_split FROM cut
  UNION ALL SELECT DISTINCT date, 'test' FROM bars WHERE date >= DATE '2000-01-01'),
dsp AS (SELECT * FROM spl WHERE dataset_split IS NOT NULL)"""


def _split(spark, d):
    return SP.assign_splits(bars(spark, d), TEST_START)


@query("r164_train_val_test_split", f"WITH {SPLIT_SQL} SELECT {D}, dataset_split FROM bars JOIN dsp USING (date)")
def _(spark, d):
    return out(_split(spark, d), keep=("date", "ticker", SPLIT))


@query("r165_per_ticker_split", f"""WITH {BARS}, el AS (SELECT date, ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM bars WHERE date < DATE '1999-12-24'),
  cut AS (SELECT *, n - greatest(1, CAST(round_even(0.3::DOUBLE * n, 0) AS BIGINT)) AS s FROM el),
  spl AS (SELECT date, ticker, CASE WHEN s <= 6 THEN CASE WHEN rn <= s THEN 'train' ELSE 'val' END WHEN rn <= s - 6 THEN 'train' WHEN rn > s THEN 'val' END AS dataset_split FROM cut
    UNION ALL SELECT date, ticker, 'test' FROM bars WHERE date >= DATE '2000-01-01') SELECT {D}, dataset_split FROM spl WHERE dataset_split IS NOT NULL""")
def _(spark, d):
    return out(SP.assign_splits(bars(spark, d), TEST_START, scope="ticker"), keep=("date", "ticker", SPLIT))


def _train_dates(spark, d):
    return C.distinct_dates(_split(spark, d).where(F.col(SPLIT) == "train"))


TRAIN_DATES = SPLIT_SQL + ", td AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM dsp WHERE dataset_split = 'train')"
FOLD_COUNTS = "fold, role, count(*) AS dates, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last"


def _fold_summary(folds):
    return folds.groupBy("fold", "role").agg(F.count("*").alias("dates"), F.min(DATE).cast("string").alias("first"), F.max(DATE).cast("string").alias("last"))


@query("r166_selection_folds", f"""WITH {TRAIN_DATES}, ch AS (SELECT *, ntile(11) OVER (ORDER BY date) AS ch FROM td), st AS (SELECT ch - 1 AS fold, min(i) AS s FROM ch WHERE ch > 1 GROUP BY 1),
  f AS (SELECT ch - 1 AS fold, 'validation' AS role, date FROM ch WHERE ch > 1 UNION ALL SELECT fold, 'train', date FROM st JOIN ch ON ch.i < st.s - 6)
  SELECT {FOLD_COUNTS} FROM f GROUP BY fold, role""")
def _(spark, d):
    return _fold_summary(SP.require_two_sided(SP.selection_folds(_train_dates(spark, d), 10)))


@query("r167_walk_forward_folds", f"""WITH {SPLIT_SQL}, ch AS (SELECT date, ntile(5) OVER (ORDER BY date) AS fold FROM dsp WHERE dataset_split = 'val'),
  st AS (SELECT fold, min(date) AS s FROM ch GROUP BY 1),
  cand AS (SELECT fold, date, row_number() OVER (PARTITION BY fold ORDER BY date DESC) AS k FROM st JOIN dsp ON dataset_split = 'train' OR (dataset_split = 'val' AND date < s)),
  f AS (SELECT fold, 'validation' AS role, date FROM ch UNION ALL SELECT fold, 'train', date FROM cand WHERE k > 6)
  SELECT {FOLD_COUNTS} FROM f GROUP BY fold, role""")
def _(spark, d):
    dates = _split(spark, d).select(DATE, SPLIT).distinct()
    return _fold_summary(SP.walk_forward_folds(dates, 5))


@query("r168_meta_folds", f"""WITH {TRAIN_DATES}, ch AS (SELECT *, ntile(4) OVER (ORDER BY date) AS fold FROM td), st AS (SELECT fold, min(i) - 7 AS ci FROM ch GROUP BY 1),
  f AS (SELECT ch.fold, td.date AS cutoff, ch.date FROM ch JOIN st USING (fold) JOIN td ON td.i = ci)
  SELECT fold, CAST(cutoff AS VARCHAR) AS train_cutoff, count(*) AS dates, CAST(min(date) AS VARCHAR) AS first FROM f GROUP BY 1, 2""")
def _(spark, d):
    folds = SP.meta_folds(_train_dates(spark, d), 4)
    return folds.groupBy("fold", F.col("train_cutoff").cast("string").alias("train_cutoff")).agg(
        F.count("*").alias("dates"), F.min(DATE).cast("string").alias("first"))


@query("r169_robustness_windows")
def _(spark, d):
    df = SP.train_windows(_train_dates(spark, d), seed=7, random_windows=2)
    return out(df, keep=("window", "start", "end", "dates"))


@query("r170_available_training_frame", f"""WITH {BARS}, ix AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bars)),
  pd AS (SELECT max(date) AS p, max(i) - 6 AS ci FROM ix) SELECT {D} FROM bars JOIN ix USING (date), pd WHERE i <= ci""")
def _(spark, d):
    df = bars(spark, d)
    last = df.agg(F.max(DATE).alias("d")).first()["d"]
    return out(SP.available_training_frame(df, str(last)))


@query("r171_burn_in_holdout_tail", f"""WITH {TRAIN_DATES}, n AS (SELECT count(*) AS n FROM td) SELECT CAST(date AS VARCHAR) AS date, (i <= ceil(0.2::DOUBLE * n))::INT AS burn_in,
  (i > n - ceil(0.2::DOUBLE * n))::INT AS calibration, (i > n - ceil(0.15::DOUBLE * n))::INT AS eval_row FROM td, n""")
def _(spark, d):
    dates = _train_dates(spark, d)
    burn = SP.date_share(dates, 0.20, "first").withColumnRenamed("inside", "burn_in")
    hold = SP.date_share(dates, 0.20, "last").withColumnRenamed("inside", "calibration")
    df = SP.early_stopping_split(dates, 0.15).join(burn, DATE).join(hold, DATE)
    return out(_int(df, "burn_in", "calibration", "eval_row"), keep=("date", "burn_in", "calibration", "eval_row"))


@query("r172_execution_date_shift", f"""WITH {BARS}, m AS (SELECT date AS sd, lead(date) OVER (ORDER BY date) AS ed FROM (SELECT DISTINCT date FROM bars))
  SELECT CAST(ed AS VARCHAR) AS date, CAST(sd AS VARCHAR) AS signal_date, ticker FROM bars JOIN m ON sd = date WHERE ed IS NOT NULL""")
def _(spark, d):
    return out(SP.shift_to_execution(bars(spark, d)), keep=("date", "signal_date", "ticker"))


@query("r173_train_test_frames", f"""WITH {SPLIT_SQL} SELECT dataset_split, count(*) AS rows FROM bars JOIN dsp USING (date) WHERE dataset_split IN ('train', 'test') GROUP BY 1""")
def _(spark, d):
    train, test = SP.train_and_test(_split(spark, d))
    return train.unionByName(test).groupBy(SPLIT).agg(F.count("*").alias("rows"))


SPACED = """pos AS (SELECT DISTINCT CASE WHEN i = w - 1 THEN n - 1 ELSE CAST(floor(i * ((n - 1)::DOUBLE / (w - 1)::DOUBLE)) AS BIGINT) END AS p, n
  FROM (SELECT n, w, unnest(range(0, w)) AS i FROM cfg))"""


@query("r175_temporal_date_sample", f"""WITH {TRAIN_DATES}, cfg AS (SELECT count(*) AS n, least(count(*), greatest(40, CAST(ceil(0.25::DOUBLE * count(*)) AS BIGINT))) AS w FROM td), {SPACED}
  SELECT CAST(date AS VARCHAR) AS date FROM td WHERE i - 1 IN (SELECT p FROM pos)""")
def _(spark, d):
    return out(SP.temporal_date_sample(_train_dates(spark, d), 0.25, 40), keep=("date",))


@query("r176_seeded_row_sample", f"""WITH {BARS} SELECT {D} FROM bars ORDER BY md5('42|' || CAST(date AS VARCHAR) || '|' || ticker) LIMIT 5000""")
def _(spark, d):
    return out(SP.seeded_row_sample(bars(spark, d), 5000, 42))


@query("r176_temporal_row_sample", f"""WITH {BARS}, pd AS (SELECT date, count(*) AS a FROM bars GROUP BY date), ix AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i FROM pd),
  cfg AS (SELECT count(*) AS n, least(count(*), greatest(30, CAST(ceil(6000 / greatest(1, floor(median(a)))) AS BIGINT))) AS w FROM pd), {SPACED},
  sel AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS o, count(*) OVER () AS k FROM pos),
  q AS (SELECT ix.date, a, least(a, greatest(1, 6000 // k + CASE WHEN o < 6000 % k THEN 1 ELSE 0 END)) AS qt FROM sel JOIN ix ON ix.i = sel.p),
  rp AS (SELECT DISTINCT date, CASE WHEN qt = 1 THEN 0 WHEN j = qt - 1 THEN a - 1 ELSE CAST(floor(j * ((a - 1)::DOUBLE / (qt - 1)::DOUBLE)) AS BIGINT) END AS rp FROM (SELECT date, a, qt, unnest(range(0, qt)) AS j FROM q)),
  nb AS (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY ticker) - 1 AS rp FROM bars)
  SELECT {D} FROM nb JOIN rp USING (date, rp)""")
def _(spark, d):
    return out(SP.temporal_row_sample(bars(spark, d), 6000, 30))


# --- sorts, limits, sets ---------------------------------------------------------------------------------------------


@query("r223_canonical_order", f"WITH {BARS} SELECT {D}, {r('c', CLOSE, 4)} FROM bars ORDER BY 1, 2")
def _(spark, d):
    return out(bars(spark, d).orderBy(*KEY), [CLOSE], digits=4)


def _topbottom_sql(f):
    return (f"row_number() OVER (PARTITION BY date ORDER BY v DESC, ticker) <= greatest(1, ceil(count(*) OVER (PARTITION BY date) * {f}::DOUBLE)) AS t, "
            f"row_number() OVER (PARTITION BY date ORDER BY v, ticker) <= greatest(1, ceil(count(*) OVER (PARTITION BY date) * {f}::DOUBLE)) AS b")


for _name, _split_plan in (("r224_top_bottom_fraction", None), ("r224_top_bottom_fraction_split", True)):
    @query(_name, f"WITH {BARS}, t AS (SELECT *, {_topbottom_sql(0.1)} FROM bars) SELECT {D}, t::INT AS is_top, b::INT AS is_bottom FROM t")
    def _(spark, d, split=_split_plan):
        # Volumes tie a lot; the second registration runs the split plan.
        df = X.with_top_bottom(bars(spark, d), [DATE], VOLUME, 0.1, split=split)
        return out(_int(df, "is_top", "is_bottom"), keep=("date", "ticker", "is_top", "is_bottom"))


@query("r225_top_k_per_date", f"""WITH {BARS}, t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY c DESC, ticker) AS k FROM bars) SELECT {D}, k AS position FROM t WHERE k <= 5""")
def _(spark, d):
    from pyspark.sql import Window
    w = Window.partitionBy(DATE).orderBy(F.col(CLOSE).desc(), TICKER)
    # Spark keeps k rows per group and task before the shuffle (window group limit).
    return out(bars(spark, d).withColumn("position", F.row_number().over(w)).where("position <= 5"), keep=("date", "ticker", "position"))


@query("r226_latest_rows", f"WITH {BARS} SELECT {D} FROM bars WHERE date IN (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 3)")
def _(spark, d):
    df = bars(spark, d)
    newest = C.distinct_dates(df).orderBy(F.col(DATE).desc()).limit(3)
    return out(df.join(F.broadcast(newest), DATE, "left_semi"))


@query("r227_multi_key_ranking", f"""WITH {BARS}, t AS (SELECT ticker, count(*) AS n, max(v) AS mv FROM bars GROUP BY ticker)
  SELECT ticker, row_number() OVER (ORDER BY mv DESC, n ASC, ticker) AS position FROM t""")
def _(spark, d):
    totals = bars(spark, d).groupBy(TICKER).agg(F.count("*").alias("n"), F.max(VOLUME).alias("mv"))
    return X.with_global_position(totals, [("mv", False), ("n", True), (TICKER, True)], "position").select(TICKER, "position")


@query("r228_union_all_wider", f"""WITH {BARS} SELECT {D}, {r('c', 'close', 4)}, NULL::DOUBLE AS open FROM bars UNION ALL SELECT {D}, NULL::DOUBLE, {r('o', 'open', 4)} FROM bars""")
def _(spark, d):
    df = bars(spark, d)
    both = df.select(*KEY, F.col(CLOSE).alias("close")).unionByName(df.select(*KEY, F.col(OPEN).alias("open")), allowMissingColumns=True)
    return out(both, ["close", "open"], digits=4)


@query("r229_intersection", "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS ticker FROM lineitem WHERE l_suppkey IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    from panelspark.session import table
    customers = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias(TICKER))
    return bars(spark, d).select(TICKER).intersect(customers)


@query("r230_difference", """SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN
  (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_suppkey = 1)""")
def _(spark, d):
    from panelspark.session import table
    days = C.distinct_dates(table(spark, d, "orders").select(F.to_date("o_orderdate").alias(DATE)))
    return out(days.join(C.distinct_dates(bars(spark, d).where(F.col(TICKER) == "1")), DATE, "left_anti"), keep=("date",))


@query("r231_distinct_keep_first", f"""WITH {BARS} SELECT ticker, CAST(min(date) AS VARCHAR) AS date, {r('arg_min(c, date)', 'close', 4)} FROM bars GROUP BY ticker""")
def _(spark, d):
    first = bars(spark, d).groupBy(TICKER).agg(F.min(DATE).alias(DATE), F.min_by(CLOSE, DATE).alias("close"))
    return out(first, ["close"], digits=4)


@query("r085_distinct_handling", f"""WITH {STATS} SELECT count(DISTINCT ticker) AS tickers, count(DISTINCT date) AS dates,
  count(DISTINCT holes) + max(CASE WHEN holes IS NULL THEN 1 ELSE 0 END) AS holes_with_missing FROM cs""")
def _(spark, d):
    df = _stat_frame(spark, d)
    return df.agg(F.count_distinct(TICKER).alias("tickers"), F.count_distinct(DATE).alias("dates"),
                  (F.count_distinct("holes") + F.max(F.col("holes").isNull().cast("bigint"))).alias("holes_with_missing"))


@query("r049_internal_column_drop", f"WITH {RETS} SELECT {D}, rn AS quant_days_in_sample, {r('dv', 'quant_dollar_volume', 3)} FROM rets")
def _(spark, d):
    df = M.drop_internal_columns(M.price_primitives(Q.returns(bars(spark, d))))
    return out(df.drop(*K.PRICE_COLUMNS), ["quant_dollar_volume"], keep=("date", "ticker", "quant_days_in_sample"), digits=3)
