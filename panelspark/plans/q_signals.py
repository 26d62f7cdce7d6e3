"""Registered queries: signals, information coefficients, ablation, classification, overfitting, ledger."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import functions as F

from panelspark import contract as K
from panelspark.contract import CLOSE, DATE, KEY, OPEN, TICKER, VOLUME
from panelspark.functions import rolling as R
from panelspark.operators import evaluation as EV
from panelspark.operators import labels as L
from panelspark.operators import ledger as LG
from panelspark.operators import quant as Q
from panelspark.operators import signals as SG
from panelspark.plans.q_market import rank_sql
from panelspark.plans.q_panel import LAB
from panelspark.plans.registry import BARS, COMPANIES, D, WINDOWS, out, query, r, roll
from panelspark.plans.testbars import bars, companies, panel
from panelspark.session import table

# Prediction panel: last log return as prediction, a squashed volume as meta probability.
SIG = LAB + f""", s0 AS (SELECT panel.date, panel.ticker, ln(c / lag(c) OVER w) AS p, least(v / 60, 1) AS mp, week AS y, panel.sector AS sector FROM panel
  JOIN lab USING (date, ticker) WINDOW w AS (PARTITION BY panel.ticker ORDER BY panel.date)),
sig AS (SELECT *, coalesce(p, 0) AS p0 FROM s0)"""


def prediction_panel(spark, d):
    df = L.forward_returns(panel(spark, d))
    return df.select(*KEY, F.log(F.col(CLOSE) / R.lag(CLOSE)).alias("prediction"), F.least(F.col(VOLUME) / 60, F.lit(1.0)).alias("meta_probability"),
                     K.WEEK_NET, K.SECTOR)


def avg_rank(x, by):
    return (f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) "
            f"+ (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE END")


def corr_sql(a, b):
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


@query("flagship_daily_rank_ic", f"""WITH {LAB}, f AS (SELECT date, ticker, ln(c) - ln(lag(c, 21) OVER w) AS mom, ret FROM (SELECT *, c / nullif(lag(c) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM bars) {WINDOWS}),
  g AS (SELECT f.date, f.ticker, mom, {roll('stddev_samp', 'ret', 21)} * {sqrt(252)} AS vol FROM f {WINDOWS}),
  h AS (SELECT g.*, week FROM g JOIN lab USING (date, ticker) WHERE mom IS NOT NULL AND week IS NOT NULL),
  k AS (SELECT *, {avg_rank('mom', 'date')} AS a, {avg_rank('week', 'date')} AS b FROM h)
  SELECT CAST(date AS VARCHAR) AS date, count(*) AS names, {r(corr_sql('a', 'b'), 'rank_ic', 8)}, {r('avg(vol)', 'mean_volatility', 5)} FROM k GROUP BY date""")
def _(spark, d):
    """Bars -> returns -> 21-row momentum and volatility -> forward week label -> rank IC per date."""
    df = L.forward_returns(Q.returns(bars(spark, d)))
    df = df.select(*KEY, R.diff(Q.LOG_CLOSE, 21).alias("momentum"), (R.std(Q.RETURN, 21) * Q.ANNUAL).alias("volatility"), K.WEEK_NET)
    known = df.where(F.col("momentum").isNotNull() & F.col(K.WEEK_NET).isNotNull())
    ranked = SG.with_side_ranks(known, "momentum", K.WEEK_NET, [DATE])
    daily = ranked.groupBy(DATE).agg(F.count("*").alias("names"), SG.corr_agg("_rank_p", "_rank_t").alias("rank_ic"), F.avg("volatility").alias("mean_volatility"))
    return out(daily, {"rank_ic": 8, "mean_volatility": 5}, keep=("date", "names"))


@query("r204_primary_context", f"""WITH {SIG}, z AS (SELECT *, avg(p0) OVER (PARTITION BY date) AS m, stddev_samp(p0) OVER (PARTITION BY date) AS s FROM sig)
  SELECT {D}, {r('p0', 'primary_prediction')}, {r(rank_sql('p0', 'date') + ' - 0.5::DOUBLE', 'primary_prediction_rank_cs')}, {r('coalesce((p0 - m) / nullif(s, 0), 0)', 'primary_prediction_zscore_cs')},
  {r('abs(p0)', 'primary_prediction_abs')}, sign(p0)::DOUBLE AS primary_prediction_sign FROM z""")
def _(spark, d):
    df = SG.primary_context(prediction_panel(spark, d))
    return out(df, ["primary_prediction", "primary_prediction_rank_cs", "primary_prediction_zscore_cs", "primary_prediction_abs"],
               keep=("date", "ticker", "primary_prediction_sign"))


BLEND = SIG + """, bl AS (SELECT *, coalesce((p0 - avg(p0) OVER (PARTITION BY date)) / greatest(stddev_samp(p0) OVER (PARTITION BY date), 1e-8), 0) AS zp,
  coalesce((mp - avg(mp) OVER (PARTITION BY date)) / greatest(stddev_samp(mp) OVER (PARTITION BY date), 1e-8), 0) AS zm FROM sig)"""
SHIFT = "least(greatest((mp - 0.45::DOUBLE) / 0.55::DOUBLE, 0), 1)"
REFINED = {"baseline_hard_050": "p0 * CASE WHEN mp >= 0.5 THEN mp ELSE 0 END", "candidate_only": "p0 * CASE WHEN p0 > 0 THEN 1 ELSE 0 END",
           "soft_shifted_045": f"p0 * {SHIFT}", "rank_blend_025": "zp + 0.25::DOUBLE * zm", "rank_blend_050": "zp + 0.5::DOUBLE * zm",
           "rank_blend_100": "zp + zm", "no_meta": "p0"}


@query("r205_refinement_strategies", f"WITH {BLEND} SELECT {D}, {', '.join(r(e, n) for n, e in REFINED.items())} FROM bl")
def _(spark, d):
    base = prediction_panel(spark, d)
    frames = []
    for regime in SG.REGIMES:
        kind = {k: v for k, v in regime.items() if k != "name"}
        frames.append(SG.refine(base, **kind).select(*KEY, F.lit(regime["name"]).alias("regime"), F.col(SG.REFINED).alias("x")))
    long = frames[0]
    for f in frames[1:]:
        long = long.unionByName(f)
    wide = long.groupBy(*KEY).pivot("regime", list(REFINED)).agg(F.first("x"))
    return out(wide, list(REFINED))


@query("r244_strategy_registry", f"""WITH {BLEND} SELECT {D}, {', '.join(r(e, n) for n, e in (('binary_gate', "CASE WHEN mp >= 0.5 THEN mp ELSE 0 END"), ('candidate_only', 'CASE WHEN p0 > 0 THEN 1 ELSE 0 END'), ('soft_shifted', SHIFT), ('rank_blend', '1'), ('no_meta', '1')))} FROM bl""")
def _(spark, d):
    df = prediction_panel(spark, d).withColumns({"_p": SG.or_zero("prediction"), "_m": SG.or_zero("meta_probability")})
    return out(df.withColumns({name: fn(F.col("_p"), F.col("_m")) for name, fn in SG.STRATEGIES.items()}), list(SG.STRATEGIES))


@query("r206_expected_return_attach", f"""WITH {SIG}, e AS (SELECT *, CASE WHEN p0 <= -2 THEN -0.05::DOUBLE WHEN p0 >= 3 THEN 0.08::DOUBLE WHEN p0 <= 0 THEN -0.05::DOUBLE + (p0 + 2) / 2 * 0.06::DOUBLE ELSE 0.01::DOUBLE + p0 / 3 * 0.07::DOUBLE END AS er FROM sig)
  SELECT {D}, {r("er * CASE WHEN mp >= 0.5 THEN mp ELSE 0 END", 'expected_return_5d', 8)} FROM e""")
def _(spark, d):
    return out(SG.attach_expected_return(prediction_panel(spark, d), [-2.0, 0.0, 3.0], [-0.05, 0.01, 0.08]), ["expected_return_5d"], digits=8)


IC = SIG + f""", rk AS (SELECT *, {avg_rank('p', 'date')} AS a, {avg_rank('y', 'date')} AS b FROM sig),
dic AS (SELECT date, count(*) AS n, {corr_sql('a', 'b')} AS ic, {corr_sql('p', 'y')} AS lic FROM rk GROUP BY date HAVING count(*) >= 2)"""


@query("r207_mean_daily_spearman_ic", f"WITH {IC} SELECT {r('coalesce(avg(ic), 0)', 'mean_rank_ic', 9)} FROM dic")
def _(spark, d):
    return out(SG.mean_daily_rank_ic(prediction_panel(spark, d), "prediction", K.WEEK_NET), ["mean_rank_ic"], keep=(), digits=9)


@query("r207_daily_spearman_ic", f"WITH {IC} SELECT CAST(date AS VARCHAR) AS date, n AS rows, {r('ic', 'rank_ic', 8)} FROM dic")
def _(spark, d):
    # The split plan of the ranks.
    return out(SG.daily_rank_ic(prediction_panel(spark, d), "prediction", K.WEEK_NET, split=True), ["rank_ic"], keep=("date", "rows"), digits=8)


DIAG = IC + """, tb AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY p DESC NULLS LAST, ticker) AS t, row_number() OVER (PARTITION BY date ORDER BY p NULLS LAST, ticker) AS u,
  greatest(1, ceil(count(*) OVER (PARTITION BY date) * 0.1::DOUBLE)) AS k FROM sig),
sp AS (SELECT date, avg(CASE WHEN t <= k THEN y END) - avg(CASE WHEN u <= k THEN y END) AS spread FROM tb GROUP BY date),
diag AS (SELECT date, coalesce(ic, 0) AS rank_ic, coalesce(lic, 0) AS linear_ic, spread, n FROM dic JOIN sp USING (date))"""


def _diagnostics(spark, d):
    return SG.daily_signal_diagnostics(prediction_panel(spark, d), "prediction", K.WEEK_NET, K.WEEK_NET, top_fraction=0.1)


@query("r208_daily_diagnostics", f"""WITH {DIAG} SELECT CAST(date AS VARCHAR) AS date, {r('rank_ic', 'rank_ic', 8)}, {r('linear_ic', 'linear_ic', 8)}, {r('spread', 'top_bottom_spread', 7)}, n::DOUBLE AS cross_section_count FROM diag""")
def _(spark, d):
    return out(_diagnostics(spark, d), {"rank_ic": 8, "linear_ic": 8, "top_bottom_spread": 7}, keep=("date", "cross_section_count"))


@query("r080_signal_summary", f"""WITH {DIAG} SELECT {r('avg(rank_ic)', 'daily_rank_ic_mean', 9)}, {r('stddev_pop(rank_ic)', 'daily_rank_ic_std', 9)}, {r('avg(rank_ic) / stddev_pop(rank_ic)', 'daily_rank_ic_ir', 9)},
  {r('avg(linear_ic)', 'daily_linear_ic_mean', 9)}, {r('avg(spread)', 'daily_top_bottom_spread_mean', 9)}, {r('stddev_pop(spread)', 'daily_top_bottom_spread_std', 9)} FROM diag""")
def _(spark, d):
    return out(SG.summarize_diagnostics(_diagnostics(spark, d)), ["daily_rank_ic_mean", "daily_rank_ic_std", "daily_rank_ic_ir", "daily_linear_ic_mean",
                                                                   "daily_top_bottom_spread_mean", "daily_top_bottom_spread_std"], keep=(), digits=9)


STACK = BLEND + ", st AS (" + " UNION ALL ".join(f"SELECT '{n}' AS regime, date, ticker, ({e})::DOUBLE + 0.0::DOUBLE AS x, y FROM bl" for n, e in REFINED.items()) + """),
cnt AS (SELECT regime, date, count(*) AS n FROM st GROUP BY 1, 2 HAVING count(*) >= 5), wh AS (SELECT * FROM st WHERE x IS NOT NULL AND y IS NOT NULL)"""
SCREEN = STACK + f""", rk AS (SELECT *, {avg_rank('x', 'regime, date')} AS a, {avg_rank('y', 'regime, date')} AS b FROM wh),
di AS (SELECT regime, date, count(*) AS n, stddev_samp(x) AS s, {corr_sql('a', 'b')} AS ic FROM rk GROUP BY 1, 2),
dj AS (SELECT cnt.regime, cnt.date, CASE WHEN di.n IS NULL OR di.n < 5 OR s < 1e-12 THEN 0 ELSE ic END AS ic FROM cnt LEFT JOIN di ON di.regime = cnt.regime AND di.date = cnt.date),
ics AS (SELECT regime, avg(ic) AS m, stddev_samp(ic) AS s FROM dj GROUP BY 1),
ed AS (SELECT regime, date, list_distinct(quantile_cont(x, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM wh GROUP BY 1, 2 HAVING count(*) >= 5),
bk AS (SELECT wh.regime, wh.date, y, greatest(1, len(list_filter(e, lambda q: q < x))) AS bucket FROM wh JOIN ed ON ed.regime = wh.regime AND ed.date = wh.date),
bm AS (SELECT regime, date, bucket, avg(y) AS m FROM bk GROUP BY 1, 2, 3),
bs AS (SELECT regime, avg(sp) * 2520000 AS spread FROM (SELECT regime, date, arg_max(m, bucket) - arg_min(m, bucket) AS sp FROM bm GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1),
br AS (SELECT regime, avg(nz) AS breadth, avg(en) AS en FROM (SELECT regime, date, count(CASE WHEN abs(x) > 1e-12 THEN 1 END) AS nz,
  CASE WHEN sum(abs(x)) < 1e-12 THEN 0 ELSE sum(abs(x)) * sum(abs(x)) / sum(x * x) END AS en FROM st GROUP BY 1, 2) GROUP BY 1),
scr AS (SELECT ics.regime, ics.m, ics.s, ics.m / ics.s AS ir, spread, breadth, en FROM ics JOIN bs USING (regime) JOIN br USING (regime))"""


@query("r209_ablation_metrics", f"""WITH {SCREEN} SELECT regime, {r('m', 'rank_ic', 9)}, {r('s', 'rank_ic_std', 9)}, {r('ir', 'rank_ic_ir', 8)}, {r('spread', 'q5_q1_spread_bps', 3)}, {r('breadth', 'breadth')}, {r('en', 'effective_n')} FROM scr""")
def _(spark, d):
    return out(SG.ablation_screen(prediction_panel(spark, d)), {"rank_ic": 9, "rank_ic_std": 9, "rank_ic_ir": 8, "q5_q1_spread_bps": 3, "breadth": 6, "effective_n": 6},
               keep=("regime",))


@query("r210_ablation_pick", f"WITH {SCREEN} SELECT DISTINCT regime FROM ((SELECT regime FROM scr ORDER BY ir DESC, regime LIMIT 2) UNION ALL SELECT regime FROM scr WHERE regime IN ('candidate_only', 'no_meta'))")
def _(spark, d):
    return SG.select_regimes(SG.ablation_screen(prediction_panel(spark, d)))


# --- classification ------------------------------------------------------------------------------------------
# Label: the forward week return is positive; probability from the volume (many ties).

CLS = SIG + ", cl AS (SELECT date, ticker, (y > 0)::INT AS lb, mp AS pr, sector FROM sig WHERE y IS NOT NULL)"


def _classified(spark, d):
    df = prediction_panel(spark, d).where(F.col(K.WEEK_NET).isNotNull())
    return df.withColumn("meta_label", (F.col(K.WEEK_NET) > 0).cast("int"))


CURVE = """cv AS (SELECT sector, pr, count(*) AS n, sum(lb) AS ps FROM cl GROUP BY 1, 2),
cw AS (SELECT *, sum(n) OVER w AS nn, sum(ps) OVER w AS pp, sum(ps) OVER (PARTITION BY sector) AS tp, sum(n) OVER (PARTITION BY sector) AS tn FROM cv WINDOW w AS (PARTITION BY sector ORDER BY pr DESC)),
rm AS (SELECT sector, sum(ps / tp * pp / nn) AS ap, sum(ps * ((tn - tp) - (nn - pp) + (n - ps) / 2)) / max(tp * (tn - tp)) AS auc FROM cw GROUP BY 1),
cm AS (SELECT sector, sum(CASE WHEN pr >= 0.5 AND lb = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN pr >= 0.5 AND lb = 0 THEN 1 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN pr < 0.5 AND lb = 1 THEN 1 ELSE 0 END)::DOUBLE AS fn,
  sum(CASE WHEN pr < 0.5 AND lb = 0 THEN 1 ELSE 0 END)::DOUBLE AS tn, -avg(CASE WHEN lb = 1 THEN ln(greatest(1e-6, least(pr, 1 - 1e-6))) ELSE ln(1 - greatest(1e-6, least(pr, 1 - 1e-6))) END) AS ll FROM cl GROUP BY 1)"""


@query("r083_classification_metrics", f"""WITH {CLS}, {CURVE} SELECT sector AS company_sector, {r('ap', 'average_precision', 9)}, {r('auc', 'roc_auc', 9)}, {r('(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))', 'mcc', 9)}, {r('ll', 'log_loss', 8)} FROM rm JOIN cm USING (sector)""")
def _(spark, d):
    df = EV.classification_metrics(_classified(spark, d), by=(K.SECTOR,))
    return out(df, {"average_precision": 9, "roc_auc": 9, "mcc": 9, "log_loss": 8}, keep=(K.SECTOR,))


@query("r083_classification_overall_balanced", f"""WITH {CLS.replace("mp AS pr, sector FROM", "mp AS pr, 'all' AS sector FROM")}, {CURVE}, w AS (SELECT *, (tp + fp + fn + tn) / (2 * (tp + fn)) AS wp, (tp + fp + fn + tn) / (2 * (fp + tn)) AS wn FROM cm),
  b AS (SELECT sector, ll, tp * wp AS tp, fn * wp AS fn, fp * wn AS fp, tn * wn AS tn FROM w)
  SELECT {r('ap', 'average_precision', 9)}, {r('auc', 'roc_auc', 9)}, {r('(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))', 'mcc', 9)}, {r('ll', 'log_loss', 8)} FROM rm JOIN b USING (sector)""")
def _(spark, d):
    return out(EV.classification_metrics(_classified(spark, d), balanced=True), {"average_precision": 9, "roc_auc": 9, "mcc": 9, "log_loss": 8}, keep=())


@query("r083_balanced_weights", f"WITH {CLS} SELECT sector AS company_sector, lb AS meta_label, {r('sum(count(*)) OVER (PARTITION BY sector)::DOUBLE / (2 * count(*))', 'weight', 8)} FROM cl GROUP BY sector, lb")
def _(spark, d):
    return out(EV.balanced_weights(_classified(spark, d), by=(K.SECTOR,)), ["weight"], keep=(K.SECTOR, "meta_label"), digits=8)


@query("r084_class_imbalance_weight", f"WITH {CLS} SELECT {r('greatest(1, sum(1 - lb) / sum(lb))', 'scale_pos_weight', 9)} FROM cl")
def _(spark, d):
    return out(EV.positive_class_weight(_classified(spark, d)), ["scale_pos_weight"], keep=(), digits=9)


# --- overfitting: one strategy per sector, its return the equal-weight mean of the week label per date --------

STRAT = SIG + ", sr AS (SELECT sector, date, avg(y) * 0.01::DOUBLE AS x FROM sig WHERE y IS NOT NULL GROUP BY 1, 2)"


def _strategies(spark, d):
    df = prediction_panel(spark, d).where(F.col(K.WEEK_NET).isNotNull())
    return df.groupBy(K.SECTOR, DATE).agg((F.avg(K.WEEK_NET) * 0.01).alias("return"))


TRIALS = 12
BEST = EV.expected_max_sharpe(TRIALS)
# Normal CDF by its power series (converges for |z| < 8; beyond it is 0 or 1).
CDF = ("CASE WHEN {z} < -8 THEN 0 WHEN {z} > 8 THEN 1 ELSE 0.5::DOUBLE + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * "
       "list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))) END")
SHARPE = STRAT + f""", mo AS (SELECT sector, count(x)::DOUBLE AS n, avg(x) AS m, stddev_pop(x) AS s, skewness(x) AS sk, kurtosis(x) AS ku FROM sr GROUP BY 1),
sh AS (SELECT *, m / s * {sqrt(252)} AS sr FROM mo), sd AS (SELECT *, 1 - sk * sr + (ku - 1) / 4 * sr * sr AS den FROM sh),
sz AS (SELECT *, CASE WHEN den > 1e-12 THEN sr * sqrt(n - 1) / sqrt(den) END AS z0, CASE WHEN den > 1e-12 THEN (sr - {BEST}) * sqrt(n - 1) / sqrt(den) END AS z1 FROM sd)"""


@query("r211_sharpe_statistics", f"""WITH {SHARPE} SELECT sector AS company_sector, {r('sr', 'sharpe_ratio')}, {r("coalesce(" + CDF.format(z='z0') + ", 0)", 'probabilistic_sharpe_ratio')},
  {r("coalesce(" + CDF.format(z='z1') + ", 0)", 'deflated_sharpe_ratio')},
  {r(f"CASE WHEN sr <= {BEST} THEN -1 ELSE greatest(1, 1 + greatest(den, 1e-12) * {EV.NORMAL.inv_cdf(0.95) ** 2} / ((sr - {BEST}) * (sr - {BEST}))) END", 'minimum_track_record_length', 5)} FROM sz""")
def _(spark, d):
    df = EV.sharpe_statistics(_strategies(spark, d), (K.SECTOR,), TRIALS)
    length = F.col("minimum_track_record_length")
    df = df.withColumn("minimum_track_record_length", F.when(length == float("inf"), -1.0).otherwise(length))
    return out(df, {"sharpe_ratio": 6, "probabilistic_sharpe_ratio": 6, "deflated_sharpe_ratio": 6, "minimum_track_record_length": 5}, keep=(K.SECTOR,))


# Trial ledger: trial = sector number, folds = calendar years 1995 to 1999 and the years from 2000 on, score = mean label of the fold.
LEDGER_SQL = SIG + """, tr AS (SELECT dense_rank() OVER (ORDER BY sector) - 1 AS trial_number, least(year(date) - 1995, 5) AS f, y FROM sig WHERE y IS NOT NULL),
tl AS (SELECT trial_number, f, avg(y) AS s FROM tr GROUP BY 1, 2)"""


def _trials(spark, d):
    """Long scores (trial_number, fold, score) and their wide form."""
    df = prediction_panel(spark, d).where(F.col(K.WEEK_NET).isNotNull())
    # The 25 sectors at most.
    from pyspark.sql import Window
    numbers = df.select(K.SECTOR).distinct().select(K.SECTOR, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(K.SECTOR)) - 1).alias("trial_number"))
    scored = df.join(F.broadcast(numbers), K.SECTOR).groupBy("trial_number", F.least(F.year(DATE) - 1995, F.lit(5)).alias("fold")).agg(F.avg(K.WEEK_NET).alias("score"))
    wide = scored.groupBy("trial_number").pivot("fold", list(range(6))).agg(F.first("score"))
    return wide.withColumnsRenamed({str(i): f"fold_{i}_daily_rank_ic" for i in range(6)})


@query("r212_backtest_overfitting", f"""WITH {LEDGER_SQL}, sub AS (SELECT m FROM (SELECT unnest(range(0, 64)) AS m) WHERE bit_count(m::INT) = 3),
  sc AS (SELECT trial_number, m, avg(CASE WHEN (m >> f) & 1 = 1 THEN s END) AS a, avg(CASE WHEN (m >> f) & 1 = 0 THEN s END) AS b FROM tl, sub GROUP BY 1, 2),
  pk AS (SELECT m, arg_max(b, struct_pack(a := a, k := -trial_number)) AS c FROM sc GROUP BY m), pc AS (SELECT m, avg(CASE WHEN b <= c THEN 1.0::DOUBLE ELSE 0 END) AS p FROM sc JOIN pk USING (m) GROUP BY m)
  SELECT {r('avg(CASE WHEN p <= 0.5 THEN 1.0::DOUBLE ELSE 0 END)', 'pbo', 9)} FROM pc""")
def _(spark, d):
    return out(EV.backtest_overfitting(_trials(spark, d)), ["pbo"], keep=(), digits=9)


@query("r213_leaderboard_promotion", f"""WITH {SHARPE}, lb AS (SELECT sector AS model_name, m - (SELECT avg(m) FROM sz) AS alpha, sr AS ir, sr / 2 AS calmar, coalesce({CDF.format(z='z1')}, 0) AS dsr FROM sz),
  dp AS (SELECT *, alpha > 0 AND ir > 0 AND dsr >= 0.5 AS ok FROM lb) SELECT model_name, ok::INT AS is_deployable FROM dp ORDER BY ok DESC, alpha DESC, ir DESC, calmar DESC, model_name LIMIT 1""")
def _(spark, d):
    s = EV.sharpe_statistics(_strategies(spark, d), (K.SECTOR,), TRIALS)
    mean = s.agg(F.avg("mean"))
    board = s.select(
        F.col(K.SECTOR).alias("model_name"), (F.col("mean") - mean.scalar()).alias("alpha_over_benchmark_net"), F.col("sharpe_ratio").alias("daily_rank_ic_ir"),
        (F.col("sharpe_ratio") / 2).alias("calmar_ratio"), "deflated_sharpe_ratio", F.lit(0.0).alias("pbo"))
    return EV.promoted_model(EV.with_deployability(board)).select("model_name", F.col("is_deployable").cast("int").alias("is_deployable"))


# --- costs and ledger --------------------------------------------------------------------------------------------
# Orders: line items per supplier (the account), valued at a tenth of the price.

ORD = """ord AS (SELECT CAST(l_suppkey AS VARCHAR) AS account, CAST(l_shipdate AS DATE) AS date, l_orderkey * 8 + l_linenumber AS seq, l_extendedprice / 2 AS val,
  CASE WHEN l_returnflag = 'R' THEN 'index_cfd' ELSE 'stock_cash' END AS grp, CASE WHEN l_linestatus = 'O' THEN 'USD' ELSE 'eur' END AS cur FROM lineitem),
mtd AS (SELECT *, date_trunc('month', date)::DATE AS month, coalesce(sum(val) OVER (PARTITION BY account, date_trunc('month', date) ORDER BY date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM ord),
bil AS (SELECT *, greatest(val - greatest(100000 - t, 0), 0) AS b FROM mtd),
cst AS (SELECT *, CASE WHEN b > 0 THEN greatest(10, b * 0.002::DOUBLE) ELSE 0 END AS com, CASE WHEN NOT (grp = 'stock_cash' AND b <= 0) AND upper(cur) <> 'EUR' THEN b * 0.005::DOUBLE ELSE 0 END AS fx FROM bil)"""


def orders(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").cast("string").alias("account"), F.to_date("l_shipdate").alias(DATE), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sequence"),
                     (F.col("l_extendedprice") / 2).alias("order_value"), F.when(F.col("l_returnflag") == "R", "index_cfd").otherwise("stock_cash").alias("instrument_group"),
                     F.when(F.col("l_linestatus") == "O", "USD").otherwise("eur").alias("currency"))


@query("r214_tiered_trade_cost", f"""WITH {ORD} SELECT account, CAST(date AS VARCHAR) AS date, seq AS sequence, {r('t', 'month_to_date_turnover', 3)}, {r('b', 'billable_turnover', 3)}, {r('com', 'commission', 4)}, {r('fx', 'fx_cost', 4)},
  {r('com + fx', 'total_cost', 4)}, {r('(com + fx) / nullif(val, 0)', 'cost_rate', 8)} FROM cst""")
def _(spark, d):
    df = LG.trade_cost(LG.month_to_date_turnover(orders(spark, d)))
    return out(df, {"month_to_date_turnover": 3, "billable_turnover": 3, "commission": 4, "fx_cost": 4, "total_cost": 4, "cost_rate": 8}, keep=("account", "date", "sequence"))


@query("r082_monthly_turnover", f"WITH {ORD} SELECT account, CAST(month AS VARCHAR) AS month, {r('sum(val)', 'turnover', 2)}, {r('avg(val)', 'average_value', 3)}, count(*) AS orders FROM mtd GROUP BY 1, 2")
def _(spark, d):
    df = LG.monthly_turnover(orders(spark, d))
    return out(df, {"turnover": 2, "average_value": 3}, keep=("account", "month", "orders"))


# Trades: every bar with a label opens a trade held five sessions, notional 1000 x volume, label / 100 realised.
TRADES = LAB + """, ses AS (SELECT date, lead(date, 5) OVER (ORDER BY date) AS ex FROM (SELECT DISTINCT date FROM bars)),
tr AS (SELECT bars.ticker, bars.date AS entry, ex, v * 1000 AS notional, week / 100 AS rl, v * 0.5::DOUBLE AS ec, v * 0.25::DOUBLE AS xc FROM bars JOIN lab USING (date, ticker) JOIN ses USING (date) WHERE week IS NOT NULL),
cl AS (SELECT *, exp(rl) - 1 AS g, notional * (exp(rl) - 1) AS gp FROM tr)"""


def _open_trades(spark, d):
    df = L.forward_returns(bars(spark, d)).where(F.col(K.WEEK_NET).isNotNull())
    v = F.col(VOLUME)
    return df.select(TICKER, F.col(DATE).alias("entry_date"), (v * 1000).alias("notional"), (F.col(K.WEEK_NET) / 100).alias("realized_log_return"),
                     (v * 0.5).alias("entry_cost"), (v * 0.25).alias("exit_cost"))


def _trades(spark, d):
    return LG.close_trades(LG.with_exit_date(_open_trades(spark, d), bars(spark, d)))


@query("r216_exit_date", f"WITH {TRADES} SELECT ticker, CAST(entry AS VARCHAR) AS entry_date, CAST(ex AS VARCHAR) AS exit_date FROM tr")
def _(spark, d):
    return out(LG.with_exit_date(_open_trades(spark, d), bars(spark, d)), keep=("ticker", "entry_date", "exit_date"))


@query("r215_trade_closing", f"""WITH {TRADES} SELECT ticker, CAST(entry AS VARCHAR) AS entry_date, {r('g', 'gross_return', 8)}, {r('(ec + xc) / notional', 'transaction_cost', 8)}, {r('g - (ec + xc) / notional', 'net_return', 8)},
  {r('gp - ec - xc', 'net_pnl', 3)}, {r('notional + gp - xc', 'exit_cash_flow', 3)} FROM cl""")
def _(spark, d):
    return out(_trades(spark, d), {"gross_return": 8, "transaction_cost": 8, "net_return": 8, "net_pnl": 3, "exit_cash_flow": 3}, keep=("ticker", "entry_date"))


EQUITY = 10_000_000.0
LEDGER = TRADES + f""", op AS (SELECT entry AS date, sum(notional) AS o, sum(ec) AS ec, count(*) AS n FROM cl GROUP BY 1), xs AS (SELECT ex AS date, sum(notional) AS c, sum(xc) AS xc, sum(gp) AS gp, count(*) AS m FROM cl WHERE ex IS NOT NULL GROUP BY 1),
d0 AS (SELECT ses.date, coalesce(o, 0) AS o, coalesce(ec, 0) AS ec, coalesce(n, 0) AS n, coalesce(c, 0) AS c, coalesce(xc, 0) AS xc, coalesce(gp, 0) AS gp, coalesce(m, 0) AS m FROM ses LEFT JOIN op ON op.date = ses.date LEFT JOIN xs ON xs.date = ses.date),
d1 AS (SELECT *, sum(o - c) OVER w AS act, sum(n - m) OVER w AS cnt FROM d0 WINDOW w AS (ORDER BY date)),
fm AS (SELECT max(date) AS date, avg(act) AS av, arg_max(cnt, date) AS oc FROM d1 GROUP BY date_trunc('month', date)),
fe AS (SELECT date, CASE WHEN oc > 0 AND av > 250000 THEN greatest(10, av * 0.0002::DOUBLE / 12) ELSE 0 END AS fee FROM fm),
d2 AS (SELECT d1.*, coalesce(fee, 0) AS fee, gp - xc - ec - coalesce(fee, 0) AS pnl FROM d1 LEFT JOIN fe ON fe.date = d1.date),
d3 AS (SELECT *, {EQUITY}::DOUBLE + sum(c - o + pnl) OVER (ORDER BY date) AS cash FROM d2),
d4 AS (SELECT *, cash + act AS eq FROM d3), d5 AS (SELECT *, coalesce(lag(eq) OVER (ORDER BY date), {EQUITY}::DOUBLE) AS oe FROM d4),
led AS (SELECT *, pnl / oe AS rr, (c + o) / oe AS tno, act / eq AS gx FROM d5)"""


def _ledger(spark, d):
    return LG.daily_ledger(_trades(spark, d), bars(spark, d), EQUITY)


@query("r217_daily_ledger", f"""WITH {LEDGER} SELECT CAST(date AS VARCHAR) AS date, {r('o', 'opened_notional', 2)}, {r('c', 'closed_notional', 2)}, {r('act', 'active_notional', 2)}, {r('pnl', 'realized_pnl', 2)}, {r('cash', 'cash', 2)}, {r('eq', 'equity', 2)},
  {r('rr', 'realized_return', 8)}, {r('tno', 'turnover', 7)}, 0.0::DOUBLE AS reconciliation_error FROM led""")
def _(spark, d):
    return out(_ledger(spark, d), {"opened_notional": 2, "closed_notional": 2, "active_notional": 2, "realized_pnl": 2, "cash": 2, "equity": 2, "realized_return": 8, "turnover": 7,
                                   "reconciliation_error": 3}, keep=("date",))


@query("r218_monthly_custody_fee", f"WITH {LEDGER} SELECT CAST(date AS VARCHAR) AS date, {r('fee', 'custody_fee', 4)} FROM fe")
def _(spark, d):
    return out(LG.custody_fees(_ledger(spark, d).drop("custody_fee")), ["custody_fee"], keep=("date",), digits=4)


# Benchmark by definition: every held ticker on every session, last price carried, drifted weights.
BENCH = BARS + """, fd AS (SELECT min(date) AS f FROM bars), el AS (SELECT ticker FROM bars, fd WHERE date = f AND c > 0), sp AS (SELECT s.date, el.ticker, c FROM (SELECT DISTINCT date FROM bars) s, el LEFT JOIN bars ON bars.date = s.date AND bars.ticker = el.ticker),
fp AS (SELECT date, ticker, last_value(c IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS p FROM sp),
wl AS (SELECT date, ticker, p / first_value(p) OVER w AS wealth, p / lag(p) OVER w - 1 AS ret FROM fp WINDOW w AS (PARTITION BY ticker ORDER BY date)),
bw AS (SELECT date, coalesce(ret, 0) AS ret, coalesce(lag(wealth) OVER (PARTITION BY ticker ORDER BY date), 1) AS pw FROM wl),
ben AS (SELECT date, sum(pw * ret) / sum(pw) AS b FROM bw GROUP BY date)"""


def _benchmark(spark, d):
    return LG.buy_and_hold_benchmark(bars(spark, d).withColumnRenamed(CLOSE, "hl_context_stock_close_price"))


@query("r219_buy_and_hold_benchmark", f"WITH {BENCH} SELECT CAST(date AS VARCHAR) AS date, {r('b', 'benchmark_return', 8)} FROM ben")
def _(spark, d):
    return out(_benchmark(spark, d), ["benchmark_return"], keep=("date",), digits=8)


def _summary(spark, d):
    daily = _ledger(spark, d).join(F.broadcast(_benchmark(spark, d).withColumn("benchmark_return", F.col("benchmark_return") / 1000)), DATE).withColumn("capacity_binding_share", F.lit(0.25))
    return LG.backtest_summary(daily, _trades(spark, d), EQUITY)


SUMMARY = LEDGER + ", " + BENCH.replace(BARS + ", ", "") + """, dd AS (SELECT led.*, b / 1000 AS b, eq / max(eq) OVER (ORDER BY led.date) - 1 AS dr FROM led JOIN ben ON ben.date = led.date),
ag AS (SELECT arg_max(eq, date) AS fe, sum(gp) AS g, sum(ec) AS e, sum(xc) AS x, sum(fee) AS cu, count(*) AS n, exp(sum(ln(1 + b))) AS be, stddev_pop(rr) * sqrt(252) AS vol, min(dr) AS mdd, avg(tno) * 252 AS tno, avg(gx) AS gx FROM dd),
tg AS (SELECT count(*)::DOUBLE AS tc, avg(CASE WHEN g - (ec + xc) / notional > 0 THEN 1.0::DOUBLE ELSE 0 END) AS wr, sum(ec) / sum(notional) AS er, sum(xc) / sum(notional) AS xr FROM cl WHERE ex IS NOT NULL),
ann AS (SELECT *, pow(fe / 1e7, 252.0::DOUBLE / n) - 1 AS ar, pow(be, 252.0::DOUBLE / n) - 1 AS br FROM ag)"""
SUMMARY_COLUMNS = {"final_equity": ("fe", 2), "net_pnl": ("fe - 1e7", 2), "gross_pnl_before_costs": ("g", 2), "transaction_cost_amount_total": ("e + x + cu", 2), "net_pnl_after_costs": ("g - e - x - cu", 2),
                   "total_return": ("fe / 1e7 - 1", 7), "annualized_return": ("ar", 7), "annualized_benchmark_return": ("br", 7), "alpha_over_benchmark_net": ("ar - br", 7), "annualized_volatility": ("vol", 7),
                   "sharpe_ratio": ("ar / vol", 6), "calmar_ratio": ("ar / abs(mdd)", 6), "max_drawdown": ("mdd", 7), "turnover_annualized": ("tno", 5), "average_gross_exposure": ("gx", 6), "capacity_binding_share": ("0.25", 4),
                   "trade_count": ("tc", 1), "win_rate": ("wr", 7), "avg_entry_cost_rate": ("er", 9), "avg_exit_cost_rate": ("xr", 9), "avg_roundtrip_cost_rate": ("er + xr", 9), "cost_drag_total": ("e + x + cu", 2),
                   "cost_drag_annualized": ("(e + x + cu) / n * 252", 2), "entry_cost_amount_total": ("e", 2), "exit_cost_amount_total": ("x", 2), "custody_fee_amount_total": ("cu", 2), "reconciliation_error_max_abs": ("0", 3)}


@query("r081_backtest_summary", f"WITH {SUMMARY} SELECT {', '.join(r(e, n, k) for n, (e, k) in SUMMARY_COLUMNS.items())} FROM ann, tg")
def _(spark, d):
    return out(_summary(spark, d), {n: k for n, (_e, k) in SUMMARY_COLUMNS.items()}, keep=())


POOL = SIG + """, pl AS (SELECT bars.date, bars.ticker, o AS price, v * 100000 AS volume, p0 / 100 AS er, CASE WHEN v > 25 THEN 0 ELSE 150000 END AS t, CASE WHEN v > 45 THEN 'USD' ELSE 'EUR' END AS cur FROM bars JOIN sig USING (date, ticker)),
p1 AS (SELECT *, greatest(ceil(10 / price), 1)::BIGINT AS ml, greatest(0, least(floor(price * volume * 0.05::DOUBLE / price), floor(0.1::DOUBLE * 1e6 / price)))::BIGINT AS cap FROM pl WHERE price > 0),
p2 AS (SELECT *, greatest(price * ml, 10) AS ov, greatest(greatest(price * ml, 10) - greatest(100000 - t, 0), 0) AS b FROM p1),
p3 AS (SELECT *, (CASE WHEN b > 0 THEN greatest(10, b * 0.002::DOUBLE) ELSE 0 END + CASE WHEN b > 0 AND cur <> 'EUR' THEN b * 0.005::DOUBLE ELSE 0 END) / ov AS cr FROM p2),
p4 AS (SELECT *, er - cr - 0.001::DOUBLE AS ne FROM p3), p5 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ne DESC, ticker) AS k FROM p4 WHERE cap >= ml AND ne > 0)"""


def _pool(spark, d):
    df = L.forward_returns(panel(spark, d))
    v = F.col(VOLUME)
    day = df.select(*KEY, F.col(K.SECTOR).alias("sector"), F.col(OPEN).alias("price"), (v * 100000).alias("volume"), (F.coalesce(F.log(F.col(CLOSE) / R.lag(CLOSE)), F.lit(0.0)) / 100).alias("expected_return"),
                    F.when(v > 25, 0.0).otherwise(150000.0).alias("month_to_date_turnover"), F.when(v > 45, "USD").otherwise("EUR").alias("currency"),
                    F.lit("stock_cash").alias("instrument_group"), F.lit(0.05).alias("max_adv_participation"))
    return LG.candidate_pool(day, equity=1e6, max_weight=0.10, pool=5, buffer_rate=0.001)


@query("r220_candidate_pool", f"WITH {POOL} SELECT {D}, k AS pool_rank, ml AS min_lot_shares, cap AS adv_cap_shares, {r('cr', 'cost_rate', 8)}, {r('ne', 'net_edge', 8)} FROM p5 WHERE k <= 5")
def _(spark, d):
    return out(_pool(spark, d), {"cost_rate": 8, "net_edge": 8}, keep=("date", "ticker", "pool_rank", "min_lot_shares", "adv_cap_shares"))


# Weights 1 / (k + 4) over the pool; covariance: variance by sector plus a common part, from the supplier balances.
ALLOC = POOL + ", " + COMPANIES.replace("companies AS", "co2 AS") + """, wt AS (SELECT p5.date, p5.ticker, 1.0::DOUBLE / (k + 4) AS w, er, cr, co2.sector AS sector FROM p5 JOIN co2 USING (ticker) WHERE k <= 5),
bal AS (SELECT ticker, balance / 10000 AS q FROM co2), va AS (SELECT a.date, sum(a.w * b.w * (x.q * y.q / 100 + CASE WHEN a.ticker = b.ticker THEN 0.04::DOUBLE ELSE 0 END)) AS v FROM wt a JOIN wt b ON a.date = b.date JOIN bal x ON x.ticker = a.ticker JOIN bal y ON y.ticker = b.ticker GROUP BY a.date),
sb AS (SELECT date, avg(CASE WHEN sw >= 0.25 - 1e-6 THEN 1.0::DOUBLE ELSE 0 END) AS s FROM (SELECT date, sector, sum(w) AS sw FROM wt GROUP BY 1, 2) GROUP BY 1)"""


@query("r221_allocation_diagnostics", f"""WITH {ALLOC} SELECT CAST(wt.date AS VARCHAR) AS date, {r('sum(w * er)', 'expected_portfolio_return', 8)}, {r('sqrt(max(v))', 'expected_portfolio_volatility', 8)}, {r('sum(w * (er - cr))', 'expected_net_alpha', 8)},
  {r('max(s)', 'sector_binding_share')}, {r('1 - sum(w)', 'cash_weight', 8)} FROM wt JOIN va ON va.date = wt.date JOIN sb ON sb.date = wt.date GROUP BY wt.date""")
def _(spark, d):
    weights = _pool(spark, d).select(*KEY, "sector", "expected_return", "cost_rate", (F.lit(1.0) / (F.col("pool_rank") + 4)).alias("weight"))
    co = companies(spark, d).select(TICKER, (F.col("account_balance") / 10000).alias("q"))
    # Only pairs held together on some date matter; a date holds at most the pool of five.
    held = weights.select(DATE, F.col(TICKER).alias("left")).join(weights.select(DATE, F.col(TICKER).alias("right")), DATE).select("left", "right").distinct()
    pairs = held.join(co.select(F.col(TICKER).alias("left"), "q"), "left").join(co.select(F.col(TICKER).alias("right"), F.col("q").alias("q2")), "right")
    cov = pairs.select("left", "right", (F.col("q") * F.col("q2") / 100 + F.when(F.col("left") == F.col("right"), 0.04).otherwise(0.0)).alias("value"))
    return out(LG.allocation_diagnostics(weights, cov, 0.25), {"expected_portfolio_return": 8, "expected_portfolio_volatility": 8, "expected_net_alpha": 8, "sector_binding_share": 6, "cash_weight": 8}, keep=("date",))


# Portfolio trials: one per sector; figures from the sector's label statistics.
PTRIAL = STRAT + """, pt AS (SELECT sector, row_number() OVER (ORDER BY sector) - 1 AS trial_index, avg(x) * 100 AS alpha, avg(x) / stddev_pop(x) AS sh, min(x) * 5 AS dd, stddev_pop(x) * 1500 AS tno, max(x) AS ca FROM sr GROUP BY sector),
ps AS (SELECT *, sh + 0.05::DOUBLE * alpha + 0.01::DOUBLE * ca - CASE WHEN alpha <= 0 THEN 5 + abs(alpha) ELSE 0 END - CASE WHEN dd < -0.15 THEN 100 * abs(dd + 0.15::DOUBLE) ELSE 0 END - CASE WHEN tno > 25 THEN 0.1::DOUBLE * (tno - 25) ELSE 0 END AS sc,
  alpha > 0 AND dd >= -0.15 AND tno <= 25 AS ok FROM pt)"""


def _portfolio_trials(spark, d):
    x = F.col("return")
    s = _strategies(spark, d).groupBy(K.SECTOR).agg((F.avg(x) * 100).alias("alpha_over_benchmark_net"), (F.avg(x) / F.stddev_pop(x)).alias("sharpe_ratio"), (F.min(x) * 5).alias("max_drawdown"),
                                                   (F.stddev_pop(x) * 1500).alias("turnover_annualized"), F.max(x).alias("calmar_ratio"))
    from pyspark.sql import Window
    s = s.withColumn("trial_index", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(K.SECTOR)) - 1)
    return EV.portfolio_trial_score(s)


@query("r222_trial_score", f"WITH {PTRIAL} SELECT trial_index, {r('sc', 'objective_score', 7)}, ok::INT AS is_valid FROM ps")
def _(spark, d):
    df = _portfolio_trials(spark, d).withColumn("is_valid", F.col("is_valid").cast("int"))
    return out(df, ["objective_score"], keep=("trial_index", "is_valid"), digits=7)


@query("r222_best_trial", f"WITH {PTRIAL} SELECT trial_index FROM ps ORDER BY ok DESC, sh DESC, alpha DESC, ca DESC, trial_index LIMIT 1")
def _(spark, d):
    return EV.best_portfolio_trial(_portfolio_trials(spark, d)).select("trial_index")


