"""Registered queries: feature selection, models, calibration, covariance, walk-forward, trials."""

from __future__ import annotations

from math import sqrt

import pandas as pd
from pyspark.sql import functions as F

from panelspark import contract as K
from panelspark.contract import DATE, KEY, SPLIT, TICKER
from panelspark.functions import crosssection as X
from panelspark.functions.stats import normal_cdf, normal_ppf
from panelspark.operators import calendars as C
from panelspark.operators import evaluation as EV
from panelspark.operators import labels as L
from panelspark.operators import models as MD
from panelspark.operators import quant as Q
from panelspark.operators import selection as SL
from panelspark.operators import splits as SP
from panelspark.operators.pairwise import PairMetrics
from panelspark.plans.q_panel import LAB, SPLIT_SQL, TEST_START
from panelspark.plans.q_signals import _classified, avg_rank, corr_sql
from panelspark.plans.registry import BARS, D, WINDOWS, out, query, r, roll
from panelspark.plans.testbars import panel
from panelspark.session import cut_lineage, fits_one_task

# Model dataset: four features, the week label as target, the date split.
FEATURES = ["quant_gap_return", "quant_log_dollar_volume", "quant_momentum_21d", "quant_realized_vol_21d"]
SHORT = {"quant_gap_return": "gap", "quant_log_dollar_volume": "ldv", "quant_momentum_21d": "mom", "quant_realized_vol_21d": "vol"}
DS = SPLIT_SQL + ", " + LAB.replace(BARS + ",\n", "") + f""", r0 AS (SELECT *, c / nullif(lag(c) OVER w, 0) - 1 AS ret, o / nullif(lag(c) OVER w, 0) - 1 AS gap FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
f0 AS (SELECT date, ticker, gap, ln(1 + c * v) AS ldv, ln(c) - ln(lag(c, 21) OVER w) AS mom, {roll('stddev_samp', 'ret', 21)} * {sqrt(252)} AS vol FROM r0 {WINDOWS}),
ds AS (SELECT f0.*, week AS y, dataset_split FROM f0 JOIN lab USING (date, ticker) JOIN dsp USING (date))"""


def dataset(spark, d):
    df = Q.bar_shape(Q.returns(L.forward_returns(panel(spark, d))))
    df = Q.momentum(df).withColumns({"quant_realized_vol_21d": Q.R.std(Q.RETURN, 21) * Q.ANNUAL, "quant_log_dollar_volume": F.log1p(Q.DOLLARS)})
    return SP.assign_splits(df.select(*KEY, *FEATURES, K.WEEK_NET), TEST_START)


def _train(spark, d):
    """Folds, moments, coverage and scores each read the train rows, so large ones are stored once."""
    df = dataset(spark, d).where(F.col(SPLIT) == "train")
    return df if fits_one_task(df) else cut_lineage(df, "train")


FOLDS = 5
FOLD_SQL = DS + f""", td AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM dsp WHERE dataset_split = 'train'), ch AS (SELECT *, ntile({FOLDS + 1}) OVER (ORDER BY date) AS ch FROM td),
st AS (SELECT ch - 1 AS fold, min(i) AS s FROM ch WHERE ch > 1 GROUP BY 1), fo AS (SELECT ch - 1 AS fold, 'validation' AS role, date FROM ch WHERE ch > 1 UNION ALL SELECT fold, 'train', date FROM st JOIN ch ON ch.i < st.s - 6),
tr AS (SELECT * FROM ds WHERE dataset_split = 'train')"""


def _folds(df):
    return SP.selection_folds(C.distinct_dates(df), FOLDS)


SFI_SQL = FOLD_SQL + ", lg AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, date, ticker, {s} AS x, y FROM tr" for n, s in SHORT.items()) + f"""),
sl AS (SELECT feature, fold, covar_pop(x, y) / nullif(var_pop(CASE WHEN y IS NOT NULL THEN x END), 0) AS slope FROM lg JOIN fo ON fo.date = lg.date AND role = 'train' WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2),
sg AS (SELECT lg.feature, fo.fold, lg.date, ticker, sign(slope) * x AS p, y FROM lg JOIN fo ON fo.date = lg.date AND role = 'validation' JOIN sl ON sl.feature = lg.feature AND sl.fold = fo.fold),
rk AS (SELECT *, {avg_rank('p', 'feature, date')} AS a, {avg_rank('y', 'feature, date')} AS b, row_number() OVER (PARTITION BY feature, date ORDER BY p DESC NULLS LAST, ticker) AS t,
  row_number() OVER (PARTITION BY feature, date ORDER BY p NULLS LAST, ticker) AS u, greatest(1, ceil(count(*) OVER (PARTITION BY feature, date) * 0.1::DOUBLE)) AS k FROM sg),
dd AS (SELECT feature, fold, date, coalesce({corr_sql('a', 'b')}, 0) AS ic, avg(CASE WHEN t <= k THEN y END) - avg(CASE WHEN u <= k THEN y END) AS sp FROM rk GROUP BY 1, 2, 3 HAVING count(*) >= 2),
fs AS (SELECT feature, fold, avg(ic) AS m, CASE WHEN stddev_pop(ic) <= 1e-12 THEN 0 ELSE avg(ic) / stddev_pop(ic) END AS ir, avg(sp) AS sp FROM dd GROUP BY 1, 2),
ag AS (SELECT feature, avg(m) AS m, avg(ir) AS ir, avg(sp) AS sp, avg(CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0 END) AS ps, avg(CASE WHEN sp > 0 THEN 1.0::DOUBLE ELSE 0 END) AS pp, median(sp) AS md, quantile_cont(sp, 0.25) AS lq FROM fs GROUP BY 1),
cv AS (SELECT feature, avg(CASE WHEN x IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS cov FROM lg GROUP BY 1),
sf AS (SELECT ag.*, cov, cov >= 0.9 AND m > 0 AND ir > 0 AND ps >= 0.5 AS ok FROM ag JOIN cv USING (feature))"""


def _sfi_folds(spark, d):
    df = _train(spark, d)
    return SL.single_feature_folds(df, _folds(df), FEATURES, K.WEEK_NET, K.WEEK_NET, 0.1)


def _sfi(spark, d):
    df = _train(spark, d)
    return SL.single_feature_scores(df, _folds(df), FEATURES, K.WEEK_NET, K.WEEK_NET, 0.1)


@query("r079_fold_score_aggregation", f"""WITH {SFI_SQL} SELECT feature, {r('m', 'objective_score', 8)}, {r('ir', 'weighted_daily_rank_ic_ir', 8)}, {r('sp', 'weighted_net_pnl_after_costs', 7)}, {r('ps', 'positive_fold_share')},
  {r('pp', 'pnl_positive_fold_share')}, {r('md', 'median_fold_net_pnl', 7)}, {r('lq', 'lower_quartile_fold_net_pnl', 7)} FROM ag""")
def _(spark, d):
    return out(SL.aggregate_fold_scores(_sfi_folds(spark, d), "feature"), {"objective_score": 8, "weighted_daily_rank_ic_ir": 8, "weighted_net_pnl_after_costs": 7, "positive_fold_share": 6,
                                                                           "pnl_positive_fold_share": 6, "median_fold_net_pnl": 7, "lower_quartile_fold_net_pnl": 7}, keep=("feature",))


@query("r077_coverage_fraction", f"WITH {SFI_SQL} SELECT feature, {r('cov', 'coverage_fraction', 8)} FROM cv")
def _(spark, d):
    return out(SL.coverage(_train(spark, d), FEATURES), ["coverage_fraction"], keep=("feature",), digits=8)


@query("r177_single_feature_scores", f"""WITH {SFI_SQL} SELECT feature, 'quant' AS feature_family, regexp_replace(feature, '_(?:lag_)?[0-9]+d?$', '') AS feature_stem, {r('cov', 'coverage_fraction', 8)}, {r('m', 'objective_score', 8)}, ok::INT AS passes_sfi,
  CASE WHEN cov < 0.9 THEN 'low_coverage' WHEN m <= 0 THEN 'non_positive_sfi' WHEN NOT ok THEN 'failed_selection_gates' ELSE 'retained' END AS sfi_drop_reason FROM sf""")
def _(spark, d):
    df = _sfi(spark, d).withColumn("passes_sfi", F.col("passes_sfi").cast("int"))
    return out(df, {"coverage_fraction": 8, "objective_score": 8}, keep=("feature", "feature_family", "feature_stem", "passes_sfi", "sfi_drop_reason"))


@query("r178_selection_gates", f"WITH {SFI_SQL} SELECT feature, (m > 0 AND ir > 0 AND ps >= 0.5)::INT AS sfi_gate, (m > 0 AND ir > 0 AND ps >= 0.5 AND sp > 0 AND pp >= 0.4 AND lq >= -0.0005)::INT AS selection_gate FROM ag")
def _(spark, d):
    df = SL.aggregate_fold_scores(_sfi_folds(spark, d), "feature")
    return df.select("feature", SL.sfi_gate().cast("int").alias("sfi_gate"), SL.selection_gate().cast("int").alias("selection_gate"))


@query("r179_false_discovery_control", f"""WITH {SFI_SQL}, bt AS (SELECT * FROM (VALUES (0, 1.0), (1, 31 / 32.0), (2, 26 / 32.0), (3, 16 / 32.0), (4, 6 / 32.0), (5, 1 / 32.0)) t(h, p)), pv AS (SELECT feature, p::DOUBLE AS p FROM sf JOIN bt ON h = round_even(ps * 5, 0)),
  bh AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS i, count(*) OVER () AS m FROM pv), ct AS (SELECT max(p) AS c FROM bh WHERE p <= 0.1::DOUBLE * i / m)
  SELECT feature, {r('p', 'p_value', 8)}, coalesce(p <= c, false)::INT AS passes_fdr FROM bh, ct""")
def _(spark, d):
    df = SL.fdr_control(_sfi(spark, d), FOLDS)
    return out(df.withColumn("passes_fdr", F.col("passes_fdr").cast("int")), ["p_value"], keep=("feature", "passes_fdr"), digits=8)


@query("r072_audit_join_and_drop_reasons", f"""WITH {SFI_SQL} SELECT feature, CASE WHEN NOT ok THEN 'rejected_sfi' WHEN feature = 'quant_gap_return' THEN 'rejected_linear_pruning' WHEN feature = 'quant_momentum_21d' THEN 'low_target_distance_correlation' ELSE 'selected' END AS drop_reason,
  CASE WHEN feature = 'quant_momentum_21d' THEN 0.004::DOUBLE WHEN feature <> 'quant_gap_return' THEN 0.2::DOUBLE END AS target_distance_correlation FROM sf""")
def _(spark, d):
    board = _sfi(spark, d)
    linear = board.where("feature <> 'quant_gap_return'").select("feature")
    audit = linear.select("feature", F.when(F.col("feature") == "quant_momentum_21d", 0.004).otherwise(0.2).alias("target_distance_correlation"),
                          (F.col("feature") != "quant_momentum_21d").alias("passes_target_correlation"))
    chosen = [x["feature"] for x in board.where("passes_sfi and feature not in ('quant_gap_return', 'quant_momentum_21d')").select("feature").collect()]
    return SL.selection_report(board, linear, linear, audit, chosen).select("feature", "drop_reason", "target_distance_correlation")


@query("r086_selection_summary", f"""WITH {SFI_SQL} SELECT count(*) AS candidate_feature_count, count(CASE WHEN ok THEN 1 END) AS sfi_survivor_count, count(*) AS linear_survivor_count, count(CASE WHEN ok THEN 1 END) AS selected_feature_count FROM sf""")
def _(spark, d):
    board = _sfi(spark, d)
    audit = board.select("feature", F.lit(0.1).alias("target_distance_correlation"), F.lit(True).alias("passes_target_correlation"))
    chosen = [x["feature"] for x in board.where("passes_sfi").select("feature").collect()]
    report = SL.selection_report(board, board.select("feature"), board.select("feature"), audit, SL.final_features(chosen))
    return SL.selection_summary(report).select("candidate_feature_count", "sfi_survivor_count", "linear_survivor_count", "selected_feature_count")


def _spearman_pair(a, b):
    return (f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", abs({corr_sql('a', 'b')}) AS v FROM (SELECT CASE WHEN {SHORT[a]} IS NOT NULL THEN rank() OVER (ORDER BY {SHORT[a]} NULLS LAST) + (count(*) OVER (PARTITION BY {SHORT[a]}) - 1) / 2.0::DOUBLE END AS a, "
            f"CASE WHEN {SHORT[b]} IS NOT NULL THEN rank() OVER (ORDER BY {SHORT[b]} NULLS LAST) + (count(*) OVER (PARTITION BY {SHORT[b]}) - 1) / 2.0::DOUBLE END AS b FROM tr)")


SPEAR_SQL = FOLD_SQL + ", spu AS (" + " UNION ALL ".join(_spearman_pair(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]) + ")"


@query("r180_spearman_matrix", f"""WITH {SPEAR_SQL} SELECT "left", "right", {r('v', 'value', 8)} FROM (SELECT * FROM spu UNION ALL SELECT "right", "left", v FROM spu UNION ALL SELECT * FROM (VALUES {", ".join(f"('{f}', '{f}', 1.0::DOUBLE)" for f in FEATURES)}))""")
def _(spark, d):
    return out(SL.spearman_matrix(_train(spark, d), FEATURES), ["value"], keep=("left", "right"), digits=8)


def _distance_sql(source, columns, pairs):
    """Distance correlation by its definition over all rows of ``source``, in sums: products of distances over all row pairs, and mean distances of rows."""
    def ordered(c):
        before = f"(row_number() OVER (ORDER BY {c}) - 1)"
        return f"({c} * (2 * {before} + 1 - n) + sum({c}) OVER () - 2 * coalesce(sum({c}) OVER (ORDER BY {c} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - {c}) / n AS a_{c}"
    used = sorted({c for pair in pairs for c in pair})
    filled = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM {source})) - (SELECT median({c}) FROM {source}) AS {c}" for c in used)
    spread = {c: f"(2 * q_{c} / n - 2 * (s_{c} / n) ** 2 - 2 * aa_{c} + am_{c} ** 2)" for c in used}
    one = ", ".join(f"sum({c}) AS s_{c}, sum({c} * {c}) AS q_{c}, avg(a_{c} * a_{c}) AS aa_{c}, avg(a_{c}) AS am_{c}" for c in used)
    two = ", ".join(f"avg(a_{a} * a_{b}) AS ab_{a}_{b}" for a, b in pairs)
    rows = " UNION ALL ".join(f"SELECT '{columns[a]}' AS \"left\", '{columns[b]}' AS \"right\", sqrt(greatest((x_{a}_{b} / n / n - 2 * ab_{a}_{b} + am_{a} * am_{b}) / sqrt({spread[a]} * {spread[b]}), 0)) AS v FROM xx, ee"
                              for a, b in pairs)
    return f"""zz AS MATERIALIZED (SELECT {filled} FROM {source}), nn AS (SELECT *, (SELECT count(*) FROM zz)::DOUBLE AS n FROM zz), aa AS (SELECT *, {", ".join(map(ordered, used))} FROM nn),
xx AS MATERIALIZED (SELECT {", ".join(f"sum(abs(p.{a} - q.{a}) * abs(p.{b} - q.{b})) AS x_{a}_{b}" for a, b in pairs)} FROM zz p, zz q),
ee AS MATERIALIZED (SELECT max(n) AS n, {one}, {two} FROM aa), dc AS ({rows})"""


LONG = {s: f for f, s in SHORT.items()}
PAIR_NAMES = [(SHORT[a], SHORT[b]) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]]


@query("r181_distance_correlation", f"""WITH {FOLD_SQL}, {_distance_sql('tr', LONG, PAIR_NAMES)} SELECT "left", "right", {r('v', 'value', 8)} FROM dc""")
def _(spark, d):
    metrics = PairMetrics(_train(spark, d), FEATURES)
    pairs = SL.feature_pairs(spark.createDataFrame([("all", f) for f in FEATURES], "scope string, feature string"))
    return out(metrics.of(pairs, "distance"), ["value"], keep=("left", "right"), digits=8)


@query("r182_target_distance_filter", f"""WITH {FOLD_SQL}, ty AS MATERIALIZED (SELECT * FROM tr WHERE y IS NOT NULL), {_distance_sql('ty', LONG | {'y': 'y'}, [(s, 'y') for s in SHORT.values()])}
  SELECT "left" AS feature, {r('v', 'target_distance_correlation', 8)}, CASE WHEN v > 0.005 THEN 'retained' ELSE 'low_target_distance_correlation' END AS drop_reason FROM dc""")
def _(spark, d):
    metrics = PairMetrics(_train(spark, d).where(F.col(K.WEEK_NET).isNotNull()), [*FEATURES, K.WEEK_NET])
    names = spark.createDataFrame([(f,) for f in FEATURES], "feature string")
    return out(SL.target_distance_filter(names, metrics, K.WEEK_NET), ["target_distance_correlation"], keep=("feature", "drop_reason"), digits=8)


# Redundant copies: a monotone transform of each feature must lose to its better-ranked original.
COPIES = [f"{f.removesuffix('d').rsplit('_', 1)[0]}_{n}d" if f[-2].isdigit() else f"{f}_{n}d" for f in FEATURES for n in (3,)]


def _with_copies(df):
    return df.withColumns({c: F.col(f) * 2 + 1 for c, f in zip(COPIES, FEATURES, strict=True)})


def _ranked_board(spark, names):
    board = spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "feature string, sfi_rank int")
    return SL.named(board)


@query("r183_greedy_redundancy_pruning", f"""WITH {FOLD_SQL} SELECT feature, stage_level, decision, reference_feature FROM (VALUES {", ".join(
    f"('{f}', 'stem', 'keep', NULL), ('{c}', 'stem', 'drop', '{f}'), ('{f}', 'family', 'keep', NULL), ('{f}', 'global', 'keep', NULL)" for f, c in zip(FEATURES, COPIES))}) t(feature, stage_level, decision, reference_feature)
  WHERE (SELECT count(*) FROM tr) > 0""")
def _(spark, d):
    metrics = PairMetrics(_with_copies(_train(spark, d)), [*FEATURES, *COPIES])
    _kept, audit = SL.prune_redundant(_ranked_board(spark, [*FEATURES, *COPIES]), metrics, "spearman", SL.LINEAR_THRESHOLD)
    return audit.select("feature", "stage_level", "decision", "reference_feature")


@query("r184_connected_component_pruning")
def _(spark, d):
    known = _with_copies(_train(spark, d).where(F.col(K.WEEK_NET).isNotNull()))
    return out(SL.prune_correlated(known, [*FEATURES, *COPIES], K.WEEK_NET), keep=("feature", "component", "keep"))


@query("r185_feature_grouping", f"""WITH {FOLD_SQL} SELECT feature, feature_family, feature_stem, feature_family || ':' || feature_stem || ':0:1' AS group_id FROM (
  SELECT feature, 'quant' AS feature_family, regexp_replace(feature, '_(?:lag_)?[0-9]+d?$', '') AS feature_stem FROM (VALUES {", ".join(f"('{f}')" for f in [*FEATURES, *COPIES])}) t(feature)) WHERE (SELECT count(*) FROM tr) > 0""")
def _(spark, d):
    names = [*FEATURES, *COPIES]
    metrics = PairMetrics(_with_copies(_train(spark, d)), names)
    return SL.group_features(SL.named(spark.createDataFrame([(n,) for n in names], "feature string")), metrics).select("feature", "feature_family", "feature_stem", "group_id")


@query("r185_feature_grouping_split")
def _(spark, d):
    """Buckets above the size are cut by correlation; a size of one splits every stem pair."""
    names = [*FEATURES, *COPIES]
    metrics = PairMetrics(_with_copies(_train(spark, d)), names)
    return SL.group_features(SL.named(spark.createDataFrame([(n,) for n in names], "feature string")), metrics, size=1).select("feature", "group_id")


@query("r186_forward_group_search")
def _(spark, d):
    df = _train(spark, d)
    chosen, history = SL.search_groups(df, _folds(df), {f: [f] for f in FEATURES}, K.WEEK_NET, K.WEEK_NET, top_fraction=0.1)
    rows = [(h["state"], float(h["objective_score"]), bool(h["passes_gates"]), set(h["state"].split("|")) == set(chosen)) for h in history]
    return spark.createDataFrame(rows, "state string, objective_score double, passes_gates boolean, chosen boolean")


@query("r188_selection_pipeline")
def _(spark, d):
    df = _train(spark, d)
    result = SL.select_features(df, _folds(df), FEATURES, FOLDS, K.WEEK_NET, K.WEEK_NET, 0.1)
    return result["report"].select("feature", "passes_sfi", "selected_linear", "selected_distance", "selected", "selection_rank", "drop_reason")


@query("r187_final_cap_and_report", f"""WITH {SFI_SQL}, k AS (SELECT feature, row_number() OVER (ORDER BY m DESC, ir DESC, cov DESC, feature) AS sfi_rank FROM sf) SELECT feature, sfi_rank, CASE WHEN sfi_rank <= 2 THEN sfi_rank ELSE 0 END AS selection_rank FROM k""")
def _(spark, d):
    board = SL.with_sfi_rank(_sfi(spark, d))
    order = [x["feature"] for x in board.orderBy("sfi_rank").select("feature").collect()]
    audit = board.select("feature", F.lit(0.1).alias("target_distance_correlation"), F.lit(True).alias("passes_target_correlation"))
    report = SL.selection_report(board, board.select("feature"), board.select("feature"), audit, SL.final_features([*order, order[0]], limit=2))
    return report.select("feature", "sfi_rank", "selection_rank")


# --- models ----------------------------------------------------------------------------------------------------------------

TWO = ["quant_log_dollar_volume", "quant_momentum_21d"]
# Ridge on two features by Cramer's rule; a missing momentum sits at its mean.
RIDGE_SQL = DS + """, tt AS MATERIALIZED (SELECT * FROM ds WHERE dataset_split = 'train' AND y IS NOT NULL), mu AS MATERIALIZED (SELECT avg(ldv) AS ma, avg(mom) AS mb, avg(y) AS my, count(*) AS n FROM tt),
zz AS MATERIALIZED (SELECT coalesce(ldv - ma, 0) AS a, coalesce(mom - mb, 0) AS b, y - my AS c FROM tt, mu), sd AS MATERIALIZED (SELECT sqrt(avg(a * a)) AS sa, sqrt(avg(b * b)) AS sb FROM zz),
gm AS MATERIALIZED (SELECT sum(a * a) / (max(sa) * max(sa)) + 1 AS g11, sum(a * b) / (max(sa) * max(sb)) AS g12, sum(b * b) / (max(sb) * max(sb)) + 1 AS g22, sum(a * c) / max(sa) AS c1, sum(b * c) / max(sb) AS c2 FROM zz, sd),
be AS MATERIALIZED (SELECT (c1 * g22 - c2 * g12) / (g11 * g22 - g12 * g12) AS b1, (c2 * g11 - c1 * g12) / (g11 * g22 - g12 * g12) AS b2 FROM gm),
pr AS (SELECT date, ticker, dataset_split, y, my + coalesce((ldv - ma) / sa, 0) * b1 + coalesce((mom - mb) / sb, 0) * b2 AS p FROM ds, mu, sd, be)"""


@query("r189_ridge", f"WITH {RIDGE_SQL} SELECT {D}, {r('p', 'prediction', 8)} FROM pr")
def _(spark, d):
    df = dataset(spark, d)
    model = MD.fit_ridge(df.where(F.col(SPLIT) == "train"), TWO, K.WEEK_NET)
    return out(MD.predict(model, df), ["prediction"], digits=8)


@query("r193_dispatch_and_predict", f"WITH {RIDGE_SQL} SELECT {D}, {r('p', 'prediction', 8)} FROM pr WHERE dataset_split <> 'train'")
def _(spark, d):
    spec = next(s for s in MD.default_specs() if s.name == "ridge")
    return out(MD.frozen_predictions(MD.ModelSpec(spec.name, spec.params, K.WEEK_NET), dataset(spark, d), TWO), ["prediction"], digits=8)


@query("r199_frozen_predictions", f"WITH {RIDGE_SQL} SELECT {D}, dataset_split, {r('p', 'prediction', 8)} FROM pr WHERE dataset_split <> 'train'")
def _(spark, d):
    return out(MD.frozen_predictions(MD.ModelSpec("ridge", {}, K.WEEK_NET), dataset(spark, d), TWO), ["prediction"], keep=("date", "ticker", SPLIT), digits=8)


# One feature in closed form: soft threshold of the correlation moment.
@query("r190_elastic_net", f"""WITH {DS}, tt AS MATERIALIZED (SELECT * FROM ds WHERE dataset_split = 'train' AND y IS NOT NULL), mu AS MATERIALIZED (SELECT avg(ldv) AS m, stddev_pop(ldv) AS s, avg(y) AS my FROM tt),
  rh AS MATERIALIZED (SELECT avg((ldv - m) / s * (y - my)) AS rho FROM tt, mu), be AS MATERIALIZED (SELECT sign(rho) * greatest(abs(rho) - 0.002::DOUBLE * 0.25::DOUBLE, 0) / (1 + 0.002::DOUBLE * 0.75::DOUBLE) AS b FROM rh)
  SELECT {D}, {r('my + b * (ldv - m) / s', 'prediction', 8)} FROM ds, mu, be""")
def _(spark, d):
    df = dataset(spark, d)
    model = MD.fit_elastic_net(df.where(F.col(SPLIT) == "train"), ["quant_log_dollar_volume"], K.WEEK_NET, alpha=0.002)
    return out(MD.predict(model, df), ["prediction"], digits=8)


@query("r191_factor_composite", f"""WITH {DS}, mu AS (SELECT avg(mom) AS mm, avg(ldv) AS ml FROM ds WHERE dataset_split = 'train'), v AS (SELECT date, ticker, coalesce(mom, mm) AS a, coalesce(ldv, ml) AS b FROM ds, mu),
  z AS (SELECT *, avg(a) OVER w AS ma, stddev_pop(a) OVER w AS sa, avg(b) OVER w AS mb, stddev_pop(b) OVER w AS sb FROM v WINDOW w AS (PARTITION BY date))
  SELECT {D}, {r('CASE WHEN sa > 1e-12 THEN (a - ma) / sa ELSE 0 END + CASE WHEN sb > 1e-12 THEN (b - mb) / sb ELSE 0 END', 'prediction')} FROM z""")
def _(spark, d):
    df = dataset(spark, d)
    return out(MD.predict(MD.fit_composite(df.where(F.col(SPLIT) == "train"), FEATURES), df), ["prediction"])


@query("r192_boosted_trees")
def _(spark, d):
    df = dataset(spark, d)
    model = MD.fit_boosted_regression(df.where(F.col(SPLIT) == "train"), TWO, K.WEEK_NET, rounds=3)
    return out(model.transform(df.where(F.col(SPLIT) == "test")), ["prediction"])


@query("r194_feature_preparation", f"""WITH {DS} SELECT {D}, {r('CAST(ldv AS FLOAT)', 'quant_log_dollar_volume', 4)}, {r('CASE WHEN NOT isinf(CAST(1 / nullif(gap, 0) AS FLOAT)) THEN CAST(1 / nullif(gap, 0) AS FLOAT) END', 'inverse_gap', 1)}, CASE WHEN gap IS NULL THEN '__missing__' ELSE ticker END AS company_sector FROM ds""")
def _(spark, d):
    gap = F.col("quant_gap_return")
    df = dataset(spark, d).withColumns({"inverse_gap": F.try_divide(F.lit(1.0), gap), "company_sector": F.when(gap.isNotNull(), F.col(TICKER))})
    return out(MD.prepare_features(df, ["quant_log_dollar_volume", "inverse_gap", "company_sector"]), {"quant_log_dollar_volume": 4, "inverse_gap": 1}, keep=("date", "ticker", "company_sector"))


@query("r245_model_registry", f"WITH {RIDGE_SQL} SELECT {D}, {r('p', 'ridge', 8)} FROM pr WHERE dataset_split = 'test'")
def _(spark, d):
    df = dataset(spark, d)
    assert set(MD.MODELS) == {s.name for s in MD.default_specs()}
    model = MD.fit_model(MD.ModelSpec("ridge", {"alpha": 1.0}, K.WEEK_NET), df.where(F.col(SPLIT) == "train"), TWO)
    return out(MD.predict(model, df.where(F.col(SPLIT) == "test")).withColumnRenamed("prediction", "ridge"), ["ridge"], digits=8)


@query("r195_probability_calibrator")
def _(spark, d):
    df = _classified(spark, d)
    return out(MD.fit_probability_calibrator(df, split=None).transform(df, "meta_probability", "calibrated"), ["calibrated"])


@query("r196_alpha_calibrator")
def _(spark, d):
    df = dataset(spark, d).withColumn("realized", F.col(K.WEEK_NET) / 100)
    train = df.where(F.col(SPLIT) == "train")
    return out(MD.fit_alpha_calibrator(train, "quant_momentum_21d", "realized").transform(df, "quant_momentum_21d", "expected_return_5d"), ["expected_return_5d"])


# Trailing matrix: last 63 dates, tickers with at least 10 known returns (bars are sparse), missing as 0.
COV_SQL = DS + """, rt AS (SELECT date, ticker, gap AS x FROM ds WHERE dataset_split = 'train'), bk AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS b FROM (SELECT DISTINCT date FROM rt)),
wn AS (SELECT rt.*, b FROM rt JOIN bk USING (date) WHERE b <= 63), vt AS (SELECT ticker FROM wn WHERE x IS NOT NULL GROUP BY ticker HAVING count(*) >= 10),
mx AS (SELECT vt.ticker, bk.b, coalesce(x, 0) AS x FROM vt CROSS JOIN (SELECT b FROM bk WHERE b <= 63) bk LEFT JOIN wn ON wn.ticker = vt.ticker AND wn.b = bk.b), cx AS (SELECT ticker, b, x - avg(x) OVER (PARTITION BY ticker) AS x FROM mx),
sc AS (SELECT a.ticker AS "left", c.ticker AS "right", sum(a.x * c.x) / 63 AS s, sum(a.x * a.x * c.x * c.x) AS q FROM cx a JOIN cx c ON a.b = c.b GROUP BY 1, 2),
pa AS (SELECT sqrt(count(*)) AS p, sum(CASE WHEN "left" = "right" THEN s ELSE 0 END) AS tr, sum(s * s) AS d2, sum(q) AS q FROM sc), sh AS (SELECT p, tr / p AS mu, least((q / 63 - d2) / (p * 63), (d2 - 2 * tr * tr / p + tr * tr / p) / p) AS beta, (d2 - 2 * tr * tr / p + tr * tr / p) / p AS delta FROM pa),
lw AS (SELECT "left", "right", (1 - beta / delta) * s + CASE WHEN "left" = "right" THEN beta / delta * mu ELSE 0 END AS v FROM sc, sh)"""


@query("r197_ledoit_wolf_covariance", f'WITH {COV_SQL} SELECT "left", "right", {r("v", "value", 6)} FROM lw')
def _(spark, d):
    return out(MD.ledoit_wolf(_train(spark, d), "quant_gap_return", 63, 10), ["value"], keep=("left", "right"))


@query("r198_proxy_covariance", f"""WITH {DS}, rt AS (SELECT date, ticker, y AS x FROM ds WHERE dataset_split = 'train'), bk AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS b FROM (SELECT DISTINCT date FROM rt)),
  mx AS (SELECT t.ticker, bk.b, coalesce(x, 0) AS x FROM (SELECT DISTINCT ticker FROM rt) t CROSS JOIN (SELECT * FROM bk WHERE b <= 63) bk LEFT JOIN rt ON rt.ticker = t.ticker AND rt.date = bk.date), cx AS (SELECT ticker, b, x - avg(x) OVER (PARTITION BY ticker) AS x FROM mx),
  sc AS (SELECT a.ticker AS "left", c.ticker AS "right", sum(a.x * c.x) / 62 AS s FROM cx a JOIN cx c ON a.b = c.b GROUP BY 1, 2), dg AS (SELECT avg(s) AS m FROM sc WHERE "left" = "right" AND s > 0)
  SELECT "left", "right", {r('CASE WHEN "left" = "right" AND s <= 0 THEN coalesce(m, 0.05) ELSE s END', 'value')} FROM sc, dg""")
def _(spark, d):
    return out(MD.proxy_covariance(_train(spark, d), K.WEEK_NET), ["value"], keep=("left", "right"))


# Ridge on one always-known feature, refitted per date from running moments.
@query("r199_walk_forward_ridge", f"""WITH {DS}, dm AS (SELECT date, count(y) AS n, sum(CASE WHEN y IS NOT NULL THEN ldv END) AS sx, sum(y) AS sy, sum(CASE WHEN y IS NOT NULL THEN ldv * ldv END) AS sxx, sum(ldv * y) AS sxy FROM ds GROUP BY date),
  cu AS (SELECT date, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy FROM dm WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING)),
  md AS (SELECT date, n, sx / n AS m, sy / n AS my, sqrt((sxx - sx * sx / n) / n) AS s, sxy - sx * sy / n AS c FROM cu WHERE n >= 2)
  SELECT {D}, {r('my + (c / s / (n + 1)) * (ldv - m) / s', 'prediction', 7)} FROM ds LEFT JOIN md USING (date)""")
def _(spark, d):
    return out(MD.walk_forward_ridge(dataset(spark, d), ["quant_log_dollar_volume"], K.WEEK_NET), ["prediction"], digits=7)


@query("r199_walk_forward_ridge_four_features")
def _(spark, d):
    return out(MD.walk_forward_ridge(dataset(spark, d), FEATURES, K.WEEK_NET), ["prediction"])


@query("r200_meta_out_of_fold")
def _(spark, d):
    df = _train(spark, d).withColumn(L.PRIMARY, F.col("quant_momentum_21d"))
    df = L.meta_labels(df, minimum=0.0)
    folds = SP.meta_folds(C.distinct_dates(df), 3)
    scored = MD.out_of_fold_probabilities(df, folds, ["quant_log_dollar_volume", "quant_momentum_21d"], lambda t, f: MD.fit_boosted_classifier(t, f, rounds=2, depth=2))
    return out(scored, ["meta_probability"], keep=("date", "ticker", "fold", "meta_candidate"))


# One-feature trials: the rank IC of a positive-slope model is that of the feature, whatever the penalty.
TRIAL_SQL = SFI_SQL + """, tc AS (SELECT fold, sp, m FROM fs WHERE feature = 'quant_log_dollar_volume'), al AS (SELECT * FROM (VALUES (0, 0.1::DOUBLE), (1, 1.0::DOUBLE), (2, 100.0::DOUBLE)) t(trial_number, alpha)),
ob AS (SELECT trial_number, avg(m) AS m, stddev_pop(m) AS s, stddev_samp(m) / sqrt(count(*)) AS se, 0.01::DOUBLE * (3 - trial_number) AS pen FROM tc, al GROUP BY trial_number)"""


def _ridge_trials(spark, d):
    df = _train(spark, d)
    scored = MD.score_ridge_trials(df, _folds(df), ["quant_log_dollar_volume"], K.WEEK_NET, [0.1, 1.0, 100.0])
    scored = scored.withColumns({"window_std": F.lit(0.0), "complexity_penalty": 0.01 * (3 - F.col("trial_number"))})
    return EV.aggregate_trials(scored)


@query("r201_trial_grid_scoring", f"""WITH {TRIAL_SQL} SELECT trial_number, {r('m', 'mean_rank_ic', 8)}, {r('s', 'std_rank_ic', 8)}, {r('-m + 0.1::DOUBLE * s + pen', 'objective_score', 8)} FROM ob""")
def _(spark, d):
    return out(_ridge_trials(spark, d), ["mean_rank_ic", "std_rank_ic", "objective_score"], keep=("trial_number",), digits=8)


@query("r202_one_standard_error_trial", f"""WITH {TRIAL_SQL}, os AS (SELECT *, -m + 0.1::DOUBLE * s + pen AS o FROM ob), lm AS (SELECT arg_min(o + se, o) AS l FROM os)
  SELECT trial_number, {r('o', 'objective_score', 8)}, {r('pen', 'complexity_penalty', 8)} FROM os, lm WHERE o <= l ORDER BY pen, o, trial_number LIMIT 1""")
def _(spark, d):
    return out(EV.one_standard_error_trial(_ridge_trials(spark, d)), ["objective_score", "complexity_penalty"], keep=("trial_number",), digits=8)


# Folds are years; probability from the volume, label from the forward return.
@query("r203_meta_scoring", """WITH """ + LAB + f""", cl AS (SELECT year(panel.date) AS sector, (week > 0)::INT AS lb, least(v / 60, 1) AS pr FROM panel JOIN lab USING (date, ticker) WHERE week IS NOT NULL),
  cv AS (SELECT sector, pr, count(*) AS n, sum(lb) AS ps FROM cl GROUP BY 1, 2), cw AS (SELECT *, sum(n) OVER w AS nn, sum(ps) OVER w AS pp, sum(ps) OVER (PARTITION BY sector) AS tp, sum(n) OVER (PARTITION BY sector) AS tn FROM cv WINDOW w AS (PARTITION BY sector ORDER BY pr DESC)),
  rm AS (SELECT sector, sum(ps / tp * pp / nn) AS ap, sum(ps * ((tn - tp) - (nn - pp) + (n - ps) / 2)) / max(tp * (tn - tp)) AS auc FROM cw GROUP BY 1) SELECT {r('avg(ap)', 'mean_pr_auc', 8)}, {r('avg(auc)', 'mean_roc_auc', 8)}, count(*) AS folds FROM rm""")
def _(spark, d):
    df = _classified(spark, d).withColumn("fold", F.year(DATE))
    m = EV.classification_metrics(df, balanced=True, by=("fold",))
    return out(m.agg(F.avg("average_precision").alias("mean_pr_auc"), F.avg("roc_auc").alias("mean_roc_auc"), F.count("*").alias("folds")), ["mean_pr_auc", "mean_roc_auc"], keep=("folds",), digits=8)


# --- scalar functions, user functions ---------------------------------------------------------------------------------------


@query("r235_statistics_functions", f"""WITH {DS} SELECT {D}, {r("CASE WHEN ldv < 8 THEN 0 WHEN ldv >= 14 THEN 13 ELSE CAST(floor((ldv - 8) / 6 * 12) AS BIGINT) + 1 END", 'bucket')}, {r('CASE WHEN ldv <= 9 THEN 1 WHEN ldv >= 13 THEN 3 WHEN ldv <= 11 THEN 1 + (ldv - 9) / 2 ELSE 2 + (ldv - 11) / 2 END', 'interpolated')},
  {r('CASE WHEN ldv IS NOT NULL THEN least(greatest(ldv, 1), 29) / 30 END', 'cdf_of_ppf')} FROM ds""")
def _(spark, d):
    from panelspark.functions.scalar import piecewise_linear
    x = F.col("quant_log_dollar_volume")
    inside = F.least(F.greatest(F.coalesce(x, F.lit(1.0)), F.lit(1.0)), F.lit(29.0))
    df = dataset(spark, d).withColumns({"bucket": F.width_bucket(x, F.lit(8.0), F.lit(14.0), F.lit(12)), "interpolated": piecewise_linear(x, [9.0, 11.0, 13.0], [1.0, 2.0, 3.0]),
                                                              "cdf_of_ppf": F.when(x.isNotNull(), normal_cdf(normal_ppf(inside / 30)))})
    return out(df, ["bucket", "interpolated", "cdf_of_ppf"])


@query("r235_group_quantiles", f"WITH {DS} SELECT CAST(date AS VARCHAR) AS date, {r('quantile_cont(ldv, 0.25)', 'q25')}, {r('quantile_cont(ldv, 0.5)', 'q50')}, {r('quantile_cont(ldv, 0.9)', 'q90')} FROM ds GROUP BY date")
def _(spark, d):
    # Split plan: exact quantiles from cumulative counts of aggregated values.
    return out(X.group_quantiles(dataset(spark, d), [DATE], "quant_log_dollar_volume", {"q25": 0.25, "q50": 0.5, "q90": 0.9}, split=True), ["q25", "q50", "q90"], keep=("date",))


@query("r242_rolling_user_aggregate", f"WITH {DS} SELECT {D}, {r('CASE WHEN count(gap) OVER w >= 10 THEN max(gap) OVER w - min(gap) OVER w END', 'gap_range_10', 5)} FROM ds WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING)")
def _(spark, d):
    from panelspark.functions.user import rolling_apply
    spread = rolling_apply(lambda x: float(x.max() - x.min()), 10)
    return out(dataset(spark, d).withColumn("gap_range_10", spread("quant_gap_return")), ["gap_range_10"], digits=5)


@query("r243_group_map", f"WITH {DS}, m AS (SELECT ticker, avg(ldv) AS m FROM ds GROUP BY ticker) SELECT {D}, {r('ldv - m', 'demeaned')} FROM ds JOIN m USING (ticker)")
def _(spark, d):
    from panelspark.functions.user import per_ticker

    def demean(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows["quant_log_dollar_volume"]
        return rows[["date", "ticker"]].assign(demeaned=x - x.mean())
    df = dataset(spark, d).select(*KEY, "quant_log_dollar_volume")
    return out(per_ticker(df, demean, "date date, ticker string, demeaned double"), ["demeaned"])


