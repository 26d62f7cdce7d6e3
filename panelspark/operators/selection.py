"""Feature selection: scores, gates, false-discovery control, pruning, grouping, search, report.

Rows are only touched by partial aggregates, ranks per (feature, date) and the pair metrics of ``operators.pairwise``; what
is left after that has one row per feature, feature pair or (feature, fold), so its size follows
the schema's width, not the data.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.contract import DATE, KEY, MODEL_TARGET, REALIZED_RETURN, TICKER
from panelspark.functions.stats import binomial_tail
from panelspark.operators.pairwise import PairMetrics
from panelspark.operators.signals import daily_signal_diagnostics
from panelspark.session import cut_lineage, groups_fit

# Default thresholds.
MIN_COVERAGE = 0.90
POSITIVE_SHARE, PNL_SHARE, PNL_FLOOR = 0.50, 0.40, -0.0005
FDR_ALPHA = 0.10
LINEAR_THRESHOLD = DISTANCE_THRESHOLD = 0.80
TARGET_THRESHOLD = 0.005
MAX_GROUP_SIZE, SELECTED_FEATURES = 64, 30
PEARSON_PRESCREEN, STRONG_EDGE = 0.90, 0.95

# Family of each name prefix.
FAMILIES = {"xtb_": "broker", "sector_": "sector", "open_": "open", "earnings_": "earnings", "signal_": "signal", "ta_": "ta",
            "quant_": "quant", "deep_": "deep", "calendar_": "calendar", "sentiment_": "sentiment", "macro_": "macro",
            "cross_asset_": "cross_asset", "company_": "company", "stock_": "stock"}


def feature_family(name: str) -> str:
    return next((family for prefix, family in FAMILIES.items() if name.startswith(prefix)), "other")


def feature_stem(name: str) -> str:
    """Name without its trailing window or lag."""
    return re.sub(r"_(?:lag_)?\d+d?$", "", name).rstrip("_")


def selected_features(df: DataFrame, protected: list[str], context: list[str], selected: list[str]) -> DataFrame:
    """date, ticker, protected columns, context columns as ``hl_context_*`` and the selected features;
    a context column that is itself selected appears under both names."""
    names = dict.fromkeys(c for c in [*protected, *selected] if c in df.columns and c not in KEY)
    return df.select(DATE, TICKER, *[c for c in names if c in protected],
                     *[F.col(c).alias(f"hl_context_{c}") for c in context if c in df.columns],
                     *[c for c in names if c not in protected])


def unpivot_features(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])
    return df.select(*keep, F.inline(pairs))


def named(features: DataFrame) -> DataFrame:
    """Add family and stem to a frame with one row per ``feature``."""
    prefixes = F.coalesce(*[F.when(F.col("feature").startswith(p), f) for p, f in FAMILIES.items()], F.lit("other"))
    return features.withColumns({"feature_family": prefixes,
                                 "feature_stem": F.rtrim(F.regexp_replace("feature", r"_(?:lag_)?\d+d?$", ""), F.lit("_"))})


def coverage(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, coverage_fraction): share of finite values, one aggregation."""
    def share(c):
        return F.avg(F.coalesce((F.abs(F.col(c).cast("double")) < float("inf")), F.lit(False)).cast("double"))
    one = df.agg(*[share(c).alias(c) for c in features])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("coverage_fraction")) for c in features])))


# --- single-feature scores -----------------------------------------------------------------------------


def fold_slopes(df: DataFrame, folds: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, fold, slope): least squares of the target on one feature over the fold's train dates.

    Moments are summed per (feature, date) once and reused by every fold.
    """
    long = unpivot_features(df, features, [DATE, target]).where(F.col("x").isNotNull() & F.col(target).isNotNull())
    x, y = F.col("x"), F.col(target)
    moments = {"n": F.count("*"), "sx": F.sum(x), "sy": F.sum(y), "sxy": F.sum(x * y), "sxx": F.sum(x * x)}
    daily = long.groupBy("feature", DATE).agg(*[c.alias(k) for k, c in moments.items()])
    train = folds.where(F.col("role") == "train").select("fold", DATE)
    total = daily.join(F.broadcast(train), DATE).groupBy("feature", "fold").agg(*[F.sum(k).alias(k) for k in moments])
    covariance = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    return total.select("feature", "fold", F.try_divide(covariance, F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")).alias("slope"))


def fold_scores(daily: DataFrame, by: str) -> DataFrame:
    """Per (by, fold): mean IC, its information ratio, mean spread; a fold weighs 1."""
    mean, std = F.avg("rank_ic"), F.stddev_pop("rank_ic")
    return daily.groupBy(by, "fold").agg(
        mean.alias("daily_rank_ic_mean"), F.when(std <= 1e-12, 0.0).otherwise(F.try_divide(mean, std)).alias("daily_rank_ic_ir"),
        F.avg("top_bottom_spread").alias("daily_top_bottom_spread_mean"), F.avg("top_bottom_spread").alias("net_pnl_after_costs"),
        F.lit(1.0).alias("weight"))


def aggregate_fold_scores(scores: DataFrame, by: str, metrics: tuple[str, ...] = (
        "net_pnl_after_costs", "daily_rank_ic_mean", "daily_rank_ic_ir", "daily_top_bottom_spread_mean")) -> DataFrame:
    """Weighted means over folds, shares of positive folds, median and lower quartile of the P&L."""
    w = F.col("weight")
    pnl, ic = F.col("net_pnl_after_costs"), F.col("daily_rank_ic_mean")
    return scores.groupBy(by).agg(
        *[F.try_divide(F.sum(w * F.col(m)), F.sum(F.when(F.col(m).isNotNull(), w))).alias(f"weighted_{m}") for m in metrics],
        F.avg((ic > 0).cast("double")).alias("positive_fold_share"), F.avg((pnl > 0).cast("double")).alias("pnl_positive_fold_share"),
        F.percentile(pnl, F.lit(0.5)).alias("median_fold_net_pnl"), F.percentile(pnl, F.lit(0.25)).alias("lower_quartile_fold_net_pnl"),
    ).withColumn("objective_score", F.col("weighted_daily_rank_ic_mean"))


def sfi_gate() -> Column:
    return F.coalesce((F.col("objective_score") > 0) & (F.col("weighted_daily_rank_ic_ir") > 0)
                      & (F.col("positive_fold_share") >= POSITIVE_SHARE), F.lit(False))


def selection_gate() -> Column:
    return sfi_gate() & F.coalesce((F.col("weighted_daily_top_bottom_spread_mean") > 0) & (F.col("pnl_positive_fold_share") >= PNL_SHARE)
                                   & (F.col("lower_quartile_fold_net_pnl") >= PNL_FLOOR), F.lit(False))


def single_feature_folds(df: DataFrame, folds: DataFrame, features: list[str], target: str = MODEL_TARGET,
                         realized: str = REALIZED_RETURN, top_fraction: float = 0.01) -> DataFrame:
    """Per (feature, fold) scores of a one-feature linear model: only the slope's sign can move a
    rank measure, so the signed feature itself is the prediction."""
    slopes = fold_slopes(df, folds, features, target)
    validation = folds.where(F.col("role") == "validation").select(DATE, "fold")
    long = unpivot_features(df, features, list(dict.fromkeys([*KEY, target, realized]))).join(F.broadcast(validation), DATE)
    signed = long.join(slopes, ["feature", "fold"]).withColumn("prediction", F.signum("slope") * F.col("x"))
    daily = daily_signal_diagnostics(signed, "prediction", target, realized, top_fraction, ("feature", "fold", DATE), row_key=("feature", *KEY))
    return fold_scores(daily, "feature")


def single_feature_scores(df: DataFrame, folds: DataFrame, features: list[str], target: str = MODEL_TARGET,
                          realized: str = REALIZED_RETURN, top_fraction: float = 0.01) -> DataFrame:
    scored = aggregate_fold_scores(single_feature_folds(df, folds, features, target, realized, top_fraction), "feature")
    board = named(coverage(df, features).join(scored, "feature", "left"))
    covered = F.col("coverage_fraction") >= MIN_COVERAGE
    board = board.withColumns({"passes_coverage": covered, "passes_sfi": covered & sfi_gate()})
    return board.withColumn("sfi_drop_reason", F.when(~covered, "low_coverage").when(F.coalesce("objective_score", F.lit(0.0)) <= 0, "non_positive_sfi")
                            .when(~F.col("passes_sfi"), "failed_selection_gates").otherwise("retained"))


def fdr_control(board: DataFrame, folds: int, alpha: float = FDR_ALPHA) -> DataFrame:
    """Benjamini-Hochberg on the binomial tail of the positive folds (one row per feature)."""
    hits = F.bround(F.col("positive_fold_share") * folds, 0)
    board = board.withColumn("p_value", binomial_tail(F.coalesce(hits, F.lit(0.0)), folds))
    whole = Window.partitionBy(F.lit(0))
    below = F.count("*").over(whole.orderBy("p_value"))  # rows with a p-value up to this one
    board = board.withColumn("_ok", F.col("p_value") <= alpha * below / F.count("*").over(whole))
    cut = F.max(F.when(F.col("_ok"), F.col("p_value"))).over(whole)
    board = board.withColumn("passes_fdr", F.coalesce(F.col("p_value") <= cut, F.lit(False))).drop("_ok")
    rejected = F.col("passes_sfi") & ~F.col("passes_fdr")
    return board.withColumns({"sfi_drop_reason": F.when(rejected, "rejected_fdr").otherwise(F.col("sfi_drop_reason")),
                              "passes_sfi": F.col("passes_sfi") & F.col("passes_fdr")})


def with_sfi_rank(board: DataFrame) -> DataFrame:
    """Add ``sfi_rank``, best first (one row per feature)."""
    order = [F.col(c).desc_nulls_last() for c in ("objective_score", "weighted_daily_rank_ic_ir", "coverage_fraction")]
    return board.withColumn("sfi_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order, "feature")))


# --- pair metrics ---------------------------------------------------------------------------------------


def feature_pairs(scopes: DataFrame) -> DataFrame:
    """(scope, left, right) for each unordered pair of features sharing a scope.  The pair list is
    as long as the schema allows and independent of the rows."""
    named_scopes = scopes.withColumn("_names", F.collect_set("feature").over(Window.partitionBy("scope")))
    return (named_scopes.withColumn("right", F.explode(F.filter("_names", lambda n: n > F.col("feature"))))
            .select("scope", F.col("feature").alias("left"), "right"))


def spearman_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """(left, right, value) over the full square, diagonal 1."""
    metrics = PairMetrics(df, features)
    upper = metrics.spearman()
    both = F.array(F.struct(F.col("left"), F.col("right")), F.struct(F.col("right").alias("left"), F.col("left").alias("right")))
    square = upper.select(F.explode(both).alias("_p"), "value").select("_p.left", "_p.right", "value")
    one = df.sparkSession.createDataFrame([(f, f, 1.0) for f in metrics.features], "left string, right string, value double")
    return square.unionByName(one)


# --- redundancy pruning ---------------------------------------------------------------------------------------

def best_of_close(ranked: DataFrame, pairs: DataFrame, level: str, threshold: float) -> DataFrame:
    """Audit of one pruning level: a feature stays unless a better-ranked one that stays is as close as the threshold.

    ``ranked`` has scope, feature and sfi_rank, ``pairs`` scope, left, right and value.  Rounds over the table of close pairs, all scopes at once: a feature without an undecided better neighbour
    stays, and what is next to it goes.  The best-ranked feature of every undecided group is settled in each round, so rounds end.
    """
    better = F.struct("sfi_rank", "feature")
    place = ranked.select("scope", F.col("feature"), better.alias("place"))
    close = pairs.where(F.col("value") >= threshold)
    close = cut_lineage(close.select("scope", F.col("left").alias("feature"), F.col("right").alias("other"), "value")
                        .unionByName(close.select("scope", F.col("right").alias("feature"), F.col("left").alias("other"), "value")), "close_pairs")
    open_ = place
    settled = []
    while True:
        rivals = close.join(open_.select("scope", F.col("feature").alias("other"), F.col("place").alias("rival")), ["scope", "other"])
        first = rivals.groupBy("scope", "feature").agg(F.min("rival").alias("rival"))
        stay = cut_lineage(open_.join(first, ["scope", "feature"], "left").where("rival IS NULL OR place < rival").select("scope", "feature", "place"), "kept")
        if stay.isEmpty():
            break
        settled.append(stay)
        beside = close.join(stay.select("scope", F.col("feature").alias("other")), ["scope", "other"]).select("scope", "feature")
        open_ = cut_lineage(open_.join(stay, ["scope", "feature"], "left_anti").join(beside, ["scope", "feature"], "left_anti"), "open")
    if not settled:
        kept = place.limit(0)
    else:
        kept = settled[0]
        for more in settled[1:]:
            kept = kept.unionByName(more)
    near = close.join(kept.select("scope", F.col("feature").alias("other"), "place"), ["scope", "other"])
    near = near.groupBy("scope", "feature").agg(F.min(F.struct("place", "other", "value")).alias("near"))
    out = place.join(kept.select("scope", "feature", F.lit(True).alias("stays")), ["scope", "feature"], "left").join(near, ["scope", "feature"], "left")
    stays = F.coalesce("stays", F.lit(False))
    gone = F.when(~stays, F.col("near.other"))
    return out.select(F.lit(level).alias("stage_level"), F.col("scope").alias("scope_key"), "feature", F.when(stays, "keep").otherwise("drop").alias("decision"),
                      F.when(stays, F.col("feature")).otherwise(gone).alias("representative_feature"), gone.alias("reference_feature"),
                      F.when(~stays, F.col("near.value")).alias("metric_value"))


def prune_redundant(board: DataFrame, metrics: PairMetrics, metric: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Stem, then family, then global pruning of the board's features; returns (survivors, audit).
    ``board`` needs feature, feature_family, feature_stem and sfi_rank."""
    current, audits = board.select("feature", "feature_family", "feature_stem", "sfi_rank"), []
    for level, scope in (("stem", F.col("feature_stem")), ("family", F.col("feature_family")), ("global", F.lit("global"))):
        scoped = cut_lineage(current.withColumn("scope", scope), "scoped")
        pairs = metrics.of(feature_pairs(scoped.select("scope", "feature")), metric)
        audit = cut_lineage(best_of_close(scoped, pairs, level, threshold))
        audits.append(audit)
        current = current.join(audit.where("decision = 'keep'").select("feature"), "feature", "left_semi")
    return current, audits[0].unionByName(audits[1]).unionByName(audits[2])


def target_distance_filter(features: DataFrame, metrics: PairMetrics, target: str, threshold: float = TARGET_THRESHOLD) -> DataFrame:
    """(feature, target_distance_correlation, passes_target_correlation, drop_reason)."""
    scored = metrics.of(features.select(F.col("feature").alias("left"), F.lit(target).alias("right")), "distance").withColumnRenamed("left", "feature")
    passes = F.col("value") > threshold
    return scored.select("feature", F.col("value").alias("target_distance_correlation"), passes.alias("passes_target_correlation"),
                         F.when(passes, "retained").otherwise("low_target_distance_correlation").alias("drop_reason"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(feature, component) of an edge list (left, right): the smallest name spreads along edges until
    nothing changes.  Each round is written out, so the plan does not grow."""
    both = edges.select("left", "right").unionByName(edges.select(F.col("right").alias("left"), F.col("left").alias("right"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.select(F.col("left").alias("feature"), F.col("left").alias("component")).distinct())
    while True:
        heard = (both.join(labels.withColumnRenamed("feature", "right"), "right").groupBy(F.col("left").alias("feature"))
                 .agg(F.min("component").alias("_heard")))
        updated = cut_lineage(labels.join(heard, "feature", "left").select(
            "feature", F.least("component", "_heard").alias("component"), (F.col("_heard") < F.col("component")).alias("_moved")))
        labels = updated.select("feature", "component")
        if updated.where("_moved").isEmpty():
            return labels


def prune_correlated(df: DataFrame, features: list[str], target: str, prescreen: float = PEARSON_PRESCREEN,
                     strong: float = STRONG_EDGE) -> DataFrame:
    """(feature, component, keep): components of near-identical features; each keeps the member with
    the highest distance correlation to the target."""
    metrics = PairMetrics(df, [*features, target])
    names = df.sparkSession.createDataFrame([("all", f) for f in features], "scope string, feature string")
    close = metrics.of(feature_pairs(names), "pearson").where(F.col("value") >= prescreen).drop("value")
    edges = metrics.of(close, "distance").where(F.col("value") >= strong)
    members = cut_lineage(connected_components(edges))
    scored = target_distance_filter(members, metrics, target).select("feature", "target_distance_correlation")
    best = Window.partitionBy("component").orderBy(F.col("target_distance_correlation").desc(), F.col("feature").desc())
    return members.join(scored, "feature").withColumn("keep", F.row_number().over(best) == 1)


# --- grouping -----------------------------------------------------------------------------------------------------


def partition_bucket(names: list[str], value: dict[tuple[str, str], float], size: int = MAX_GROUP_SIZE) -> list[list[str]]:
    """Groups of at most ``size``: pairs join in the order of falling correlation, as long as the joint group has room.

    Single linkage with bounded groups; ties go by name.  A bucket within the size is one group.
    """
    if len(names) <= size:
        return [sorted(names)]
    group = {name: (name,) for name in names}
    for a, b in sorted((pair for pair in value if group.keys() >= set(pair)), key=lambda pair: (-value[pair], pair)):
        joint = group[a] + group[b]
        if group[a] is not group[b] and len(joint) <= size:
            group |= dict.fromkeys(joint, joint)
    return sorted(map(sorted, set(group.values())))


def group_features(features: DataFrame, metrics: PairMetrics, size: int = MAX_GROUP_SIZE) -> DataFrame:
    """(group_id, feature_family, feature_stem, feature): buckets by family and stem, large ones split.
    Pair metrics are only computed for buckets above the size."""
    scoped = features.select("feature", "feature_family", "feature_stem", F.concat_ws(":", "feature_family", "feature_stem").alias("scope"))
    large = scoped.groupBy("scope").agg(F.count("*").alias("_n")).where(F.col("_n") > size).select("scope")
    pairs = metrics.of(feature_pairs(scoped.join(large, "scope", "left_semi").select("scope", "feature")), "spearman")

    def split(key, rows: pd.DataFrame, metrics: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"group_id": [], "feature": []})
        value = {(a, b): v for a, b, v in zip(metrics["left"], metrics["right"], metrics["value"], strict=True)}
        groups = partition_bucket(rows["feature"].tolist(), value, size)
        return pd.DataFrame([(f"{key[0]}:0:{i}", name) for i, group in enumerate(groups, 1) for name in group], columns=["group_id", "feature"])
    paired = pairs.select(F.col("scope").alias("pair_scope"), "left", "right", "value")
    ids = scoped.groupBy("scope").cogroup(paired.groupBy("pair_scope")).applyInPandas(split, "group_id string, feature string")
    return ids.join(scoped.drop("scope"), "feature")


# --- forward group search --------------------------------------------------------------------------------------------


def neighbour_states(current: tuple[str, ...], groups: list[str]) -> list[tuple[str, ...]]:
    """All states one addition, replacement or removal away."""
    inside, outside = set(current), [g for g in groups if g not in current]
    states = {tuple(sorted(inside | {g})) for g in outside}
    states |= {tuple(sorted(inside - {g} | {o})) for g in current for o in outside}
    states |= {tuple(sorted(inside - {g})) for g in current}
    return sorted(s for s in states if s)


def score_states(states: dict[str, list[str]], df: DataFrame, folds: DataFrame, features: list[str], target: str, realized: str,
                 grams: dict, top_fraction: float = 0.01, split: bool | None = None) -> DataFrame:
    """Aggregate fold scores of many feature subsets in one job.

    ``grams`` holds each fold's train moments over all features; a state's ridge model is a small
    solve on its rows and columns.  Validation rows are scored for all states at once.
    """
    from panelspark.operators.models import ridge_from_moments
    rows = []
    for fold, moments in grams.items():
        for state, names in states.items():
            model = ridge_from_moments(moments, names)
            coefficient = dict(zip(model.features, zip(model.coefficients, model.mean, model.std, strict=True), strict=True))
            rows.append((state, int(fold), [float(coefficient[f][0] / coefficient[f][2]) if f in coefficient else 0.0 for f in features],
                         [float(moments["mean"][i]) for i in range(len(features))]))
    table = df.sparkSession.createDataFrame(rows, "state string, fold int, weights array<double>, means array<double>")
    validation = folds.where(F.col("role") == "validation").select(DATE, F.col("fold").cast("int").alias("fold"))
    base = (df.select(*dict.fromkeys([*KEY, target, realized]), F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
            .join(F.broadcast(validation), DATE))
    # States x folds rows, a few kilobytes.
    scored = base.join(F.broadcast(table), "fold")
    centred = F.zip_with("_x", "means", lambda x, m: F.coalesce(x - m, F.lit(0.0)))
    prediction = F.aggregate(F.zip_with(centred, F.col("weights"), lambda z, w: z * w), F.lit(0.0), lambda a, v: a + v)
    scored = scored.withColumn("prediction", prediction).drop("_x", "weights", "means")
    # The plan choice follows the rows of a date, not the small table made here.
    split = not groups_fit(df, [DATE], list(dict.fromkeys([*KEY, target, realized]))) if split is None else split
    daily = daily_signal_diagnostics(scored, "prediction", target, realized, top_fraction, ("state", "fold", DATE), split, ("state", *KEY))
    return aggregate_fold_scores(fold_scores(daily, "state"), "state").withColumn("passes_gates", selection_gate())


def search_groups(df: DataFrame, folds: DataFrame, groups: dict[str, list[str]], target: str = MODEL_TARGET, realized: str = REALIZED_RETURN,
                  max_rounds: int | None = None, top_fraction: float = 0.01) -> tuple[list[str], list[dict]]:
    """Start from the best single group, then move to the best improving neighbour that passes the
    gates, until none improves (or ``max_rounds``).  One Spark job per round; the driver only sees one row per scored state."""
    from panelspark.operators.models import fold_moments
    features = sorted({f for names in groups.values() for f in names})
    # Every round reads these columns again, so they are stored once.
    df = cut_lineage(df.select(*dict.fromkeys([*KEY, target, realized, *features])))
    split = not groups_fit(df, [DATE], [*KEY, target, realized])
    folds = cut_lineage(folds)
    grams = fold_moments(df, folds, features, target)
    seen: dict[tuple[str, ...], dict] = {}
    history: list[dict] = []

    def evaluate(states: list[tuple[str, ...]]) -> None:
        fresh = [s for s in states if s not in seen]
        if not fresh:
            return
        named_states = {"|".join(s): sorted({f for g in s for f in groups[g]}) for s in fresh}
        for x in score_states(named_states, df, folds, features, target, realized, grams, top_fraction, split).collect():
            seen[tuple(x["state"].split("|"))] = x.asDict()
            history.append(x.asDict())

    def best(states: list[tuple[str, ...]]):
        known = [s for s in states if s in seen and seen[s]["objective_score"] is not None]
        passing = [s for s in known if seen[s]["passes_gates"]]
        return max(passing, key=lambda s: (seen[s]["objective_score"], s), default=None), max(
            known, key=lambda s: (seen[s]["objective_score"], s), default=None)
    singles = [(g,) for g in sorted(groups)]
    evaluate(singles)
    accepted, anchor = best(singles)
    current = accepted or anchor
    rounds = 0
    while current is not None and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        options = neighbour_states(current, sorted(groups))
        evaluate(options)
        candidate, _any = best(options)
        floor = seen[accepted]["objective_score"] if accepted else 0.0
        if candidate is None or seen[candidate]["objective_score"] <= floor:
            break
        accepted = current = candidate
    chosen = accepted or ()
    return sorted({f for g in chosen for f in groups[g]}), history


# --- report ------------------------------------------------------------------------------------------------------------


def final_features(names: list[str], limit: int = SELECTED_FEATURES) -> list[str]:
    return list(dict.fromkeys(names))[:limit]


def selection_report(board: DataFrame, linear: DataFrame, distance: DataFrame, target_audit: DataFrame, selected: list[str]) -> DataFrame:
    """Scores with one flag per stage, the final rank and the reason a feature dropped out."""
    spark = board.sparkSession
    ranks = spark.createDataFrame([(n, i) for i, n in enumerate(selected, 1)], "feature string, selection_rank int")
    out = (board.join(linear.select("feature", F.lit(True).alias("selected_linear")), "feature", "left")
           .join(distance.select("feature", F.lit(True).alias("selected_distance")), "feature", "left")
           .join(target_audit.select("feature", "target_distance_correlation", F.col("passes_target_correlation").alias("selected_target_correlation")), "feature", "left")
           .join(ranks, "feature", "left"))
    stages = ("selected_linear", "selected_distance", "selected_target_correlation")
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in stages}
                          | {"selected": F.col("selection_rank").isNotNull(), "selection_rank": F.coalesce("selection_rank", F.lit(0))})
    reason = (F.when(F.col("selected"), "selected").when(~F.col("passes_sfi"), "rejected_sfi").when(~F.col("selected_linear"), "rejected_linear_pruning")
              .when(~F.col("selected_distance"), "rejected_distance_pruning")
              .when(~F.col("selected_target_correlation"), "low_target_distance_correlation").otherwise("not_selected"))
    return out.withColumn("drop_reason", reason)


def selection_summary(report: DataFrame) -> DataFrame:
    """Survivors per stage."""
    return report.agg(F.count("*").alias("candidate_feature_count"), F.count_if("passes_sfi").alias("sfi_survivor_count"),
                      F.count_if("selected_linear").alias("linear_survivor_count"), F.count_if("selected_distance").alias("distance_survivor_count"),
                      F.count_if("selected_target_correlation").alias("target_correlation_survivor_count"), F.count_if("selected").alias("selected_feature_count"))


def family_counts(groups: DataFrame) -> DataFrame:
    return groups.groupBy("feature_family").agg(F.count_distinct("group_id").alias("groups"), F.count("*").alias("features"))


def select_features(df: DataFrame, folds: DataFrame, features: list[str], fold_count: int, target: str = MODEL_TARGET,
                    realized: str = REALIZED_RETURN, top_fraction: float = 0.01, limit: int = SELECTED_FEATURES) -> dict[str, DataFrame]:
    """Whole pipeline: scores and FDR, linear, distance and target pruning, groups, search, report.  All over all rows."""
    board = cut_lineage(with_sfi_rank(fdr_control(single_feature_scores(df, folds, features, target, realized, top_fraction), fold_count)))
    survivors = board.where("passes_sfi")
    metrics = PairMetrics(df, [*features, target])
    linear, linear_audit = prune_redundant(survivors, metrics, "spearman", LINEAR_THRESHOLD)
    distance, distance_audit = prune_redundant(linear, metrics, "distance", DISTANCE_THRESHOLD)
    known_target = PairMetrics(df.where(F.col(target).isNotNull()), [*features, target])
    audit = cut_lineage(target_distance_filter(distance, known_target, target))
    passing = distance.join(audit.where("passes_target_correlation"), "feature", "left_semi")
    manifest = cut_lineage(group_features(passing, metrics))
    groups: dict[str, list[str]] = {}
    for x in manifest.orderBy("group_id", "feature").collect():
        groups.setdefault(x["group_id"], []).append(x["feature"])
    chosen, history = search_groups(df, folds, groups, target, realized, top_fraction=top_fraction) if groups else ([], [])
    fallback = [x["feature"] for x in passing.orderBy("sfi_rank").collect()]
    selected = final_features(chosen or fallback, limit)
    report = selection_report(board, linear, distance, audit, selected)
    spark = df.sparkSession
    trail = spark.createDataFrame([(h["state"], h["objective_score"], h["passes_gates"]) for h in history],
                                  "state string, objective_score double, passes_gates boolean")
    return {"report": report, "linear_audit": linear_audit, "distance_audit": distance_audit, "target_audit": audit, "groups": manifest,
            "summary": selection_summary(report), "search": trail}
