"""Split plans against plain windows and pandas, with ties, missing values and a hot group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import crosssection as X
from panelspark.operators import evaluation as EV
from panelspark.operators import signals as SG
from panelspark.session import GROUP_BYTES_CONF, fits_one_task, groups_fit
from tests.helpers import rows


@pytest.fixture(scope="module")
def skewed():
    """One date holds most rows, and a third of its values are equal; some are missing."""
    rng = np.random.default_rng(11)
    sizes = {"2020-01-01": 600, "2020-01-02": 40, "2020-01-03": 1, "2020-01-06": 7}
    parts = []
    for date, n in sizes.items():
        x = rng.normal(0, 1, n) * 10.0 ** rng.integers(-3, 4, n)
        x[: n // 3] = 0.0
        x[-(n // 10):] = np.nan if n >= 10 else x[-(n // 10):]
        parts.append(pd.DataFrame({"date": date, "ticker": [f"K{i:04d}" for i in range(n)], "x": x, "y": rng.normal(0, 1, n)}))
    frame = pd.concat(parts, ignore_index=True)
    frame["date"] = pd.to_datetime(frame["date"]).dt.date
    return frame


def load(spark, frame):
    data = frame.astype(object).where(frame.notna(), None).values.tolist()
    return spark.createDataFrame(data, "date date, ticker string, x double, y double")


@pytest.mark.parametrize("split", [False, True])
def test_ranks_match_pandas(spark, skewed, split):
    got = X.with_group_ranks(load(spark, skewed), ["date"], {"r": "x"}, split=split).toPandas().sort_values(["date", "ticker"])
    want = skewed.sort_values(["date", "ticker"]).groupby("date")["x"].rank(pct=True)
    assert np.allclose(got["r"].astype(float).to_numpy(), want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("split", [False, True])
def test_quantiles_match_pandas(spark, skewed, split):
    got = X.group_quantiles(load(spark, skewed), ["date"], "x", {"a": 0.1, "b": 0.5, "c": 0.77}, split).toPandas().sort_values("date")
    want = skewed.groupby("date")["x"].quantile([0.1, 0.5, 0.77]).unstack().to_numpy()
    assert np.allclose(got[["a", "b", "c"]].to_numpy(dtype=float), want)


@pytest.mark.parametrize("split", [False, True])
def test_top_bottom_takes_ties_in_ticker_order(spark, skewed, split):
    got = X.with_top_bottom(load(spark, skewed), ["date"], "x", 0.4, split=split).toPandas()
    for date, g in skewed.groupby("date"):
        k = max(1, int(np.ceil(len(g) * 0.4)))
        top = set(g.sort_values(["x", "ticker"], ascending=[False, True]).head(k)["ticker"])
        low = set(g.sort_values(["x", "ticker"]).head(k)["ticker"])
        mine = got[got["date"] == date]
        assert set(mine.loc[mine["is_top"], "ticker"]) == top
        assert set(mine.loc[mine["is_bottom"], "ticker"]) == low


@pytest.mark.parametrize("split", [False, True])
def test_missing_values_fill_up_the_top(spark, split):
    df = spark.createDataFrame([("2020-01-01", f"K{i}", 1.0 if i == 3 else None, 0.0) for i in range(5)], "date string, ticker string, x double, y double")
    got = X.with_top_bottom(df.withColumn("date", F.col("date").cast("date")), ["date"], "x", 0.6, split=split).where("is_top").toPandas()
    assert sorted(got["ticker"]) == ["K0", "K1", "K3"]


AWKWARD = [(None, "A", 1.0), (None, "B", 1.0), (None, None, -2.0), ("d", "A", 1.0), ("d", "A", 3.0), ("d", "A", 3.0), ("d", "B", 2.0), ("d", None, None), ("d", None, 0.5)]


@pytest.mark.parametrize("plan", ["window", "narrow window", "split"])
def test_ranks_with_null_and_repeated_keys(spark, monkeypatch, plan):
    if plan == "narrow window":
        monkeypatch.setattr(X, "WIDE", -1)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(AWKWARD)], "date string, ticker string, x double, i int")
    got = X.with_group_ranks(df, ["date"], {"r": "x"}, pct=False, split=plan == "split")
    assert got.columns == ["date", "ticker", "x", "i", "r"]
    assert {x["i"]: x["r"] for x in got.collect()} == {0: 2.5, 1: 2.5, 2: 1.0, 3: 2.0, 4: 4.5, 5: 4.5, 6: 3.0, 7: None, 8: 1.0}
    assert got.count() == len(AWKWARD)


@pytest.mark.parametrize("split", [False, True])
def test_top_bottom_with_null_groups_and_ties(spark, split):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(AWKWARD)], "date string, ticker string, x double, i int")
    got = X.with_top_bottom(df, ["date"], "x", 0.5, split=split).collect()
    assert len(got) == len(AWKWARD)
    assert sorted(x["i"] for x in got if x["is_top"]) == [0, 1, 4, 5, 6]
    assert sorted(x["i"] for x in got if x["is_bottom"]) == [0, 2, 3, 6, 8]


@pytest.mark.parametrize("up", [True, False])
def test_global_position_follows_a_sort(spark, up):
    values = [3.0, None, float("nan"), -1.0, 0.0, float("inf"), None, 1e300, float("-inf"), 1.0]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x double, i int")
    want = [x["i"] for x in df.orderBy(F.col("x").asc() if up else F.col("x").desc(), "i").collect()]
    assert [x["i"] for x in X.with_global_position(df, [("x", up), ("i", True)], "p").orderBy("p").collect()] == want


def test_cumulative_over_everything_uses_no_global_sort(spark, skewed):
    c = X.cumulative_by_value(load(spark, skewed), [], "x", {"n": F.count("*")}).toPandas().sort_values("x")
    assert (c["n_before"].to_numpy() == np.concatenate([[0], c["n"].cumsum().to_numpy()[:-1]])).all()
    assert (c["n_total"] == skewed["x"].notna().sum()).all()


def test_monotone_bin_never_decreases(spark):
    rng = np.random.default_rng(5)
    x = np.sort(np.concatenate([rng.normal(0, 1, 500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, -0.0, 1e-308, -1e-308]]))
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", X.monotone_bin(F.col("x")).alias("b")).orderBy("x")
    assert df.toPandas()["b"].is_monotonic_increasing


def test_position_over_the_whole_frame(spark, skewed):
    frame = skewed.assign(x=skewed["x"].fillna(-5.0))
    got = X.with_global_position(load(spark, frame), [("x", False), ("y", True)], "p").toPandas().sort_values("p")
    want = frame.sort_values(["x", "y"], ascending=[False, True])
    assert got["ticker"].tolist() == want["ticker"].tolist()


@pytest.mark.parametrize("split", [False, True])
def test_rank_ic_matches_pandas(spark, skewed, split):
    got = {x["date"]: x["rank_ic"] for x in SG.daily_rank_ic(load(spark, skewed), "x", "y", split=split).collect()}
    for date, g in skewed.groupby("date"):
        if len(g) < 2:
            assert date not in got
            continue
        assert got[date] == pytest.approx(g["x"].rank().corr(g["y"].rank()))


def test_classification_metrics_by_definition(spark):
    rng = np.random.default_rng(2)
    y, p = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "meta_label int, meta_probability double")
    got = EV.classification_metrics(df).first()
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    steps, recall, ap = sorted(set(p), reverse=True), 0.0, 0.0
    for t in steps:
        hit = p >= t
        ap += (y[hit].sum() / y.sum() - recall) * y[hit].mean()
        recall = y[hit].sum() / y.sum()
    assert got["roc_auc"] == pytest.approx(auc)
    assert got["average_precision"] == pytest.approx(ap)
    g = (p >= 0.5).astype(int)
    assert got["mcc"] == pytest.approx(np.corrcoef(y, g)[0, 1])
    one = spark.createDataFrame([(1, 0.3), (1, 0.9)], "meta_label int, meta_probability double")
    assert EV.ranking_metrics(one).first().asDict() == {"average_precision": 0.0, "roc_auc": 0.5}


def test_plan_follows_the_largest_group_not_all_input(spark, tmp_path, monkeypatch):
    """Many small dates stay with plain windows however large the table is; one hot date is split."""
    bars = [(f"2020-01-{1 + i % 20:02d}", f"T{i}", float(i % 7), float(i % 5)) for i in range(2000)]
    spark.createDataFrame(bars, "date string, ticker string, x double, y double").withColumn("date", F.col("date").cast("date")).write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    stored = []
    for module in (X, SG):
        monkeypatch.setattr(module, "cut_lineage", lambda df, name="stage", keep=X.cut_lineage: stored.append(name) or keep(df, name))
    want = {x["date"]: x["rank_ic"] for x in SG.daily_signal_diagnostics(df, "x", "y", "y", 0.1, split=False).collect()}
    try:
        spark.conf.set(GROUP_BYTES_CONF, "8000")  # below the file, above a date of 100 rows
        assert not fits_one_task(df) and groups_fit(df, ["date"], df.columns)
        got = {x["date"]: x["rank_ic"] for x in SG.daily_signal_diagnostics(df, "x", "y", "y", 0.1).collect()}
        assert not stored
        spark.conf.set(GROUP_BYTES_CONF, "2000")
        assert not groups_fit(df, ["date"], df.columns)
        hot = {x["date"]: x["rank_ic"] for x in SG.daily_signal_diagnostics(df, "x", "y", "y", 0.1).collect()}
        assert stored
    finally:
        spark.conf.unset(GROUP_BYTES_CONF)
    assert got.keys() == want.keys() == hot.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 and abs(hot[k] - want[k]) < 1e-9 for k in want)


def test_a_rank_takes_one_sort(spark, tmp_path):
    spark.range(50).selectExpr("id % 3 AS g", "CAST(nullif(id % 4, 0) AS DOUBLE) AS x").write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p").withColumn("r", X.average_rank(F.col("x"), ["g"]))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window") == 1, plan
    want = df.select("g", "x").toPandas()
    want["r"] = want.groupby("g")["x"].rank()
    assert rows(df) == rows(spark.createDataFrame(want.astype(object).where(want.notna(), None).values.tolist(), "g long, x double, r double"))
