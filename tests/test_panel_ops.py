"""Joins, calendars, ingestion, labels, splits, ledger: hand-computed cases and error contracts."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark import contract as K
from panelspark.operators import calendars as C
from panelspark.operators import clean as CL
from panelspark.operators import ingest as I
from panelspark.operators import joins as J
from panelspark.operators import labels as L
from panelspark.operators import ledger as LG
from panelspark.operators import market as M
from panelspark.operators import signals as SG
from panelspark.operators import splits as SP
from panelspark.session import missing_to_null
from panelspark.sources import scans as SC
from panelspark.sources import sinks as W
from tests.helpers import random_panel, rows, to_spark

D = lambda s: dt.date.fromisoformat(s)


def days(spark, *dates):
    return spark.createDataFrame([(D(x),) for x in dates], "date date")


def test_publication_lag(spark):
    sessions = days(spark, "2020-01-02", "2020-01-03", "2020-01-06", "2020-01-07")
    obs = spark.createDataFrame([("s", D("2020-01-02"), 1.0), ("s", D("2020-01-03"), 2.0)], "series string, obs_date date, value double")
    panel = SC.macro_panel(obs, sessions, {"s": "daily"}).orderBy("date")
    assert [x["s"] for x in panel.collect()] == [None, 1.0, 2.0, 2.0]


def test_snapshot_intervals_merge(spark):
    snaps = spark.createDataFrame([(D("2020-01-01"), "AAPL, BF-B"), (D("2020-01-03"), "BF-B"), (D("2020-01-06"), "BF-B,MSFT")], "date date, tickers string")
    parts = J.snapshots_to_intervals(snaps, F.lit("2020-01-10").cast("date")).withColumn("ticker", SC.normalize_symbol(F.col("ticker")))
    assert rows(J.merge_intervals(parts).select("ticker", "start_date", "end_date")) == sorted([
        ("AAPL", D("2020-01-01"), D("2020-01-02")), ("BF.B", D("2020-01-01"), D("2020-01-10")), ("MSFT", D("2020-01-06"), D("2020-01-10"))], key=str)


def test_asof_carries_the_whole_row(spark):
    left = spark.createDataFrame([("A", D("2020-01-05")), ("A", D("2020-01-01")), ("B", D("2020-01-05"))], "ticker string, date date")
    right = spark.createDataFrame([("A", D("2020-01-02"), 1.0, 5.0), ("A", D("2020-01-04"), 2.0, None)], "ticker string, date date, x double, y double")
    got = {(x["ticker"], x["date"]): (x["x"], x["y"]) for x in J.asof_backward(left, right).collect()}
    assert got == {("A", D("2020-01-05")): (2.0, None), ("A", D("2020-01-01")): (None, None), ("B", D("2020-01-05")): (None, None)}


def test_exchange_calendar(spark):
    got = {x["date"] for x in C.exchange_sessions_between(spark, "2021-12-20", "2022-07-10").collect()}
    closed = {"2021-12-24", "2022-01-17", "2022-02-21", "2022-04-15", "2022-05-30", "2022-06-20", "2022-07-04"}
    weekdays = {d.date() for d in pd.bdate_range("2021-12-20", "2022-07-10")}
    # New Year 2022 falls on a Saturday, so the Friday before is closed.
    assert weekdays - got == {D(x) for x in closed} | {D("2021-12-31")}


def test_business_days_back(spark):
    dates = [d.date() for d in pd.date_range("2024-01-01", periods=21)]
    df = spark.createDataFrame([(d,) for d in dates], "d date").select("d", C.business_days_before(F.col("d"), 6).alias("b"))
    assert all(x["b"] == (pd.Timestamp(x["d"]) - pd.offsets.BusinessDay(6)).date() for x in df.collect())


def test_label_geometry(spark):
    dates = pd.bdate_range("2020-01-01", periods=8)
    frame = pd.DataFrame({"date": dates.date, "ticker": "A", "stock_open_price": 100.0 + 2 * np.arange(8), "stock_high_price": 200.0, "stock_low_price": 1.0,
                          "stock_close_price": 101.0 + 2 * np.arange(8), "stock_trading_volume": 1.0})
    first = L.forward_returns(to_spark(spark, frame)).orderBy("date").first()
    assert first[K.WEEK_GROSS] == pytest.approx(np.log(113 / 102))
    assert first[K.INTRADAY_NET] == pytest.approx(np.log(103 / 102))
    assert first[K.OVERNIGHT_NET] == pytest.approx(np.log(104 / 103))
    assert first[K.MEDIUM_GROSS] == pytest.approx(np.log(112 / 102))


def test_label_metrics_split_plan_equals_windows(spark):
    df = L.forward_returns(to_spark(spark, random_panel(6, 60)).withColumn("company_sector", F.when(F.col("ticker") > "T3", "x")).withColumn("company_industry", F.lit("i")))
    assert rows(L.label_metrics(df, split=True)) == rows(L.label_metrics(df, split=False))


def test_splits_leave_purge_gaps(spark):
    dates = pd.bdate_range("2024-06-03", "2025-01-31")
    frame = spark.createDataFrame([(d.date(), "A") for d in dates], "date date, ticker string")
    got = {x["dataset_split"]: x for x in SP.assign_splits(frame, "2025-01-01").groupBy("dataset_split").agg(
        F.min("date").alias("a"), F.max("date").alias("b"), F.count("*").alias("n")).collect()}
    cutoff = (pd.Timestamp("2025-01-01") - pd.offsets.BusinessDay(6)).date()
    eligible = [d.date() for d in dates if d.date() < cutoff]
    n_val = round(0.30 * len(eligible))
    assert got["val"]["n"] == n_val and got["val"]["b"] == eligible[-1]
    assert got["train"]["n"] == len(eligible) - n_val - 6
    assert got["test"]["a"] == D("2025-01-01")
    short = SP.assign_splits(frame.where("date <= '2024-06-12'"), "2025-01-01").groupBy("dataset_split").count()
    assert {x["dataset_split"]: x["count"] for x in short.collect()} == {"train": 6, "val": 2}


def test_embargo_before_prediction(spark):
    frame = spark.createDataFrame([(d.date(), "A") for d in pd.bdate_range("2022-01-03", "2022-01-20")], "date date, ticker string")
    assert SP.available_training_frame(frame, "2022-01-17", 5).agg(F.max("date")).first()[0] == D("2022-01-10")
    with pytest.raises(ValueError):
        SP.available_training_frame(frame, "2022-01-04", 5)
    with pytest.raises(ValueError):
        SP.available_training_frame(frame, "2022-01-16", 5)


def test_fold_without_history_is_an_error(spark):
    dates = spark.createDataFrame([(d.date(),) for d in pd.bdate_range("2022-01-03", periods=20)], "date date")
    with pytest.raises(ValueError):
        SP.require_two_sided(SP.train_only_walk_forward_folds(dates, 4))


def test_tiered_cost_case(spark):
    order = spark.createDataFrame([(50_000.0, 80_000.0, "stock_cash", "EUR")], "order_value double, month_to_date_turnover double, instrument_group string, currency string")
    x = LG.trade_cost(order).first()
    assert (x["billable_turnover"], x["commission"], x["fx_cost"]) == (30_000.0, 60.0, 0.0)


def test_running_turnover_over_many_bins(spark):
    data = [("a", D("2020-01-02"), i * 40_000, float(i)) for i in range(50)] + [("a", D("2020-01-01"), 7, 100.0), ("a", D("2020-02-01"), 1, 3.0)]
    got = LG.month_to_date_turnover(spark.createDataFrame(data, "account string, date date, sequence long, order_value double")).collect()
    for x in got:
        want = sum(v for _, d, s, v in data if d.month == x["date"].month and (d, s) < (x["date"], x["sequence"]))
        assert x["month_to_date_turnover"] == pytest.approx(want)


def test_drifted_benchmark(spark):
    data = [(D(d), t, p) for t, ps in {"AAA": (100, 200, 100), "BBB": (100, 50, 50)}.items() for d, p in zip(("2020-01-01", "2020-01-02", "2020-01-03"), map(float, ps), strict=True)]
    b = LG.buy_and_hold_benchmark(spark.createDataFrame(data, "date date, ticker string, hl_context_stock_close_price double")).orderBy("date")
    assert [x["benchmark_return"] for x in b.collect()] == pytest.approx([0.0, 0.25, -0.4])


def test_order_sequence_bills_exits_first(spark):
    trades = spark.createDataFrame([("A", D("2020-01-02"), D("2020-01-09"), 1), ("B", D("2020-01-09"), None, 1)], "ticker string, entry_date date, exit_date date, signal_rank int")
    got = [(x["side"], x["ticker"]) for x in LG.order_sequence(trades).orderBy("date", "sequence").collect()]
    assert got == [("entry", "A"), ("exit", "A"), ("entry", "B")]


def test_outlier_cases(spark):
    base = [(D("2020-01-02"), f"T{i}", 0.01, 100) for i in range(9)]
    df = spark.createDataFrame([*base, (D("2020-01-02"), "T9", 0.50, 100), (D("2020-01-03"), "T0", 0.01, -5)], "date date, ticker string, stock_open_log_return double, stock_trading_volume long")
    got = {(x["ticker"], x["date"].day): x for x in CL.apply_outlier_flags(df).collect()}
    assert got["T9", 2]["cross_section_return_extreme_flag"] and got["T9", 2]["outlier_severity"] == "extreme"
    assert got["T0", 3]["outlier_reason"] == "NEGATIVE_VOLUME" and got["T0", 3]["outlier_severity"] == "data_error"
    assert sum(x["is_outlier_flag"] for x in got.values()) == 2
    plain = CL.apply_outlier_flags(df.drop("stock_open_log_return"))
    assert plain.where("is_outlier_flag").count() == 1


def test_error_contracts(spark, tmp_path):
    df = spark.createDataFrame([(D("2020-01-02"), "A", 1.0), (D("2020-01-02"), "A", None)], "date date, ticker string, x double")
    with pytest.raises(ValueError):
        CL.require_unique_keys(df)
    with pytest.raises(ValueError, match="x=1"):
        CL.require_complete(df)
    with pytest.raises(ValueError):
        CL.require_columns(df, ("date", "missing"))
    with pytest.raises(ValueError):
        CL.require_train_only(df.withColumn("dataset_split", F.lit("val")))
    with pytest.raises(ValueError):
        SG.refine(df.withColumn("prediction", F.lit(1.0)), strategy="nothing")
    with pytest.raises(Exception, match="Path|PATH"):
        SC.load_panel(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="incomplete"):
        W.write_checked(df, str(tmp_path / "out"), 3, 1)
    with pytest.raises(ValueError, match="nothing is published"):
        W.read_published(spark, str(tmp_path / "out"))
    bad = spark.createDataFrame([("A", "2020-01-01", "noon", 2020, 1)], "ticker string, announcement_date string, announcement_session string, fiscal_year int, fiscal_quarter int")
    with pytest.raises(Exception, match="noon"):
        SC.earnings_events(bad).collect()
    spec = spark.createDataFrame([("B", 5.0, D("2020-01-01"), None)], "symbol string, spread_bps double, effective_from date, effective_to date")
    with pytest.raises(Exception, match="no instrument spec"):
        J.validity_lookup(df.limit(1), spec, ["spread_bps"]).collect()


def test_validity_lookup_against_all_versions(spark):
    """Nested, adjoining, equal and open versions, gaps, missing starts, symbols in other case: the same as trying every version."""
    rng = random.Random(5)
    day = lambda n: D("2020-01-01") + dt.timedelta(days=n)
    versions = []
    for symbol in ("A", "b", "C", None):
        for _ in range(60):
            start = rng.randrange(80)
            end = rng.choice([None, start + rng.randrange(-1, 30), start + rng.randrange(8)]) if symbol != "C" else start + rng.randrange(3)
            versions.append((symbol, rng.choice([None, 1.0, 2.0, 3.0]), day(start) if rng.random() < 0.95 else None, None if end is None else day(end)))
    versions = [v for v in versions if v[3] is not None or v[0] != "b"] + [("b", 9.0, day(40), None)]
    spec = spark.createDataFrame(versions, "symbol string, spread_bps double, effective_from date, effective_to date")
    points = [(day(n), t) for n in range(-3, 120) for t in ("A", "a", "B", "C", "none")]
    df = spark.createDataFrame([*points, (day(5), None)], "date date, ticker string")

    def best(date, ticker):
        valid = [(s, str(e or ""), x is not None, x or 0.0, x) for name, x, s, e in versions
                 if name and ticker and name.upper() == ticker.upper() and s and s <= date and (e is None or date <= e)]
        return max(valid)[-1] if valid else -1.0

    got = {(r["date"], r["ticker"]): r["spread_bps"] for r in J.validity_lookup(df, spec, ["spread_bps"], {"spread_bps": -1.0}).collect()}
    assert len(got) == len(points) + 1 and got == {(d, t): best(d, t) for d, t in [*points, (day(5), None)]}
    empty = J.validity_lookup(df, spec.limit(0), ["spread_bps"], {"spread_bps": -1.0})
    assert {r["spread_bps"] for r in empty.collect()} == {-1.0}


def test_lag_block_names_and_values(spark):
    """Names that need quoting, a lag column that exists already, float results."""
    df = spark.createDataFrame([(D(f"2020-01-0{i}"), "A", float(i), 2.0 * i, 7.0) for i in range(1, 8)],
                               ["date", "ticker", "deep_a.b`c", "ta_x", "ta_x_lag_1d"])
    rows = M.add_feature_lags(df, chunk=2).orderBy("date").collect()
    assert [r["deep_a.b`c_lag_5d"] for r in rows] == [None] * 5 + [1.0, 2.0]
    assert [r["ta_x_lag_1d"] for r in rows] == [None, 2.0, 4.0, 6.0, 8.0, 10.0, 12.0]
    assert dict(M.add_feature_lags(df).dtypes)["ta_x_lag_21d"] == "float"


def test_missing_values_become_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (3.0, 3)], "x double, i int")
    assert [x["x"] for x in missing_to_null(df).orderBy("i").collect()] == [None, None, 3.0]


def test_spec_json_defaults(spark, tmp_path):
    path = tmp_path / "specs.json"
    path.write_text('[{"symbol": "A", "instrument_group": "stock_cash", "currency": "EUR", "spread_bps": 2.0, "effective_from": "2020-01-01", "commission_rate": 0.5}]')
    x = SC.load_instrument_specs(spark, str(path)).first()
    assert (x["commission_rate"], x["minimum_commission_eur"], x["effective_to"]) == (0.5, 10.0, None)


def test_symbols_from_text(spark):
    df = spark.createDataFrame([(2, "MSFT.US* and BFB.US"), (1, "AAPL.US, DEAD.US*CLOSE ONLY / AAPL.US"), (3, "DEAD.US")], "id int, text string")
    assert rows(SC.extract_symbols(df, "id")) == sorted([("AAPL", 1, 0), ("MSFT", 2, 0), ("BF.B", 2, 1)], key=str)


def test_fundamental_availability(spark):
    raw = spark.createDataFrame([("A-B", "2020-03-31", None, "10", "2"), ("A-B", "2020-06-30", "2020-07-20", "12", "2")], "tic string, datadate string, rdq string, prccq string, cshoq string")
    for c in ("epspxq", "ceqq", "actq", "lctq", "niq", "saleq"):
        raw = raw.withColumn(c, F.lit("4"))
    fq = SC.quarterly_extract(raw)
    members = spark.createDataFrame([("A.B",)], "ticker string")
    names = spark.createDataFrame([("Z", "Zed", "s", "i")], "ticker string, company_name string, sector string, industry string")
    got = I.quarterly_ratios(fq, members, names, "2020-01-01", "2020-12-31").orderBy("date").collect()
    assert [x["date"] for x in got] == [D("2020-05-15"), D("2020-07-20")]
    assert got[0]["company_name"] == "A.B" and got[0]["market_cap"] == 20e6 and got[0]["trailing_p_e"] == 2.5 and got[0]["enterprise_value"] is None


def test_spaced_positions_match_linspace(spark):
    for n, m in ((10, 4), (7, 7), (101, 13), (5, 1), (2499, 317)):
        got = spark.range(1).select(SP.spaced_positions(F.lit(n).cast("bigint"), F.lit(m).cast("bigint")).alias("p")).first()["p"]
        assert got == np.unique(np.linspace(0, n - 1, num=m, dtype=np.int64)).tolist()


def test_uninformative_columns(spark):
    data = [(i, 5, "same" if i else "other", 0 if i else 1, None if i else 2.0, None, i % 3, "only") for i in range(300)]
    df = spark.createDataFrame(data, "row int, fixed int, dominated string, indicator int, holes double, empty double, spread int, text string")
    assert set(CL.uninformative_columns(df, df.columns)) == {"fixed", "dominated", "holes", "empty", "text"}


def test_open_intervals_are_clipped_to_the_sessions(spark):
    days = ["2020-01-02", "2020-01-03", "2020-01-06"]
    sessions = spark.createDataFrame([(d,) for d in days], "date string").select(F.col("date").cast("date"))
    spells = spark.createDataFrame([("A", "0001-01-01", "9999-12-31"), ("B", "2020-01-03", "9999-12-31"), ("C", "2021-01-01", "2022-01-01"), ("D", None, "2020-01-06")],
                                   "ticker string, f string, t string").select("ticker", F.col("f").cast("date").alias("start_date"), F.col("t").cast("date").alias("end_date"))
    got = sorted((x["ticker"], str(x["date"])) for x in J.expand_intervals(spells, sessions).collect())
    assert got == [("A", d) for d in days] + [("B", d) for d in days[1:]]
    assert J.expand_intervals(spells, sessions.limit(0)).count() == 0


def test_overlapping_intervals_are_unrolled_once_without_a_shuffle_of_days(spark):
    rows = [("A", 0, 3), ("A", 0, 3), ("A", 2, 5), ("A", 6, 7), ("A", 1, 1), ("A", 12, 14), ("A", 9, 8), (None, 1, 2), (None, 2, 4), ("B", 5, None)]
    day = lambda c: F.date_add(F.lit("2020-01-01").cast("date"), F.col(c))
    spells = spark.createDataFrame(rows, "ticker string, f int, t int").select("ticker", day("f").alias("start_date"), day("t").alias("end_date"))
    sessions = spark.range(0, 14, 2).select(F.col("id").cast("int").alias("id")).select(day("id").alias("date"))
    df = J.expand_intervals(spells, sessions)
    got = sorted((x["ticker"] or "", x["date"].toordinal() - dt.date(2020, 1, 1).toordinal()) for x in df.collect())
    assert got == [("", 2), ("", 4), ("A", 0), ("A", 2), ("A", 4), ("A", 6), ("A", 12)]
    above = df._jdf.queryExecution().executedPlan().toString().split("Generate explode(sequence")[0]
    assert "Exchange hashpartitioning" not in above


def test_a_failed_check_leaves_the_published_version(spark, tmp_path):
    path = str(tmp_path / "out")
    first = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "ticker string, x double")
    W.write_checked(first, path, 2, 2)
    for rows, tickers in ((3, 2), (2, 1)):
        with pytest.raises(ValueError, match="incomplete"):
            W.write_checked(first.withColumn("x", F.lit(9.0)), path, rows, tickers)
    assert sorted(r["x"] for r in W.read_published(spark, path).collect()) == [1.0, 2.0] and W.published(spark, path)[0] == 1
    W.write_checked(first.limit(1), path, 1, 1)
    assert W.read_published(spark, path).count() == 1 and W.published(spark, path)[0] == 2


def test_a_split_is_a_view_of_the_one_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "train"), (3, "val")], "x int, dataset_split string")
    W.write_splits(df, str(tmp_path))
    assert [W.read_split(spark, str(tmp_path), s).count() for s in ("train", "val", "test")] == [2, 1, 0]
    assert set(W.read_split(spark, str(tmp_path), "test").columns) == {"x", "dataset_split"}
