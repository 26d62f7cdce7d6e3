"""Rolling primitives against pandas, recursive indicators against loops, panel invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import rolling as R
from panelspark.operators import indicators as TA
from panelspark.operators import market as M
from panelspark.operators import quant as Q
from tests.helpers import close_to, random_panel, series, to_spark


@pytest.fixture(scope="module")
def frame():
    return random_panel()


def per_ticker(frame, fn):
    ordered = frame.sort_values(["ticker", "date"], ignore_index=True)
    return np.concatenate([np.asarray(fn(g.reset_index(drop=True)), dtype=float) for _, g in ordered.groupby("ticker")])


@pytest.mark.parametrize("name,mine,theirs", [
    ("mean", lambda: R.mean("x", 10, 4), lambda s: s.rolling(10, min_periods=4).mean()),
    ("std", lambda: R.std("x", 10), lambda s: s.rolling(10).std()),
    ("median", lambda: R.median("x", 9, 3), lambda s: s.rolling(9, min_periods=3).median()),
    ("skew", lambda: R.skew("x", 12), lambda s: s.rolling(12).skew()),
    ("kurt", lambda: R.kurt("x", 12), lambda s: s.rolling(12).kurt()),
    ("fill", lambda: R.forward_fill("x", 2), lambda s: s.ffill(limit=2)),
    ("corr", lambda: R.corr("x", "y", 8), None)])
def test_rolling_matches_pandas(spark, frame, name, mine, theirs):
    rng = np.random.default_rng(1)
    sparse = frame.assign(x=np.where(rng.random(len(frame)) < 0.1, np.nan, frame["stock_close_price"].pct_change()), y=frame["stock_open_price"])
    df = spark.createDataFrame(sparse[["date", "ticker", "x", "y"]].astype(object).where(sparse[["date", "ticker", "x", "y"]].notna(), None).values.tolist(),
                               "date date, ticker string, x double, y double")
    want = per_ticker(sparse, lambda g: theirs(g["x"]) if theirs else g["x"].rolling(8).corr(g["y"]))
    close_to(series(df.withColumn("v", mine()), "v"), want, 1e-7)


def window_results(df):
    """Window results that the plan computes for ``df``."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("windowspecdefinition(")


@pytest.mark.parametrize("fn,sums", [(R.skew, 3), (R.kurt, 4)])
def test_moments_read_a_frame_once_per_sum(spark, frame, fn, sums):
    df = to_spark(spark, frame).withColumn("v", fn("stock_close_price", 12))
    assert window_results(df) == sums + 1


def test_median_is_one_window_result_and_equals_the_percentile(spark):
    rows = [(t, i, None if i % 7 == 3 else float((i * i * 13) % 11) / 3 - 1) for t in ("A", None) for i in range(60)] + [("B", i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "ticker string, day int, x double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("day")))
    for n, least, end in ((9, None, 0), (9, 3, 0), (8, 0, 0), (10, 4, -1)):
        got = df.withColumn("v", R.median("x", n, least, end))
        assert window_results(got) == 1
        want = R.rolling(lambda c: F.percentile(c, F.lit(0.5)), "x", n, least, end)
        assert got.withColumn("w", want).where(~F.col("v").eqNullSafe(F.col("w"))).count() == 0


def test_frame_sums_read_the_shortest_frame_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(t, i, None if rng.random() < 0.05 else float(rng.normal(1e3, 1))) for t, n in (("A", 300), ("B", 40), (None, 270)) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "ticker string, row long, x double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("row").cast("int")))
    sizes = (5, 10, 21, 63, 126, 252)
    got = R.with_frame_sums(df, ["x"], sizes, "row", "s_", same=("x",))
    assert got.columns == [*df.columns, "s_x_known", "s_x_same", *[f"s_x_{n}" for n in sizes]]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RowFrame, -4, currentrow" in plan
    assert not [n for n in sizes[1:] if f"RowFrame, -{n - 1}, currentrow" in plan]
    want = df.withColumns({f"w{n}": F.coalesce(F.sum("x").over(R.last_rows(n)), F.lit(0.0)) for n in sizes})
    both = got.join(want.drop("x", "date").withColumnRenamed("ticker", "t"), (F.col("ticker").eqNullSafe(F.col("t"))) & (got.row == want.row))
    assert both.count() == len(rows)
    for n in sizes:
        assert both.where(F.abs(F.col(f"s_x_{n}") - F.col(f"w{n}")) > 1e-9 * F.abs(F.col(f"w{n}"))).count() == 0


def test_drawdown_and_aroon_match_pandas_and_read_short_frames(spark):
    frame = random_panel(2, 330, seed=9).round(1)
    rng = np.random.default_rng(2)
    frame.loc[rng.choice(40, 3, replace=False), "stock_close_price"] = np.nan
    df = Q.drawdown(to_spark(spark, frame))
    assert "RowFrame, -251, currentrow" not in df._jdf.queryExecution().optimizedPlan().toString()
    for n in Q.DRAWDOWN_WINDOWS:
        close_to(series(df, f"quant_drawdown_{n}d"), per_ticker(frame, lambda g: g["stock_close_price"] / g["stock_close_price"].rolling(n).max() - 1))
        close_to(series(df, f"quant_rebound_from_low_{n}d"), per_ticker(frame, lambda g: g["stock_close_price"] / g["stock_close_price"].rolling(n).min() - 1))
    df = TA.trend_indicators(to_spark(spark, frame))
    assert "_by(" not in df._jdf.queryExecution().optimizedPlan().toString()
    # Of equal extremes the latest counts.
    close_to(series(df, "ta_trend_aroon_up"), per_ticker(frame, lambda g: g["stock_high_price"].rolling(26).apply(lambda v: 4.0 * (25 - np.argmax(v[::-1])), raw=True)))
    close_to(series(df, "ta_trend_aroon_down"), per_ticker(frame, lambda g: g["stock_low_price"].rolling(26).apply(lambda v: 4.0 * (25 - np.argmin(v[::-1])), raw=True)))


def test_return_moments_with_constant_prices(spark):
    flat = random_panel(1, 40, gaps=False).assign(stock_close_price=5.0)
    df = Q.return_moments(Q.returns(to_spark(spark, flat)))
    assert set(series(df, "quant_realized_vol_5d")[10:]) == {0.0}
    assert set(series(df, "quant_return_skew_5d")[10:]) == {0.0}
    assert set(series(df, "quant_return_kurt_5d")[10:]) == {-3.0}
    assert np.isnan(series(df, "quant_return_autocorr_lag1_5d")).all()


def test_moments_match_pandas(spark, frame):
    df = Q.return_moments(Q.returns(to_spark(spark, frame)))
    ret = lambda g: g["stock_close_price"].pct_change()
    close_to(series(df, "quant_realized_vol_21d"), per_ticker(frame, lambda g: ret(g).rolling(21).std() * np.sqrt(252)), 1e-8)
    close_to(series(df, "quant_return_kurt_21d"), per_ticker(frame, lambda g: ret(g).rolling(21).kurt()), 1e-6)
    close_to(series(df, "quant_return_autocorr_lag1_10d"), per_ticker(frame, lambda g: ret(g).rolling(10).corr(ret(g).shift())), 1e-6)


def test_trend_matches_polyfit(spark, frame):
    def slope(v):
        return np.expm1(np.polyfit(np.arange(len(v)), v, 1)[0] * 252)
    df = Q.trend(Q.returns(to_spark(spark, frame)))
    want = per_ticker(frame, lambda g: np.log(g["stock_close_price"]).rolling(21).apply(slope, raw=True))
    close_to(series(df, "quant_trend_slope_21d"), want, 1e-6)


def test_sign_flip_counts_missing_sides(spark):
    flat = random_panel(1, 30, gaps=False).assign(stock_close_price=lambda f: np.arange(1.0, len(f) + 1))
    df = Q.deep_path(Q.price_context(to_spark(spark, flat)))
    rate = series(df, "deep_path_sign_flip_rate_21d")
    assert rate[20] == pytest.approx(2 / 21)  # the first two rows, whose signs are missing
    assert rate[22] == 0.0


def test_no_look_ahead_and_no_mixing(spark, frame):
    names = ["quant_realized_vol_21d", "quant_momentum_10d"]
    build = lambda f: Q.momentum(Q.return_moments(Q.returns(to_spark(spark, f)))).select("date", "ticker", *names)
    base = build(frame).toPandas().set_index(["ticker", "date"]).sort_index()
    last = frame.groupby("ticker")["date"].transform("max")
    shocked = frame.assign(stock_close_price=np.where(frame["date"] == last, 9999.0, frame["stock_close_price"]))
    after = build(shocked.sample(frac=1, random_state=1)).toPandas().set_index(["ticker", "date"]).sort_index()
    older = ~base.index.isin(pd.MultiIndex.from_frame(frame.loc[frame["date"] == last, ["ticker", "date"]]))
    pd.testing.assert_frame_equal(base[older], after[older])
    fewer = build(frame[frame["ticker"] != "T1"]).toPandas().set_index(["ticker", "date"]).sort_index()
    pd.testing.assert_frame_equal(base.loc[fewer.index], fewer)


def wilder_loop(x, n):
    out, value, seen = [], None, 0
    for v in x:
        if not np.isnan(v):
            value = v if value is None else value + (v - value) / n
            seen += 1
        out.append(value if value is not None and seen >= n else np.nan)
    return np.array(out)


def test_recursive_indicators_against_loops(spark, frame):
    got = TA.recursive_indicators(to_spark(spark, frame))

    def rsi(g):
        step = np.diff(g["stock_close_price"], prepend=np.nan)
        up, down = wilder_loop(np.where(np.isnan(step), np.nan, np.maximum(step, 0)), 14), wilder_loop(np.where(np.isnan(step), np.nan, np.maximum(-step, 0)), 14)
        return 100 - 100 / (1 + up / down)

    def kama(g):
        c, out, value = g["stock_close_price"].to_numpy(), np.full(len(g), np.nan), None
        for i in range(9, len(c)):
            if i == 9:
                value = c[9]
            else:
                path = np.abs(np.diff(c[i - 10:i + 1])).sum()
                er = abs(c[i] - c[i - 10]) / path if path else 0.0
                value += (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (c[i] - value)
            out[i] = value
        return out

    def atr(g):
        h, l, p = g["stock_high_price"].to_numpy(), g["stock_low_price"].to_numpy(), np.concatenate([[np.nan], g["stock_close_price"].to_numpy()[:-1]])
        tr = np.nanmax(np.vstack([h - l, np.abs(h - p), np.abs(l - p)]), axis=0)
        return wilder_loop(tr, 10)
    close_to(series(got, "ta_momentum_rsi"), per_ticker(frame, rsi), 1e-7)
    close_to(series(got, "ta_momentum_kama"), per_ticker(frame, kama), 1e-8)
    close_to(series(got, "ta_volatility_atr"), per_ticker(frame, atr), 1e-8)


def test_parabolic_stop_stays_on_its_side(frame):
    g = frame[frame["ticker"] == "T0"]
    h, l, c = (g[x].to_numpy() for x in ("stock_high_price", "stock_low_price", "stock_close_price"))
    up, down = TA.parabolic_sar(h, l, c)
    assert not (~np.isnan(up) & ~np.isnan(down)).any()
    assert (~np.isnan(up[2:]) | ~np.isnan(down[2:])).all()
    both = ~np.isnan(up[3:]) & ~np.isnan(up[2:-1])  # rising twice in a row: the stop is below the low
    assert (up[3:][both] <= l[3:][both]).all()


def test_universe_measures_leave_the_row_out(spark, frame):
    df = M.universe_relative(Q.returns(to_spark(spark, frame)))
    got = df.toPandas().sort_values(["ticker", "date"], ignore_index=True)
    r = got.pivot(index="date", columns="ticker", values=Q.RETURN)
    for _, x in got.sample(40, random_state=0).iterrows():
        others = r.loc[x["date"]].drop(x["ticker"]).dropna()
        if pd.notna(x[Q.RETURN]) and len(others):
            assert x[M.EX_SELF] == pytest.approx(others.mean())


def test_lag_policy_and_floats(spark, frame):
    df = M.add_feature_lags(to_spark(spark, frame).select("date", "ticker", F.col("stock_close_price").alias("quant_x"), F.col("stock_open_price").alias("ta_volume_x")))
    assert [c for c in df.columns if "_lag_" in c] == ["quant_x_lag_1d", "quant_x_lag_5d", "quant_x_lag_21d"]
    assert dict(df.dtypes)["quant_x_lag_1d"] == "float"
