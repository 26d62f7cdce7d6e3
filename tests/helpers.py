"""Small frames and comparisons shared by the tests."""

import math

import numpy as np
import pandas as pd

PANEL = "date date, ticker string, stock_open_price double, stock_high_price double, stock_low_price double, stock_close_price double, stock_trading_volume double"


def random_panel(tickers=4, days=120, seed=3, gaps=True):
    """Random walk bars; some tickers miss days."""
    rng = np.random.default_rng(seed)
    parts = []
    for t in range(tickers):
        dates = pd.bdate_range("2020-01-01", periods=days)
        if gaps and t % 2:
            dates = dates[rng.random(days) > 0.2]
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, len(dates))))
        open_ = close * np.exp(rng.normal(0, 0.01, len(dates)))
        parts.append(pd.DataFrame({
            "date": dates.date, "ticker": f"T{t}", "stock_open_price": open_, "stock_high_price": np.maximum(open_, close) * (1 + rng.random(len(dates)) * 0.01),
            "stock_low_price": np.minimum(open_, close) * (1 - rng.random(len(dates)) * 0.01), "stock_close_price": close,
            "stock_trading_volume": rng.integers(1, 20, len(dates)).astype(float) * 100}))
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, frame, schema=PANEL):
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), schema)


def series(df, column, key=("ticker", "date")):
    out = df.select(*key, column).toPandas().sort_values(list(key), ignore_index=True)
    return out[column].astype(float).to_numpy()


def close_to(a, b, tol=1e-9):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    assert a.shape == b.shape
    assert (np.isnan(a) == np.isnan(b)).all()
    known = ~np.isnan(a)
    assert np.allclose(a[known], b[known], rtol=tol, atol=tol), np.abs(a[known] - b[known]).max()


def rows(df):
    def norm(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else (round(v, 9) if isinstance(v, float) else v)
    return sorted((tuple(norm(v) for v in x) for x in df.collect()), key=str)
