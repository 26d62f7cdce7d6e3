"""Pair metrics over all rows against their definitions, and pruning against one feature after the other."""

import numpy as np
import pandas as pd
import pytest
from panelspark.functions import crosssection as X
from panelspark.operators import pairwise as PW
from panelspark.operators import selection as SL
from panelspark.session import cut_lineage
from pyspark.sql import functions as F


def columns(n, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.normal(0, 1, n)
    out = {"a": a, "b": a * a + rng.normal(0, 0.3, n), "c": np.round(a, 0), "d": np.exp(a), "narrow": 100 + 0.2 * rng.random(n), "e": rng.normal(0, 1, n),
           "flat": np.full(n, 3.0), "empty": np.full(n, np.nan), "hot": np.where(rng.random(n) < 0.4, 7.0, a)}
    out["b"][rng.random(n) < 0.1] = np.nan
    out["e"][rng.random(n) < 0.3] = np.nan
    out["d"][: n // 50] = np.inf
    return pd.DataFrame(out)


def frame(spark, data):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in data.to_numpy()]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data.columns))


def defined_distance(a, b):
    a, b = (np.where(np.isfinite(v), v, np.median(v[np.isfinite(v)]) if np.isfinite(v).any() else 0.0) for v in (a, b))
    p, q = (np.abs(v[:, None] - v[None, :]) for v in (a, b))
    p, q = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (p, q))
    spread = np.sqrt((p * p).mean() * (q * q).mean())
    return np.sqrt(max((p * q).mean() / spread, 0.0)) if spread > 1e-12 else 0.0


def defined_correlation(a, b, ranked):
    a, b = (pd.Series(np.where(np.isfinite(v), v, np.nan)) for v in (a, b))
    if ranked:
        a, b = a.rank(), b.rank()
    both = a.notna() & b.notna()
    a, b = a[both], b[both]
    return abs(np.corrcoef(a, b)[0, 1]) if len(a) > 1 and np.ptp(a) > 0 and np.ptp(b) > 0 else 0.0


@pytest.mark.parametrize("metric", ["spearman", "pearson", "distance"])
def test_metrics_by_definition(spark, monkeypatch, metric):
    monkeypatch.setattr(PW, "BLOCK", 400)  # many blocks
    data = columns(700)
    names = sorted(data.columns)
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(names) for b in names[i + 1:]], "left string, right string")
    got = {(r["left"], r["right"]): r["value"] for r in PW.PairMetrics(frame(spark, data), names).of(pairs, metric).collect()}
    assert len(got) == len(names) * (len(names) - 1) // 2
    for (a, b), value in got.items():
        x, y = data[a].to_numpy(), data[b].to_numpy()
        want = defined_distance(x, y) if metric == "distance" else defined_correlation(x, y, metric == "spearman")
        assert value == pytest.approx(want, abs=1e-9), (a, b)


def test_pairs_in_any_order_and_few_rows(spark):
    data = columns(60, 1)
    metrics = PW.PairMetrics(frame(spark, data), ["a", "b"])
    turned = spark.createDataFrame([("b", "a", "kept")], "left string, right string, note string")
    for metric in ("spearman", "pearson", "distance"):
        assert [(r["left"], r["right"], r["note"]) for r in metrics.of(turned, metric).collect()] == [("b", "a", "kept")]
    pair = turned.drop("note")
    for rows in (data[:0], data[:1]):
        few = PW.PairMetrics(frame(spark, rows), ["a", "b"])
        for metric in ("spearman", "pearson", "distance"):
            assert all(r["value"] == 0.0 for r in few.of(pair, metric).collect())


def test_discordant_sums():
    rng = np.random.default_rng(3)
    for m in (0, 1, 2, 7, 64, 131):
        u, v = rng.integers(0, 12, m).astype(float), rng.integers(0, 12, m).astype(float)
        w = rng.normal(0, 1, (4, m))
        want = sum(w[3, i] * w[0, j] - w[1, i] * w[2, j] - w[2, i] * w[1, j] + w[0, i] * w[3, j] for i in range(m) for j in range(m) if u[j] < u[i] and v[j] > v[i])
        assert PW.discordant(u, v, *w) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("m", [31, 32, 33, 64, 65, 500, 1000])
@pytest.mark.parametrize("values", [3, 40, 10_000])
def test_discordant_sums_across_leaves(m, values):
    rng = np.random.default_rng(m)
    u, v = rng.integers(0, values, m).astype(float), rng.integers(0, values, m).astype(float)
    w = rng.normal(0, 1, (4, m))
    met = (u[None, :] < u[:, None]) & (v[None, :] > v[:, None])
    want = (met * (w[3][:, None] * w[0] - w[1][:, None] * w[2] - w[2][:, None] * w[1] + w[0][:, None] * w[3])).sum()
    assert PW.discordant(u, v, *w) == pytest.approx(want, abs=1e-7)


def test_distance_stores_packs_and_not_a_row_for_each_point(spark, monkeypatch):
    stored = {}

    def kept(df, name="stage"):
        stored[name] = cut_lineage(df, name)
        return stored[name]
    monkeypatch.setattr(PW, "cut_lineage", kept)
    monkeypatch.setattr(PW, "HELD", 1 << 10)  # many chunks
    data = columns(3000, 6)[["a", "b", "hot"]]
    pairs = spark.createDataFrame([("a", "b"), ("a", "hot")], "left string, right string")
    got = {(r["left"], r["right"]): r["value"] for r in PW.PairMetrics(frame(spark, data), ["a", "b", "hot"]).of(pairs, "distance").collect()}
    for (a, b), value in got.items():
        assert value == pytest.approx(defined_distance(data[a].to_numpy(), data[b].to_numpy()), abs=1e-9)
    assert len(got) == 2 and len(stored) > 3
    assert all(df.count() < 1000 for name, df in stored.items() if name != "pair_rows")


def test_values_in_a_narrow_band_are_spread(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(float(x),) for x in 100 + 0.2 * rng.random(20_000)], "x double")
    ranked = X.cumulative_by_value(rows, [], "x", {"n": F.count("*")}, split=True).toPandas().sort_values("x")
    assert (ranked["n_before"].to_numpy() == np.arange(len(ranked))).all()
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        dealt = rows.distinct().repartitionByRange("x").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set(name, before)
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 2 * 20_000 / 8


def one_by_one(ranked, pairs, threshold):
    out = {}
    for scope in sorted({s for s, _, _ in ranked}):
        kept = []
        for _, name in sorted((rank, f) for s, f, rank in ranked if s == scope):
            near = [k for k in kept if pairs.get((scope, min(k, name), max(k, name)), 0) >= threshold]
            out[scope, name] = near[0] if near else None
            kept += [] if near else [name]
    return out


@pytest.mark.parametrize("density", [0.05, 0.3, 0.9])
def test_pruning_equals_one_feature_after_the_other(spark, density):
    rng = np.random.default_rng(int(100 * density))
    ranked = [(s, f"f{i}", int(rng.integers(0, 10))) for s in ("x", "y") for i in range(25)] + [("alone", "f0", 1)]
    pairs = {(s, *sorted((f"f{i}", f"f{j}"))): float(rng.random() < density) for s in ("x", "y") for i in range(25) for j in range(i)}
    got = SL.best_of_close(spark.createDataFrame(ranked, "scope string, feature string, sfi_rank int"),
                           spark.createDataFrame([(*k, v) for k, v in pairs.items()], "scope string, left string, right string, value double"), "family", 0.8).collect()
    want = one_by_one(ranked, pairs, 0.8)
    assert {(r["scope_key"], r["feature"]): r["reference_feature"] for r in got} == want
    assert all(r["decision"] == ("keep" if want[r["scope_key"], r["feature"]] is None else "drop") and r["stage_level"] == "family" for r in got)
    assert all(r["representative_feature"] == (r["reference_feature"] or r["feature"]) and (r["metric_value"] is None) == (r["decision"] == "keep") for r in got)


def test_chain_of_close_features(spark):
    """Every other link of a chain stays; rounds go on to its end."""
    n = 12
    ranked = spark.createDataFrame([("s", f"f{i:02}", i) for i in range(n)], "scope string, feature string, sfi_rank int")
    pairs = spark.createDataFrame([("s", f"f{i:02}", f"f{i + 1:02}", 0.9) for i in range(n - 1)], "scope string, left string, right string, value double")
    kept = {r["feature"] for r in SL.best_of_close(ranked, pairs, "global", 0.8).where("decision = 'keep'").collect()}
    assert kept == {f"f{i:02}" for i in range(0, n, 2)}


def test_ranks_of_copies_over_many_blocks(spark, monkeypatch):
    """Copies of a value that fill whole blocks, and both zeros, have one rank; no value is stored or dealt as a row of its own after the first time."""
    monkeypatch.setattr(PW, "BLOCK", 20)
    rng = np.random.default_rng(6)
    data = pd.DataFrame({"a": np.where(rng.random(400) < 0.6, 0.0, rng.normal(0, 1, 400)), "b": rng.integers(0, 3, 400).astype(float), "c": rng.normal(0, 1, 400)})
    data.loc[data.a == 0, "a"] = np.where(rng.random(int((data.a == 0).sum())) < 0.5, 0.0, -0.0)
    data.loc[::7, "c"] = np.nan
    stored = []
    monkeypatch.setattr(PW, "cut_lineage", lambda df, name="stage": stored.append(cut_lineage(df, name)) or stored[-1])
    metrics = PW.PairMetrics(frame(spark, data), ["a", "b", "c"])
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "left string, right string")
    for r in metrics.of(pairs, "spearman").collect():
        assert r["value"] == pytest.approx(defined_correlation(data[r["left"]].to_numpy(), data[r["right"]].to_numpy(), True), abs=1e-12)
    assert max(s.count() for s in stored[1:]) < 300


def test_copies_in_other_blocks_are_counted():
    rng = np.random.default_rng(2)
    v = np.sort(rng.integers(0, 4, 60))
    cut = np.unique(rng.integers(1, 60, 15))
    parts = np.split(v, cut)
    blocks = [(0, b, len(p), float(p[0]), int((p == p[0]).sum()), float(p[-1]), int((p == p[-1]).sum())) for b, p in enumerate(parts)]
    for (_, b, before, less, more, total), p, start in zip(PW._ties_beyond(blocks[::-1]), parts, [0, *cut]):
        assert (before, total) == (start, 60)
        assert less == (v[:start] == p[0]).sum() and more == (v[start + len(p):] == p[-1]).sum()
