import math

import numpy as np
import pytest
from panelspark.llm import negatives
from tests.llm.data import multiset


def brute(rows, is_anchor, positives=5, hard=3):
    kept = [(k, lab, [math.floor(256 * float(np.float32(c))) for c in v]) for k, v, lab in rows
            if k is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, label, x in kept:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), k, lab) for k, lab, y in kept if k != a)
        for s, positive, _ in [r for r in scored if r[2] == label][:positives]:
            found = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:hard]
            out += [(a, positive, i, k, -s, -n) for i, (n, k, _) in enumerate(found, 1)]
    return out


def check(spark, rows, is_anchor=lambda k: k % 50 == 0):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, score string, _key int")
    anchors = spark.createDataFrame([(*r, "x", 1) for r in rows if r[0] is not None and is_anchor(r[0])], frame.schema)
    got = negatives.hard_negatives(frame, anchors)
    assert multiset(map(tuple, got.collect())) == multiset(brute(rows, is_anchor))


@pytest.mark.parametrize("kind", ["spread", "clustered", "same", "large", "one label"])
def test_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "ROWS", 300)
    monkeypatch.setattr(negatives, "TREE", 20)
    rng = np.random.default_rng(len(kind))
    n = 1500
    x = rng.normal(0, 0.3, (n, 12))
    label = rng.integers(0, 4, n)
    if kind == "clustered":
        x = x * 0.1 + rng.normal(0, 1, (12, 12))[rng.integers(0, 12, n)]
        label[: n // 2] = 1
    if kind == "same":
        x[: n // 2] = x[0]
    if kind == "large":
        x *= 1e6
    if kind == "one label":
        label[:] = 3
    check(spark, [(i, [float(c) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, label))])


def test_awkward_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (50, [1.0, float("nan")], 1), (100, None, 1), (150, [1.0, None], 2), (200, [float("inf"), 1.0], 2), (250, [2.0, 1.0], None), (None, [2.0, 2.0], 1),
            (1, [2.0, 2.0], 1), (2, [2.0, 2.0], 1), (3, [1.5, 2.0], 2), (4, [1.0, 1.9], 2), (5, [1.0, 1.9], 3), (300, [0.0, 0.0], 2), (350, [-1.0, -2.0], 1), (6, [-0.9, -1.7], 2),
            (7, [0.6, 1.0], 2), (7, [0.6, 1.0], 2), (400, [1.0, 2.0], 1), (400, [1.0, 2.0], 1)]
    check(spark, rows)
    short = [(k, v if v is None or k != 4 else [1.0], lab) for k, v, lab in rows]
    filled = [(k, v if k != 4 else [1.0, 0.0], lab) for k, v, lab in rows]
    frame = spark.createDataFrame(short, "vec_id long, embedding array<float>, label int")
    got = negatives.hard_negatives(frame, frame.where("vec_id % 50 = 0")).collect()
    assert multiset(map(tuple, got)) == multiset(brute(filled, lambda k: k % 50 == 0))


def test_few_rows_and_none(spark):
    check(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.7], 2)])
    check(spark, [(0, [1.0], 1)])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(empty, empty).count() == 0
    no_parts = spark.createDataFrame([(0, [], 1), (1, [], 1), (2, [], 2)], empty.schema)
    assert [tuple(r) for r in negatives.hard_negatives(no_parts, no_parts.where("vec_id = 0")).collect()] == [(0, 1, 1, 2, 0, 0)]


def test_a_spanning_tree_is_a_least_one():
    rng = np.random.default_rng(0)
    x = rng.integers(-50, 50, (40, 3))
    order, parent, edge = negatives.spanning_tree(x)
    assert sorted(order) == list(range(40)) and all(order.index(parent[i]) < order.index(i) for i in order[1:])
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.allclose(edge[1:], away[np.arange(1, 40), parent[1:]])
    joined, total = list(range(40)), 0.0  # the least tree by joining the shortest edges first
    for d, i, j in sorted((away[i, j], i, j) for i in range(40) for j in range(i)):
        if joined[i] != joined[j]:
            total += d
            joined = [joined[i] if c == joined[j] else c for c in joined]
    assert abs(total - edge.sum()) < 1e-9


def test_bounds_spare_most_scores():
    """Among near anchors few rows are scored again."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 300, (20, 16))
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 3, (4000, 16))).astype(np.int64)
    label = rng.integers(0, 3, 4000)
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"_key": np.arange(4000), "_label": label, "_v": x.tolist(), "_square": (x.astype(float) ** 2).sum(axis=1)})
    own = np.flatnonzero(((x - x[0]) ** 2).sum(axis=1) < 16 * 100)[:60]
    mining = negatives.Mining(own, label[own], x[own], True, 5, 3, (50, 95))
    block = negatives.Block(batch, 16, True, len(own))
    mining.find_positives(block)
    for at in range(len(own)):
        score = x @ x[own[at]]
        assert (block.low[at] <= score).all() and (score <= block.high[at]).all()
    mining.set_windows()
    mining.find_negatives(block)
    assert mining.scored < 0.15 * 2 * 4000 * len(own)
