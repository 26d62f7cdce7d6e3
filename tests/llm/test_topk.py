import math

import numpy as np
import pytest
from panelspark.llm import topk
from tests.llm.data import multiset


def brute(rows, queries, k=20):
    def usable(v):
        return v is not None and all(c is not None and math.isfinite(c) for c in v)

    ints = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows if i is not None and usable(v)]
    out = []
    for q, v in queries:
        if q is None or not usable(v):
            continue
        x = [math.floor(64 * float(np.float32(c))) for c in v]
        found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ints if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return out


def check(spark, rows, k=20):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = topk.top_k(frame, frame.where("vec_id % 20 = 0"), k).collect()
    plain = [(r[0], r[1]) for r in rows]
    assert multiset(map(tuple, got)) == multiset(brute(plain, [r for r in plain if r[0] is not None and r[0] % 20 == 0], k))


@pytest.mark.parametrize("kind", ["spread", "clustered", "same", "large"])
def test_equals_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    x = rng.normal(0, 0.2, (3000, 16))
    if kind == "clustered":
        x = x * 0.1 + rng.normal(0, 1, (20, 16))[rng.integers(0, 20, 3000)]
    if kind == "same":
        x[:1200] = x[0]
    if kind == "large":
        x *= 1e6
    check(spark, [(i, [float(c) for c in v], "s") for i, v in enumerate(x)])


def test_awkward_rows(spark):
    rows = [(0, [1.0, 2.0], "s"), (20, [1.0, float("nan")], "s"), (40, None, "s"), (60, [1.0, None], "s"), (80, [float("inf"), 1.0], "s"), (1, [2.0, 2.0], None), (2, [2.0, 2.0], "s"),
            (None, [3.0, 3.0], "s"), (100, [], "s"), (120, [0.0, 0.0], "s"), (3, [-1.0, -2.0], "s"), (4, [0.5], "s"), (4, [0.5], "s")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = topk.top_k(frame, frame.where("vec_id % 20 = 0")).collect()
    plain = [(i, None if v is None else v + [0.0] * (2 - len(v))) for i, v, _ in rows]
    assert multiset(map(tuple, got)) == multiset(brute(plain, [r for r in plain if r[0] is not None and r[0] % 20 == 0]))


def test_few_rows_and_none(spark):
    check(spark, [(i, [1.0, float(i)], "s") for i in range(5)])
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, empty).count() == 0


def test_bounds_leave_parts_of_the_index(monkeypatch):
    """On clustered rows most annuli are never scored."""
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 2, (30, 8))
    x = np.floor(64 * (centres[rng.integers(0, 30, 6000)] + rng.normal(0, 0.02, (6000, 8)))).astype(np.int64)
    most = float((x.astype(float) ** 2).sum(axis=1).max())
    space = topk.Space(np.zeros((1, 9)), most, 8, True)
    space.pivots = space.rows(x[:60])
    away = space.distances(space.rows(x))
    pivot = away.argmin(axis=1)
    order = np.lexsort((away[np.arange(6000), pivot], pivot))
    distance = away[np.arange(6000), pivot][order]
    opened = {"f": {"key": order, "distance": distance, "x": x[order].ravel()}}
    edge = np.flatnonzero(np.diff(pivot[order], prepend=-1))
    last = np.r_[edge[1:], 6000]
    segments = [("f", int(pivot[order][a]), int(a), int(b), distance[a], distance[b - 1]) for a, b in zip(edge, last)]
    scored = []
    real = topk.Space.products
    monkeypatch.setattr(topk.Space, "products", lambda self, q, y: scored.append(len(y)) or real(self, q, y))
    best = int(np.argmax((x.astype(float) ** 2).sum(axis=1)))
    q, score, key = topk.answer(space, opened, segments, np.array([best]), x[best:best + 1], 5)
    want = sorted(((-int(x[best] @ y), i) for i, y in enumerate(x) if i != best))[:5]
    assert [(-int(s), int(i)) for s, i in zip(score, key)] == want and sum(scored) < 3000
