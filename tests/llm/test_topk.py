"""Exact top-k search against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from formloom.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, vector int, score string, block int"


def brute(rows, every=1, k=topk.K):
    """Rows (vec_id, vector) in, all (query_id, rank, vec_id, score) out; a query is a row, not an id."""
    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (query, q) in enumerate(fine):
        if query is None or query % every:
            continue
        scores = [(i, sum(x * y for x, y in zip(q, v, strict=False))) for j, (i, v) in enumerate(fine) if j != at]
        best = sorted(scores, key=lambda r: (-r[1], math.inf if r[0] is None else r[0]))[:k]
        out += [(query, rank, i, s) for rank, (i, s) in enumerate(best, start=1)]
    return sorted(out, key=str)


def got(spark, rows, every=1, k=topk.K, parts=3):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(parts)
    ready = topk.prepared(df)
    return sorted(map(tuple, topk.nearest(ready, ready.filter(F.col("vec_id") % every == 0), k).collect()), key=str)


def test_odd_vectors(spark):
    rows = [
        (1, [0.5, -0.25, 3.0]), (2, [0.5, -0.25, 3.0]), (2, [0.5, -0.25, 3.0]), (3, None), (4, [None, 1.0]), (5, [math.nan, 1.0]), (6, [math.inf, 0.0]),
        (7, []), (8, [1.0]), (9, [1.0, 2.0, 3.0, 4.0, 5.0]), (None, [2.0, 2.0]), (None, None), (10, [-1.0, -1.0, -1.0]), (2, [0.1, 0.1, 0.1]),
    ]
    for k in (1, 3, 10, 50):
        assert got(spark, rows, k=k) == brute(rows, k=k)
    assert got(spark, []) == [] and got(spark, [(1, [1.0])]) == [] and got(spark, [(3, [1.0]), (1, None)], every=100) == []


def test_ties_and_hot_vectors(spark):
    """A third of all rows is one vector, and small whole numbers give many equal scores."""
    rng = np.random.default_rng(5)
    rows = [(i, [0.25, 0.5, -0.25, 1.0]) for i in range(0, 900, 3)] + [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(900) if i % 3]
    assert got(spark, rows, every=20, parts=7) == brute(rows, every=20)


def test_blocks_and_large_numbers(spark, monkeypatch):
    """More queries than fit a block, and components whose products need whole numbers or more than 64 bits."""
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "CHUNK", 3)
    monkeypatch.setattr(topk, "CELLS", 64)
    rng = np.random.default_rng(6)
    for scale in (1.0, 3e3, 1e9):
        rows = [(i, (rng.standard_normal(10) * (scale if i % 5 == 0 else 1)).astype(np.float32).tolist()) for i in range(120)]
        found, want = got(spark, rows, every=4), brute(rows, every=4)
        clipped = sorted([(*r[:3], max(min(r[3], 2**63 - 1), -(2**63) + 2)) for r in want], key=str)
        if scale < 1e9:
            assert found == clipped
        else:  # scores at the ends of a long tie, so ids differ from those of unbounded numbers
            assert sorted((r[0], r[1], r[3]) for r in found) == sorted((r[0], r[1], r[3]) for r in clipped)


@pytest.mark.parametrize("kind", [np.float64, np.int64, object])
def test_best_rows(kind):
    scores = topk.exact(np.array([[3.0, 1.0], [3.0, 5.0], [2.0, 5.0], [3.0, 0.0]]), kind)
    assert sorted(topk.best_rows(scores, 2)[:, 0].tolist()) == [0, 1] and sorted(topk.best_rows(scores, 2)[:, 1].tolist()) == [1, 2]
