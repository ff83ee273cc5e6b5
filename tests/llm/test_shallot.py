"""Shallot search against plain Lloyd rounds in whole numbers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from pitwall.llm import shallot

VECTORS = "vec_id long, embedding array<double>, label int, x string, cluster string, total string"


def lloyd(rows, k=40, rounds=5):
    kept = [
        (i, [math.floor(256 * v) for v in e]) for i, e in rows
        if e is not None and len(e) == 64 and all(v is not None and math.isfinite(v) for v in e)
    ]
    order = sorted((i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept)[:k]
    x = np.array([v for _, v in kept], np.int64)
    centres = np.array([v for _, _, v in order], np.int64)
    for turn in range(rounds + 1):
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
        a = d.argmin(axis=1)
        if turn < rounds:
            for c in range(len(centres)):
                if (a == c).any():
                    centres[c] = [int(s) // int((a == c).sum()) for s in x[a == c].sum(axis=0)]
    best = d[np.arange(len(x)), a]
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    return sorted(
        (i or 0, int(c), int(v), int(best[a == c].sum()), int(best.sum()), digest[c])
        for (i, _), c, v in zip(kept, a, best, strict=True)
    )


def found(spark, rows):
    df = spark.createDataFrame([(i, e, 0, "x", "c", "t") for i, e in rows], VECTORS).repartition(3)
    return sorted((r[0] or 0, *r[1:]) for r in shallot.clusters(df).collect())


@pytest.mark.parametrize("spread", [0.01, 0.3, 5.0])
def test_clusters_equal_plain_rounds(spark, spread):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 64))
    rows = [(i, (centres[rng.integers(12)] + rng.normal(size=64) * spread).tolist()) for i in range(900)]
    assert found(spark, rows) == lloyd(rows)


def test_ties_and_equal_centroids(spark):
    """Few distinct vectors: equal first centroids, empty clusters, and equal distances."""
    rng = np.random.default_rng(3)
    base = np.round(rng.integers(-2, 3, size=(9, 64)) / 256, 8)
    rows = [(i, base[i % 9].tolist()) for i in range(300)] + [(5, base[0].tolist())] * 200
    assert found(spark, rows) == lloyd(rows)
    line = [(i, [float(i % 7)] + [0.0] * 63) for i in range(200)]
    assert found(spark, line) == lloyd(line)


def test_bounds_rule_out_and_second_centroid_is_remembered():
    rng = np.random.default_rng(1)
    x = rng.integers(-200, 200, size=(500, 64))
    centres = x[:40].copy()
    first = shallot.Search(centres)
    n = len(x)
    state = first.assign(x, np.zeros(n, int), np.full(n, first.order[0, 1]), np.full(n, np.inf), np.zeros(n))
    moved = centres + rng.integers(-3, 4, size=centres.shape)
    search = shallot.Search(moved, centres)
    asked = []
    scan = search._scan
    search._scan = lambda rows, *rest: asked.append(len(rows)) or scan(rows, *rest)
    got = search.assign(x, *state)
    d = np.stack([((x - c) ** 2).sum(axis=1) for c in moved], axis=1)
    assert (got[0] == d.argmin(axis=1)).all()
    rest = np.where(np.arange(40)[None, :] == got[0][:, None], np.inf, np.sqrt(d))
    assert (got[3] <= rest.min(axis=1) + 1e-6).all() and (got[2] >= np.sqrt(d.min(axis=1)) - 1e-6).all()
    assert sum(asked) < n


def test_clusters_of_odd_rows(spark):
    good = [(i, [0.5 * (i % 3)] * 64) for i in range(5)]
    odd = [
        (10, None), (11, []), (12, [1.0] * 63), (13, [1.0] * 65), (14, [None] + [1.0] * 63), (15, [math.nan] + [1.0] * 63),
        (16, [math.inf] * 64), (17, [-math.inf] * 64), (None, [3.0] * 64), (2, [1.0] * 64),
    ]
    assert found(spark, good + odd) == lloyd(good + odd)
    assert found(spark, odd[:8]) == [] and found(spark, []) == []
    with pytest.raises(Exception, match="beyond"):
        found(spark, [(1, [1e9] * 64)])
    assert found(spark, [(None, [1.0] * 64)]) == lloyd([(None, [1.0] * 64)])
