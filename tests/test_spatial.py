"""Neighbours and links of points whose density varies a hundredfold, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import mesh as ms
from scanloom.operators import spatial as sp

KIND = "scan_id string, vertex_id bigint, x double, y double, z double"


def cloud(rng, n, dense, scan="a", first=0):
    """n points in a box of 4, and a spot of `dense` points a tenth as wide."""
    at = np.concatenate([rng.uniform(0, 4, (n, 3)), 1.0 + rng.uniform(0, 0.4, (dense, 3))])
    at[::17] = at[0]  # equal points
    return [(scan, first + i, *map(float, p)) for i, p in enumerate(at)]


def slow(targets, source, k, limit):
    out = []
    for scan, i, *p in targets:
        near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)))), j) for s, j, *q in source if s == scan)
        out += [(scan, i, n + 1, j, round(d, 9)) for n, (d, j) in enumerate(near[:k]) if d <= limit]
    return sorted(out)


@pytest.mark.parametrize(("k", "limit", "most"), [(3, 0.5, 32), (3, 0.5, 1), (1, 10.0, 4), (40, 0.3, 2)])
def test_nearest_k(spark, k, limit, most):
    rng = np.random.default_rng(k)
    source = cloud(rng, 150, 250) + cloud(rng, 40, 0, "b", 9000)
    targets = cloud(rng, 60, 60) + cloud(rng, 20, 0, "b") + [("a", 777, 30.0, 0.0, 0.0), ("none", 1, 0.0, 0.0, 0.0)]
    got = sp.nearest_k(spark.createDataFrame(targets, KIND), spark.createDataFrame(source, KIND), k, limit, most)
    assert sorted((r.scan_id, r.vertex_id, r.k, r.r_vertex_id, round(r.distance, 9)) for r in got.collect()) == slow(targets, source, k, limit)


def test_cells_follow_the_density(spark):
    """A hundred times the points in the same room: the first cells hold as many as before."""
    rng = np.random.default_rng(1)
    for n in (300, 30_000):
        flat = [("a", i, float(x), float(y), 0.0) for i, (x, y) in enumerate(rng.uniform(0, 4, (n, 2)))]
        df = spark.createDataFrame(flat, KIND)
        edge = sp.first_edges(df, 1.0, 32).first().edge
        fullest = df.groupBy(*(F.floor(F.col(c) / edge) for c in "xyz")).count().agg(F.max("count")).first()[0]
        assert fullest <= 3 * 32


def test_nearest_vertex_far_away(spark):
    source = [("a", 1, 0.0, 0.0, 0.0)]
    got = sp.nearest_vertex(spark.createDataFrame([("a", 5, 3.0, 0.0, 0.0), ("a", 6, 500.0, 0.0, 0.0)], KIND), spark.createDataFrame(source, KIND), 0.5, rounds=5).collect()
    assert [(r.vertex_id, r.nearest, r.distance) for r in got] == [(5, 1, 3.0)]
    assert sp.nearest_vertex(spark.createDataFrame([], KIND), spark.createDataFrame(source, KIND), 0.5).count() == 0
    assert sp.nearest_vertex(spark.createDataFrame(source, KIND), spark.createDataFrame([], KIND), 0.5).count() == 0


@pytest.mark.parametrize("by_rows", [0, 5, 1024])
def test_links_connect_what_pairs_connect(spark, by_rows):
    rng = np.random.default_rng(9)
    rows = cloud(rng, 220, 160) + [("b", 9000 + i, 0.29 * i, 0.0, 0.0) for i in range(12)] + [("b", 9100 + i, 0.29 * i, 0.0, 5.0 + 0.01 * i) for i in range(3)]
    eps = 0.3
    root = {r[1]: r[1] for r in rows}
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[0] == b[0] and np.sqrt(sum((x - y) ** 2 for x, y in zip(a[2:], b[2:], strict=True))) <= eps:
                x, y = root[a[1]], root[b[1]]
                if x != y:
                    root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    links = sp.close_links(spark.createDataFrame(rows, KIND), eps, by_rows)
    assert links.count() < 8 * len(rows)
    got = {r.node: r.root for r in ms.components(links).collect()}
    assert all(got.get(v, v) == r for v, r in root.items())
