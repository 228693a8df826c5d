"""Planes, boxes and the transform table against numpy."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from scanloom.operators import alignment as al
from scanloom.operators import geometry as ge

KIND = "scan_id string, x double, y double, z double, nx double, ny double, nz double"


def plane(rng, normal, offset, n, noise, spread=0.05):
    """Points of a noisy plane, with noisy normals."""
    w = np.array(normal) / np.linalg.norm(normal)
    a = np.linalg.svd(w[None])[2][1:]
    at = rng.uniform(-3, 3, (n, 2)) @ a + np.outer(offset + rng.normal(0, noise, n), w)
    normals = w + rng.normal(0, spread, (n, 3))
    return [("a", *map(float, p), *map(float, m / np.linalg.norm(m))) for p, m in zip(at, normals, strict=True)]


def test_noisy_ground_is_found_within_a_tenth_of_a_degree(spark):
    rng = np.random.default_rng(3)
    true = np.array([0.13, -0.21, 1.0]) / np.linalg.norm([0.13, -0.21, 1.0])
    rows = plane(rng, true, -0.4, 4000, 0.008) + plane(rng, [1.0, 0.2, 0.0], 2.5, 1500, 0.008)
    points = spark.createDataFrame(rows, KIND).repartition(3)
    found = al.ground_planes(points, 500, behind=4000).collect()
    assert len(found) == 1
    n = np.array([found[0].nx, found[0].ny, found[0].nz])
    assert abs(np.linalg.norm(n) - 1) < 1e-9 and math.degrees(math.acos(min(1.0, abs(float(n @ true))))) < 0.1 and abs(found[0].offset + 0.4) < 0.005


def test_a_plane_that_cells_cut_is_one(spark):
    """Its offset lies on the border of two cells, its normals on that of several."""
    rng = np.random.default_rng(5)
    step = math.sqrt(0.2)
    rows = plane(rng, [step / 2, 0.0, math.sqrt(1 - step * step / 4)], 0.525, 3000, 0.004, 0.03)
    got = al.plane_clusters(spark.createDataFrame(rows, KIND), 500).collect()
    assert len(got) == 1 and got[0].n > 2900
    apart = spark.createDataFrame(plane(rng, [0, 0, 1], 0.5, 800, 0.001) + plane(rng, [0, 0, 1], 0.8, 700, 0.001), KIND)
    assert sorted(r.n for r in al.plane_clusters(apart, 500).collect()) == [700, 800]


def test_eigen(spark):
    rng = np.random.default_rng(1)
    some = [(lambda m: (m + m.T).ravel().tolist())(rng.normal(size=(3, 3))) for _ in range(20)] + [[0.0] * 9, np.diag([3.0, 3.0, 1.0]).ravel().tolist(), np.ones(9).tolist()]
    for r in spark.createDataFrame([(m,) for m in some], "m array<double>").select("m", al.eigen(F.col("m")).alias("e")).collect():
        a, v = np.array(r.m).reshape(3, 3), np.array(r.e.vectors).reshape(3, 3)
        assert np.allclose(a @ v, v * np.array(r.e["values"]), atol=1e-9) and np.allclose(v.T @ v, np.eye(3), atol=1e-9)
        assert np.allclose(sorted(r.e["values"]), np.linalg.eigvalsh(a), atol=1e-9)


def test_box_is_never_above_a_sweep(spark):
    rng = random.Random(4)
    rows = [("a", rng.gauss(0, 3), rng.gauss(0, 1)) for _ in range(3000)]
    c, s = math.cos(0.4), math.sin(0.4)
    rows += [("b", c * x - s * y, s * x + c * y) for x in range(8) for y in range(5)] + [("line", float(i), 2.0 * i) for i in range(9)] + [("dot", 1.0, 1.0)] * 3
    rows = [(k, float(x), float(y), 0.0) for k, x, y in rows]
    got = {r.scan_id: r for r in al.oriented_box(spark.createDataFrame(rows, "scan_id string, x double, y double, z double").repartition(6)).collect()}

    def area(kind, degrees):
        t = math.radians(degrees)
        u = [x * math.cos(t) - y * math.sin(t) for k, x, y, _ in rows if k == kind]
        v = [x * math.sin(t) + y * math.cos(t) for k, x, y, _ in rows if k == kind]
        return (max(u) - min(u)) * (max(v) - min(v))

    assert abs(got["b"].area - 28) < 1e-9 and abs(got["b"].angle - (90 - math.degrees(0.4))) < 1e-6 and got["dot"].area == 0 and abs(got["line"].area) < 1e-9
    for k in "ab":
        assert abs(area(k, got[k].angle) - got[k].area) < 1e-9 and all(got[k].area <= area(k, a / 4) + 1e-9 for a in range(360))


def test_one_table_moves_points_meshes_and_poses(spark):
    rng = np.random.default_rng(8)
    rows = plane(rng, [0.2, 0.1, 1.0], 0.0, 900, 0.002)
    points = spark.createDataFrame(rows, KIND)
    up = spark.createDataFrame([("a", 0.0, 0.0, 1.0), ("b", 0.0, 0.0, -1.0)], "scan_id string, ux double, uy double, uz double")
    scans = spark.createDataFrame([("a", True, True, False), ("b", True, True, False)], "scan_id string, processed boolean, valid boolean, aligned boolean")
    table = al.alignments(points, up, scans)
    m = {r.scan_id: np.array(r.matrix).reshape(4, 4) for r in table.collect()}
    assert np.allclose(m["a"][:3, :3] @ m["a"][:3, :3].T, np.eye(3)) and np.allclose(m["b"] @ [0, 0, -1, 1], [0, 0, 1, 1])
    moved = np.array([[r.x, r.y, r.z] for r in al.moved(points, table).orderBy("x").collect()])
    assert np.abs(moved.min(0)).max() < 1e-9 and np.ptp(moved[:, 2]) < 0.02
    inf = float("-inf")
    poses = spark.createDataFrame([("a", 0, np.eye(4).ravel().tolist()), ("a", 1, [inf] * 16), ("c", 2, [1.0] * 16)], "scan_id string, frame_id int, pose array<double>")
    got = {r.frame_id: r.pose for r in al.moved_poses(poses, table).collect()}
    assert np.allclose(np.array(got[0]).reshape(4, 4), m["a"]) and got[1] == [inf] * 16 and got[2] == [1.0] * 16
    other = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("c", 1.0, 2.0, 3.0)], "scan_id string, x double, y double, z double")
    at = {r.scan_id: (r.x, r.y, r.z) for r in al.moved(other, table).collect()}
    assert np.allclose(at["a"], (m["a"] @ [1, 2, 3, 1])[:3]) and at["c"] == (1.0, 2.0, 3.0)


def test_greatest_steps_and_colours(spark):
    f = spark.createDataFrame([("a", 1, 1.0, 2.0), ("a", 2, 0.1, 9.0), ("a", 3, 1.0, 9.5), ("a", 4, -1.0, 11.0), ("b", 1, 1.0, 4.0), ("c", 1, 1.0, 4.0), ("c", 2, 1.0, 3.0)], "scan_id string, frame_id int, nz double, offset double")
    assert {r.scan_id: r.step for r in ge.greatest_steps(f).collect()} == {"a": 1.5, "b": 0.0, "c": 0.0}
    depth = spark.createDataFrame([(0, 0, 0, 0, 1000), (0, 0, 1, 1, 2000), (0, 0, 1, 0, 0), (0, 0, 0, 1, 500)], "scan_id int, frame_id int, y int, x int, d int")
    frames = spark.createDataFrame([(0, 0, [float("-inf")] * 16)], "scan_id int, frame_id int, pose array<double>")
    colour = spark.createDataFrame([(0, 0, 0, 0, 10, 20, 30), (0, 0, 1, 1, 40, 50, 60)], "scan_id int, frame_id int, y int, x int, r int, g int, b int")
    t = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    got = ge.coloured_points(depth, frames, colour, (1.0, 1.0, 0.0, 0.0), t, (1.0, 1.0, 0.0, 0.0), (2, 2))
    assert {(r.y, r.x): (r.r, r.g, r.b) for r in got.collect()} == {(0, 0): (10, 20, 30), (1, 1): (40, 50, 60), (0, 1): (0, 0, 0)}
