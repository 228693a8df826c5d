"""The frustum join and the tiles against plain loops."""

import math
import random

from pyspark.sql import functions as F

from scanloom.operators import mesh as ms
from scanloom.operators import pixels as px
from scanloom.operators import projection as pr

POINTS = "scan_id string, vertex_id bigint, x double, y double, z double"
FACES = "scan_id string, face_id bigint, v0 bigint, v1 bigint, v2 bigint"
FRAMES = "scan_id string, frame_id bigint, w2c array<double>"
K, SIZE = (30.0, 30.0, 20.0, 15.0), (31, 41)


def looking(x, y, z, turn):
    """A camera at (x, y, z) that looks along the floor, turned about z."""
    c, s = math.cos(turn), math.sin(turn)
    rows = [(-s, c, 0.0), (0.0, 0.0, -1.0), (c, s, 0.0)]
    return [v for r in rows for v in (*r, -(r[0] * x + r[1] * y + r[2] * z))] + [0.0, 0.0, 0.0, 1.0]


def hall(spark, side=40):
    """A long floor of small triangles with a wall, and cameras along it that see a little each."""
    rng = random.Random(2)
    at = lambda i, j: i * side + j
    points = [("hall", at(i, j), float(i), j / 8.0, rng.random() * 0.05) for i in range(side * 2) for j in range(side)]
    faces = [("hall", 2 * at(i, j) + k, *((at(i, j), at(i + 1, j), at(i, j + 1)) if k else (at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)))) for i in range(side * 2 - 1) for j in range(side - 1) for k in (0, 1)]
    points += [("hall", 90_000 + i, x, y, z) for i, (x, y, z) in enumerate([(30.0, 0.0, -1.0), (30.0, 9.0, -1.0), (30.0, 0.0, 5.0), (30.0, 9.0, 5.0)])]
    faces += [("hall", 90_000, 90_000, 90_001, 90_002), ("hall", 90_001, 90_001, 90_003, 90_002)]
    points += [("dot", 0, 1.0, 1.0, 1.0), ("dot", 1, 1.0, 1.0, 1.0), ("dot", 2, 1.0, 1.0, 1.0)]
    faces += [("dot", 5, 0, 1, 2)]
    frames = [("hall", 10 * n + t, looking(4.0 * n, 2.5, 1.5, t * math.pi / 2)) for n in range(18) for t in range(4)] + [("dot", 1, looking(0, 0, 0, 0)), ("none", 1, looking(0, 0, 0, 0))]
    return points, faces, frames


def slow(points, faces, frames, near, far):
    p = {(s, v): xyz for s, v, *xyz in points}
    best, seen = {}, 0
    for scan, frame, m in frames:
        for s, face, *corners in faces:
            if s != scan:
                continue
            cam = [[sum(m[4 * r + j] * c for j, c in enumerate(p[s, v])) + m[4 * r + 3] for r in range(3)] for v in corners]
            if not all(near <= c[2] <= far for c in cam):
                continue
            u, w, d = [K[0] * c[0] / c[2] + K[2] for c in cam], [K[1] * c[1] / c[2] + K[3] for c in cam], [c[2] for c in cam]
            area = (u[1] - u[0]) * (w[2] - w[0]) - (u[2] - u[0]) * (w[1] - w[0])
            xs, ys = range(max(0, math.ceil(min(u))), min(SIZE[1] - 1, math.floor(max(u))) + 1), range(max(0, math.ceil(min(w))), min(SIZE[0] - 1, math.floor(max(w))) + 1)
            seen += bool(area and len(xs) and len(ys))
            for y in ys if area else ():
                for x in xs:
                    b1 = ((x - u[0]) * (w[2] - w[0]) - (u[2] - u[0]) * (y - w[0])) / area
                    b2 = ((u[1] - u[0]) * (y - w[0]) - (x - u[0]) * (w[1] - w[0])) / area
                    if b1 >= 0 and b2 >= 0 and b1 + b2 <= 1:
                        key = (round(1 / ((1 - b1 - b2) / d[0] + b1 / d[1] + b2 / d[2]), 9), face, corners[0] % 7)
                        best[scan, frame, y, x] = min(best.get((scan, frame, y, x), key), key)
    return {k: (v[2], v[0]) for k, v in best.items()}, seen


def test_hall(spark):
    points, faces, frames = hall(spark)
    v, f, fr = spark.createDataFrame(points, POINTS).cache(), spark.createDataFrame(faces, FACES).cache(), spark.createDataFrame(frames, FRAMES)
    want, seen = slow(points, faces, frames, 0.1, 9.0)
    got = pr.project(f, v, v.select("scan_id", "vertex_id", (F.col("vertex_id") % 7).alias("value")), fr, K, SIZE, far=9.0, cell_faces=16)
    found = {(r.scan_id, r.frame_id, r.y, r.x): (r.label, r.depth) for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(found[k][0] == want[k][0] and abs(found[k][1] - want[k][1]) < 1e-6 for k in want)
    met = pr.in_view(ms.corners(f, v), fr, K, SIZE, 0.1, 9.0, cell_faces=16).count()
    every = sum(s == "hall" for s, *_ in faces) * sum(s == "hall" for s, *_ in frames)
    assert seen <= met <= 2 * seen and met < every / 8  # of all pairs few are joined


def test_boxes_lose_no_visible_face(spark):
    """Whatever the depth of the tree, the same pixels."""
    rng = random.Random(7)
    points = [("a", i, rng.gauss(0, 3), rng.gauss(0, 3), rng.gauss(0, 1)) for i in range(150)]
    faces = [("a", i, *rng.sample(range(150), 3)) for i in range(120)]
    frames = [("a", i, looking(rng.gauss(0, 2), rng.gauss(0, 2), 0.0, rng.random() * 6)) for i in range(6)]
    v, f, fr = spark.createDataFrame(points, POINTS), spark.createDataFrame(faces, FACES), spark.createDataFrame(frames, FRAMES)
    want, _ = slow(points, faces, frames, 0.1, 15.0)
    for cell_faces in (1, 8, 1000):
        got = pr.project(f, v, v.select("scan_id", "vertex_id", (F.col("vertex_id") % 7).alias("value")), fr, K, SIZE, cell_faces=cell_faces)
        assert {(r.scan_id, r.frame_id, r.y, r.x): r.label for r in got.collect()} == {k: x[0] for k, x in want.items()}


def test_labels_behind_what_was_captured(spark):
    drawn = spark.createDataFrame([(1, 0, 0, 5, 2.0), (1, 0, 1, 5, 2.0), (1, 3, 3, 6, 4.0), (2, 0, 0, 7, 1.0)], "frame_key int, y bigint, x bigint, label int, depth double")
    captured = spark.createDataFrame([(1, 0, 0, 2.1), (1, 1, 1, 3.0)], "frame_key int, y bigint, x bigint, depth double")
    label = lambda **kw: {(r.frame_key, r.y, r.x): r.label for r in px.seen_labels(drawn, captured, (4, 4), (2, 2), **kw).collect()}
    assert label() == {(1, 0, 0): 5, (1, 0, 1): 5, (1, 3, 3): 0, (2, 0, 0): 7}
    assert label(captured_only=True) == {(1, 0, 0): 5, (1, 0, 1): 5, (1, 3, 3): 0, (2, 0, 0): 0}
