"""What queries met on larger tables: values that small ones lack, and joins and shuffles that must not grow."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.operators import alignment as al
from scanloom.operators import evaluate as ev
from scanloom.operators import mesh as ms
from scanloom.operators import pixels as px
from scanloom.operators import projection as pr
from scanloom.operators import spatial as sp
from scanloom.operators import temporal as tp
from scanloom.plans import bindings, files, geometry
from scanloom.sources import sens

EYE = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]


@pytest.mark.parametrize("source,column", [("gravity", "gravity"), ("accel", "acceleration")])
def test_zero_sample_is_no_error(spark, source, column):
    rows = [(0, EYE, (0.0, 0.0, 0.0)), (0, EYE, (0.0, 2.0, 0.0)), (1, EYE, (0.0, 0.0, 2.0)), (1, EYE, None)]
    up = tp.up_vector(spark.createDataFrame(rows, f"scan_id int, pose array<double>, {column} struct<x: double, y: double, z: double>"), source)
    got = {r.scan_id: (r.x, r.y, r.z) for r in up.collect()}
    assert all(math.isnan(x) for x in got[0])
    assert got[1] == ((0, 0, 1) if source == "gravity" else (0, 0, -1))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merging_vertices_broadcasts_none(spark):
    points = spark.createDataFrame([(0, i, 0.4 * (i // 2), 0.0, 0.0) for i in range(40)], "scan_id int, vertex_id bigint, x double, y double, z double")
    faces = spark.createDataFrame([(0, i, i, i + 2, i + 1) for i in range(30)], "scan_id int, face_id bigint, v0 bigint, v1 bigint, v2 bigint")
    assert "Broadcast" not in plan_of(sp.close_links(points, 0.1))
    kept, left = ms.merge_close(points, faces, 0.1)
    assert "Broadcast" not in plan_of(kept) and "Broadcast" not in plan_of(left)
    assert sorted(r.vertex_id for r in kept.collect()) == list(range(0, 40, 2)) and left.count() == 0


def test_tasks_connect_what_they_hold(spark):
    """A chain of 3,000 in pieces of 500 pairs leaves a link a border; the same pairs shuffled lose none."""
    chain = spark.range(0, 2999, 1, 1).selectExpr("'s' AS scan_id", "id AS a", "id + 1 AS b")
    stars = ms._contracted(chain, 500).groupBy("node").count()
    assert stars.where("count > 1").count() <= 5
    for pairs in (chain, chain.orderBy("a", ascending=False), chain.repartition(7, "a").sortWithinPartitions(F.hash("b"))):
        roots = ms.components(pairs, 500)
        assert roots.count() == 3000 and roots.select("root").distinct().collect()[0].root == 0


def test_pixels_are_shuffled_not_faces(spark):
    """2,000 faces over the same 16 x 16 pixels of a frame: what a task passes on is a row a pixel."""
    rows = [(0, 5, i, i % 9, 1.0 + i % 50 + i / 1e4, -1.0, -1.0, 40.0, -1.0, -1.0, 40.0) for i in range(2000)]
    f = spark.createDataFrame(rows, "scan_id int, frame_id bigint, face_id bigint, label bigint, d double, u0 double, w0 double, u1 double, w1 double, u2 double, w2 double").coalesce(1)
    drawn = f.selectExpr("*", "d AS d0", "d AS d1", "d AS d2", "0 AS ul", "15 AS uh", "0 AS wl", "15 AS wh", "1681D AS area").drop("d")
    got = pr.nearest_pixels(drawn, ["label"], (16, 16), samples=1000)
    assert "Window" not in plan_of(got) and "MapInArrow" in plan_of(got)
    assert got.count() == 256 and {(r.label, r.depth) for r in got.collect()} == {(0, 1.0)}


def test_texts_of_many_scans_are_many_tasks(spark):
    few = files._dealt(spark.range(40).selectExpr("id AS scan_id", "'x' AS value").groupBy("scan_id").agg(F.max("value").alias("value")))
    assert plan_of(few).count("REPARTITION_BY_NUM") == 1
    assert few.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_points_of_a_scan_meet_planes_where_they_are(spark):
    """One scan holds all the points: neither way of meeting its planes may bring them into one task."""
    points = spark.range(0, 9000, 1, 4).selectExpr("if(id < 0, 't', 's') AS scan_id", "cast(id % 90 AS double) AS x", "0D AS y", "id % 3 + id % 7 * 0.001D AS z", "0D AS nx", "0D AS ny", "if(id % 10 = 0, null, 1D) AS nz")
    unit = points.union(points.limit(3).selectExpr("cast(null AS string) AS scan_id", "x", "y", "z", "nx", "ny", "nz"))
    leaders = spark.createDataFrame([("s", k, n, 0.0, 0.0, 1.0, 0.0, 0.0, z) for k, n, z in ((1, 5, 0.0), (2, 9, 1.0), (3, 9, 2.0), (4, 8, 1.98))], "scan_id string, cell bigint, n bigint, nx double, ny double, nz double, x double, y double, z double")
    both = [al.members(unit, leaders, 0.05, 0.9, few) for few in (10, 0)]
    rows = [sorted((r.scan_id, r.cell, r.n, round(r.x, 6), round(r.z, 6)) for r in df.collect()) for df in both]
    assert rows[0] == rows[1] and [r[1:3] for r in rows[0]] == [(1, 2700), (2, 2700), (3, 2700)]
    assert "MapInArrow" in plan_of(both[0]) and "Join" not in plan_of(both[0]) and "_s" in plan_of(both[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        planes = leaders.selectExpr("scan_id", "nx", "ny", "nz", "z AS offset", "x", "y", "z", "n")
        kept = al.bounding(planes, points, behind=3500)
        assert "BroadcastHashJoin" in plan_of(kept)  # of points and planes; the few planes left are joined by merge
        assert sorted((r.offset) for r in kept.collect()) == [0.0, 1.0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_windows_run_over_the_pixels_of_a_tile(spark):
    """Cores of the size of what lies in a tile, not of the tile; smoothing is done once for its three readers."""
    pixels = spark.range(0, 300).selectExpr("0 AS frame_key", "id div 20 + 58 AS y", "id % 20 - 3 AS x", "cast(id % 3 AS bigint) AS instance", "id % 7 / 10D AS depth", "id % 5 / 10D AS intensity")

    def run(t):
        return {"a": np.full(t.shape, t.shape[0] * t.shape[1]), "b": t.core(t.grid("instance")), "c": sum(seen(t.present).astype(int) for _, _, seen in t.steps())}

    got = {(r.y, r.x): (r.a, r.b, r.c) for r in px.stencil(pixels, 2, run, "a bigint, b bigint, c bigint").collect()}
    at = {(58 + i // 20, i % 20 - 3) for i in range(300)}
    assert set(got) == at and {v[0] for v in got.values()} == {6 * 3, 6 * 17, 9 * 3, 9 * 17}
    for (y, x), (_, b, c) in got.items():
        assert b == ((y - 58) * 20 + x + 3) % 3 and c == sum((y + i, x + j) in at for i in range(-2, 3) for j in range(-2, 3))
    assert plan_of(px.two_pass(pixels.where("x >= 0").withColumn("y", F.col("y") - 58), (15, 17), (8, 9))).count("FlatMapGroupsInPandas") == 2


def test_small_streams_share_tasks(spark, tmp_path, monkeypatch):
    """120 streams in three ranges each are a few tasks; batches of a range end where they are full; nothing is lost."""
    head = {"name": "n", **{k: EYE for k in ("k_color", "e_color", "k_depth", "e_depth")}, "color_compression": 0, "depth_compression": sens.RAW, "color_width": 1, "color_height": 1, "depth_width": 2, "depth_height": 1, "depth_shift": 1.0}
    for i in range(120):
        imu = np.array([((float(j),) * 15, j) for j in range(i % 3)], sens.IMU)
        sens.write_stream(f"{tmp_path}/s{i}.sens", head, [(EYE, i, j, b"c" * j, np.array([i, j], "<u2").tobytes()) for j in range(i % 5)], imu)
    frames, imu = sens.read(spark, str(tmp_path), splits=3, packed=True), sens.read(spark, str(tmp_path), "imu", packed=True)
    most = 3 * spark.sparkContext.defaultParallelism
    assert frames.rdd.getNumPartitions() <= most and imu.rdd.getNumPartitions() <= most
    got = sorted((r.scan_id, r.frame_id, r.ts_color, r.ts_depth, bytes(r.color), list(r.pose)) for r in frames.collect())
    assert got == sorted((f"s{i}", j, i, j, b"c" * j, EYE) for i in range(120) for j in range(i % 5))
    assert sorted((r.scan_id, r.ts, r.gravity.z) for r in imu.collect()) == sorted((f"s{i}", j, float(j)) for i in range(120) for j in range(i % 3))
    d = sens.depth_pixels(frames, 2, 1, sens.RAW).collect()
    assert sorted((r.scan_id, r.frame_id, r.y, r.x, r.d) for r in d) == sorted((f"s{i}", j, 0, x, (i, j)[x]) for i in range(120) for j in range(i % 5) for x in (0, 1))
    monkeypatch.setattr(sens, "BATCH", 256)
    for table, n in (("frames", 4), ("imu", 2)):
        r = sens._Reader(f"{tmp_path}/s{119}.sens", table)
        sizes = [b.num_rows for p in r.partitions() for b in r.batches(p)]
        assert sum(sizes) == n and max(sizes) <= 3


def test_texts_are_written_without_a_folder_of_attempts(spark):
    """Spark's writer would leave _SUCCESS and check sums; a scan that comes back in a task loses no line."""
    rows = [(1, "a"), (2, "b"), (1, "c"), (3, None), (3, "dé")]
    path = files._round_trip(spark, spark.createDataFrame(rows, "scan_id bigint, value string").coalesce(1), "texts")
    local = path.removeprefix("file://")
    found = sorted(os.path.join(d, f).removeprefix(local) for d, _, names in os.walk(local) for f in names)
    assert [f.split("/")[1] for f in found] == ["scan_id=1", "scan_id=1", "scan_id=2", "scan_id=3"]
    assert sorted((r.scan_id, r.value) for r in spark.read.text(path).collect()) == [(1, "a"), (1, "c"), (2, "b"), (3, ""), (3, "dé")]


def test_matches_are_settled_once(spark, monkeypatch):
    """Matches have two readers, but turns are taken once, in a number of tasks that is named; masks meet the ground truth once."""
    plans = []
    monkeypatch.setattr(ev, "settled", lambda df, f=ev.settled: plans.append(plan_of(df)) or f(df))
    gt, preds, masks = bindings.instances(spark, "/root/testdata/sf0.001")
    inst, pred, shared = ev.instance_tables(gt, preds, masks, ev.INSTANCE_CLASSES)
    assert sum("vertex_id" in p and "Join" in p for p in plans) == 1
    found = ev.matches(pred, inst, shared, ev.OVERLAPS_3D, 1)
    assert "FlatMapGroupsInPandas" not in plan_of(found)
    assert plans[-1].count("FlatMapGroupsInPandas") == 1 and "REPARTITION_BY_NUM" in plans[-1]
    assert found.where("is_true").count() > 0


def test_largest_clusters_shuffle_no_points(spark, monkeypatch):
    """srt6 has four scans: its three passes over the points are sums where they are read, without a join by scan."""
    plans = []
    monkeypatch.setattr(al, "settled", lambda df, f=al.settled: plans.append(plan_of(df)) or f(df))
    assert geometry.srt6_largest_clusters(spark, "/root/testdata/sf0.001").count() > 0
    read = [p for p in plans if "l_extendedprice" in p]
    assert len(read) == 3 and not any("Join" in p for p in read)


@pytest.mark.parametrize("name", ["src15_inertial_samples", "src24_frame_folders"])
def test_files_are_written_in_the_number_of_tasks_that_is_named(spark, name):
    """Adaptive plans count bytes and would write all files of small rows in one task."""
    tasks, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    spark.sparkContext.setJobGroup(name, name)
    try:
        getattr(files, name)(spark, "/root/testdata/sf0.01")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.sparkContext.setJobGroup("", "")
    of = spark.sparkContext.statusTracker()
    for job in of.getJobIdsForGroup(name):
        tasks += [of.getStageInfo(s).numTasks for s in of.getJobInfo(job).stageIds if of.getStageInfo(s)]
    assert 7 in tasks
