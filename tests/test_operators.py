"""Cases that the driver's tables do not show."""

import struct
import zlib
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from scanloom.functions import scalars as sc
from scanloom.operators import evaluate as ev
from scanloom.operators import labels as lb
from scanloom.operators import mesh as ms
from scanloom.operators import scan_index as ix
from scanloom.operators import spatial as sp
from scanloom.operators import temporal as tp
from scanloom.sources import files as fl
from scanloom.sources import sens


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_asof_ties_ends_and_missing(spark):
    f = spark.createDataFrame([("a", 1, 5), ("a", 2, 10), ("a", 3, 99), ("a", 4, 12), ("b", 5, 1)], "scan_id string, frame_id int, ts bigint")
    s = spark.createDataFrame([("a", 8, 1.0), ("a", 16, 2.0), ("a", 16, 3.0)], "scan_id string, ts bigint, v double")
    assert rows(tp.asof_nearest(f, s), "frame_id", "near_ts", "v") == [(1, 8, 1.0), (2, 8, 1.0), (3, 16, 3.0), (4, 16, 3.0), (5, None, None)]


def test_asof_over_buckets(spark):
    """A hot scan, long gaps, bursts at one time: the same as from all samples, however many buckets."""
    import random

    rng = random.Random(3)
    samples = [("hot", t, t * 10) for t in [*(rng.randint(0, 500) for _ in range(200)), *([9000] * 30), *range(20_000, 20_050)]] + [("b", 5, 1), (None, 7, 2)]
    frames = [("hot", i, rng.randint(-50, 21_000)) for i in range(300)] + [("b", 900, 1), ("c", 901, 1), (None, 902, 9), ("hot", 903, None)]
    s = spark.createDataFrame(samples, "scan_id string, ts bigint, v bigint")
    f = spark.createDataFrame(frames, "scan_id string, frame_id bigint, ts bigint")
    want = []
    for scan, i, ts in frames:
        near = [(abs(t - ts), -t, v) for k, t, v in samples if k == scan] if ts is not None else []
        best = min(near, key=lambda x: (x[0], x[1], -x[2]), default=(None, None, None))
        want.append((i, None if best[1] is None else -best[1], best[2]))
    for bucket_rows in (100_000, 40, 3):
        assert sorted((r.frame_id, r.near_ts, r.v) for r in tp.asof_nearest(f, s, bucket_rows=bucket_rows).collect()) == sorted(want)
    sizes = tp.in_buckets(s.where("ts < 600"), "scan_id", "ts", 20).groupBy("scan_id", "_bucket").count().where("scan_id = 'hot'").collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) < 60


def test_dense_numbers(spark):
    kind = "scan_id string, vertex_id bigint, x double, y double, z double"
    v = spark.createDataFrame([(s, i * i, 0.0, 0.0, 0.0) for s in ("a", "b") for i in range(200)], kind).repartition(5)
    f = spark.createDataFrame([("a", 0, 4, 100, 9), ("a", 1, 4, 10_000, 9), ("b", 2, 0, 1, 4), ("b", 3, 0, 1, 7)], "scan_id string, face_id bigint, v0 bigint, v1 bigint, v2 bigint")
    kept, out = ms.renumbered(v, f)
    assert rows(kept, "scan_id", "vertex_id") == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1), ("b", 2)]
    assert rows(out, "scan_id", "face_id", "v0", "v1", "v2") == [("a", 0, 0, 2, 1), ("a", 1, 0, 3, 1), ("b", 2, 0, 1, 2)]
    assert sorted((r.scan_id, r.vertex_id, r.n) for r in ms.dense_ids(v, ["vertex_id"], "n").collect()) == [(s, i * i, i) for s in ("a", "b") for i in range(200)]


def test_matches_below_one_half_are_settled_in_turn(spark):
    big = [("s", v, 3001) for v in range(300)] + [("s", v, 3002) for v in range(300, 600)]
    gt = spark.createDataFrame(big, "scan_id string, vertex_id bigint, id bigint")
    masks = spark.createDataFrame([("s", 1, v) for v in range(120, 480)], "scan_id string, pred_id bigint, vertex_id bigint")
    preds = spark.createDataFrame([("s", 1, 3, 0.9)], "scan_id string, pred_id bigint, label_id bigint, conf double")
    inst, pred = ev.gt_instances(gt, [3]), ev.pred_instances(preds, masks, gt, [3])
    shared = ev.intersections(pred, masks, gt, inst)
    found = ev.matches(pred, inst, shared, [0.25, 0.5])
    assert rows(found, "overlap", "score", "is_true", "n") == [(0.25, 0.9, True, 1), (0.25, None, None, 1), (0.5, 0.9, False, 1), (0.5, None, None, 2)]
    both = ev.matches(pred, inst, shared, [0.25], visited=False)
    assert rows(both, "score", "is_true") == [(0.9, True), (0.9, True)]


def test_ap_of_ignored_missing_and_undefined_classes(spark):
    gt = spark.createDataFrame([("s", v, 3001) for v in range(150)] + [("s", v, 0) for v in range(150, 400)], "scan_id string, vertex_id bigint, id bigint")
    masks = spark.createDataFrame([("s", 1, v) for v in range(150, 300)], "scan_id string, pred_id bigint, vertex_id bigint")
    preds = spark.createDataFrame([("s", 1, 3, 0.9), ("s", 2, 77, 0.5)], "scan_id string, pred_id bigint, label_id bigint, conf double")
    inst, pred = ev.gt_instances(gt, [3, 4]), ev.pred_instances(preds, masks, gt, [3, 4])
    found = ev.matches(pred, inst, ev.intersections(pred, masks, gt, inst), [0.5])
    assert rows(found, "score", "n") == [(None, 1)]  # the prediction lies on nothing and is ignored
    ap = ev.average_precision(found, pred, inst, spark.createDataFrame([(3,), (4,)], "label_id bigint"), [0.5])
    assert rows(ap, "label_id", "ap") == [(3, 0.0), (4, None)]


def test_painting_overlaps_and_gaps(spark):
    seg = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 2, 9), ("b", 0, 1)], "scan_id string, vertex_id int, seg_id bigint")
    groups = spark.createDataFrame([("a", 0, 0, 0, "chair", [1, 2]), ("a", 1, 1, 1, "table", [2, 77]), ("a", 2, 2, 2, "x", [])], "scan_id string, group_pos int, id int, object_id int, label string, segments array<bigint>")
    assert rows(lb.paint_instances(seg, groups), "scan_id", "vertex_id", "value") == [("a", 0, 1), ("a", 1, 2), ("a", 2, 0), ("b", 0, 0)]


def test_predicates(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, None, 7), (3, "y", None)], "id int, a string, n int")
    find = lambda q: [r.id for r in ix.find(df, q).orderBy("id").collect()]
    assert find({"a": {"$ne": "x"}}) == [2, 3] and find({"a": None}) == [2] and find({"n": {"$gt": 5}}) == [2]
    assert find({"$or": [{"a": "x"}, {"n": {"$exists": "false"}}]}) == [1, 3] and find({"a": {"$nin": ["x"]}}) == [2, 3] and find({"_": 1, "$limit": 3}) == [1, 2, 3]


def test_components_of_chains_and_several_scans(spark):
    pairs = spark.createDataFrame([("a", i, i + 1) for i in range(50)] + [("b", 7, 3), ("b", 3, 3), ("b", 90, 91)], "scan_id string, a bigint, b bigint")
    got = {(r.scan_id, r.node): r.root for r in ms.components(pairs).collect()}
    assert {v for (s, _), v in got.items() if s == "a"} == {0} and got["b", 7] == 3 and got["b", 91] == 90


def test_cleaning_a_mesh(spark):
    v = spark.createDataFrame([("a", i, float(x), 0.0, 0.0) for i, x in enumerate((0, 1, 2, 2.001, 5))], "scan_id string, vertex_id bigint, x double, y double, z double")
    f = spark.createDataFrame([("a", 0, 0, 1, 2), ("a", 1, 1, 2, 3), ("a", 2, 2, 0, 1), ("a", 3, 0, 1, 3)], "scan_id string, face_id bigint, v0 bigint, v1 bigint, v2 bigint")
    kept, faces = ms.merge_close(v, f, 0.01)
    assert rows(kept, "vertex_id") == [(0,), (1,), (2,), (4,)] and rows(faces, "face_id") == [(0,), (2,), (3,)]
    assert rows(ms.distinct_faces(faces), "face_id") == [(0,)] and rows(ms.referenced(kept, faces), "vertex_id") == [(0,), (1,), (2,)]


def test_nearest_vertex_beyond_the_first_radius(spark):
    kind = "scan_id int, vertex_id bigint, x double, y double, z double"
    t, s = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (0, 2, 50.0, 0.0, 0.0)], kind), spark.createDataFrame([(0, 9, 0.1, 0.0, 0.0), (0, 8, 9.0, 0.0, 0.0)], kind)
    assert rows(sp.nearest_vertex(t, s, 0.5), "vertex_id", "nearest") == [(1, 9), (2, 8)]


def test_segmentation_of_two_flat_parts(spark):
    w = [("a", i, i + 1, 0.0) for i in range(10)] + [("a", i, i + 1, 0.0) for i in range(20, 30)] + [("a", 10, 20, 0.9)]
    got = ms.over_segment(spark.createDataFrame(w, "scan_id string, a bigint, b bigint, w double"), 0.01, 2)
    assert {r.seg_id for r in got.collect()} == {0, 20}


def test_text_files(spark, tmp_path):
    (tmp_path / "scene0001_00.txt").write_text("5\n7\n\n9\n")
    assert rows(fl.read_ids(spark, str(tmp_path)), "scan_id", "vertex_id", "id") == [("scene0001_00", 0, 5), ("scene0001_00", 1, 7), ("scene0001_00", 2, None), ("scene0001_00", 3, 9)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "map.tsv").write_text("id\traw_category\tnyu40id\n1\tchair\t5\n2\tchair\t6\n3\t\t7\n4\tbed\n")
    assert rows(fl.read_label_map(spark, str(tmp_path / "m"), "raw_category", "nyu40id"), "key", "target") == [("bed", None), ("chair", "6")]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "s1.aggregation.json").write_text('{"segGroups": [{"id": "3", "objectId": 4, "segments": [1, "2"], "label": "a:b"}, {"id": null, "objectId": 0, "segments": [], "label": ""}]}')
    assert rows(fl.read_aggregation(spark, str(tmp_path / "a")), "scan_id", "group_pos", "id", "object_id", "segments") == [("s1", 0, 3, 4, [1, 2]), ("s1", 1, None, 0, [])]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "0.pose.txt").write_text(" ".join(map(str, range(16))) + "\n")
    (tmp_path / "p" / "1.pose.txt").write_text("1 2 3")
    assert sorted(r.matrix is None for r in fl.read_matrices(spark, str(tmp_path / "p")).collect()) == [False, True]
    assert {r.name for r in fl.listing(spark, str(tmp_path / "p")).collect()} == {"0.pose.txt", "1.pose.txt"}


def test_sensor_streams(spark, tmp_path):
    eye = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
    head = {"name": "dev", "k_color": eye, "e_color": eye, "k_depth": eye, "e_depth": eye, "color_compression": 2, "depth_compression": 1, "color_width": 4, "color_height": 2, "depth_width": 3, "depth_height": 2, "depth_shift": 1000.0}
    depth = struct.pack("<6H", 0, 1, 2, 3, 4, 65535)
    sens.write_stream(str(tmp_path / "scene1.sens"), head, [(eye, 10, 11, b"jpg", zlib.compress(depth)), (eye, 20, 21, b"", b"")], [([float(i) for i in range(15)], 15)])
    spark.dataSource.register(sens.SensSource)
    read = lambda t: spark.read.format("sens").option("table", t).load(str(tmp_path))
    assert rows(read("frames"), "scan_id", "frame_id", "ts_color", "ts_depth") == [("scene1", 0, 10, 11), ("scene1", 1, 20, 21)]
    imu = read("imu").collect()
    assert len(imu) == 1 and imu[0].ts == 15 and imu[0].gravity.z == 14.0 and read("sensors").first().depth_width == 3
    assert [r.d for r in sens.depth_pixels(read("frames"), 3, 2).orderBy("y", "x").collect()] == [0, 1, 2, 3, 4, 65535]


def test_ranges_of_a_stream(spark, tmp_path):
    eye = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
    head = {"name": "dév", "k_color": eye, "e_color": eye, "k_depth": eye, "e_depth": eye, "color_compression": 2, "depth_compression": 0, "color_width": 4, "color_height": 2, "depth_width": 3, "depth_height": 2, "depth_shift": 1000.0}
    for scan, n in (("a", 57), ("b", 1), ("c", 0)):
        sens.write_stream(f"{tmp_path}/in/{scan}.sens", head, [(eye, i, 2 * i, b"c" * (i % 5), b"d" * (i * 7 % 11)) for i in range(n)], [([0.5] * 15, i) for i in range(n)])
    want = [(s, i, i, 2 * i, b"c" * (i % 5), b"d" * (i * 7 % 11)) for s, n in (("a", 57), ("b", 1)) for i in range(n)]
    assert sens.write_index(spark, f"{tmp_path}/in", f"{tmp_path}/index") == 3
    get = lambda df: sorted((r.scan_id, r.frame_id, r.ts_color, r.ts_depth, bytes(r.color), bytes(r.depth)) for r in df.collect())
    for splits in (1, 3, 100):
        for index in (None, f"{tmp_path}/index"):
            df = sens.read(spark, f"{tmp_path}/in", splits=splits, index=index)
            assert get(df) == want and df.rdd.getNumPartitions() == 3 * splits
    assert sens.read(spark, f"{tmp_path}/in", "imu", index=f"{tmp_path}/index").count() == sens.read(spark, f"{tmp_path}/in", "imu").count() == 58
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    some = sens.read(spark, f"{tmp_path}/in", splits=4, index=f"{tmp_path}/index").where("scan_id = 'a' AND frame_id >= 20 AND frame_id < 23")
    assert get(some) == want[20:23] and some.rdd.getNumPartitions() == 4
    assert get(sens.read(spark, f"{tmp_path}/in").where("scan_id IN ('b', 'x') AND frame_id <= 9 AND ts_color < 5")) == want[57:]
    assert sens.read(spark, f"{tmp_path}/in").where("scan_id = 'z'").count() == 0
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    r = sens._Pruned(f"{tmp_path}/in", "frames", 100, f"{tmp_path}/index")
    assert list(r.pushFilters([sens.EqualTo(("scan_id",), "a"), sens.GreaterThan(("frame_id",), 50), sens.EqualTo(("ts_color",), 3)])) == [sens.EqualTo(("ts_color",), 3)]
    assert {p.path.rpartition("/")[2] for p in r.partitions()} == {"a.sens"} and [x[1] for p in r.partitions() for x in r.read(p)] == list(range(51, 57))
    data = (tmp_path / "in" / "a.sens").read_bytes()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.sens").write_bytes(data[:2500])
    with pytest.raises(Exception, match="ends within|unpack"):
        sens.read(spark, f"{tmp_path}/cut").collect()


@pytest.mark.parametrize(("n", "want"), [(0, "0.0B"), (1023, "1023.0B"), (1536, "1.5KiB"), (5 * 1024**3, "5.0GiB")])
def test_natural_size(spark, n, want):
    assert spark.range(1).select(sc.natural_size(F.lit(float(n))).alias("s")).first().s == want


def test_malformed_durations_and_names(spark):
    df = spark.createDataFrame([("1:02:03.5",), ("x",), ("1:2",)], "t string")
    assert [r.s for r in df.select(sc.duration_seconds(F.col("t")).alias("s")).collect()] == [3723.5, None, None]
    names = spark.createDataFrame([("kitchen_2",), ("bath-1 ",), ("room",), ("r2d2",)], "t string")
    assert [r.s for r in names.select(sc.scene_name(F.col("t")).alias("s")).collect()] == ["kitchen", "bath", "room", "r2d"]


def test_old_state_leaves_the_streams(spark, tmp_path):
    from scanloom.streaming import streams as st

    files = ["a.depth", "a.imu", "b.txt"], ["c.txt", "a.depth"], ["d.jpg"], ["d.jpg"], ["a.jpg", "e.exe"]
    for n, names in enumerate(files):
        hours = F.expr(f"timestamp'2024-01-01 00:00:00' + INTERVAL {3 * n} HOURS")
        spark.createDataFrame([(x, "Time=0:00:02.5 for fuse, cmd=x") for x in names], "file string, value string").withColumn("ts", hours).withColumn("scan_id", F.lit(None).cast("string")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    schema = "file string, value string, ts timestamp, scan_id string"

    def progress(stream, keys):
        out = []

        def put(batch, n):
            out.extend(tuple(r[k] for k in keys) for r in batch.collect())

        q = stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{tmp_path}/{keys[-1]}").trigger(availableNow=True).start()
        q.awaitTermination()
        return out, [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]

    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out, kept = progress(st.completed_uploads(read().drop("value"), "1 hour", files=2), ["scan_id", "files", "done"])
    assert [x for x in out if x[0] == "a"][0] == ("a", 2, True) and ("a", 1, False) in out  # what comes late begins anew
    assert max(kept) < 4 and kept[-1] <= 2
    lines = read().select(F.col("ts") + F.expr("make_interval(0, 0, 0, 2 * (hour(ts) div 3))"), "value", F.lit("s").alias("scan_id")).toDF("ts", "value", "scan_id")
    days, kept = progress(st.live_timings(lines, "1 hour"), ["scan_id", "day", "seconds"])
    assert kept[-1] < len({d for _, d, _ in days})
    last = {(s, d): x for s, d, x in days}
    assert sum(last.values()) == 2.5 * sum(map(len, files))


def test_changes_of_a_stream_are_put_into_the_index(spark, tmp_path):
    from scanloom.streaming import streams as st

    for n, rows in enumerate(([(1, 1, "a"), (1, 2, "b"), (9, 1, "new")], [(1, 1, "c"), (3, 5, "d")])):
        spark.createDataFrame(rows, "id int, ts int, name string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("id int, ts int, name string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    st.reindex(stream, f"{tmp_path}/changes", f"{tmp_path}/c").awaitTermination()
    index = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    got = st.reindexed(index, spark.read.parquet(f"{tmp_path}/changes"))
    assert sorted(map(tuple, got.collect())) == [(1, "c"), (2, "y"), (3, "d"), (9, "new")]


def test_batches_rewrite_the_buckets_they_touch(spark, tmp_path):
    from scanloom.streaming import bucketed as bk

    schema, at = "id bigint, name string", f"file://{tmp_path}/index"
    index = spark.createDataFrame([(i, f"old{i}") for i in range(200)], schema)
    bk.create(index, at, 32)
    get = lambda: {r.id: r.name for r in bk.read(spark, at, schema).collect()}
    want = {i: f"old{i}" for i in range(200)}
    assert get() == want
    change = lambda *rows: spark.createDataFrame(list(rows), "id bigint, ts bigint, name string")
    before = {r.bucket: r.path for r in bk.manifest(spark, at).collect()}
    assert bk.put(change((7, 1, "a"), (7, 3, "c"), (7, 2, "b"), (1000, 1, "new")), at, 0, "ts", schema) in (1, 2)
    want |= {7: "c", 1000: "new"}
    after = {r.bucket: r.path for r in bk.manifest(spark, at).collect()}
    assert get() == want and 0 < sum(before.get(k) != v for k, v in after.items()) <= 2
    assert bk.put(change((7, 9, "again")), at, 0, "ts", schema) == 0 and get() == want  # a repeated batch
    assert bk.put(change(), at, 1, "ts", schema) == 0 and get() == want
    assert bk.put(change((None, 1, "none"), (8, 1, None)), at, 2, "ts", schema) >= 1
    assert get() == want | {None: "none", 8: None}
    assert bk.vacuum(spark, at) >= 2 and get() == want | {None: "none", 8: None} and bk.vacuum(spark, at) == 0
    with pytest.raises(FileNotFoundError):
        bk.read(spark, f"file://{tmp_path}/nowhere", schema)
    bk.create(spark.createDataFrame([], schema), f"file://{tmp_path}/empty", 4)
    assert bk.read(spark, f"file://{tmp_path}/empty", schema).count() == 0
    assert bk.put(change((1, 1, "x")), f"file://{tmp_path}/empty", 0, "ts", schema) == 1


def test_shared_folder(spark, tmp_path):
    from scanloom.operators import tables

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            tables.local_folder(master, "app")
    assert tables.local_folder("local[4]", "app").startswith("file:///")
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=spark.sparkContext)
    assert str(tmp_path) in tables.fresh_path(unset, "x")
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "hdfs://named/"), sparkContext=None)
    assert tables.fresh_path(named, "x").startswith("hdfs://named/x-")


def test_stencils_across_tiles_with_holes_and_nulls(spark):
    import math
    import random

    from scanloom.operators import pixels as px

    rng = random.Random(3)
    at = [(f, y, x) for f in ("a", "b") for y in range(60, 70) for x in range(120, 134) if rng.random() < 0.8]
    grid = {p: (rng.choice([None, 1, 2, 3]), rng.choice([None, 0.1, 0.2, 0.5]), rng.choice([0.3, 0.35, None])) for p in at}
    df = spark.createDataFrame([(*p, *v) for p, v in grid.items()], "frame_key string, y int, x int, instance int, depth double, intensity double")
    near = lambda p, r: [(q, grid[q]) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if (q := (p[0], p[1] + dy, p[2] + dx)) in grid]
    got = {(r.frame_key, r.y, r.x): r.label for r in px.without_isolated(df.withColumnRenamed("instance", "label"), 2, 0.3).collect()}
    same = lambda p: sum((v[0] or 0) == (grid[p][0] or 0) for _, v in near(p, 2)) >= 0.3 * len(near(p, 2))
    assert got == {p: (v[0] or 0) if same(p) else 0 for p, v in grid.items()}
    weight = lambda p, q: math.exp(-((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) / 2)
    got = {(r.frame_key, r.y, r.x): r.depth for r in px.bilateral(df, 1.0, 0.1, "depth").collect()}
    assert set(got) == {p for p, v in grid.items() if v[1] is not None}
    for p, x in got.items():
        w = [(weight(p, q) * math.exp(-((v[1] - grid[p][1]) ** 2) / 0.02), v[1]) for q, v in near(p, 2) if v[1] is not None]
        assert abs(x - sum(a * b for a, b in w) / sum(a for a, _ in w)) < 1e-9
    got = {(r.frame_key, r.y, r.x): r.instance for r in px.vote(df, 3, 2.0).collect()}
    gap = lambda a, b: 0.0 if a is None or b is None else a - b
    for p, v in grid.items():
        votes = {}
        for q, u in near(p, 3):
            w = math.exp(-((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) / 50 - (gap(u[1], v[1]) ** 2 + 4 * gap(u[2], v[2]) ** 2) / 0.02)
            votes[u[0] or 0] = votes.get(u[0] or 0, 0) + w
        assert got[p] == min(votes, key=lambda i: (-round(votes[i], 9), i))
    empty = df.where("y < 0")
    assert px.vote(empty, 3, 2.0).count() == px.bilateral(empty, 1.0, 0.1, "depth").count() == px.two_pass(empty, (32, 32), (16, 16)).count() == 0


def test_aligned_finds_the_floor(spark):
    """A floor tilted against the up-vector becomes level; a table above it is larger but has points behind."""
    import math

    from scanloom.operators import alignment as al

    c, s = math.cos(0.2), math.sin(0.2)
    flat = [(0, x / 4, y / 3, 0.0) for x in range(12) for y in range(10)] + [(1, x / 9, y / 9, 1.0) for x in range(14) for y in range(12)]
    rows = [(7, k, c * x + s * z, y, -s * x + c * z, s, 0.0, c) for k, x, y, z in flat]
    points = spark.createDataFrame(rows, "scan_id int, kind int, x double, y double, z double, nx double, ny double, nz double")
    up = spark.createDataFrame([(7, 0.0, 0.0, 1.0)], "scan_id int, ux double, uy double, uz double")
    scans = spark.createDataFrame([(7, True, True, False)], "scan_id int, processed boolean, valid boolean, aligned boolean")
    got = al.aligned(points, up, scans, least=50).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.z - r.kind) < 1e-9 and abs(r.nz - 1) < 1e-9
    assert [r.n for r in al.largest(al.plane_clusters(points, 50), 1).collect()] == [168]
    assert al.aligned(points, up, scans, least=500).count() == len(rows)


def test_frames_of_a_folder(spark, tmp_path):
    for name, data in (("s1/frame-000001.color.jpg", b"c1"), ("s1/frame-000001.depth.pgm", b"d1"), ("s1/frame-000001.pose.txt", b"1 0"), ("s1/frame-000002.color.png", b"c2"), ("s2/frame-000007.pose.txt", b"p"), ("s2/_info.txt", b"x"), ("s2/frame-7.other.txt", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = sorted((r.scan_id, r.frame_id, *(None if x is None else bytes(x) for x in (r.color, r.depth, r.pose))) for r in sens.imported_frames(spark, str(tmp_path)).collect())
    assert got == [("s1", 1, b"c1", b"d1", b"1 0"), ("s1", 2, b"c2", None, None), ("s2", 7, None, None, b"p")]
