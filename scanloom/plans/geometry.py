"""Queries on points, voxels, depth pixels and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import alignment as al
from ..operators import geometry as ge
from ..operators import pixels as px
from ..operators import spatial as sp
from . import bindings as b
from .registry import query

_M = [0.0, -1.0, 0.0, 2.0, 1.0, 0.0, 0.0, -3.0, 0.0, 0.0, 1.0, 0.5, 0.01, 0.0, 0.0, 2.0]


def _xyz(df: DataFrame, *more: str) -> DataFrame:
    return df.select("scan_id", "vertex_id", *more, *((F.round(c, 6) + 0.0).alias(c) for c in ("x", "y", "z")))


def _matrices(spark: SparkSession, m: list[float], scans: range = range(0, 10)) -> DataFrame:
    return spark.createDataFrame([(s, m) for s in scans], "scan_id int, matrix array<double>")


@query(f"WITH {b.POINTS_SQL} SELECT scan_id, vertex_id, round((2 - y) / (0.01 * x + 2), 6) + 0.0 AS x, round((x - 3) / (0.01 * x + 2), 6) + 0.0 AS y, round((z + 0.5) / (0.01 * x + 2), 6) + 0.0 AS z FROM pts")
def geo1_transform_points(spark: SparkSession, d: str) -> DataFrame:
    return _xyz(ge.transform(b.points(spark, d), _matrices(spark, _M)))


@query(f"WITH {b.POINTS_SQL} SELECT scan_id, vertex_id, round(CASE WHEN scan_id < 5 THEN 2 - y ELSE x END, 6) + 0.0 AS x, round(CASE WHEN scan_id < 5 THEN x - 3 ELSE y END, 6) + 0.0 AS y, round(CASE WHEN scan_id < 5 THEN z + 0.5 ELSE z END, 6) + 0.0 AS z FROM pts")
def geo2_axis_alignment(spark: SparkSession, d: str) -> DataFrame:
    """From text properties, identity where a scan has none."""
    from ..sources.files import numbers

    text = spark.createDataFrame([(s, "0 -1 0 2 1 0 0 -3 0 0 1 .5 0 0 0 1") for s in range(5)], "scan_id int, value string")
    return _xyz(ge.transform(b.points(spark, d), text.select("scan_id", numbers(F.col("value")).alias("matrix")), divide=False))


@query("SELECT event_id AS frame_id, CASE WHEN event_id % 10 = 0 THEN -1 ELSE round(-sin(event_id % 16 * 0.39) * -1, 6) + 0.0 END AS m00, CASE WHEN event_id % 10 = 0 THEN -1 ELSE 2 END AS m03 FROM events WHERE event_type = 'view'")
def geo3_move_trajectory(spark: SparkSession, d: str) -> DataFrame:
    from .sensors import frames

    t = F.array(*(F.lit(x) for x in [*_M[:12], 0.0, 0.0, 0.0, 1.0]))
    moved = ge.move_trajectory(frames(spark, d), t)
    cell = lambda i: F.when(F.col("pose")[i] == float("-inf"), -1.0).otherwise(F.round(F.col("pose")[i], 6) + 0.0)
    return moved.select("frame_id", cell(0).alias("m00"), cell(3).cast("int").alias("m03"))


@query(f"WITH {b.POINTS_SQL}, bb AS (SELECT scan_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, min(z) AS e FROM pts GROUP BY 1) SELECT scan_id, vertex_id, round(x - (a + b) / 2, 6) + 0.0 AS x, round(y - (c + d) / 2, 6) + 0.0 AS y, round(z - e, 6) + 0.0 AS z FROM pts JOIN bb USING (scan_id)")
def agg31_bbox_shift(spark: SparkSession, d: str) -> DataFrame:
    return _xyz(ge.floored(b.points(spark, d)))


@query(f"WITH {b.POINTS_SQL} SELECT scan_id, floor(x / 0.8)::bigint AS ix, floor(y / 0.8)::bigint AS iy, floor(z / 0.8)::bigint AS iz, min(vertex_id) AS vertex_id, count(*) AS n FROM pts GROUP BY 1, 2, 3, 4")
def geo9_voxel_quantise(spark: SparkSession, d: str) -> DataFrame:
    return ge.voxel_quantise(b.points(spark, d), 0.8)


_GRID = "g AS (SELECT scan_id, vertex_id, greatest(0, least(floor(x * 2 + 3), 7))::bigint AS ix, greatest(0, least(floor(y * 2 + 3), 7))::bigint AS iy, greatest(0, least(floor(z * 2 + 3), 7))::bigint AS iz FROM pts)"


@query(f"WITH {b.POINTS_SQL}, {_GRID}, v AS (SELECT DISTINCT scan_id, ix, iy, iz FROM g WHERE vertex_id % 3 = 0) SELECT g.scan_id, vertex_id, CASE WHEN v.ix IS NULL THEN 0 ELSE g.ix + 10 * g.iy + 100 * g.iz + 1 END AS value FROM g LEFT JOIN v USING (scan_id, ix, iy, iz)")
def jn17_voxel_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = b.points(spark, d)
    cell = lambda c: F.greatest(F.lit(0), F.least(F.floor(F.col(c) * 2 + 3), F.lit(7))).cast("bigint").alias(f"i{c}")
    v = p.where("vertex_id % 3 = 0").select("scan_id", *map(cell, "xyz")).distinct().withColumn("value", F.expr("ix + 10 * iy + 100 * iz + 1"))
    m = [2.0, 0.0, 0.0, 3.0, 0.0, 2.0, 0.0, 3.0, 0.0, 0.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0]
    grids = _matrices(spark, m).select("scan_id", F.col("matrix").alias("world2grid"), *(F.lit(8).alias(f"n{c}") for c in "xyz"))
    return ge.voxel_lookup(p, v, grids).select("scan_id", "vertex_id", "value")


@query("WITH q AS (SELECT vec_id AS query_id, embedding::double[] AS v FROM embeddings WHERE vec_id % 10 = 0), r AS (SELECT query_id, vec_id AS id, list_distance(v, embedding::double[]) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(v, embedding::double[]), vec_id) AS rank FROM q, embeddings) SELECT query_id, rank, id, round(distance, 6) AS distance FROM r WHERE rank <= 5")
def jn14_knn_retrieval(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "embeddings").selectExpr("vec_id AS id", "cast(embedding AS array<double>) AS vec")
    q = e.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    return sp.k_nearest(q, e, 5).select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


_OBJ = "vertex_id % 2 = 1 AND vertex_id % 7 <> 0"


@query(f"""WITH {b.POINTS_SQL}, one AS (SELECT * FROM pts), src AS (SELECT * FROM one WHERE {_OBJ}), c AS (SELECT t.vertex_id, s.vertex_id % 7 AS o, t.vertex_id % 4 = s.vertex_id % 4 OR s.vertex_id % 3 = 0 AS fits, sqrt(power(t.x - s.x, 2) + power(t.y - s.y, 2) + power(t.z - s.z, 2)) AS d, s.vertex_id AS sid FROM one t JOIN src s ON t.vertex_id % 2 = 0 AND abs(t.x - s.x) <= 1 AND abs(t.y - s.y) <= 1 AND abs(t.z - s.z) <= 1),
k AS (SELECT *, row_number() OVER (PARTITION BY vertex_id ORDER BY d, sid) AS k FROM c WHERE d <= 1), b AS (SELECT vertex_id, arg_min(o, k) FILTER (fits) AS first, count(*) AS n, min(o) AS lo, max(o) AS hi FROM k WHERE k <= 3 GROUP BY 1)
SELECT 0 AS scan_id, t.vertex_id, coalesce(first, CASE WHEN n = 3 AND lo = hi THEN lo END, 0) AS object_id FROM one t LEFT JOIN b USING (vertex_id) WHERE t.vertex_id % 2 = 0""")
def jn15_transfer_labels(spark: SparkSession, d: str) -> DataFrame:
    p = b.one_cloud(spark, d)
    # normals: four directions by id; those of sources divisible by three are not of unit length and fit most
    t = p.where("vertex_id % 2 = 0").withColumn("m", F.expr("vertex_id % 4"))
    s = p.where(_OBJ).withColumn("m", F.expr("vertex_id % 4")).withColumn("object_id", F.expr("vertex_id % 7"))
    dirs = {0: (1.0, 0.0, 0.0), 1: (0.0, 1.0, 0.0), 2: (0.0, 0.0, 1.0), 3: (-1.0, 0.0, 0.0)}
    axis = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in dirs.items() for x in (k, v[i]))), F.col("m").cast("int"))
    t = t.withColumns({f"n{c}": axis(i) for i, c in enumerate("xyz")})
    s = s.withColumns({f"n{c}": F.when(F.expr("vertex_id % 3 = 0"), F.lit(v)).otherwise(axis(i)) for i, (c, v) in enumerate(zip("xyz", (2.0, 0.0, 2.0), strict=True))})
    return sp.transfer_labels(s, t, 1.0).select("scan_id", "vertex_id", "object_id")


@query(f"WITH {b.POINTS_SQL}, k AS (SELECT t.vertex_id, s.vertex_id AS nearest, sqrt(power(t.x - s.x, 2) + power(t.y - s.y, 2) + power(t.z - s.z, 2)) AS distance, row_number() OVER (PARTITION BY t.vertex_id ORDER BY sqrt(power(t.x - s.x, 2) + power(t.y - s.y, 2) + power(t.z - s.z, 2)), s.vertex_id) AS k FROM pts t, pts s WHERE t.vertex_id % 2 = 0 AND s.vertex_id % 2 = 1) SELECT 0 AS scan_id, vertex_id, nearest, round(distance, 6) AS distance FROM k WHERE k = 1")
def jn16_nearest_vertex(spark: SparkSession, d: str) -> DataFrame:
    p = b.one_cloud(spark, d)
    return sp.nearest_vertex(p.where("vertex_id % 2 = 0"), p.where("vertex_id % 2 = 1"), 0.3).select("scan_id", "vertex_id", "nearest", F.round("distance", 6).alias("distance"))


_CAL = "c AS (SELECT l_orderkey AS frame_id, min(l_partkey) % 64 AS x, min(l_suppkey) % 48 AS y, sum(l_quantity) / 50.0 AS observed, sum(l_quantity) / 50.0 * (1 + (min(l_partkey) % 7) / 100.0) AS real FROM lineitem GROUP BY 1)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    li = b.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("frame_id")).agg(F.expr("min(l_partkey) % 64").alias("x"), F.expr("min(l_suppkey) % 48").alias("y"), F.expr("sum(l_quantity) / 50.0D").alias("observed"), F.expr("sum(l_quantity) / 50.0D * (1 + (min(l_partkey) % 7) / 100.0D)").alias("real"))
    return li


_LUT = f"{_CAL}, fit AS (SELECT x // 2 AS ix, y // 2 AS iy, floor(observed / 8.0 * 10)::int AS iz, sum(observed * real) / nullif(sum(real * real), 0) AS mult FROM c WHERE floor(observed / 8.0 * 10) BETWEEN 1 AND 9 GROUP BY ALL), grid AS (SELECT a.ix, b.iy, c.iz FROM (SELECT unnest(range(32)) AS ix) a, (SELECT unnest(range(24)) AS iy) b, (SELECT unnest(range(10)) AS iz) c), lut AS (SELECT grid.ix, grid.iy, grid.iz, coalesce(mult, 1.0) AS mult FROM grid LEFT JOIN fit ON fit.ix = least(grid.ix, 23) AND fit.iy = grid.iy AND fit.iz = grid.iz)"


@query(f"WITH {_LUT} SELECT ix, iy, iz, round(mult, 6) AS mult FROM lut")
def agg28_lut_fit(spark: SparkSession, d: str) -> DataFrame:
    return ge.lut_fit(_pairs(spark, d), 32, 24, 10, 8.0).select("ix", "iy", "iz", F.round("mult", 6).alias("mult"))


@query(f"""WITH {_LUT}, p AS (SELECT frame_id, x, y, observed AS d, x / 2.0 AS ax, y / 2.0 AS ay, observed / 8.0 * 10 AS az FROM c),
q AS (SELECT *, least(floor(ax), 31)::int AS x0, least(floor(ay), 23)::int AS y0, least(floor(az), 9)::int AS z0, CASE WHEN floor(ax) >= 31 THEN 0 ELSE ax - floor(ax) END AS fx, CASE WHEN floor(ay) >= 23 THEN 0 ELSE ay - floor(ay) END AS fy, CASE WHEN floor(az) >= 9 THEN 0 ELSE az - floor(az) END AS fz FROM p),
e AS (SELECT q.*, least(x0 + i, 31) AS jx, least(y0 + j, 23) AS jy, least(z0 + k, 9) AS jz, (CASE i WHEN 1 THEN fx ELSE 1 - fx END) * (CASE j WHEN 1 THEN fy ELSE 1 - fy END) * (CASE k WHEN 1 THEN fz ELSE 1 - fz END) AS w FROM q, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j), (VALUES (0), (1)) cc(k))
SELECT frame_id, round(any_value(d) / sum(w * mult), 6) AS d FROM e JOIN lut ON lut.ix = jx AND lut.iy = jy AND lut.iz = jz GROUP BY frame_id""")
def jn18_lut_apply(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    lut = ge.lut_fit(p, 32, 24, 10, 8.0)
    return ge.lut_apply(p.select("frame_id", "x", "y", F.col("observed").alias("d")), lut, (32, 24, 10), 8.0).select("frame_id", F.round("d", 6).alias("d"))


def _depth(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "events").selectExpr("0 AS scan_id", "event_id div 1024 AS frame_id", "event_id div 32 % 32 AS y", "event_id % 32 AS x", "cast(CASE WHEN event_id % 9 = 0 THEN 0 ELSE event_id * 37 % 4000 END AS int) AS d")


_DEPTH = "dp AS (SELECT 0 AS scan_id, event_id // 1024 AS frame_id, event_id // 32 % 32 AS y, event_id % 32 AS x, CASE WHEN event_id % 9 = 0 THEN 0 ELSE event_id * 37 % 4000 END AS d FROM events)"


@query(f"WITH {_DEPTH} SELECT frame_id, y, x, round(CASE WHEN frame_id % 2 = 0 THEN (x - 16) * d / 1000.0 / 20 ELSE -(y - 16) * d / 1000.0 / 20 + 2 END, 6) + 0.0 AS wx, round(CASE WHEN frame_id % 2 = 0 THEN (y - 16) * d / 1000.0 / 20 ELSE (x - 16) * d / 1000.0 / 20 - 3 END, 6) + 0.0 AS wy, round(CASE WHEN frame_id % 2 = 0 THEN d / 1000.0 ELSE d / 1000.0 + 0.5 END, 6) AS wz FROM dp WHERE d <> 0")
def geo4_back_project(spark: SparkSession, d: str) -> DataFrame:
    dp = _depth(spark, d)
    pose = F.when(F.col("frame_id") % 2 == 0, F.array_repeat(F.lit(float("-inf")), 16)).otherwise(F.array(*(F.lit(x) for x in [*_M[:12], 0.0, 0.0, 0.0, 1.0])))
    frames = dp.select("scan_id", "frame_id").distinct().withColumn("pose", pose)
    r = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return ge.back_project(dp, frames, (20.0, 20.0, 16.0, 16.0)).select("frame_id", "y", "x", r("wx"), r("wy"), r("wz"))


_COLOUR = "SELECT event_id // 1024 AS frame_id, event_id // 32 % 32 AS v, event_id % 32 AS u, event_id % 251 AS r, event_id % 13 AS g, event_id % 7 AS b FROM events WHERE event_id % 17 > 0"


@query(f"""WITH {_DEPTH}, p AS (SELECT *, floor(15 * ((x - 16) * (d / 1000.0) / 20 + 0.3) / (d / 1000.0 + 0.1) + 15 + 0.5) AS u, floor(15 * ((y - 16) * (d / 1000.0) / 20) / (d / 1000.0 + 0.1) + 15 + 0.5) AS v FROM dp WHERE d <> 0)
SELECT frame_id, y, x, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM p LEFT JOIN ({_COLOUR}) c USING (frame_id, u, v)""")
def geo4_coloured_points(spark: SparkSession, d: str) -> DataFrame:
    dp = _depth(spark, d)
    frames = dp.select("scan_id", "frame_id").distinct().withColumn("pose", F.array_repeat(F.lit(float("-inf")), 16))
    colour = b.table(spark, d, "events").where("event_id % 17 > 0").selectExpr("0 AS scan_id", "event_id div 1024 AS frame_id", "event_id div 32 % 32 AS y", "event_id % 32 AS x", "event_id % 251 AS r", "event_id % 13 AS g", "event_id % 7 AS b")
    t = [1, 0, 0, 0.3, 0, 1, 0, 0, 0, 0, 1, 0.1, 0, 0, 0, 1]
    return ge.coloured_points(dp, frames, colour, (20.0, 20.0, 16.0, 16.0), t, (15.0, 15.0, 15.0, 15.0), (32, 32)).select("frame_id", "y", "x", "r", "g", "b")


@query(f"WITH {_DEPTH}, p AS (SELECT frame_id, (x - 16) * (d / 1000.0) / 20 + 0.05 AS px, (y - 16) * (d / 1000.0) / 20 AS py, d / 1000.0 AS pz FROM dp WHERE d > 0), q AS (SELECT frame_id, floor(10 * px / pz + 8 + 0.5)::bigint AS x, floor(10 * py / pz + 8 + 0.5)::bigint AS y, pz FROM p) SELECT frame_id, y, x, round(min(pz), 6) AS z FROM q WHERE x BETWEEN 0 AND 15 AND y BETWEEN 0 AND 15 GROUP BY ALL")
def geo5_reproject_depth(spark: SparkSession, d: str) -> DataFrame:
    t = [1, 0, 0, 0.05, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    out = ge.reproject(_depth(spark, d).withColumn("d", sc.depth_metres(F.col("d"))), (20.0, 20.0, 16.0, 16.0), t, (10.0, 10.0, 8.0, 8.0), (16, 16))
    return out.select("frame_id", "y", "x", F.round("z", 6).alias("z"))


@query(f"""WITH {_DEPTH}, g AS (SELECT i // 32 AS ty, i % 32 AS tx, (i % 32 - 16) / 20.0 AS a, (i // 32 - 16) / 20.0 AS b FROM (SELECT unnest(range(1024)) AS i)), h AS (SELECT *, a * a + b * b AS r FROM g),
s AS (SELECT ty, tx, floor((b * (1 + r * (0.1 + r * -0.02)) + 0.001 * (r + 2 * b * b) + 2 * 0.002 * a * b) * 20 + 16 + 0.5)::bigint AS y, floor((a * (1 + r * (0.1 + r * -0.02)) + 2 * 0.001 * a * b + 0.002 * (r + 2 * a * a)) * 20 + 16 + 0.5)::bigint AS x FROM h)
SELECT frame_id, ty AS y, tx AS x, d AS value FROM dp JOIN s USING (y, x)""")
def geo6_undistort(spark: SparkSession, d: str) -> DataFrame:
    p = _depth(spark, d).withColumnRenamed("d", "value")
    return ge.undistort(p, (20.0, 20.0, 16.0, 16.0), (0.1, -0.02, 0.001, 0.002, 0.0), (32, 32)).select("frame_id", "y", "x", "value")


@query(f"WITH {_DEPTH} SELECT frame_id, y, x, round(2.0 / (0.3 * (x - 16) / 20.0 + 0.95), 6) AS real FROM dp WHERE d > 0 AND frame_id % 3 <> 0")
def geo8_plane_pairs(spark: SparkSession, d: str) -> DataFrame:
    dp = _depth(spark, d)
    planes = dp.select("frame_id").distinct().selectExpr("frame_id", "0.3D AS nx", "0D AS ny", "CASE WHEN frame_id % 3 = 0 THEN 0.5D ELSE 0.95D END AS nz", "2D AS offset")
    return ge.plane_pairs(dp, planes, (20.0, 20.0, 16.0, 16.0)).select("frame_id", "y", "x", F.round("real", 6).alias("real"))


@query("SELECT floor(l_quantity / 7)::bigint AS bin, count(*) AS n FROM lineitem WHERE l_partkey % 10 > 0 GROUP BY 1")
def agg29_depth_bins(spark: SparkSession, d: str) -> DataFrame:
    f = b.table(spark, d, "lineitem").selectExpr("CASE WHEN l_partkey % 10 > 0 THEN 0.95D ELSE 0.2D END AS nz", "l_quantity AS offset")
    return ge.depth_bins(f, 7.0)


_STEPS = "SELECT l_suppkey AS scan_id, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS frame_id, l_partkey % 10 > 0 AS near, l_quantity::double AS o FROM lineitem"


@query(f"SELECT scan_id, greatest(0, coalesce(max(CASE WHEN near THEN o - p END), 0))::double AS step FROM (SELECT *, lag(o) OVER (PARTITION BY scan_id ORDER BY frame_id) AS p FROM ({_STEPS})) GROUP BY 1")
def agg29_greatest_step(spark: SparkSession, d: str) -> DataFrame:
    near = "CASE WHEN l_partkey % 10 > 0 THEN 0.95D ELSE 0.2D END AS nz"
    f = b.table(spark, d, "lineitem").selectExpr("l_suppkey AS scan_id", "(l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS frame_id", near, "cast(l_quantity AS double) AS offset")
    return ge.greatest_steps(f)


def _box_sql(points: str) -> str:
    """(scan_id, angle, area) of the least upright box over all directions between two points: one of the
    hull's sides is among them, and no direction gives less."""
    area = " * ".join(f"(max({c}) - min({c}))" for c in ("x * cos(radians(angle)) - y * sin(radians(angle))", "x * sin(radians(angle)) + y * cos(radians(angle))"))
    return f"""SELECT scan_id, arg_min(angle, (round(area, 9), round(angle, 9))) AS angle, min(area) AS area FROM (
  SELECT p.scan_id, angle, {area} AS area FROM {points} p JOIN (
    SELECT DISTINCT scan_id, a - 90 * floor(a / 90) AS angle FROM (
      SELECT i.scan_id, degrees(-atan2(j.y - i.y, j.x - i.x)) AS a FROM {points} i JOIN {points} j ON i.scan_id = j.scan_id AND i.vertex_id < j.vertex_id AND (i.x <> j.x OR i.y <> j.y)
    )
  ) d USING (scan_id) GROUP BY ALL
) GROUP BY 1"""


@query(f"WITH {b.POINTS_SQL}, e AS ({_box_sql('pts')}) SELECT scan_id, round(angle, 6) AS angle, round(area, 6) AS area FROM e")
def geo13_oriented_box(spark: SparkSession, d: str) -> DataFrame:
    return al.oriented_box(b.points(spark, d)).select("scan_id", F.round("angle", 6).alias("angle"), F.round("area", 6).alias("area"))


@query("SELECT label AS key, 0.0 AS r0, -1.0 AS r1, 1.0 AS r3, 1.0 AS r8, 2.0 AS t0, -3.0 AS t1, 0.5 AS t2 FROM embeddings GROUP BY 1")
def agg34_rigid_transform(spark: SparkSession, d: str) -> DataFrame:
    p = b.points(spark, d)
    pairs = p.selectExpr("scan_id AS key", "x AS x0", "y AS x1", "z AS x2", "2 - y AS y0", "x - 3 AS y1", "z + 0.5D AS y2")
    r = ge.rigid_transforms(pairs)
    n = lambda c, i: (F.round(F.col(c)[i], 6) + 0.0).alias(f"{c}{i}")
    return r.select("key", n("r", 0), n("r", 1), n("r", 3), n("r", 8), n("t", 0), n("t", 1), n("t", 2))


_LEVELS = "a AS (SELECT l_orderkey % 4 AS scan_id, floor(l_extendedprice / 30000)::int AS o, l_partkey % 5 > 0 AS up FROM lineitem), g AS (SELECT scan_id, o, count(*) AS n FROM a WHERE up GROUP BY ALL)"


def _level_points(spark: SparkSession, d: str) -> DataFrame:
    """Points on level planes, four in five with their normal up, the others with it along x."""
    up = "CASE WHEN l_partkey % 5 > 0 THEN 1D ELSE 0D END"
    return b.table(spark, d, "lineitem").selectExpr("l_orderkey % 4 AS scan_id", "CASE WHEN l_partkey % 5 > 0 THEN 0D ELSE 1D END AS nx", "0D AS ny", f"{up} AS nz", "-1D AS x", "0D AS y", "floor(l_extendedprice / 30000) AS z")


@query(f"WITH {_LEVELS}, k AS (SELECT g.scan_id, g.o, any_value(g.n) AS n FROM g LEFT JOIN a ON a.scan_id = g.scan_id AND a.o < g.o WHERE g.n >= 200 GROUP BY ALL HAVING count(a.o) <= 3000) SELECT scan_id, arg_max(o, (n, -o)) AS \"offset\", max(n) AS n FROM k GROUP BY 1")
def geo14_ground_planes(spark: SparkSession, d: str) -> DataFrame:
    return al.ground_planes(_level_points(spark, d), 200, behind=3000).select("scan_id", F.round("offset").cast("int").alias("offset"), "n")


@query(f"WITH {_LEVELS} SELECT scan_id, o AS \"offset\", n FROM g QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, o) <= 2")
def srt6_largest_clusters(spark: SparkSession, d: str) -> DataFrame:
    up = _level_points(spark, d).where("nz > 0")
    return al.largest(al.plane_clusters(up, 1), 2).select("scan_id", F.round("offset").cast("int").alias("offset"), "n")


@query("WITH v AS (SELECT DISTINCT l_partkey % 40 AS ix, l_suppkey % 40 AS iy, l_linenumber AS iz FROM lineitem), c AS (SELECT DISTINCT ix AS cx, iy AS cy FROM v WHERE ix BETWEEN 15 AND 24 AND iy BETWEEN 15 AND 24) SELECT cx, cy, count(*) AS n, sum(iz * (ix - cx)) AS checksum FROM c JOIN v ON abs(ix - cx) <= 15 AND abs(iy - cy) <= 15 GROUP BY ALL")
def geo16_column_samples(spark: SparkSession, d: str) -> DataFrame:
    v = b.table(spark, d, "lineitem").selectExpr("0 AS scan_id", "l_partkey % 40 AS ix", "l_suppkey % 40 AS iy", "l_linenumber AS iz").distinct().withColumn("value", F.lit(1))
    return ge.column_samples(v, extent=(40, 40)).groupBy("cx", "cy").agg(F.count("*").alias("n"), F.sum(F.col("iz") * F.col("dx")).alias("checksum"))


_SHIFT = "('0x' || substr(md5(user_id || ':0:{0}'), 1, 8))::bigint % 7 - 3 AS {0}"


@query(f"""WITH v AS (
  SELECT user_id, value, event_id % 30 + a.ix AS ix, event_id // 30 % 30 + a.iy AS iy, event_id // 900 % 30 + a.iz AS iz
  FROM events JOIN (SELECT user_id, {_SHIFT.format('ix')}, {_SHIFT.format('iy')}, {_SHIFT.format('iz')} FROM (SELECT DISTINCT user_id FROM events)) a USING (user_id)
) SELECT user_id AS sample_id, ix, iy, iz, value FROM v WHERE ix BETWEEN 0 AND 29 AND iy BETWEEN 0 AND 29 AND iz BETWEEN 0 AND 29""")
def geo17_jittered_voxels(spark: SparkSession, d: str) -> DataFrame:
    v = b.table(spark, d, "events").selectExpr("user_id AS sample_id", "event_id % 30 AS ix", "event_id div 30 % 30 AS iy", "event_id div 900 % 30 AS iz", "value")
    return px.jitter(v, 3, 30)


@query(f"WITH {_DEPTH} SELECT frame_id, y, x, ((d >> 3) & 8191) | ((d & 7) << 13) AS rotated, d AS back, round(d / nullif(1000.0, 0), 6) AS metres FROM dp WHERE d > 0")
def scl13_scl10_depth_codes(spark: SparkSession, d: str) -> DataFrame:
    dp = _depth(spark, d).where("d > 0").withColumn("rotated", sc.rotate_depth(F.col("d")))
    return dp.select("frame_id", "y", "x", "rotated", sc.unrotate_depth(F.col("rotated")).alias("back"), F.round(sc.depth_metres(F.col("d")), 6).alias("metres"))


@query("SELECT event_id, event_id % 256 AS r, event_id // 256 % 256 AS g, event_id // 65536 % 256 AS b, round((0.299 * (event_id % 256) + 0.587 * (event_id % 100) + 0.114 * (event_id % 7)) / 255, 6) AS gray FROM events")
def scl12_scl9_colours(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return b.table(spark, d, "events").select("event_id", sc.instance_colour(e).alias("c"), F.round(sc.grayscale(e % 256, e % 100, e % 7), 6).alias("gray")).select("event_id", "c.r", "c.g", "c.b", "gray")


@query("SELECT vec_id, round(1 - 2 * (y * y + z * z), 6) AS m0, round(2 * (x * y - z * w), 6) + 0.0 AS m1, round(1 - 2 * (x * x + y * y), 6) AS m8 FROM (SELECT vec_id, embedding[1]::double / n AS w, embedding[2]::double / n AS x, embedding[3]::double / n AS y, embedding[4]::double / n AS z FROM (SELECT *, sqrt(power(embedding[1]::double, 2) + power(embedding[2]::double, 2) + power(embedding[3]::double, 2) + power(embedding[4]::double, 2)) AS n FROM embeddings))")
def scl14_quaternion_matrix(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "embeddings").selectExpr("vec_id", *(f"cast(embedding[{i}] AS double) AS q{i}" for i in range(4)))
    n = F.sqrt(sum((F.col(f"q{i}") * F.col(f"q{i}") for i in range(1, 4)), F.col("q0") * F.col("q0")))
    m = sc.quaternion_matrix(*(F.col(f"q{i}") / n for i in range(4)))
    return e.select("vec_id", m.alias("m")).select("vec_id", F.round(F.col("m")[0], 6).alias("m0"), (F.round(F.col("m")[1], 6) + 0.0).alias("m1"), F.round(F.col("m")[8], 6).alias("m8"))


@query("SELECT l_linenumber AS scan_id, count(*) FILTER (l_partkey % 7 IN (0, 1, 2)) AS bad FROM lineitem GROUP BY 1")
def flt6_finite_check(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey") % 7
    p = b.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("scan_id"), F.when(k == 0, float("nan")).when(k == 1, float("-inf")).otherwise(1.0).alias("x"), F.when(k == 2, F.lit(None)).otherwise(2.0).alias("y"))
    return ge.not_finite(p, ["x", "y"])


_MOVED = f"""{b.POINTS_SQL}, u AS (SELECT scan_id, vertex_id, x, -z AS y, y AS z FROM pts WHERE scan_id <> 3), g AS ({_box_sql('u')}),
r AS (SELECT scan_id, vertex_id, x * cos(radians(angle)) - y * sin(radians(angle)) AS x, x * sin(radians(angle)) + y * cos(radians(angle)) AS y, z FROM u JOIN g USING (scan_id)),
lo AS (SELECT scan_id, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM r GROUP BY 1)"""


def _unaligned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, up, scans): all scans have y up; one of them is aligned already."""
    p = b.points(spark, d)
    scans = p.select("scan_id").distinct().selectExpr("scan_id", "true AS processed", "true AS valid", "scan_id = 3 AS aligned")
    return p, scans.selectExpr("scan_id", "0D AS ux", "1D AS uy", "0D AS uz"), scans


@query(f"WITH {_MOVED} SELECT scan_id, vertex_id, round(x - lx, 5) + 0.0 AS x, round(y - ly, 5) + 0.0 AS y, round(z - lz, 5) + 0.0 AS z FROM r JOIN lo USING (scan_id)")
def geo15_aligned_scans(spark: SparkSession, d: str) -> DataFrame:
    return al.aligned(*_unaligned(spark, d)).select("scan_id", "vertex_id", *((F.round(c, 5) + 0.0).alias(c) for c in "xyz"))


@query(f"""WITH {_MOVED}, src AS (
  SELECT 'mesh' AS kind, scan_id, vertex_id AS id, x + 1 AS x, y / 2 AS y, z - 2 AS z FROM pts UNION ALL SELECT 'pose', scan_id, vertex_id, x, y, z FROM pts WHERE vertex_id % 5 = 0
), q AS (SELECT kind, s.scan_id, id, angle IS NOT NULL AS todo, coalesce(radians(angle), 0) AS a, x, CASE WHEN angle IS NULL THEN y ELSE -z END AS y, CASE WHEN angle IS NULL THEN z ELSE y END AS z FROM src s LEFT JOIN g USING (scan_id)),
m AS (SELECT kind, q.scan_id, id, x * cos(a) - y * sin(a) - coalesce(lx, 0) AS x, x * sin(a) + y * cos(a) - coalesce(ly, 0) AS y, z - coalesce(lz, 0) AS z FROM q LEFT JOIN lo USING (scan_id))
SELECT kind, scan_id, id, round(CASE WHEN kind = 'pose' AND id % 10 = 0 THEN -1 ELSE x END, 5) + 0.0 AS x, round(CASE WHEN kind = 'pose' AND id % 10 = 0 THEN -1 ELSE y END, 5) + 0.0 AS y, round(CASE WHEN kind = 'pose' AND id % 10 = 0 THEN -1 ELSE z END, 5) + 0.0 AS z FROM m""")
def geo15_transform_table(spark: SparkSession, d: str) -> DataFrame:
    """One table of matrices moves a second mesh of each scan, and its camera poses (half of them invalid)."""
    p, up, scans = _unaligned(spark, d)
    table = al.alignments(p, up, scans)
    mesh = al.moved(p.selectExpr("scan_id", "vertex_id", "x + 1 AS x", "y / 2 AS y", "z - 2 AS z"), table)
    at = [F.lit(1.0), F.lit(0.0), F.lit(0.0), F.col("x"), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.col("y"), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.col("z"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    lost = F.array_repeat(F.lit(float("-inf")), 16)
    poses = p.where("vertex_id % 5 = 0").select("scan_id", "vertex_id", F.when(F.expr("vertex_id % 10 = 0"), lost).otherwise(F.array(*at)).alias("pose"))
    r = lambda c, n: (F.round(F.when(c == float("-inf"), -1.0).otherwise(c), 5) + 0.0).alias(n)
    moved = al.moved_poses(poses, table).select(F.lit("pose").alias("kind"), "scan_id", F.col("vertex_id").alias("id"), *(r(F.col("pose")[4 * i + 3], c) for i, c in enumerate("xyz")))
    return mesh.select(F.lit("mesh").alias("kind"), "scan_id", F.col("vertex_id").alias("id"), *(r(F.col(c), c) for c in "xyz")).union(moved)


@query(f"WITH {_DEPTH}, p AS (SELECT frame_id, x, y, d / 1000.0 / 1.25 AS z FROM dp WHERE d > 0), q AS (SELECT frame_id, x, y, min(z) AS z FROM p GROUP BY ALL) SELECT frame_id, y, x, round(z, 6) AS z FROM q WHERE x % 5 <> 0")
def geo7_calibrated_depth(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain with plain lenses, a table of 1.25 throughout, and every fifth column black."""
    dp = _depth(spark, d)
    depth = dp.select("scan_id", "frame_id", "y", "x", sc.depth_metres(F.col("d")).alias("value")).na.fill(0.0)
    colour = dp.select("scan_id", "frame_id", "y", "x", F.when(F.col("x") % 5 == 0, 0).otherwise(9).alias("value"))
    lut = spark.range(16 * 16 * 4).selectExpr("cast(id % 16 AS int) AS ix", "cast(id div 16 % 16 AS int) AS iy", "cast(id div 256 AS int) AS iz", "1.25D AS mult")
    k, plain, eye = (20.0, 20.0, 16.0, 16.0), (0.0,) * 5, [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    out = ge.calibrated_depth(depth, colour, lut, (16, 16, 4), 8.0, k, plain, k, plain, eye, (32, 32))
    return out.select("frame_id", "y", "x", F.round("z", 6).alias("z"))
