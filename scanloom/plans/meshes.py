"""Queries on meshes and pixel neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mesh as ms
from ..operators import pixels as px
from ..operators import projection as pr
from . import bindings as b
from .registry import query

_ONE = b.MESH_POINTS_SQL
_CORNERS = f"{_ONE}, {b.FACES_SQL}, c AS (SELECT faces.scan_id, face_id, v0, v1, v2, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS cx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS cy, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS cz FROM faces JOIN pts a ON a.vertex_id = v0 JOIN pts b ON b.vertex_id = v1 JOIN pts c ON c.vertex_id = v2)"
_NORMALS = f"{_CORNERS}, u AS (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS m FROM c), e AS (SELECT unnest([v0, v1, v2]) AS vertex_id, cx / m AS nx, cy / m AS ny, cz / m AS nz FROM u WHERE m > 0), nrm AS (SELECT vertex_id, avg(nx) AS nx, avg(ny) AS ny, avg(nz) AS nz FROM e GROUP BY 1)"


@query(f"WITH {_NORMALS} SELECT vertex_id // 100 AS scan_id, vertex_id, round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(nz, 6) + 0.0 AS nz FROM nrm")
def msh1_vertex_normals(spark: SparkSession, d: str) -> DataFrame:
    n = ms.vertex_normals(b.faces(spark, d), b.mesh_points(spark, d))
    return n.select("scan_id", "vertex_id", *((F.round(c, 6) + 0.0).alias(c) for c in ("nx", "ny", "nz")))


_WEIGHTS = f"""{_NORMALS}, ed AS (SELECT face_id, v0 AS a, v1 AS b FROM faces UNION ALL SELECT face_id, v0, v2 FROM faces UNION ALL SELECT face_id, v2, v1 FROM faces),
w AS (SELECT face_id, a, b, 1 - (n1.nx * n2.nx + n1.ny * n2.ny + n1.nz * n2.nz) AS w, n2.nx * (q.x - p.x) + n2.ny * (q.y - p.y) + n2.nz * (q.z - p.z) AS up FROM ed JOIN nrm n1 ON n1.vertex_id = a JOIN nrm n2 ON n2.vertex_id = b JOIN pts p ON p.vertex_id = a JOIN pts q ON q.vertex_id = b)"""


@query(f"WITH {_WEIGHTS} SELECT face_id, a, b, round(CASE WHEN up > 0 THEN w * w ELSE w END, 6) + 0.0 AS w FROM w")
def msh2_edge_weights(spark: SparkSession, d: str) -> DataFrame:
    f, v = b.faces(spark, d), b.mesh_points(spark, d)
    return ms.edge_weights(f, v, ms.vertex_normals(f, v)).select("face_id", "a", "b", (F.round("w", 6) + 0.0).alias("w"))


@query(f"WITH {_CORNERS} SELECT scan_id, v0 % 3 AS seg_id, round(sum(0.5 * sqrt(cx * cx + cy * cy + cz * cz)), 6) AS area FROM c WHERE v0 % 3 = v1 % 3 AND v1 % 3 = v2 % 3 GROUP BY 1, 2")
def agg32_segment_areas(spark: SparkSession, d: str) -> DataFrame:
    v = b.mesh_points(spark, d)
    return ms.segment_areas(b.faces(spark, d), v, v.selectExpr("scan_id", "vertex_id", "vertex_id % 3 AS seg_id")).select("scan_id", "seg_id", F.round("area", 6).alias("area"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Events in tens around their first; the firsts in chains of four."""
    return b.table(spark, d, "events").selectExpr("0 AS scan_id", "event_id AS a", "CASE WHEN event_id % 10 = 0 AND event_id % 40 <> 30 THEN event_id + 10 ELSE event_id - event_id % 10 END AS b")


_LINKS = "l AS (SELECT event_id AS a, CASE WHEN event_id % 10 = 0 AND event_id % 40 <> 30 THEN event_id + 10 ELSE event_id - event_id % 10 END AS b FROM events)"


@query(f"WITH RECURSIVE {_LINKS}, s AS (SELECT a, b FROM l UNION SELECT b, a FROM l), reach(node, r) AS (SELECT DISTINCT a, a FROM s UNION SELECT s.b, reach.r FROM reach JOIN s ON s.a = reach.node) SELECT 0 AS scan_id, node, min(r) AS root FROM reach GROUP BY node")
def msh4_components(spark: SparkSession, d: str) -> DataFrame:
    return ms.components(_links(spark, d))


@query("SELECT event_id AS face_id FROM (SELECT event_id, count(*) OVER (PARTITION BY floor(sqrt(event_id))) AS n FROM events) WHERE n >= 31")
def msh4_drop_small_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Events as faces in strips: strip k begins at k * k and is 2 k + 1 long (the last one may end before)."""
    e = b.table(spark, d, "events").selectExpr("0 AS scan_id", "event_id AS face_id", "event_id AS v1", "cast(floor(sqrt(event_id)) AS bigint) AS k")
    f = e.selectExpr("scan_id", "face_id", "greatest(v1 - 1, k * k) AS v0", "v1", "greatest(v1 - 2, k * k) AS v2")
    return ms.drop_small_pieces(f, 31).select("face_id")


@query(f"WITH {b.FACES_SQL}, k AS (SELECT list_sort([v0, v1, v2]) AS k, min(face_id) AS face_id FROM faces GROUP BY 1) SELECT face_id FROM k")
def set7_distinct_faces(spark: SparkSession, d: str) -> DataFrame:
    return ms.distinct_faces(b.faces(spark, d)).select("face_id")


@query(f"WITH {_ONE}, {b.FACES_SQL} SELECT vertex_id * 2 AS vertex_id FROM pts WHERE vertex_id * 2 IN (SELECT v0 FROM faces UNION SELECT v1 FROM faces UNION SELECT v2 FROM faces)")
def set7_referenced_vertices(spark: SparkSession, d: str) -> DataFrame:
    return ms.referenced(b.mesh_points(spark, d).withColumn("vertex_id", F.col("vertex_id") * 2).withColumn("scan_id", F.expr("vertex_id div 100")), b.faces(spark, d)).select("vertex_id")


@query(f"""WITH {_ONE}, {b.FACES_SQL}, odd AS (SELECT * FROM faces WHERE v0 % 7 > 0 AND v1 % 3 > 0),
used AS (SELECT DISTINCT scan_id, unnest([v0, v1, v2]) AS vertex_id FROM odd), num AS (SELECT scan_id, vertex_id, row_number() OVER (PARTITION BY scan_id ORDER BY vertex_id) - 1 AS n FROM used JOIN pts USING (scan_id, vertex_id))
SELECT scan_id, -1::bigint AS face_id, n AS v0, vertex_id AS v1, vertex_id AS v2 FROM num
UNION ALL SELECT o.scan_id, face_id, a.n, b.n, c.n FROM odd o JOIN num a ON a.scan_id = o.scan_id AND a.vertex_id = v0 JOIN num b ON b.scan_id = o.scan_id AND b.vertex_id = v1 JOIN num c ON c.scan_id = o.scan_id AND c.vertex_id = v2""")
def set7_renumbered(spark: SparkSession, d: str) -> DataFrame:
    """Faces without those that begin or go on with certain vertices: new numbers beside the old ones, and the faces."""
    faces = b.faces(spark, d).where("v0 % 7 > 0 AND v1 % 3 > 0")
    kept, out = ms.renumbered(b.mesh_points(spark, d).withColumn("old", F.col("vertex_id")), faces)
    return kept.select("scan_id", F.lit(-1).cast("bigint").alias("face_id"), F.col("vertex_id").alias("v0"), F.col("old").alias("v1"), F.col("old").alias("v2")).union(out.select("scan_id", "face_id", "v0", "v1", "v2"))


@query(f"""WITH RECURSIVE {_ONE}, {b.FACES_SQL}, near AS (SELECT p.vertex_id AS a, q.vertex_id AS b FROM pts p JOIN pts q ON p.scan_id = q.scan_id AND p.vertex_id <> q.vertex_id AND sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2) + power(p.z - q.z, 2)) <= 0.6),
reach(node, r) AS (SELECT vertex_id, vertex_id FROM pts UNION SELECT near.b, reach.r FROM reach JOIN near ON near.a = reach.node), root AS (SELECT node, min(r) AS root FROM reach GROUP BY 1),
f AS (SELECT a.root AS v0, b.root AS v1, c.root AS v2 FROM faces JOIN root a ON a.node = v0 JOIN root b ON b.node = v1 JOIN root c ON c.node = v2)
SELECT node AS vertex_id, 0::bigint AS faces FROM root WHERE node = root UNION ALL SELECT -1, count(*) FROM f WHERE v0 <> v1 AND v1 <> v2 AND v0 <> v2""")
def msh5_merge_close(spark: SparkSession, d: str) -> DataFrame:
    v, f = ms.merge_close(b.mesh_points(spark, d), b.faces(spark, d), 0.6)
    return v.select("vertex_id").withColumn("faces", F.lit(0).cast("bigint")).union(f.agg(F.lit(-1).cast("bigint"), F.count("*")))


@query()
def msh3_over_segmentation(spark: SparkSession, d: str) -> DataFrame:
    f, v = b.faces(spark, d), b.mesh_points(spark, d)
    return ms.over_segment(ms.edge_weights(f, v, ms.vertex_normals(f, v)), 0.05, 5)


_POSES = "fr AS (SELECT scan_id, vertex_id AS frame_id, vertex_id % 4 AS turn, vertex_id % 7 / 4.0 AS tx, 6.0 + vertex_id % 3 AS tz FROM pts WHERE vertex_id % 50 < 2)"
_IN_VIEW = "(SELECT scan_id, frame_id, vertex_id, 20 * px / pz + 16 AS u, 20 * py / pz + 12 AS w, pz AS d FROM (SELECT fr.scan_id, frame_id, vertex_id, CASE turn WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN -x ELSE y END + tx AS px, CASE turn WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN -y ELSE -x END AS py, z + tz AS pz FROM fr JOIN pts USING (scan_id)) WHERE pz BETWEEN 0.1 AND 15)"


_DRAWN = f"""{_ONE}, {b.FACES_SQL}, {_POSES}, seen AS {_IN_VIEW},
t AS (
  SELECT f.scan_id, p.frame_id, face_id, v0 % 20 AS label, p.u AS u0, p.w AS w0, p.d AS d0, q.u AS u1, q.w AS w1, q.d AS d1, s.u AS u2, s.w AS w2, s.d AS d2
  FROM faces f JOIN seen p ON p.vertex_id = v0 JOIN seen q ON q.vertex_id = v1 AND q.frame_id = p.frame_id JOIN seen s ON s.vertex_id = v2 AND s.frame_id = p.frame_id
),
b AS (
  SELECT *, (u1 - u0) * (w2 - w0) - (u2 - u0) * (w1 - w0) AS m FROM t
  JOIN (SELECT unnest(range(24)) AS y) ON y BETWEEN least(w0, w1, w2) AND greatest(w0, w1, w2)
  JOIN (SELECT unnest(range(32)) AS x) ON x BETWEEN least(u0, u1, u2) AND greatest(u0, u1, u2)
),
c AS (SELECT *, ((x - u0) * (w2 - w0) - (u2 - u0) * (y - w0)) / m AS b1, ((u1 - u0) * (y - w0) - (x - u0) * (w1 - w0)) / m AS b2 FROM b WHERE m <> 0),
k AS (SELECT scan_id, frame_id, y, x, label, round(1 / ((1 - b1 - b2) / d0 + b1 / d1 + b2 / d2), 9) AS depth, face_id FROM c WHERE b1 >= 0 AND b2 >= 0 AND b1 + b2 <= 1),
drawn AS (SELECT scan_id, frame_id, y, x, arg_min(label, (depth, face_id)) AS label, min(depth) AS depth FROM k GROUP BY ALL)"""


def _projected(spark: SparkSession, d: str) -> DataFrame:
    """Four frames a scan, each with a quarter turn and a shift of its own."""
    v, f = b.mesh_points(spark, d), b.faces(spark, d)
    turn = lambda *row: F.element_at(F.array(*map(F.lit, row)), (F.col("vertex_id") % 4 + 1).cast("int")).cast("double")
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = [turn(1, 0, -1, 0), turn(0, -1, 0, 1), zero, F.col("vertex_id") % 7 / 4.0, turn(0, 1, 0, -1), turn(1, 0, -1, 0)]
    rows += [zero, zero, zero, zero, one, 6.0 + F.col("vertex_id") % 3, zero, zero, zero, one]
    frames = v.where("vertex_id % 50 < 2").select("scan_id", F.col("vertex_id").alias("frame_id"), F.array(*rows).alias("w2c"))
    return pr.project(f, v, v.selectExpr("scan_id", "vertex_id", "vertex_id % 20 AS value"), frames, (20.0, 20.0, 16.0, 12.0), (24, 32))


@query(f"WITH {_DRAWN} SELECT scan_id, frame_id, y, x, label, round(depth, 6) AS depth FROM drawn")
def geo10_project_mesh(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d).withColumn("depth", F.round("depth", 6))


_CAPTURED = "CASE WHEN (frame_id * 7 + y * 3 + x) % 9 = 0 THEN 0.0 ELSE 2.0 + (frame_id * 5 + y + x) % 23 / 4.0 END"


@query(f"""WITH {_DRAWN}, dp AS (SELECT frame_id, y, x, {_CAPTURED} AS depth FROM fr, (SELECT unnest(range(12)) AS y), (SELECT unnest(range(16)) AS x)),
low AS (SELECT frame_id, r.t AS y, c.t AS x, depth FROM drawn JOIN (SELECT unnest(range(12)) AS t) r ON y = floor((r.t + 0.5) * 2) JOIN (SELECT unnest(range(16)) AS t) c ON x = floor((c.t + 0.5) * 2)),
j AS (
  SELECT d.frame_id, d.y, d.x, d.label, low.depth AS r, nullif(dp.depth, 0) AS c FROM drawn d
  JOIN dp ON dp.frame_id = d.frame_id AND dp.y = floor(d.y * (11 / 23.0) + 0.5) AND dp.x = floor(d.x * (15 / 31.0) + 0.5)
  LEFT JOIN low ON low.frame_id = d.frame_id AND low.y = dp.y AND low.x = dp.x
)
SELECT frame_id, y, x, CASE WHEN c IS NULL OR coalesce(abs(r - c) > 0.2 + 0.01 * c, false) THEN 0 ELSE label END AS label FROM j""")
def geo12_seen_labels(spark: SparkSession, d: str) -> DataFrame:
    """The drawn frames held against a captured depth image of half their size for each."""
    drawn = _projected(spark, d).withColumnRenamed("frame_id", "frame_key")
    frames = b.mesh_points(spark, d).where("vertex_id % 50 < 2").select(F.col("vertex_id").alias("frame_id"))
    grid = frames.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(15))))
    captured = grid.selectExpr("frame_id AS frame_key", "y", "x", f"cast({_CAPTURED} AS double) AS depth")
    return px.seen_labels(drawn, captured, (24, 32), (12, 16), captured_only=True).withColumnRenamed("frame_key", "frame_id")


# --- pixel neighbourhoods

_GRID = "g AS (SELECT event_id // 1024 AS frame_key, event_id // 32 % 32 AS y, event_id % 32 AS x, CASE WHEN event_id % 32 < 20 THEN event_id % 3 ELSE 5 END AS label, event_id * 7 % 11 / 10.0 AS value, event_id % 4 AS instance FROM events)"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "events").selectExpr("event_id div 1024 AS frame_key", "event_id div 32 % 32 AS y", "event_id % 32 AS x", "CASE WHEN event_id % 32 < 20 THEN event_id % 3 ELSE 5 END AS label", "event_id * 7 % 11 / 10.0D AS value", "event_id % 4 AS instance")


@query(f"WITH {_GRID} SELECT a.frame_key, a.y, a.x, CASE WHEN avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END) >= 0.2 THEN a.label ELSE 0 END AS label FROM g a JOIN g b ON a.frame_key = b.frame_key AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY a.frame_key, a.y, a.x, a.label")
def img1_isolated_pixels(spark: SparkSession, d: str) -> DataFrame:
    return px.without_isolated(_grid(spark, d)).select("frame_key", "y", "x", "label")


@query(f"WITH {_GRID}, r AS (SELECT unnest(range(24)) AS t), c AS (SELECT unnest(range(20)) AS t) SELECT frame_key, r.t AS y, c.t AS x, label FROM g JOIN r ON y = floor((r.t + 0.5) * 32 / 24) JOIN c ON x = floor((c.t + 0.5) * 32 / 20)")
def img4_resample_nearest(spark: SparkSession, d: str) -> DataFrame:
    return px.resample_nearest(_grid(spark, d), (32, 32), (24, 20)).select("frame_key", "y", "x", "label")


@query(f"""WITH {_GRID}, v AS (SELECT * FROM g WHERE label <> 1), r AS (SELECT t, floor(t * 31 / 15.0)::bigint AS s0, t * 31 / 15.0 - floor(t * 31 / 15.0) AS w FROM (SELECT unnest(range(16)) AS t)), e AS (SELECT t, s0 AS s, 1 - w AS w FROM r UNION ALL SELECT t, least(s0 + 1, 31), w FROM r WHERE w > 0)
SELECT frame_key, ey.t AS y, ex.t AS x, round(sum(ey.w * ex.w * value) / sum(ey.w * ex.w), 5) AS value FROM v JOIN e ey ON v.y = ey.s JOIN e ex ON v.x = ex.s WHERE ey.w > 1e-12 AND ex.w > 1e-12 GROUP BY ALL""")
def img4_resample_bilinear(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d).withColumn("value", F.when(F.col("label") != 1, F.col("value")))
    return px.resample_bilinear(g, (32, 32), (16, 16)).select("frame_key", "y", "x", F.round("value", 5).alias("value"))


@query(f"WITH {_GRID} SELECT a.frame_key, a.y, a.x, round(sum(w * bv) / sum(w), 6) AS value FROM (SELECT a.frame_key, a.y, a.x, b.value AS bv, exp(-(power(a.x - b.x, 2) + power(a.y - b.y, 2)) / 2.0) * exp(-power(a.value - b.value, 2) / 0.02) AS w FROM g a JOIN g b ON a.frame_key = b.frame_key AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2) a GROUP BY 1, 2, 3")
def img3_bilateral(spark: SparkSession, d: str) -> DataFrame:
    return px.bilateral(_grid(spark, d), 1.0, 0.1).select("frame_key", "y", "x", F.round("value", 6).alias("value"))


@query(f"""WITH {_GRID}, w AS (SELECT a.frame_key, a.y, a.x, b.instance, round(sum(exp(-(power(a.x - b.x, 2) + power(a.y - b.y, 2)) / 50.0) * exp(-power(a.value - b.value, 2) / 0.02) * exp(-power(4.0 * (a.label - b.label) / 10.0, 2) / 0.02)), 9) AS w FROM g a JOIN g b ON a.frame_key = b.frame_key AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL)
SELECT frame_key, y, x, arg_max(instance, (w, -instance)) AS instance FROM w GROUP BY 1, 2, 3""")
def img2_vote_filter(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d).withColumnRenamed("value", "depth").withColumn("intensity", F.col("label") / 10.0)
    return px.vote(g, 2, 4.0)


_NEAR = "JOIN {t} b ON a.frame_key = b.frame_key AND abs(a.y - b.y) <= {r} AND abs(a.x - b.x) <= {r}"
_FAR = "power(a.x - b.x, 2) + power(a.y - b.y, 2)"


def _smooth_sql(value: str, sigma: float) -> str:
    return f"SELECT frame_key, y, x, sum(w * v) / sum(w) AS v FROM (SELECT a.frame_key, a.y, a.x, b.{value} AS v, exp(-({_FAR}) / {2 * sigma * sigma}) * exp(-power(a.{value} - b.{value}, 2) / 0.02) AS w FROM p a {_NEAR.format(t='p', r=int(2 * sigma))}) GROUP BY 1, 2, 3"


def _vote_sql(table: str, radius: int, scale: float) -> str:
    return f"SELECT frame_key, y, x, arg_max(instance, (w, -instance)) AS instance FROM (SELECT a.frame_key, a.y, a.x, b.instance, round(sum(exp(-({_FAR}) / 50.0) * exp(-power(coalesce(a.depth - b.depth, 0), 2) / 0.02) * exp(-power({scale} * coalesce(a.light - b.light, 0), 2) / 0.02)), 9) AS w FROM {table} a {_NEAR.format(t=table, r=radius)} GROUP BY ALL) GROUP BY 1, 2, 3"


def _half_sql(table: str) -> str:
    return f"SELECT frame_key, ey.t AS y, ex.t AS x, sum(ey.w * ex.w * v) / sum(ey.w * ex.w) AS v FROM {table} JOIN e ey ON y = ey.s JOIN e ex ON x = ex.s WHERE ey.w > 1e-12 AND ex.w > 1e-12 GROUP BY ALL"


@query(f"""WITH {_GRID}, p AS (SELECT frame_key, y, x, instance, value AS depth, label / 10.0 AS light FROM g), sd AS ({_smooth_sql("depth", 2.0)}), sl AS ({_smooth_sql("light", 6.0)}),
r AS (SELECT t, floor(t * 31 / 15.0)::bigint AS s0, t * 31 / 15.0 - floor(t * 31 / 15.0) AS w FROM (SELECT unnest(range(16)) AS t)), e AS (SELECT t, s0 AS s, 1 - w AS w FROM r UNION ALL SELECT t, least(s0 + 1, 31), w FROM r WHERE w > 0),
hd AS ({_half_sql("sd")}), hl AS ({_half_sql("sl")}), hp AS (SELECT p.frame_key, r.t AS y, c.t AS x, instance FROM p JOIN r ON p.y = floor((r.t + 0.5) * 2) JOIN r c ON p.x = floor((c.t + 0.5) * 2)),
h AS (SELECT hp.*, hd.v AS depth, hl.v AS light FROM hp LEFT JOIN hd USING (frame_key, y, x) LEFT JOIN hl USING (frame_key, y, x)), one AS ({_vote_sql("h", 12, 10.0)}),
f AS (SELECT sd.frame_key, sd.y, sd.x, one.instance, sd.v AS depth, sl.v AS light FROM sd JOIN sl USING (frame_key, y, x) JOIN one ON one.frame_key = sd.frame_key AND one.y = floor((sd.y + 0.5) / 2) AND one.x = floor((sd.x + 0.5) / 2)), two AS ({_vote_sql("f", 10, 4.0)})
SELECT frame_key, y, x, CASE WHEN instance < 3 THEN instance * 10 + 1 ELSE 0 END AS label, instance + 1 AS object FROM two""")
def img6_two_pass_filter(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d).withColumnRenamed("value", "depth").withColumn("intensity", F.col("label") / 10.0)
    of = spark.range(3).select(F.col("id").alias("instance"), (F.col("id") * 10 + 1).alias("label_id"))
    return px.instance_to_label(px.two_pass(g, (32, 32), (16, 16)), of)


@query(f"WITH {_GRID} SELECT frame_key, y, x, CASE WHEN abs(value + CASE WHEN x % 2 = 0 THEN 0.5 ELSE 0.1 END - value) > 0.2 + 0.01 * value THEN 0 ELSE label END AS label FROM g")
def geo12_depth_consistency(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d).withColumnRenamed("value", "depth").withColumn("rendered", F.col("depth") + F.when(F.col("x") % 2 == 0, 0.5).otherwise(0.1))
    return px.consistent(g)


@query(f"WITH {_GRID} SELECT a.frame_key, a.y, a.x, b.value FROM g a LEFT JOIN g b ON a.frame_key = b.frame_key AND b.y = floor(a.y * (15 / 31.0) + 0.5) AND b.x = floor(a.x * (15 / 31.0) + 0.5) AND b.y < 16 AND b.x < 16")
def jn19_scaled_lookup(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    return px.scaled_lookup(g.select("frame_key", "y", "x"), g.where("y < 16 AND x < 16"), (32, 32), (16, 16), "value")
