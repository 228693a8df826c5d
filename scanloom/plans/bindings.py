"""The driver's tables seen as tables of the scan domain. Row-wise, so filters and column pruning
reach the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import INSTANCE_CLASSES


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def label_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(pred, gt) labels of vertices: orders as vertices, a scan for 64 customers."""
    o = table(spark, d, "orders").selectExpr("o_custkey div 64 AS scan_id", "o_orderkey AS vertex_id", "o_orderkey % 41 AS gt", "CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey % 41 ELSE o_custkey % 41 END AS pred")
    return o.select("scan_id", "vertex_id", F.col("pred").alias("value")), o.select("scan_id", "vertex_id", F.col("gt").alias("value"))


LABELS_SQL = "SELECT o_custkey // 64 AS scan_id, o_orderkey AS vertex_id, o_orderkey % 41 AS gt, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey % 41 ELSE o_custkey % 41 END AS pred FROM orders"

_CLASS = f"element_at(array({', '.join(map(str, INSTANCE_CLASSES))}), cast(%s %% 6 AS int) + 1)"


def instances(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gt, preds, masks): a scan for 512 customers, ten instances each, the ninth of no class and the tenth
    none; a prediction for each that covers four fifths of it and a fifth of the next."""
    o = table(spark, d, "orders").selectExpr("o_custkey div 512 AS scan_id", "o_orderkey AS vertex_id", "o_orderkey % 10 AS k", "(o_orderkey div 10) % 5 AS m")
    gt = o.selectExpr("scan_id", "vertex_id", f"CASE WHEN k = 9 THEN 0 WHEN k = 8 THEN 2001 ELSE {_CLASS % 'k'} * 1000 + k + 1 END AS id")
    masks = o.selectExpr("scan_id", "CASE WHEN m < 4 THEN k ELSE (k + 9) % 10 END AS pred_id", "vertex_id")
    preds = o.select("scan_id", F.col("k").alias("pred_id")).distinct().selectExpr("scan_id", "pred_id", f"cast({_CLASS % 'pred_id'} AS bigint) AS label_id", "(pred_id * 37 % 100) / 100.0D + scan_id / 1000000.0D AS conf")
    return gt, preds, masks


_CLASS_SQL = f"([{', '.join(map(str, INSTANCE_CLASSES))}])[%s %% 6 + 1]"
INSTANCES_SQL = f"""o AS (SELECT o_custkey // 512 AS scan_id, o_orderkey AS vertex_id, o_orderkey % 10 AS k, (o_orderkey // 10) % 5 AS m FROM orders),
gt AS (SELECT scan_id, vertex_id, CASE WHEN k = 9 THEN 0 WHEN k = 8 THEN 2001 ELSE {_CLASS_SQL % 'k'} * 1000 + k + 1 END AS id FROM o),
masks AS (SELECT scan_id, CASE WHEN m < 4 THEN k ELSE (k + 9) % 10 END AS pred_id, vertex_id FROM o),
preds AS (SELECT DISTINCT scan_id, k AS pred_id, {_CLASS_SQL % 'k'} AS label_id, (k * 37 % 100) / 100.0 + scan_id / 1000000.0 AS conf FROM o)"""


def segmentation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(segments, groups): orders as vertices in fifty segments a scan; parts as groups of segments."""
    segments = table(spark, d, "orders").selectExpr("o_custkey div 64 AS scan_id", "o_orderkey AS vertex_id", "o_orderkey % 50 AS seg_id")
    groups = table(spark, d, "part").selectExpr(
        "p_partkey div 64 AS scan_id", "p_partkey % 64 AS group_pos", "p_partkey % 64 AS id", "p_partkey % 64 AS object_id",
        "CASE WHEN p_partkey % 11 = 0 THEN 'unknown' WHEN p_partkey % 13 = 0 THEN '' ELSE p_type END AS label", "array(p_partkey % 47, (p_partkey * 7) % 47, (p_partkey * 3) % 53) AS segments",
    )
    return segments, groups


SEGMENTATION_SQL = """segments AS (SELECT o_custkey // 64 AS scan_id, o_orderkey AS vertex_id, o_orderkey % 50 AS seg_id FROM orders),
grp AS (SELECT p_partkey // 64 AS scan_id, p_partkey % 64 AS group_pos, CASE WHEN p_partkey % 11 = 0 THEN 'unknown' WHEN p_partkey % 13 = 0 THEN '' ELSE p_type END AS label, [p_partkey % 47, (p_partkey * 7) % 47, (p_partkey * 3) % 53] AS segments FROM part)"""


def label_map(spark: SparkSession, d: str) -> DataFrame:
    """(raw_category, id, position) with repeated categories: part types in key order."""
    return table(spark, d, "part").selectExpr("p_type AS raw_category", "p_partkey % 41 AS id", "p_partkey AS position")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """(frame_key, y, x, label, instance): events as pixels of a frame a user; the grid is by event id."""
    return table(spark, d, "events").selectExpr("user_id AS frame_key", "event_id div 64 AS y", "event_id % 64 AS x", "event_id % 7 AS label", "event_id % 5 AS instance")


PIXELS_SQL = "px AS (SELECT user_id AS frame_key, event_id // 64 AS y, event_id % 64 AS x, event_id % 7 AS label, event_id % 5 AS instance FROM events)"


def scan_index(spark: SparkSession, d: str) -> DataFrame:
    """Customers as scans."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).selectExpr(
        "concat('scene', lpad(cast(c_custkey AS string), 6, '0')) AS id", "c_custkey AS num", "concat('dev', c_custkey % 17) AS deviceId", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('phone', c_custkey % 6) END AS deviceName",
        "n_name AS userName", "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE concat('room', c_custkey % 23) END AS sceneName", "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS sceneType",
        "CASE WHEN c_custkey % 19 = 0 THEN 'nyuv2' ELSE 'staging' END AS `group`", "CASE WHEN c_custkey % 4 = 0 THEN array() WHEN c_custkey % 4 = 1 THEN array('indoor') ELSE array('indoor', concat('t', c_custkey % 3)) END AS tags",
        "c_acctbal AS floorArea", "CASE WHEN c_custkey % 9 = 0 THEN 0.0D ELSE abs(c_acctbal) + 1 END AS floorAreaFilled", "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE cast(c_custkey % 900 AS int) END AS numColorFrames", "cast(c_custkey % 777 AS int) AS numTransforms",
        "concat('/scans/staging/scene', lpad(cast(c_custkey AS string), 6, '0')) AS path",
    )


INDEX_SQL = """scans AS (SELECT 'scene' || lpad(c_custkey::varchar, 6, '0') AS id, c_custkey AS num, 'dev' || (c_custkey % 17) AS deviceId, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'phone' || (c_custkey % 6) END AS deviceName,
n_name AS userName, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'room' || (c_custkey % 23) END AS sceneName, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS sceneType,
CASE WHEN c_custkey % 19 = 0 THEN 'nyuv2' ELSE 'staging' END AS grp, CASE WHEN c_custkey % 4 = 0 THEN [] WHEN c_custkey % 4 = 1 THEN ['indoor'] ELSE ['indoor', 't' || (c_custkey % 3)] END AS tags,
c_acctbal AS floorArea, CASE WHEN c_custkey % 9 = 0 THEN 0.0 ELSE abs(c_acctbal) + 1 END AS floorAreaFilled, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 900 END AS numColorFrames, c_custkey % 777 AS numTransforms,
'/scans/staging/scene' || lpad(c_custkey::varchar, 6, '0') AS path FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """(scan_id, vertex_id, x, y, z): the first components of embeddings, ten times."""
    v = lambda i: f"cast(embedding[{i}] AS double) * 10"
    return table(spark, d, "embeddings").selectExpr("label AS scan_id", "vec_id AS vertex_id", f"{v(0)} AS x", f"{v(1)} AS y", f"{v(2)} AS z")


POINTS_SQL = "pts AS (SELECT label AS scan_id, vec_id AS vertex_id, embedding[1]::double * 10 AS x, embedding[2]::double * 10 AS y, embedding[3]::double * 10 AS z FROM embeddings)"


def mesh_points(spark: SparkSession, d: str) -> DataFrame:
    """points() in scans of a hundred each."""
    return points(spark, d).withColumn("scan_id", F.expr("vertex_id div 100"))


MESH_POINTS_SQL = POINTS_SQL.replace("label AS scan_id", "vec_id // 100 AS scan_id")


def faces(spark: SparkSession, d: str) -> DataFrame:
    """(scan_id, face_id, v0, v1, v2): line items as faces over mesh_points(), dealt to as many scans as
    these have."""
    n = max(1, table(spark, d, "embeddings").count() // 100)
    of = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.expr("min(l_partkey)").alias("a"), F.expr("min(l_suppkey)").alias("b")).withColumn("s", F.expr(f"l_orderkey % {n}"))
    return of.selectExpr("s AS scan_id", "l_orderkey AS face_id", f"s * 100 + l_orderkey div {n} % 100 AS v0", "s * 100 + a % 100 AS v1", "s * 100 + (b * 7 + a) % 100 AS v2")


FACES_SQL = """faces AS (SELECT s AS scan_id, l_orderkey AS face_id, s * 100 + l_orderkey // n % 100 AS v0, s * 100 + a % 100 AS v1, s * 100 + (b * 7 + a) % 100 AS v2
FROM (SELECT *, l_orderkey % n AS s FROM (SELECT l_orderkey, min(l_partkey) AS a, min(l_suppkey) AS b FROM lineitem GROUP BY 1), (SELECT greatest(1, count(*) // 100) AS n FROM embeddings)))"""


def one_cloud(spark: SparkSession, d: str) -> DataFrame:
    """points() as one scan."""
    return points(spark, d).withColumn("scan_id", F.lit(0))
