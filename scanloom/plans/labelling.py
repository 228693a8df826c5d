"""Queries on label maps, painted vertices, annotation statistics and pixel labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import annotation_stats as st
from ..operators import labels as lb
from ..operators import pixels as px
from . import bindings as b
from .registry import query

_LAST = "SELECT raw_category, arg_max(id, position) AS id FROM (SELECT p_type AS raw_category, p_partkey % 41 AS id, p_partkey AS position FROM part) GROUP BY 1"
_FIRST = _LAST.replace("arg_max", "arg_min")
_OWNED = "owned AS (SELECT scan_id, seg_id, arg_max(value, group_pos) AS value FROM (SELECT scan_id, group_pos, %s AS value, unnest(segments) AS seg_id FROM grp) GROUP BY ALL)"


@query(f"WITH {b.SEGMENTATION_SQL}, lm AS ({_LAST}), g2 AS (SELECT grp.*, coalesce(id, 0) AS lid FROM grp LEFT JOIN lm ON label = raw_category), owned AS (SELECT scan_id, seg_id, arg_max(lid, group_pos) AS value FROM (SELECT scan_id, group_pos, lid, unnest(segments) AS seg_id FROM g2) GROUP BY ALL) SELECT scan_id, vertex_id, coalesce(value, 0) AS value FROM segments LEFT JOIN owned USING (scan_id, seg_id)")
def jn1_paint_labels(spark: SparkSession, d: str) -> DataFrame:
    segments, groups = b.segmentation(spark, d)
    last = b.label_map(spark, d).groupBy("raw_category").agg(F.max_by("id", "position").alias("target")).withColumnRenamed("raw_category", "key")
    return lb.paint_labels(segments, groups, last)


@query(f"WITH {b.SEGMENTATION_SQL}, {_OWNED % 'group_pos + 1'} SELECT scan_id, vertex_id, coalesce(value, 0) AS value FROM segments LEFT JOIN owned USING (scan_id, seg_id)")
def jn2_paint_instances(spark: SparkSession, d: str) -> DataFrame:
    return lb.paint_instances(*b.segmentation(spark, d))


@query(f"""WITH {b.SEGMENTATION_SQL}, lm AS (SELECT * FROM ({_FIRST}) WHERE id % 2 = 0), g2 AS (SELECT grp.*, coalesce(lm.id, 0) AS lid FROM grp LEFT JOIN lm ON label = raw_category),
e AS (SELECT scan_id, group_pos, lid, unnest(segments) AS seg_id FROM g2), owned AS (SELECT scan_id, seg_id, arg_max(lid, group_pos) AS lid, max(group_pos) AS inst FROM e GROUP BY ALL)
SELECT scan_id, vertex_id, coalesce(lid, 0) AS label_id, coalesce(inst, 0) AS instance_id FROM segments LEFT JOIN owned USING (scan_id, seg_id)""")
def jn3_paint_large_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    segments, groups = b.segmentation(spark, d)
    m = b.label_map(spark, d)
    return lb.paint_large_vocabulary(segments, groups, m, m.where("id % 2 = 0").select("id").distinct())


@query(f"WITH {b.SEGMENTATION_SQL} SELECT scan_id, seg_id, max(group_pos) AS group_pos FROM (SELECT scan_id, group_pos, unnest(segments) AS seg_id FROM grp) GROUP BY ALL")
def jn4_segment_groups(spark: SparkSession, d: str) -> DataFrame:
    return lb.segment_groups(b.segmentation(spark, d)[1])


@query(f"WITH {b.SEGMENTATION_SQL} SELECT scan_id, seg_id, list(vertex_id ORDER BY vertex_id) AS vertices FROM segments GROUP BY ALL")
def jn5_segment_vertices(spark: SparkSession, d: str) -> DataFrame:
    return lb.segment_vertices(b.segmentation(spark, d)[0])


@query("SELECT c_custkey AS scan_id, CASE WHEN c_custkey % 4 = 0 THEN 'train' WHEN c_custkey % 6 = 1 THEN 'val' ELSE 'test' END AS split FROM customer")
def jn11_split_membership(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("scan_id"))
    train = c.where("scan_id % 4 = 0").withColumn("split", F.lit("train"))
    return lb.split_of(c, train.union(c.where("scan_id % 6 IN (0, 1) AND scan_id % 12 <> 6").withColumn("split", F.lit("val"))))


@query(f"""WITH {b.SEGMENTATION_SQL}, own AS (SELECT DISTINCT scan_id, unnest(segments) AS seg_id FROM grp WHERE label NOT IN ('', 'unknown')),
sz AS (SELECT scan_id, seg_id, count(*) AS n FROM segments GROUP BY ALL),
per AS (SELECT sz.scan_id, sum(n) AS verts, count(*) AS segs, coalesce(sum(n) FILTER (own.seg_id IS NOT NULL), 0) AS annotated_verts, count(own.seg_id) AS annotated_segs FROM sz LEFT JOIN own ON own.scan_id = sz.scan_id AND own.seg_id = sz.seg_id GROUP BY 1),
g AS (SELECT scan_id, count(*) AS groups, count(*) FILTER (label NOT IN ('', 'unknown')) AS labelled, count(DISTINCT label) FILTER (label NOT IN ('', 'unknown')) AS labels, count(DISTINCT split_part(label, ':', 1)) FILTER (label NOT IN ('', 'unknown')) AS categories FROM grp GROUP BY 1)
SELECT scan_id, verts, segs, annotated_verts, annotated_segs, groups, labelled, labels, categories, verts - annotated_verts AS unannotated_verts, segs - annotated_segs AS unannotated_segs, floor(100 * annotated_verts / verts)::bigint AS vert_percent, floor(100 * annotated_segs / segs)::bigint AS seg_percent FROM per JOIN g USING (scan_id)""")
def agg15_annotation_stats(spark: SparkSession, d: str) -> DataFrame:
    return st.scan_statistics(*b.segmentation(spark, d))


@query(f"WITH {b.SEGMENTATION_SQL} SELECT label, count(*) AS n FROM grp WHERE label NOT IN ('', 'unknown') GROUP BY 1")
def agg16_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return st.label_counts(b.segmentation(spark, d)[1])


@query("SELECT 'm' || (p_size % 60) AS model, count(*) AS groups FROM part WHERE p_size % 60 < 40 GROUP BY 1 UNION ALL SELECT 'none', 0")
def agg17_annotations_by_model(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part")
    notes = p.selectExpr("concat('scan.m', p_size % 60) AS model_id", "p_partkey AS id", "p_type AS label")
    models = p.where("p_size % 60 < 40").selectExpr("concat('m', p_size % 60) AS scan_id").distinct().union(p.limit(1).select(F.lit("none")))
    return st.annotations_by_model(notes, models).select("model", F.size("groups").cast("bigint").alias("groups"))


@query(f"SELECT p_partkey, coalesce(m.id, p_size) AS value FROM part LEFT JOIN (SELECT p_size AS s, arg_max(p_partkey % 41, p_partkey) AS id FROM part WHERE p_size % 2 = 0 GROUP BY 1) m ON s = p_size")
def prj1_remap_labels(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part")
    mapping = p.where("p_size % 2 = 0").selectExpr("p_size AS key", "p_partkey % 41 AS target", "p_partkey AS position")
    return lb.remap(p.selectExpr("p_partkey", "cast(p_size AS bigint) AS value"), mapping)


@query("SELECT event_id, event_id // 1000 AS label, CASE WHEN event_id < 1000 THEN event_id ELSE event_id // 1000 END AS panoptic FROM events")
def prj2_instance_labels(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events")
    return e.select("event_id", sc.label_of_instance(F.col("event_id")).alias("label"), sc.panoptic_label(F.col("event_id")).alias("panoptic"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 50 < 20 THEN l_partkey % 50 ELSE 20 END + 1 AS class FROM lineitem")
def prj3_class_remap(spark: SparkSession, d: str) -> DataFrame:
    v = b.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_partkey % 50 AS value")
    mapping = b.table(spark, d, "part").where("p_partkey BETWEEN 1 AND 20").selectExpr("p_partkey - 1 AS key", "p_partkey - 1 AS target")
    return lb.class_remap(v, mapping, 21).select("l_orderkey", "l_linenumber", "l_partkey", "class")


@query("SELECT event_id, CASE WHEN event_id % 4 = 2 THEN 1 ELSE event_id % 4 END AS occupied, round(least(abs(value - 50), 3.0), 6) AS distance, CASE WHEN value - 50 >= -1 THEN 1 ELSE -1 END AS known FROM events")
def prj5_prj6_voxel_encoding(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events").withColumn("v", F.col("value") - 50)
    return e.select("event_id", sc.occupancy(F.col("event_id") % 4).alias("occupied"), F.round(sc.sdf_distance(F.col("v"), 3.0), 6).alias("distance"), sc.sdf_known(F.col("v")).alias("known"))


@query(f"WITH {b.PIXELS_SQL}, f AS (SELECT frame_key, instance, arg_min(label, y * 64 + x) AS label FROM px WHERE instance <> 0 GROUP BY ALL) SELECT frame_key, instance, label * 1000 + row_number() OVER (PARTITION BY frame_key, label ORDER BY instance) AS value FROM f")
def win1_renumber_instances(spark: SparkSession, d: str) -> DataFrame:
    return lb.renumber_instances(b.pixels(spark, d))


@query(f"WITH {b.PIXELS_SQL} SELECT frame_key, instance, count(*) AS area, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM px WHERE label <> 3 GROUP BY ALL")
def agg33_panoptic_segments(spark: SparkSession, d: str) -> DataFrame:
    return px.panoptic_segments(b.pixels(spark, d).where("label <> 3"))


@query("SELECT o_custkey // 64 AS scan_id, row_number() OVER (PARTITION BY o_custkey // 64 ORDER BY o_custkey % 29) - 1 AS pred_id, o_custkey % 29 AS instance, arg_min(o_orderkey % 17, o_orderkey) AS label_id, 1.0::double AS conf FROM orders WHERE o_custkey % 29 <> 0 GROUP BY 1, 3")
def src22_export_instances(spark: SparkSession, d: str) -> DataFrame:
    ids = b.table(spark, d, "orders").selectExpr("o_custkey div 64 AS scan_id", "o_orderkey AS vertex_id", "o_orderkey % 17 AS label", "o_custkey % 29 AS instance")
    return lb.exported_instances(ids)


@query("SELECT 'p' || (p_partkey % 3) AS part, count(*) AS classes, count(*) FILTER (p_partkey % 2 = 0 AND p_partkey % 5 <> 0) AS train_only, count(*) FILTER (p_partkey % 5 = 0 AND p_partkey % 2 <> 0) AS val_only FROM part GROUP BY 1")
def set6_vocabulary_splits(spark: SparkSession, d: str) -> DataFrame:
    return lb.vocabulary_splits(b.table(spark, d, "part").selectExpr("concat('p', p_partkey % 3) AS part", "p_partkey % 2 = 0 AS in_train", "p_partkey % 5 = 0 AS in_val"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE '%:%' THEN split_part(p_type, ':', 1) ELSE p_type END AS category FROM part")
def scl8_label_category(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "part").select("p_partkey", sc.category(F.col("p_type")).alias("category"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY 1")
def flt2_void_rows(spark: SparkSession, d: str) -> DataFrame:
    v = b.table(spark, d, "lineitem").select(F.col("l_partkey").alias("class_id"))
    kept = lb.restrict(v, b.table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("class_id")), void=True)
    return kept.groupBy(F.col("class_id").alias("l_partkey")).agg(F.count("*").alias("n"))


@query(f"WITH {b.PIXELS_SQL}, m AS (SELECT p_size % 5 AS k, max(p_partkey % 41) AS t FROM part WHERE p_size % 5 < 3 GROUP BY 1) SELECT frame_key, y, x, coalesce(t, 0) AS label, instance + 1 AS object FROM px LEFT JOIN m ON k = instance")
def img5_instance_to_label(spark: SparkSession, d: str) -> DataFrame:
    of = b.table(spark, d, "part").where("p_size % 5 < 3").groupBy(F.expr("cast(p_size % 5 AS bigint)").alias("instance")).agg(F.max(F.expr("p_partkey % 41")).alias("label_id"))
    return px.instance_to_label(b.pixels(spark, d).drop("label"), of)


@query(f"WITH {b.SEGMENTATION_SQL}, lm AS ({_LAST}), e AS (SELECT scan_id, group_pos, coalesce(id, 0) AS lid, unnest(segments) AS seg_id FROM grp LEFT JOIN lm ON label = raw_category), o AS (SELECT scan_id, seg_id, arg_max(lid, group_pos) AS lid, max(group_pos) + 1 AS obj FROM e GROUP BY ALL) SELECT scan_id, vertex_id, coalesce(lid, 0) AS label_id, coalesce(obj, 0) AS object_id FROM segments LEFT JOIN o USING (scan_id, seg_id)")
def geo11_projection_labels(spark: SparkSession, d: str) -> DataFrame:
    segments, groups = b.segmentation(spark, d)
    last = b.label_map(spark, d).groupBy(F.col("raw_category").alias("key")).agg(F.max_by("id", "position").alias("target"))
    return lb.projection_labels(segments, groups, last)


@query(f"WITH {b.PIXELS_SQL} SELECT frame_key, y, x, n_nationkey * 9 AS r, n_regionkey * 50 AS g, 7 AS b FROM px JOIN nation ON n_nationkey = (y * 64 + x) % 25")
def scl11_instance_colours(spark: SparkSession, d: str) -> DataFrame:
    palette = b.table(spark, d, "nation").selectExpr("n_nationkey AS position", "n_nationkey * 9 AS r", "n_regionkey * 50 AS g", "7 AS b")
    p = b.pixels(spark, d).select("frame_key", "y", "x", (F.col("y") * 64 + F.col("x")).alias("value"))
    return lb.coloured(p, palette, modulo=True).drop("value")
