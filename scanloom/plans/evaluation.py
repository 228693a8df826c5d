"""Queries on predictions: semantic labels, pixels, scene types, voxels, instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators.tables import settled
from . import bindings as b
from .registry import query

VALID = ", ".join(map(str, ev.VALID_CLASSES))
_PAIRS = f"p AS ({b.LABELS_SQL})"
_MATRIX = f"{_PAIRS}, m AS (SELECT gt, CASE WHEN pred IN ({VALID}) THEN pred ELSE 40 END AS pred, count(*) AS n FROM p WHERE gt IN ({VALID}) GROUP BY ALL)"
_SCORES = f"""c AS (SELECT unnest([{VALID}]) AS class),
s AS (SELECT class, coalesce((SELECT sum(n) FROM m WHERE gt = class AND pred = class), 0) AS tp, coalesce((SELECT sum(n) FROM m WHERE gt = class), 0) AS rs, coalesce((SELECT sum(n) FROM m WHERE pred = class), 0) AS cs FROM c)"""


def _matrix(spark: SparkSession, d: str, valid: list[int] | None = None) -> DataFrame:
    pred, gt = b.label_pairs(spark, d)
    return ev.confusion(ev.aligned(pred, gt, ["scan_id", "vertex_id"]), valid)


def _classes(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ids], "class bigint")


@query(f"WITH {_MATRIX} SELECT gt, pred, n FROM m")
def agg1_label_confusion(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d, ev.VALID_CLASSES)


@query(f"WITH {_MATRIX}, {_SCORES} SELECT class, tp, rs - tp AS fn, cs - tp AS fp, round(tp / nullif(rs + cs - tp, 0), 6) AS iou, round(tp / nullif(rs, 0), 6) AS recall FROM s")
def agg4_label_iou(spark: SparkSession, d: str) -> DataFrame:
    s = ev.class_scores(_matrix(spark, d, ev.VALID_CLASSES), _classes(spark, ev.VALID_CLASSES))
    return s.select("class", "tp", "fn", "fp", ev.row("iou"), ev.row("recall"))


@query(f"WITH {_MATRIX}, {_SCORES} SELECT round(avg(tp / nullif(rs + cs - tp, 0)), 6) AS mean_iou FROM s")
def agg8_label_miou(spark: SparkSession, d: str) -> DataFrame:
    s = ev.class_scores(_matrix(spark, d, ev.VALID_CLASSES), _classes(spark, ev.VALID_CLASSES))
    return ev.mean_score(s).select(ev.row("mean_iou"))


@query(f"WITH {_PAIRS} SELECT gt, pred, count(*) AS n FROM p GROUP BY ALL")
def agg2_pixel_confusion(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d)


@query(f"WITH {_PAIRS}, m AS (SELECT gt, pred, count(*) AS n FROM p GROUP BY ALL) SELECT gt, pred, n, round(n / sum(n) OVER (PARTITION BY gt), 6) AS share FROM m")
def agg6_confusion_norm(spark: SparkSession, d: str) -> DataFrame:
    return ev.normalised(_matrix(spark, d)).select("gt", "pred", "n", ev.row("share"))


@query(f"WITH {_PAIRS} SELECT gt, round(count(*) / (SELECT count(*) FROM p), 6) AS prior FROM p GROUP BY gt")
def agg7_class_prior(spark: SparkSession, d: str) -> DataFrame:
    return ev.priors(_matrix(spark, d)).select("gt", ev.row("prior"))


@query("SELECT count(*) AS pixels FROM orders")
def agg36_matrix_total(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d).agg(F.sum("n").alias("pixels"))


@query("SELECT o_custkey // 64 AS scan_id, count(*) FILTER (o_orderkey % 10 = 3) AS missing, count(*) FILTER (o_orderkey % 10 = 7) AS extra FROM orders GROUP BY 1")
def jn6_mismatch_report(spark: SparkSession, d: str) -> DataFrame:
    pred, gt = b.label_pairs(spark, d)
    return ev.mismatch(pred.where("vertex_id % 10 <> 3"), gt.where("vertex_id % 10 <> 7"), ["scan_id", "vertex_id"])


def _scenes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from ..operators.scan_index import scene_type_ids

    c = b.table(spark, d, "customer")
    types = c.select("c_mktsegment").distinct().selectExpr("lower(c_mktsegment) AS name", "cast(length(c_mktsegment) AS bigint) * 100 + ascii(c_mktsegment) AS id")
    gt = scene_type_ids(c.selectExpr("c_custkey AS scan_id", "concat(' ', c_mktsegment) AS type"), types)
    pred = gt.where("scan_id % 20 <> 0").withColumn("type_id", F.when(F.col("scan_id") % 4 == 0, F.col("scan_id") % 5).otherwise(F.col("type_id")))
    return pred, gt


_SCENES_SQL = "g AS (SELECT c_custkey AS scan_id, length(c_mktsegment) * 100 + ascii(c_mktsegment) AS t FROM customer), p AS (SELECT scan_id, t AS gt, CASE WHEN scan_id % 4 = 0 THEN scan_id % 5 ELSE t END AS pred FROM g WHERE scan_id % 20 <> 0)"


@query(f"WITH {_SCENES_SQL} SELECT gt AS class, round(avg(CASE WHEN gt = pred THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) FILTER (gt = pred) AS tp FROM p GROUP BY gt")
def agg5_scene_type_recall(spark: SparkSession, d: str) -> DataFrame:
    pred, gt = _scenes(spark, d)
    pairs = ev.aligned(pred.withColumnRenamed("type_id", "value"), gt.withColumnRenamed("type_id", "value"), ["scan_id"])
    matrix = ev.confusion(pairs)
    return ev.class_scores(matrix, matrix.select(F.col("gt").alias("class")).distinct()).select("class", ev.row("recall"), "tp")


@query("SELECT c_custkey AS scan_id FROM customer WHERE c_custkey % 20 = 0")
def agg3_scene_type_missing(spark: SparkSession, d: str) -> DataFrame:
    pred, gt = _scenes(spark, d)
    return ev.missing_scenes(pred, gt).select("scan_id")


@query("WITH v AS (SELECT l_partkey % 12 + 1 AS gt, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 12 + 1 ELSE l_partkey % 12 + 1 END AS pred FROM lineitem), a AS (SELECT gt, count(*) AS n, count(*) FILTER (gt = pred) AS r FROM v WHERE gt NOT IN (1, 12) GROUP BY gt) SELECT round(sum(r) / sum(n), 6) AS accuracy, round(avg(r / n), 6) AS class_accuracy FROM a")
def agg9_voxel_accuracy(spark: SparkSession, d: str) -> DataFrame:
    v = b.table(spark, d, "lineitem").selectExpr("l_partkey % 12 + 1 AS gt", "CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 12 + 1 ELSE l_partkey % 12 + 1 END AS pred")
    return ev.accuracy(v, [1, 12]).select(ev.row("accuracy"), ev.row("class_accuracy"))


@query("SELECT round(avg(CASE WHEN l_partkey % 12 = l_suppkey % 12 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM lineitem WHERE l_partkey % 12 IN (SELECT p_size % 12 FROM part WHERE p_size < 5)")
def agg10_restricted_accuracy(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.labels import restrict

    v = b.table(spark, d, "lineitem").selectExpr("l_partkey % 12 AS class_id", "l_suppkey % 12 AS pred")
    kept = restrict(v, b.table(spark, d, "part").where("p_size < 5").selectExpr("p_size % 12 AS class_id"))
    return kept.agg(F.round(F.avg((F.col("class_id") == F.col("pred")).cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


@query("WITH h AS (SELECT l_linenumber AS class, count(*) AS n FROM lineitem GROUP BY 1) SELECT class, n, round(n / sum(n) OVER (), 6) AS frequency, round(1 / ln(1.2 + n / sum(n) OVER ()), 6) AS weight FROM h")
def agg27_class_weights(spark: SparkSession, d: str) -> DataFrame:
    h = b.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("class")).agg(F.count("*").alias("n"))
    return ev.class_weights(h).select("class", "n", ev.row("frequency"), ev.row("weight"))


# --- instances

IVALID = ", ".join(map(str, ev.INSTANCE_CLASSES))
_GT = f"inst AS (SELECT scan_id, id AS gt_id, id // 1000 AS label_id, count(*) AS size FROM gt WHERE id <> 0 AND id // 1000 IN ({IVALID}) GROUP BY ALL)"
_PRED = f"pred AS (SELECT scan_id, pred_id, label_id, conf, count(*) AS size, count(*) FILTER (id // 1000 NOT IN ({IVALID})) AS void FROM preds JOIN masks USING (scan_id, pred_id) JOIN gt USING (scan_id, vertex_id) GROUP BY ALL HAVING count(*) >= 100)"
_INTER = "inter AS (SELECT p.scan_id, p.pred_id, i.gt_id, p.label_id, p.conf, p.size AS pred_size, i.size AS gt_size, p.void, count(*) AS n, count(*) / (p.size + i.size - count(*)) AS iou FROM pred p JOIN masks m ON p.scan_id = m.scan_id AND p.pred_id = m.pred_id JOIN gt g ON g.scan_id = m.scan_id AND g.vertex_id = m.vertex_id JOIN inst i ON i.scan_id = g.scan_id AND i.gt_id = g.id AND i.label_id = p.label_id GROUP BY p.scan_id, p.pred_id, i.gt_id, p.label_id, p.conf, p.size, i.size, p.void)"
_ALL = f"{b.INSTANCES_SQL}, {_GT}, {_PRED}, {_INTER}"
_TH = f"th AS (SELECT unnest([{', '.join(repr(x) + '::double' for x in ev.OVERLAPS_3D)}]) AS overlap)"
#: At these tables no prediction meets two ground truths above 0.25, so the order of matching is moot.
_FOUND = f"""{_ALL}, {_TH},
met AS (SELECT label_id, overlap, conf AS score, row_number() OVER (PARTITION BY scan_id, gt_id, overlap ORDER BY conf DESC, pred_id) = 1 AS is_true FROM inter, th WHERE iou > overlap AND gt_size >= 100),
lost AS (SELECT label_id, overlap, count(*) AS lost FROM inst i, th WHERE size >= 100 AND NOT EXISTS (SELECT 1 FROM inter x WHERE x.scan_id = i.scan_id AND x.gt_id = i.gt_id AND x.iou > overlap) GROUP BY ALL),
fals AS (SELECT label_id, overlap, conf AS score, false AS is_true FROM pred p, th WHERE NOT EXISTS (SELECT 1 FROM inter x WHERE x.scan_id = p.scan_id AND x.pred_id = p.pred_id AND x.iou > overlap)
  AND (void + coalesce((SELECT sum(n) FROM inter x WHERE x.scan_id = p.scan_id AND x.pred_id = p.pred_id AND x.gt_size < 100), 0)) / size <= overlap),
f AS (SELECT * FROM met UNION ALL SELECT * FROM fals)"""
_CURVE = f"""{_FOUND},
pos AS (SELECT label_id, overlap, count(*) FILTER (is_true) AS t FROM f GROUP BY ALL),
pts AS (SELECT label_id, overlap, score, count(*) FILTER (is_true) AS t, count(*) AS m FROM f GROUP BY ALL),
cum AS (SELECT label_id, overlap, score, sum(t) OVER w AS tp, sum(m) OVER w AS seen FROM pts WINDOW w AS (PARTITION BY label_id, overlap ORDER BY score DESC)),
curve AS (SELECT cum.label_id, cum.overlap, score, tp / seen AS precision, tp / nullif(pos.t + coalesce(lost, 0), 0) AS recall FROM cum JOIN pos USING (label_id, overlap) LEFT JOIN lost USING (label_id, overlap))"""
_AP = f"""{_CURVE},
steps AS (SELECT label_id, overlap, precision * 0.5 * (coalesce(lag(recall) OVER u, recall) - coalesce(lead(recall) OVER u, 0)) + CASE WHEN lead(score) OVER u IS NULL THEN 0.5 * recall ELSE 0 END AS a FROM curve WINDOW u AS (PARTITION BY label_id, overlap ORDER BY score)),
area AS (SELECT label_id, overlap, sum(a) AS ap FROM steps GROUP BY ALL),
ap AS (SELECT c.label_id, overlap, CASE WHEN c.label_id IN (SELECT label_id FROM inst WHERE size >= 100) THEN coalesce(ap, 0) END AS ap FROM (SELECT unnest([{IVALID}]) AS label_id) c CROSS JOIN th LEFT JOIN area USING (label_id, overlap))"""


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    gt, preds, masks = b.instances(spark, d)
    inst, pred, shared = ev.instance_tables(gt, preds, masks, ev.INSTANCE_CLASSES)
    return settled(ev.matches(pred, inst, shared, ev.OVERLAPS_3D)), pred, inst


def _ap(spark: SparkSession, d: str) -> DataFrame:
    found, pred, inst = _found(spark, d)
    classes = spark.createDataFrame([(x,) for x in ev.INSTANCE_CLASSES], "label_id bigint")
    return ev.average_precision(found, pred, inst, classes, ev.OVERLAPS_3D)


@query(f"WITH {b.INSTANCES_SQL}, {_GT} SELECT scan_id, gt_id, label_id, size, -1.0::double AS med_dist, 0.0::double AS dist_conf FROM inst")
def agg11_instance_inventory(spark: SparkSession, d: str) -> DataFrame:
    return ev.gt_instances(b.instances(spark, d)[0], ev.INSTANCE_CLASSES)


@query(f"WITH {b.INSTANCES_SQL}, {_PRED} SELECT scan_id, pred_id, label_id, round(conf, 6) AS conf, size, void FROM pred")
def agg12_prediction_stats(spark: SparkSession, d: str) -> DataFrame:
    gt, preds, masks = b.instances(spark, d)
    return ev.pred_instances(preds, masks, gt, ev.INSTANCE_CLASSES).select("scan_id", "pred_id", "label_id", ev.row("conf"), "size", "void")


@query(f"WITH {_ALL} SELECT scan_id, pred_id, gt_id, label_id, n, round(iou, 6) AS iou FROM inter")
def jn7_instance_matches(spark: SparkSession, d: str) -> DataFrame:
    gt, preds, masks = b.instances(spark, d)
    inst = ev.gt_instances(gt, ev.INSTANCE_CLASSES)
    pred = ev.pred_instances(preds, masks, gt, ev.INSTANCE_CLASSES)
    return ev.intersections(pred, masks, gt, inst).select("scan_id", "pred_id", "gt_id", "label_id", "n", ev.row("iou"))


@query(f"WITH {_FOUND} SELECT label_id, round(overlap, 6) AS overlap, round(score, 6) AS score, is_true, 1 AS n FROM f UNION ALL SELECT label_id, round(overlap, 6), NULL, NULL, lost FROM lost")
def win4_best_prediction_per_gt(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d)[0].select("label_id", ev.row("overlap"), ev.row("score"), "is_true", "n")


@query(f"WITH {_CURVE} SELECT label_id, round(overlap, 6) AS overlap, round(score, 6) AS score, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve")
def win2_pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return ev.pr_curve(_found(spark, d)[0]).select("label_id", ev.row("overlap"), ev.row("score"), ev.row("precision"), ev.row("recall"))


@query(f"WITH {_AP} SELECT label_id, round(overlap, 6) AS overlap, round(ap, 6) AS ap FROM ap")
def agg13_instance_ap(spark: SparkSession, d: str) -> DataFrame:
    return _ap(spark, d).select("label_id", ev.row("overlap"), ev.row("ap"))


@query(f"""WITH {_AP}, per AS (SELECT label_id, CASE WHEN count(*) FILTER (overlap > 0.49 AND ap IS NULL) = 0 THEN avg(ap) FILTER (overlap > 0.49) END AS ap, max(ap) FILTER (overlap = 0.5) AS ap50, max(ap) FILTER (overlap = 0.25) AS ap25 FROM ap GROUP BY label_id)
SELECT label_id, round(ap, 6) AS ap, round(ap50, 6) AS ap50, round(ap25, 6) AS ap25 FROM per UNION ALL SELECT NULL, round(avg(ap) FILTER (overlap > 0.49), 6), round(avg(ap) FILTER (overlap = 0.5), 6), round(avg(ap) FILTER (overlap = 0.25), 6) FROM ap""")
def agg14_ap_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.ap_summary(_ap(spark, d)).select("label_id", ev.row("ap"), ev.row("ap50"), ev.row("ap25"))
