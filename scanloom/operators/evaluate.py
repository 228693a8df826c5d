"""Scores of predictions: confusion matrices, IoU, recall, accuracy, average precision of instances.

Matrices are long tables (gt, pred, n): a map-side count before the only shuffle, however many
vertices or pixels there are. Undefined scores are null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import label_of_instance
from .tables import settled

#: Class ids that the 20-class semantic task scores.
VALID_CLASSES = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 24, 28, 33, 34, 36, 39]
#: Class ids of the instance task (no walls and floors).
INSTANCE_CLASSES = VALID_CLASSES[2:]
OVERLAPS_3D = [0.5 + i * 0.05 for i in range(9)] + [0.25]
OVERLAPS_2D = [0.5 + i * 0.05 for i in range(10)]
MIN_REGION = 100


def aligned(pred: DataFrame, gt: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gt, pred) of rows that both have."""
    return gt.select(*keys, F.col("value").alias("gt")).join(pred.select(*keys, F.col("value").alias("pred")), keys)


def mismatch(pred: DataFrame, gt: DataFrame, keys: list[str], by: str = "scan_id") -> DataFrame:
    """Per scan the rows that only one side has; scans without any are absent."""
    both = gt.select(*keys, F.lit(1).alias("g")).join(pred.select(*keys, F.lit(1).alias("p")), keys, "full_outer")
    out = both.groupBy(by).agg(F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("g").isNull()).alias("extra"))
    return out.where("missing > 0 OR extra > 0")


def confusion(pairs: DataFrame, valid: list[int] | None = None) -> DataFrame:
    """(gt, pred, n). With valid, rows of other gt are skipped and other predictions count as unknown,
    which is one more than the largest class."""
    if valid is not None:
        pairs = pairs.where(F.col("gt").isin(valid)).withColumn("pred", F.when(F.col("pred").isin(valid), F.col("pred")).otherwise(F.lit(max(valid) + 1).cast("bigint")))
    return pairs.groupBy("gt", "pred").agg(F.count("*").alias("n"))


def class_scores(matrix: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, tp, fn, fp, iou, recall) for each of classes (class): false positives only from rows of
    these classes; null where a denominator is 0."""
    valid = matrix.join(classes.select(F.col("class").alias("gt")), "gt", "left_semi")
    rows = valid.groupBy(F.col("gt").alias("class")).agg(F.sum("n").alias("row"), F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    columns = valid.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("column"))
    s = classes.select("class").join(rows, "class", "left").join(columns, "class", "left").fillna(0, ["row", "tp", "column"])
    s = s.select("class", "tp", (F.col("row") - F.col("tp")).alias("fn"), (F.col("column") - F.col("tp")).alias("fp"))
    return s.select("*", F.try_divide("tp", F.col("tp") + F.col("fn") + F.col("fp")).alias("iou"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"))


def mean_score(scores: DataFrame, column: str = "iou") -> DataFrame:
    """Mean over the classes for which the score is defined."""
    return scores.agg(F.avg(column).alias(f"mean_{column}"))


def normalised(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("gt")))


def priors(matrix: DataFrame) -> DataFrame:
    """(gt, prior): a class's share of all rows."""
    rows = matrix.groupBy("gt").agg(F.sum("n").alias("row"))
    return rows.join(F.broadcast(rows.agg(F.sum("row").alias("total"))), F.lit(True)).select("gt", (F.col("row") / F.col("total")).alias("prior"))


def accuracy(pairs: DataFrame, excluded: list[int]) -> DataFrame:
    """(accuracy, class_accuracy): overall, and the mean over classes with support; targets in
    `excluded` do not count."""
    per = pairs.where(~F.col("gt").isin(excluded)).groupBy("gt").agg(F.count("*").alias("n"), F.count_if(F.col("gt") == F.col("pred")).alias("right"))
    return per.agg(F.try_divide(F.sum("right"), F.sum("n")).alias("accuracy"), F.avg(F.col("right") / F.col("n")).alias("class_accuracy"))


def class_weights(histogram: DataFrame) -> DataFrame:
    """(class, n, frequency, weight) of (class, n): 1 / ln(1.2 + frequency), 0 for empty classes."""
    total = histogram.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return histogram.join(F.broadcast(total), F.lit(True)).select("class", "n", p.alias("frequency"), F.when(p > 0, 1 / F.log(p + 1.2)).otherwise(0.0).alias("weight"))


def missing_scenes(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Scans of gt without a prediction."""
    return gt.join(pred.select("scan_id"), "scan_id", "left_anti")


# --- instances


def gt_instances(gt: DataFrame, valid: list[int]) -> DataFrame:
    """(scan_id, gt_id, label_id, size, med_dist, dist_conf) of gt (scan_id, vertex_id, id) but id 0."""
    label = label_of_instance(F.col("id"))
    found = gt.where((F.col("id") != 0) & label.isin(valid)).groupBy("scan_id", F.col("id").alias("gt_id")).agg(F.count("*").alias("size"))
    return found.select("scan_id", "gt_id", label_of_instance(F.col("gt_id")).alias("label_id"), "size", F.lit(-1.0).alias("med_dist"), F.lit(0.0).alias("dist_conf"))


def pred_instances(preds: DataFrame, masks: DataFrame, gt: DataFrame, valid: list[int], least: int = MIN_REGION, pixel_void: bool = False) -> DataFrame:
    """preds (scan_id, pred_id, label_id, conf) of valid labels with size and void, the mask's rows on
    ground truth of no scored class; smaller ones than `least` go. pixel_void: void means pixels that
    hold a bare valid label instead, without an instance."""
    return _sized(preds, _counted(masks, gt), valid, least, pixel_void)


def _counted(masks: DataFrame, gt: DataFrame) -> DataFrame:
    """(scan_id, pred_id, id, n): a mask's rows by what the ground truth has there (null: no such row)."""
    return masks.join(gt, ["scan_id", "vertex_id"], "left").groupBy("scan_id", "pred_id", "id").agg(F.count("*").alias("n"))


def _sized(preds: DataFrame, counted: DataFrame, valid: list[int], least: int = MIN_REGION, pixel_void: bool = False) -> DataFrame:
    void = F.col("id").isin(valid) if pixel_void else ~label_of_instance(F.col("id")).isin(valid)
    kept = preds.where(F.col("label_id").isin(valid))
    size = counted.groupBy("scan_id", "pred_id").agg(F.sum("n").alias("size"), F.sum(F.when(void, F.col("n")).otherwise(0)).alias("void"))
    return kept.join(size, ["scan_id", "pred_id"]).where(F.col("size") >= least)


def intersections(preds: DataFrame, masks: DataFrame, gt: DataFrame, instances: DataFrame) -> DataFrame:
    """(scan_id, pred_id, gt_id, label_id, conf, pred_size, gt_size, void, n, iou) of predictions and
    ground truth of one label that share rows: one join by row, then counts."""
    return _crossed(preds, _counted(masks, gt.where("id <> 0")), instances)


def _crossed(preds: DataFrame, counted: DataFrame, instances: DataFrame) -> DataFrame:
    shared = counted.where("id <> 0").withColumnRenamed("id", "gt_id")
    p = preds.select("scan_id", "pred_id", "label_id", "conf", F.col("size").alias("pred_size"), "void")
    g = instances.select("scan_id", "gt_id", "label_id", F.col("size").alias("gt_size"))
    both = shared.join(p, ["scan_id", "pred_id"]).join(g, ["scan_id", "gt_id", "label_id"])
    return both.withColumn("iou", F.col("n") / (F.col("gt_size") + F.col("pred_size") - F.col("n")))


def instance_tables(gt: DataFrame, preds: DataFrame, masks: DataFrame, valid: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(instances, preds, intersections) as tables: matching reads them several times, and they are as
    small as the lists of instances, whatever the number of vertices. Masks meet the ground truth once."""
    counted = settled(_counted(masks, gt))
    inst, pred = settled(gt_instances(gt, valid)), settled(_sized(preds, counted, valid))
    return inst, pred, settled(_crossed(pred, counted, inst))


def _greedy(rows: pd.DataFrame) -> pd.DataFrame:
    """Matches of one scan, class and overlap in which a prediction may meet two ground truths: in order
    of gt_id, then pred_id, a prediction that was some ground truth's first match is skipped."""
    used, out, best, at = set(), [], None, None
    for gt_id, pred_id, conf in sorted(zip(rows["gt_id"].tolist(), rows["pred_id"].tolist(), rows["conf"].tolist(), strict=True)):
        if gt_id != at:
            if best is not None:
                out.append((best, True))
            best, at = None, gt_id
        if pred_id in used:
            continue
        if best is None:
            best = conf
            used.add(pred_id)
        else:
            out.append((min(best, conf), False))
            best = max(best, conf)
    if best is not None:
        out.append((best, True))
    first = rows.iloc[0]
    return pd.DataFrame({"label_id": first.label_id, "overlap": first.overlap, "score": [s for s, _ in out], "is_true": [t for _, t in out], "matched": [t for _, t in out]})


def matches(preds: DataFrame, instances: DataFrame, shared: DataFrame, overlaps: list[float], least: int = MIN_REGION, visited: bool = True) -> DataFrame:
    """(label_id, overlap, score, is_true) of all scored predictions, and one row with null score for
    each ground truth without a match (a hard false negative).

    At overlaps of 0.5 or more a prediction matches one ground truth at most, so the best prediction of
    a ground truth is true and the others false; below, and where visited, matches are settled in turn
    per scan and class (lists of a scan's matches, a few rows)."""
    spark = preds.sparkSession
    th = spark.createDataFrame([(float(x),) for x in overlaps], "overlap double")
    over = shared.join(F.broadcast(th), F.col("iou") > F.col("overlap"))
    big = over.where(F.col("gt_size") >= least)
    place = F.row_number().over(Window.partitionBy("scan_id", "gt_id", "overlap").orderBy(F.desc("conf"), "pred_id"))
    apart = F.col("overlap") >= 0.5 if visited else F.lit(True)
    simple = big.where(apart).withColumn("k", place).select("label_id", "overlap", F.col("conf").alias("score"), (F.col("k") == 1).alias("is_true"), (F.col("k") == 1).alias("matched"))
    turns = ["scan_id", "label_id", "overlap"]  # dealt by a number: a turn costs more than its few bytes tell
    turn = big.where(~apart).select("scan_id", "label_id", "overlap", "gt_id", "pred_id", "conf").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *turns).groupBy(*turns).applyInPandas(_greedy, "label_id bigint, overlap double, score double, is_true boolean, matched boolean")
    met = settled(simple.select(F.col("label_id").cast("bigint").alias("label_id"), "overlap", "score", "is_true", "matched").union(turn))  # read twice
    scored = instances.where(F.col("size") >= least).groupBy(F.col("label_id").cast("bigint").alias("label_id")).agg(F.count("*").alias("all"))
    hits = met.where("matched").groupBy("label_id", "overlap").agg(F.count("*").alias("hit"))
    lost = scored.join(F.broadcast(th), F.lit(True)).join(hits, ["label_id", "overlap"], "left").select("label_id", "overlap", (F.col("all") - F.coalesce("hit", F.lit(0))).alias("lost"))
    small = shared.groupBy("scan_id", "pred_id").agg(F.sum(F.when(F.col("gt_size") < least, F.col("n")).otherwise(0)).alias("small"), F.max("iou").alias("best"))
    free = preds.join(small, ["scan_id", "pred_id"], "left").join(F.broadcast(th), F.coalesce("best", F.lit(0.0)) <= F.col("overlap"))
    ignored = (F.col("void") + F.coalesce("small", F.lit(0))) / F.col("size")
    false = free.where(ignored <= F.col("overlap")).select(F.col("label_id").cast("bigint").alias("label_id"), "overlap", F.col("conf").alias("score"), F.lit(False).alias("is_true"))
    none = lost.where("lost > 0").select("label_id", "overlap", F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("is_true"), F.col("lost").alias("n"))
    return met.select("label_id", "overlap", "score", "is_true", F.lit(1).cast("bigint").alias("n")).union(false.withColumn("n", F.lit(1).cast("bigint"))).union(none)


def pr_curve(found: DataFrame) -> DataFrame:
    """(label_id, overlap, score, precision, recall): a point for each distinct score."""
    total = found.groupBy("label_id", "overlap").agg(F.sum(F.when(F.col("is_true") | F.col("score").isNull(), F.col("n")).otherwise(0)).alias("positives"))
    points = found.where("score IS NOT NULL").groupBy("label_id", "overlap", "score").agg(F.count_if("is_true").alias("t"), F.count("*").alias("m"))
    down = Window.partitionBy("label_id", "overlap").orderBy(F.desc("score"))
    run = points.select("label_id", "overlap", "score", F.sum("t").over(down).alias("tp"), F.sum("m").over(down).alias("seen"))
    return run.join(total, ["label_id", "overlap"]).select("label_id", "overlap", "score", (F.col("tp") / F.col("seen")).alias("precision"), F.try_divide("tp", "positives").alias("recall"))


def average_precision(found: DataFrame, preds: DataFrame, instances: DataFrame, classes: DataFrame, overlaps: list[float], least: int = MIN_REGION) -> DataFrame:
    """(label_id, overlap, ap) for every class (label_id) and overlap. Ground truth and no (counted)
    prediction: 0; no ground truth: null."""
    curve = pr_curve(found)
    up = Window.partitionBy("label_id", "overlap").orderBy("score")
    above = F.coalesce(F.lead("recall").over(up), F.lit(0.0))
    step, first = 0.5 * (F.lag("recall").over(up) - above), 0.5 * (F.col("recall") - above)
    last = F.when(F.lead("score").over(up).isNull(), 0.5 * F.col("recall")).otherwise(0.0)
    area = curve.select("label_id", "overlap", (F.col("precision") * F.coalesce(step, first) + last).alias("a")).groupBy("label_id", "overlap").agg(F.sum("a").alias("ap"))
    has = instances.where(F.col("size") >= least).select(F.col("label_id").cast("bigint").alias("label_id")).distinct().withColumn("has_gt", F.lit(True))
    th = preds.sparkSession.createDataFrame([(float(x),) for x in overlaps], "overlap double")
    grid = classes.select(F.col("label_id").cast("bigint").alias("label_id")).join(F.broadcast(th), F.lit(True))
    return grid.join(has, "label_id", "left").join(area, ["label_id", "overlap"], "left").select("label_id", "overlap", F.when(F.col("has_gt"), F.coalesce("ap", F.lit(0.0))).alias("ap"))


def ap_summary(ap: DataFrame, strict: list[float] = OVERLAPS_3D[:-1]) -> DataFrame:
    """(label_id, ap, ap50, ap25): per class the plain mean over the strict overlaps (undefined if one
    is), and a row with null label_id: means over the classes for which they are defined."""
    low, high = min(strict) - 1e-9, max(strict) + 1e-9
    at = lambda x: F.max(F.when(F.abs(F.col("overlap") - x) < 1e-9, F.col("ap")))
    inside = F.col("overlap").between(low, high)
    whole = F.when(F.count_if(inside & F.col("ap").isNull()) == 0, F.avg(F.when(inside, F.col("ap"))))
    per = ap.groupBy("label_id").agg(whole.alias("ap"), at(0.5).alias("ap50"), at(0.25).alias("ap25"))
    all_ = ap.agg(F.avg(F.when(inside, F.col("ap"))).alias("ap"), F.avg(F.when(F.abs(F.col("overlap") - 0.5) < 1e-9, F.col("ap"))).alias("ap50"), F.avg(F.when(F.abs(F.col("overlap") - 0.25) < 1e-9, F.col("ap"))).alias("ap25"))
    return per.unionByName(all_.withColumn("label_id", F.lit(None).cast("bigint")))


def row(n: str) -> Column:
    return F.round(F.col(n), 6).alias(n)
