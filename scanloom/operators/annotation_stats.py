"""Statistics of annotations: per scan and over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import category
from .labels import segment_groups


def scan_statistics(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """Per scan: vertices and segments in all and annotated (in a group whose label is neither empty nor
    "unknown"), groups, labelled groups, distinct labels and categories, and whole percentages, rounded
    down. Segments in several groups count once; labels of segments follow any named group."""
    named = (F.col("label") != "") & (F.col("label") != "unknown")
    sizes = segments.groupBy("scan_id", "seg_id").agg(F.count("*").alias("n"))
    owned = groups.where(named).select("scan_id", F.explode("segments").alias("seg_id")).distinct().withColumn("named", F.lit(1))
    per = sizes.join(owned, ["scan_id", "seg_id"], "left").groupBy("scan_id").agg(
        F.sum("n").alias("verts"), F.count("*").alias("segs"), F.sum(F.when(F.col("named") == 1, F.col("n")).otherwise(0)).alias("annotated_verts"), F.count("named").alias("annotated_segs"),
    )
    of = groups.groupBy("scan_id").agg(F.count("*").alias("groups"), F.count_if(named).alias("labelled"), F.count_distinct(F.when(named, F.col("label"))).alias("labels"), F.count_distinct(F.when(named, category(F.col("label")))).alias("categories"))
    share = lambda a, b: F.floor(100 * F.col(a) / F.col(b)).cast("bigint")
    joined = per.join(of, "scan_id", "left").fillna(0)
    return joined.select("*", (F.col("verts") - F.col("annotated_verts")).alias("unannotated_verts"), (F.col("segs") - F.col("annotated_segs")).alias("unannotated_segs"), share("annotated_verts", "verts").alias("vert_percent"), share("annotated_segs", "segs").alias("seg_percent"))


def label_counts(groups: DataFrame, by_category: bool = False) -> DataFrame:
    """Groups per label or category, most frequent first."""
    key = category(F.col("label")) if by_category else F.col("label")
    return groups.where("label NOT IN ('', 'unknown')").groupBy(key.alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def annotations_by_model(annotations: DataFrame, segments: DataFrame) -> DataFrame:
    """(model, groups): annotations (model_id "source.name", id, label) gathered by model name; models of
    segments without annotations have empty groups."""
    of = annotations.groupBy(F.element_at(F.split("model_id", r"\."), 2).alias("model")).agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("groups"))
    models = segments.select(F.col("scan_id").alias("model")).distinct()
    return models.join(of, "model", "left").select("model", F.coalesce("groups", F.array().cast(of.schema["groups"].dataType)).alias("groups"))


__all__ = ["annotations_by_model", "label_counts", "scan_statistics", "segment_groups"]
