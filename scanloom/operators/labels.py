"""Labels of vertices and pixels: remapping, painting through an over-segmentation, renumbering.

Keys are scan_id and vertex_id unless said otherwise; all sides of a join are shuffled by them, and
only dimension tables (label maps, class sets, splits) are left to the optimizer to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remap(values: DataFrame, mapping: DataFrame, value_col: str = "value", parity: bool = False) -> DataFrame:
    """values with value_col replaced through mapping (key, target); unmapped values stay. parity:
    narrowed to a byte as an image would. Duplicate keys of mapping: the last by position wins."""
    last = mapping.groupBy("key").agg(F.max_by("target", "position").alias("target")) if "position" in mapping.columns else mapping.dropDuplicates(["key"])
    out = F.coalesce("target", F.col(value_col))
    joined = values.join(last, values[value_col] == last["key"], "left").withColumn(value_col, F.pmod(out, F.lit(256)) if parity else out)
    return joined.drop("key", "target")


def class_remap(values: DataFrame, mapping: DataFrame, num_classes: int) -> DataFrame:
    """Training classes 1..num_classes: unmapped values become the last one ("unlabeled")."""
    mapped = values.join(mapping.select("key", "target"), values["value"] == mapping["key"], "left")
    to = F.coalesce("target", F.lit(255))
    return mapped.withColumn("class", F.when(to == 255, num_classes - 1).otherwise(to) + 1).drop("key", "target")


def class_map(lines: DataFrame) -> DataFrame:
    """(key, target) of a class-map file (line_no, value): the header goes, the first two tokens count,
    and reading stops at the first malformed line."""
    t = F.split(F.trim("value"), r"\s+")
    rows = lines.where("line_no > 0").select("line_no", F.get(t, F.lit(0)).try_cast("int").alias("key"), F.get(t, F.lit(1)).try_cast("int").alias("target"))
    stop = rows.where("key IS NULL OR target IS NULL").agg(F.min("line_no").alias("stop"))
    return rows.join(F.broadcast(stop), F.col("stop").isNull() | (F.col("line_no") < F.col("stop"))).select("key", "target")


def paint(segments: DataFrame, groups: DataFrame, value: Column, default: int = 0) -> DataFrame:
    """(scan_id, vertex_id, value) for every vertex of segments (scan_id, vertex_id, seg_id): the value
    of the group (scan_id, group_pos, ..., segments) that has its segment; of several the last by
    position, of none `default`."""
    owned = groups.select("scan_id", "group_pos", value.alias("value"), F.explode("segments").alias("seg_id"))
    owned = owned.groupBy("scan_id", "seg_id").agg(F.max_by("value", "group_pos").alias("value"))
    return segments.join(owned, ["scan_id", "seg_id"], "left").select("scan_id", "vertex_id", F.coalesce("value", F.lit(default)).alias("value"))


def paint_labels(segments: DataFrame, groups: DataFrame, label_map: DataFrame) -> DataFrame:
    """paint() with the id of the group's label (label_map: key, target); labels without id paint 0."""
    named = groups.join(label_map.select(F.col("key").alias("label"), F.col("target").alias("label_id")), "label", "left")
    return paint(segments, named, F.coalesce("label_id", F.lit(0)))


def paint_instances(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """paint() with object ids from 1."""
    return paint(segments, groups, F.col("object_id") + 1)


def paint_large_vocabulary(segments: DataFrame, groups: DataFrame, label_map: DataFrame, valid: DataFrame) -> DataFrame:
    """(scan_id, vertex_id, label_id, instance_id): raw category by first entry of label_map
    (raw_category, id, position), 0 where not in valid (id); instances are group ids, so group 0 is as
    if not annotated; of several groups the last by position."""
    first = label_map.groupBy("raw_category").agg(F.min_by("id", "position").alias("label_id"))
    known = first.join(valid.select(F.col("id").alias("label_id")), "label_id", "left_semi")
    named = groups.join(known, groups["label"] == known["raw_category"], "left")
    both = paint(segments, named, F.named_struct(F.lit("label_id"), F.coalesce("label_id", F.lit(0)), F.lit("instance_id"), F.col("id")), None)
    return both.select("scan_id", "vertex_id", F.coalesce("value.label_id", F.lit(0)).alias("label_id"), F.coalesce("value.instance_id", F.lit(0)).alias("instance_id"))


def segment_groups(groups: DataFrame) -> DataFrame:
    """(scan_id, seg_id, group_pos): the last group that has the segment."""
    return groups.select("scan_id", "group_pos", F.explode("segments").alias("seg_id")).groupBy("scan_id", "seg_id").agg(F.max("group_pos").alias("group_pos"))


def segment_vertices(segments: DataFrame) -> DataFrame:
    """(scan_id, seg_id, vertices ascending)."""
    return segments.groupBy("scan_id", "seg_id").agg(F.array_sort(F.collect_list("vertex_id")).alias("vertices"))


def renumber_instances(pixels: DataFrame) -> DataFrame:
    """(frame_key, instance, value) for instances (not 0) of pixels (frame_key, y, x, label, instance):
    label of the first pixel in raster order * 1000 + running number among the label's instances."""
    first = pixels.where("instance <> 0").groupBy("frame_key", "instance").agg(F.min_by("label", F.struct("y", "x")).alias("label"))
    number = F.row_number().over(Window.partitionBy("frame_key", "label").orderBy("instance"))
    return first.select("frame_key", "instance", (F.col("label") * 1000 + number).cast("bigint").alias("value"))


def split_of(scans: DataFrame, splits: DataFrame) -> DataFrame:
    """scans with split: train if listed there, else val if listed there, else test."""
    listed = splits.groupBy("scan_id").agg(F.max(F.col("split") == "train").alias("train"), F.max(F.col("split") == "val").alias("val"))
    named = F.when(F.col("train"), "train").when(F.col("val"), "val").otherwise("test")
    return scans.join(listed, "scan_id", "left").withColumn("split", named).drop("train", "val")


def exported_instances(ids: DataFrame) -> DataFrame:
    """Prediction list of (scan_id, vertex_id, label, instance): an entry for each instance but 0, its
    label that of its first vertex, confidence 1, numbered by instance id from 0."""
    found = ids.where("instance <> 0").groupBy("scan_id", "instance").agg(F.min_by("label", "vertex_id").alias("label_id"))
    number = F.row_number().over(Window.partitionBy("scan_id").orderBy("instance")) - 1
    return found.select("scan_id", number.alias("pred_id"), "instance", "label_id", F.lit(1.0).alias("conf"))


def restrict(rows: DataFrame, classes: DataFrame, key: str = "class_id", void: bool = False) -> DataFrame:
    """rows whose class is in the class set; void: those whose class is not."""
    return rows.join(classes.select(key), key, "left_anti" if void else "left_semi")


def vocabulary_splits(class_dim: DataFrame) -> DataFrame:
    """Classes by part (head, common, tail) with counts of those in training and validation only."""
    return class_dim.groupBy("part").agg(F.count("*").alias("classes"), F.sum((F.col("in_train") & ~F.col("in_val")).cast("int")).alias("train_only"), F.sum((F.col("in_val") & ~F.col("in_train")).cast("int")).alias("val_only"))


def projection_labels(segments: DataFrame, groups: DataFrame, label_map: DataFrame) -> DataFrame:
    """(scan_id, vertex_id, label_id, object_id) for drawing: objects are group positions from 1 (each its
    own, also of one label), labels through label_map (key, target), 0 for none."""
    named = groups.join(label_map.select(F.col("key").alias("label"), F.col("target").alias("label_id")), "label", "left")
    both = paint(segments, named, F.named_struct(F.lit("label_id"), F.coalesce("label_id", F.lit(0)), F.lit("object_id"), F.col("group_pos") + 1), None)
    return both.select("scan_id", "vertex_id", F.coalesce("value.label_id", F.lit(0)).alias("label_id"), F.coalesce("value.object_id", F.lit(0)).alias("object_id"))


def coloured(rows: DataFrame, palette: DataFrame, value: str = "value", modulo: bool = False) -> DataFrame:
    """rows with r, g, b from palette (position, r, g, b): labels by position (null beyond the palette),
    instances modulo its size. The palette is a few dozen rows."""
    n = palette.count()
    p = palette.select(F.col("position").alias("_p"), "r", "g", "b")
    key = F.pmod(F.col(value), F.lit(n)) if modulo else F.col(value)
    return rows.withColumn("_p", key).join(p, "_p", "left").drop("_p")
