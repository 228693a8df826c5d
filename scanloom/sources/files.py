"""Readers of the text and JSON files around scans, and their writers.

Files whose lines have an order that counts are read whole, one row a file, and numbered by position;
nothing depends on how Spark splits its input. Paths are whatever Spark's readers take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AGGREGATION = "segGroups array<struct<id:string,objectId:string,segments:array<string>,label:string>>"
SEGMENTATION = "params map<string,string>, segIndices array<bigint>"


def scan_of(path: Column) -> Column:
    """File name before its first dot."""
    return F.regexp_extract(path, r"([^/.]+)[^/]*$", 1)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of text files, without the empty piece after a last line feed."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\r?\n$", "").alias("v"))
    return whole.select("path", F.posexplode(F.split("v", r"\r?\n")).alias("line_no", "value"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(scan_id, vertex_id, id): one integer a line, in vertex order."""
    return lines(spark, path).select(scan_of(F.col("path")).alias("scan_id"), F.col("line_no").alias("vertex_id"), F.trim("value").try_cast("bigint").alias("id"))


def write_ids(ids: DataFrame, path: str) -> None:
    """A text file a scan, one id a line in vertex order."""
    text = ids.groupBy("scan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("vertex_id", "id"))), lambda r: r["id"].cast("string")), "\n").alias("value"))
    text.write.partitionBy("scan_id").text(path)


def read_segmentation(spark: SparkSession, path: str) -> DataFrame:
    """(scan_id, vertex_id, seg_id)."""
    j = spark.read.schema(SEGMENTATION).json(path, multiLine=True).select(scan_of(F.col("_metadata.file_path")).alias("scan_id"), "segIndices")
    return j.select("scan_id", F.posexplode("segIndices").alias("vertex_id", "seg_id"))


def read_aggregation(spark: SparkSession, path: str) -> DataFrame:
    """(scan_id, group_pos, id, object_id, label, segments); ids may be numbers, numerals or null."""
    j = spark.read.schema(AGGREGATION).json(path, multiLine=True).select(scan_of(F.col("_metadata.file_path")).alias("scan_id"), F.posexplode("segGroups").alias("group_pos", "g"))
    number = lambda c: F.col(c).try_cast("bigint")
    return j.select("scan_id", "group_pos", number("g.id").alias("id"), number("g.objectId").alias("object_id"), F.col("g.label").alias("label"), F.transform("g.segments", lambda s: s.try_cast("bigint")).alias("segments"))


def aggregation_json(groups: DataFrame) -> DataFrame:
    """(scan_id, value): a scan's groups as JSON, object ids renumbered to positions."""
    g = F.struct("group_pos", "id", "label", "segments")
    listed = groups.groupBy("scan_id").agg(F.array_sort(F.collect_list(g)).alias("g"))
    out = F.transform("g", lambda x, i: F.struct(x["id"].alias("id"), i.alias("objectId"), x["segments"].alias("segments"), x["label"].alias("label")))
    return listed.select("scan_id", F.to_json(F.struct(out.alias("segGroups"))).alias("value"))


def segmentation_json(segments: DataFrame, params: dict[str, str]) -> DataFrame:
    listed = segments.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("vertex_id", "seg_id"))), lambda r: r["seg_id"]).alias("segIndices"))
    named = F.create_map(*(F.lit(x) for kv in params.items() for x in kv)) if params else F.lit(None).cast("map<string,string>")
    return listed.select("scan_id", F.to_json(F.struct(named.alias("params"), "segIndices")).alias("value"))


def read_label_map(spark: SparkSession, path: str, source: str = "raw_category", target: str = "id") -> DataFrame:
    """(key, target) of a tab-separated label map; of duplicate keys the last row wins, rows without a
    key do not count."""
    t = lines(spark, path)
    head = t.where("line_no = 0").select("path", F.split("value", "\t").alias("names"))
    named = t.where("line_no > 0").join(head, "path").select("path", "line_no", F.map_from_arrays("names", F.expr("transform(names, (n, i) -> get(split(value, '\\t'), i))")).alias("r"))
    rows = named.select("path", "line_no", F.col("r")[source].alias("key"), F.col("r")[target].alias("target")).where("key <> ''")
    return rows.groupBy("key").agg(F.max_by("target", F.struct("path", "line_no")).alias("target"))


def read_scene_types(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    t = spark.read.csv(path, sep="\t", schema="id bigint, name string")
    return t.withColumn("name", F.trim("name")) if strip else t


def read_splits(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("scan_id"), F.lit(split).alias("split")).where("scan_id <> ''")


def properties(text: DataFrame) -> DataFrame:
    """(scan_id, key, value) of lines (scan_id, line_no, value) "key = value"; blank lines do not count,
    and a file in which a line has not exactly one = is left out as a whole."""
    parts = F.split("value", "=", -1)
    rows = text.where(F.trim("value") != "").select("scan_id", "line_no", F.size(parts).alias("n"), F.trim(parts[0]).alias("key"), F.trim(F.get(parts, F.lit(1))).alias("value"))
    bad = rows.where("n <> 2").select("scan_id").distinct()
    return rows.join(bad, "scan_id", "left_anti").groupBy("scan_id", "key").agg(F.max_by("value", "line_no").alias("value"))


def field(text: DataFrame, name: str) -> DataFrame:
    """(scan_id, value) of lines with exactly "name = value"."""
    p = F.split("value", " = ", -1)
    return text.where((p[0] == name) & (F.size(p) == 2)).select("scan_id", p[1].alias("value"))


def typed_parameters(props: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """One row a scan: wanted is name -> (Spark type, default as SQL)."""
    one = lambda k, t, default: F.coalesce(F.max(F.when(F.col("key") == k, F.col("value"))).try_cast(t), F.expr(default).cast(t)).alias(k)
    return props.groupBy("scan_id").agg(*(one(k, t, v) for k, (t, v) in wanted.items()))


def numbers(text: Column) -> Column:
    """Blank-separated numbers as array<double>."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda s: s != ""), lambda s: s.try_cast("double"))


def read_matrices(spark: SparkSession, path: str, skip_lines: int = 0) -> DataFrame:
    """(path, matrix): 16 numbers a file, row-major; skip_lines header lines; null if not 16."""
    kept = lines(spark, path).where(F.col("line_no") >= skip_lines).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda r: r["value"]), " ").alias("v"))
    m = numbers(F.col("v"))
    return kept.select("path", F.when(F.size(m) == 16, m).alias("matrix"))


def prediction_list(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of lines (scan_id, line_no, value) "mask label confidence": good (scan_id, pred_id,
    mask, label_id, conf), bad with a reason. Masks are relative paths that stay below their root."""
    p = F.split(F.trim("value"), " ")
    label, conf = F.get(p, F.lit(1)).try_cast("double"), F.get(p, F.lit(2)).try_cast("double")
    why = F.when(F.size(p) != 3, "fields").when(p[0].startswith("/"), "absolute").when(p[0].rlike(r"(^|/)\.\.(/|$)"), "outside").when(label.isNull() | conf.isNull(), "number")
    rows = text.withColumn("reason", why)
    return rows.where("reason IS NULL").select("scan_id", F.col("line_no").alias("pred_id"), p[0].alias("mask"), label.cast("bigint").alias("label_id"), conf.alias("conf")), rows.where("reason IS NOT NULL").select("scan_id", "line_no", "value", "reason")


def scene_predictions(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of lines "scan type" with an integer type."""
    p = F.split(F.trim("value"), r"\s+")
    rows = text.select("value", p[0].alias("scan_id"), F.get(p, F.lit(1)).try_cast("bigint").alias("type"), F.size(p).alias("n"))
    ok = (F.col("n") == 2) & F.col("type").isNotNull()
    return rows.where(ok).select("scan_id", "type"), rows.where(~ok).select("value")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(scan_id, name, size, mtime) of files below path; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return f.select(F.element_at(F.split("path", "/"), -2).alias("scan_id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))


def tree_sizes(files: DataFrame) -> DataFrame:
    """(dir, files, size) of every directory above files (path, size)."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.select(F.explode(above).alias("dir"), "size").groupBy("dir").agg(F.count("*").alias("files"), F.sum("size").alias("size"))


def verify(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, ok) for each of manifest (path, md5): whether files (path, content) has it with this MD5."""
    return manifest.join(files.select("path", F.md5("content").alias("found")), "path", "left").select("path", F.coalesce(F.col("found") == F.lower("md5"), F.lit(False)).alias("ok"))


def save_index(index: DataFrame, path: str, columns: list[str], form: str = "csv") -> None:
    """Fixed columns in fixed order, others dropped; lists and structs as JSON in CSV."""
    if form == "json":
        index.select(*columns).write.json(path)
        return
    flat = [F.to_json(c).alias(c) if index.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c) for c in columns]
    index.select(*flat).write.csv(path, header=True)


def panoptic_records(segments: DataFrame, categories: DataFrame) -> DataFrame:
    """(part, value): the panoptic document as JSON lines, each a member of the list that `part` names:
    images and annotations have a line a frame, categories one each. No line grows with the number of
    frames, so the lines may be written side by side."""
    by = segments.groupBy("frame_key").agg(F.array_sort(F.collect_list(F.struct("instance", "area", "x", "y", "w", "h"))).alias("segments_info"))
    line = lambda part, *columns: (F.lit(part).alias("part"), F.to_json(F.struct(*columns)).alias("value"))
    frame = F.col("frame_key")
    both = F.array(F.struct(*line("images", frame.alias("id"))), F.struct(*line("annotations", frame.alias("image_id"), "segments_info")))
    return by.select(F.explode(both).alias("l")).select("l.*").union(categories.select(*line("categories", "id", "name")))


def write_mesh(vertices: DataFrame, path: str) -> None:
    """Typed vertex columns by split and scan (train, val, test)."""
    vertices.write.partitionBy("split", "scan_id").parquet(path)


def write_scores(ap: DataFrame, path: str) -> None:
    """Scores as CSV with a header, undefined ones as nan."""
    ap.write.csv(path, header=True, nullValue="nan")
