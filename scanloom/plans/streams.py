"""Streams over the driver's events, run to the end of the input that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables as tb
from ..streaming import bucketed as bk
from ..streaming import streams as st
from . import bindings as b
from .registry import query


def _folder(spark: SparkSession) -> str:
    return tb.fresh_path(spark, "stream")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of the file that they are in."""
    schema = b.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT 's' || user_id AS scan_id, count(DISTINCT event_id % 7) FILTER (event_id % 7 < 5) AS files, count(DISTINCT event_id % 7) FILTER (event_id % 7 < 5) >= 5 AS done FROM events WHERE event_id % 7 < 5 GROUP BY 1")
def str1_upload_complete(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, [*st.EXTENSIONS, "exe", "tmp"]))
    e = _events(spark, d).select("ts", F.concat(F.lit("s"), "user_id").alias("scan_id"), F.concat(F.lit("scan."), F.element_at(names, (F.col("event_id") % 7 + 1).cast("int"))).alias("file"))
    out = st.completed_uploads(e, lateness="4000 days")
    at = _folder(spark)
    return st.run_updates(out, f"{at}/out", f"{at}/checkpoint", ["scan_id"]).select("scan_id", "files", "done")


@query("SELECT user_id AS scan_id, event_type AS name, sum((event_id % 3) * 3600 + (event_id % 60) * 60 + event_id % 59)::double AS seconds FROM events WHERE event_id % 13 <> 0 GROUP BY ALL")
def str4_live_timings(spark: SparkSession, d: str) -> DataFrame:
    value = F.expr("CASE WHEN event_id % 13 = 0 THEN 'noise' ELSE concat('Time=', event_id % 3, ':', lpad(cast(event_id % 60 AS string), 2, '0'), ':', lpad(cast(event_id % 59 AS string), 2, '0'), ' for ', event_type, ', cmd=\"run\"') END")
    at = _folder(spark)
    out = st.live_timings(_events(spark, d).select("ts", F.col("user_id").alias("scan_id"), value.alias("value")))
    return st.total_timings(st.run_updates(out, f"{at}/out", f"{at}/checkpoint", ["scan_id", "name", "day"]))


@query("WITH u AS (SELECT user_id AS id, arg_max(event_type, event_id) AS name FROM events GROUP BY 1) SELECT * FROM u UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT id FROM u)")
def str2_incremental_reindex(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    index = b.table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name")
    updates = _events(spark, d).select(F.col("user_id").alias("id"), F.col("event_id").alias("ts"), F.col("event_type").alias("name"))
    st.reindex(updates, f"{at}/changes", f"{at}/checkpoint").awaitTermination()
    return st.reindexed(index, spark.read.parquet(f"{at}/changes"))


@query("WITH u AS (SELECT user_id AS id, arg_max(event_type, event_id) AS name FROM events GROUP BY 1) SELECT * FROM u UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT id FROM u)")
def str2_bucketed_index(spark: SparkSession, d: str) -> DataFrame:
    """The index in 16 buckets of its id; the stream's batches rewrite those that they touch."""
    at = _folder(spark)
    schema = "id bigint, name string"
    bk.create(b.table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name"), f"{at}/index", 16)
    updates = _events(spark, d).select(F.col("user_id").alias("id"), F.col("event_id").alias("ts"), F.col("event_type").alias("name"))
    bk.reindex(updates, f"{at}/index", f"{at}/checkpoint", schema).awaitTermination()
    return bk.read(spark, f"{at}/index", schema)


@query("""WITH f AS (SELECT user_id AS scan_id, event_id AS frame_id, epoch_us(ts) AS ts FROM events WHERE event_type = 'view'), s AS (SELECT user_id AS scan_id, epoch_us(ts) AS ts FROM events WHERE event_type = 'click'),
n AS (SELECT f.scan_id, frame_id, f.ts AS frame_us, s.ts AS near_us, row_number() OVER (PARTITION BY f.scan_id, frame_id ORDER BY abs(s.ts - f.ts), s.ts DESC) AS k FROM f JOIN s ON s.scan_id = f.scan_id AND abs(s.ts - f.ts) <= 20000000000) SELECT scan_id, frame_id, near_us FROM n WHERE k = 1""")
def str3_aligned_frames(spark: SparkSession, d: str) -> DataFrame:
    """A far later frame and sample of no scan, appended as a second file, push the watermark on."""
    at = _folder(spark)
    e = b.table(spark, d, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    e.withColumn("part", F.lit(0)).write.parquet(f"{at}/in/a")
    end = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("bigint").alias("user_id"), F.explode(F.expr("array(-1L, -2L, -3L, -4L)")).alias("event_id"), "ts")
    for n, days in enumerate((3000, 6000)):
        late = end.select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, "view").otherwise("click").alias("event_type"), (F.col("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("ts"), F.lit(n + 1).alias("part"))
        late.write.parquet(f"{at}/in/b{n}")
    schema = spark.read.parquet(f"{at}/in/a").schema
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1000).parquet(f"{at}/in")
    f = stream().where("event_type = 'view'").select(F.col("user_id").alias("scan_id"), F.col("event_id").alias("frame_id"), "ts")
    s = stream().where("event_type = 'click'").select(F.col("user_id").alias("scan_id"), "ts")
    out = st.aligned_frames(f, s, 20_000_000_000)
    return st.run_to_files(out, f"{at}/out", f"{at}/checkpoint").where("scan_id >= 0").select("scan_id", "frame_id", "near_us")


@query("SELECT user_id AS scan_id, count(*) AS files FROM events WHERE event_id % 7 < 5 GROUP BY 1")
def flt9_allowed_files(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, [*st.EXTENSIONS, "exe", "tmp"]))
    e = b.table(spark, d, "events").select("ts", F.col("user_id").alias("scan_id"), F.concat(F.lit("scan.x."), F.element_at(names, (F.col("event_id") % 7 + 1).cast("int"))).alias("file"))
    return st.allowed(e).groupBy("scan_id").agg(F.count("*").alias("files"))
