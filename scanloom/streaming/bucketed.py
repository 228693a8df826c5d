"""A scan index kept in buckets of its id, so that a batch of changes rewrites the buckets it touches.

Below the folder lie data/<version>/_bucket=<k> and, for every version, a manifest: which path holds which
bucket, and the last batch that was put in. A version is there when its manifest is complete, so a batch
that fails half-way changes nothing, and one that is put in again is left out. Readers take the newest
manifest's paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scan_index as ix

MANIFEST = "bucket int, path string, batch bigint, buckets int"


def bucket_of(id_col: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete folders below path."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listStatus(top) if fs.exists(top) else []
    return [f.getPath().getName() for f in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(bucket, path, batch, buckets) of the newest version: a row a bucket that is not empty, and one
    without a path."""
    versions = [int(x) for x in _folders(spark, f"{folder}/manifest")]
    if not versions:
        raise FileNotFoundError(f"no index in {folder}")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/{max(versions)}")


def _commit(spark: SparkSession, folder: str, rows: list[tuple], version: int) -> None:
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/{version}")


def _write(rows: DataFrame, folder: str, version: int, buckets: int, id_col: str) -> list[str]:
    """Writes rows by bucket; the buckets that are there."""
    at = f"{folder}/data/{version}"
    keyed = rows.withColumn("_bucket", bucket_of(id_col, buckets)).repartition("_bucket")
    keyed.write.mode("overwrite").partitionBy("_bucket").parquet(at)
    jvm, spark = rows.sparkSession.sparkContext._jvm, rows.sparkSession
    top = jvm.org.apache.hadoop.fs.Path(at)
    names = [f.getPath().getName() for f in top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(top)]
    return [x for x in names if x.startswith("_bucket=")]


def create(index: DataFrame, folder: str, buckets: int, id_col: str = "id") -> None:
    """Writes an index as version 0. A hundred MB or so a bucket is a good size."""
    made = _write(index, folder, 0, buckets, id_col)
    _commit(index.sparkSession, folder, [(int(x.partition("=")[2]), f"data/0/{x}", -1, buckets) for x in made] + [(None, None, -1, buckets)], 0)


def read(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The index as the newest manifest has it."""
    paths = [f"{folder}/{r.path}" for r in manifest(spark, folder).where("path IS NOT NULL").collect()]  # a row a bucket
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def put(changes: DataFrame, folder: str, batch: int, order: str, schema, id_col: str = "id") -> int:
    """Puts the last row of each id of changes (schema and `order`) into the index; how many buckets were
    rewritten. Only these are read; the others stay where they are. A batch that is in already, or an
    earlier one, changes nothing."""
    spark = changes.sparkSession
    now = manifest(spark, folder).collect()  # a row a bucket
    buckets, done = now[0].buckets, max(r.batch for r in now)
    if batch <= done:
        return 0
    changes = changes.persist()
    try:
        last = ix.last_by_id(changes, order).drop(order)
        touched = {r.b for r in last.select(bucket_of(id_col, buckets).alias("b")).distinct().collect()}  # at most a row a bucket
        old = [f"{folder}/{r.path}" for r in now if r.bucket in touched]
        held = spark.read.schema(schema).parquet(*old) if old else spark.createDataFrame([], schema)
        made = _write(ix.append(held, last.select(*held.columns)), folder, batch + 1, buckets, id_col) if touched else []
    finally:
        changes.unpersist()
    rows = [(r.bucket, r.path, batch, buckets) for r in now if r.bucket not in touched]
    _commit(spark, folder, rows + [(int(x.partition("=")[2]), f"data/{batch + 1}/{x}", batch, buckets) for x in made], batch + 1)
    return len(made)


def reindex(updates: DataFrame, folder: str, checkpoint: str, schema, order: str = "ts", id_col: str = "id") -> StreamingQuery:
    """Runs over the updates that are there; each batch is put in."""
    run = lambda batch, n: put(batch, folder, n, order, schema, id_col) and None
    return updates.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vacuum(spark: SparkSession, folder: str) -> int:
    """Removes what only older versions read; the number of folders that went. Not while one is read."""
    keep = {r.path for r in manifest(spark, folder).collect()}
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for version in fs.listStatus(path(f"{folder}/data")):
        for part in fs.listStatus(version.getPath()):
            name = f"data/{version.getPath().getName()}/{part.getPath().getName()}"
            if part.isDirectory() and name not in keep:
                fs.delete(part.getPath(), True)
                gone += 1
    return gone
