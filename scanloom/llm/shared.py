"""Helpers that the operators of this subpackage share: tables in the cluster's shared folder,
columns that clash with nobody's, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import fresh_path

__all__ = ["components", "cut", "discard", "free_name", "fresh_path", "hex64", "remove"]


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: what follows neither
    repeats the work nor depends on an executor's local files."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scanloom_path = path
    return back


def discard(df: DataFrame) -> None:
    """Removes a table made by cut() that nothing reads any more."""
    path = getattr(df, "_scanloom_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, wish: str) -> str:
    """wish, or wish with as many underscores as no column of df has (case aside)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def hex64(c: Column) -> Column:
    """A bigint's 64 bits as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): one row (node, root) per node, root being the smallest
    node reachable. Large-star and small-star rounds in turn; every round is a map-side minimum, a
    join on the node with the table of minima, and a table in the shared folder. The minima have a row a
    node, so a node with many neighbours skews only the edges' side of the join, which Spark splits.
    Empty edges give an empty table; loops and repeated edges do no harm."""
    spark = edges.sparkSession
    now = cut(edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "stars")
    before = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u AS x", "least(u, m) AS m"), "minima")
        large = cut(both.join(low, both.u == low.x).where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct(), "stars")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x"), "minima")
        small = large.join(least, large.u == least.x).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = cut(small, "stars")
        for old in (now, low, large, least):
            discard(old)
        now = after
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            break
        before = state
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
