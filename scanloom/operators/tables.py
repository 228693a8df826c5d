"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else the context's checkpoint folder. Where both are unset, a
    temporary folder if the session runs on one machine (as in tests); a cluster has no folder that could
    be guessed, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_by_user = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_by_user.get() if set_by_user.isDefined() else None
    if found:
        return found.rstrip("/")
    return local_folder(spark.sparkContext.master, spark.sparkContext.applicationId)


def local_folder(master: str, app: str) -> str:
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, so an iteration does not carry its lineage on."""
    path = fresh_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
