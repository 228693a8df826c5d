"""Structured Streaming forms: upload completion, live timings, incremental reindex, sensor alignment.

Every stream that keeps state has event times and a lateness after which a key's state leaves, so state
is that of the keys seen lately, however long the stream runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import TIMING, duration_seconds
from ..operators import scan_index as ix

#: What an upload consists of.
EXTENSIONS = ("depth", "h264", "imu", "jpg", "txt")


def allowed(events: DataFrame) -> DataFrame:
    """File events (ts, scan_id, file) with an allowed extension; the scan is the name before the last dot."""
    name = F.regexp_extract("file", r"^(.*)\.([^.]+)$", 1)
    extension = F.regexp_extract("file", r"^(.*)\.([^.]+)$", 2)
    return events.where(extension.isin(*EXTENSIONS)).withColumn("scan_id", F.coalesce("scan_id", name))


def completed_uploads(events: DataFrame, lateness: str = "1 hour", files: int = len(EXTENSIONS)) -> DataFrame:
    """(scan_id, files, done): per scan the distinct files so far and whether they are enough. As a stream,
    update mode: a scan's state is the set of its files (at most one per allowed extension and name), and
    goes when no file has come for `lateness`; files that come later still begin anew."""
    ok = allowed(events).where("scan_id IS NOT NULL AND file IS NOT NULL")
    if not ok.isStreaming:
        return ok.groupBy("scan_id").agg(F.countDistinct("file").alias("files")).withColumn("done", F.col("files") >= files)
    keep = int(ok.sparkSession.range(1).select(F.unix_micros(F.lit(0).cast("timestamp") + F.expr(f"INTERVAL {lateness}")) / 1000).first()[0])

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, last = state.get if state.exists else ([], 0)
        found = set(seen)
        for b in batches:
            found |= set(b["file"])
            last = max(last, int(b["ts"].max().timestamp() * 1000))
        state.update((sorted(found), last))
        state.setTimeoutTimestamp(max(last + keep, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"scan_id": [key[0]], "files": [len(found)], "done": [len(found) >= files]})

    kind = ok.schema["scan_id"].dataType.simpleString()
    keyed = ok.withWatermark("ts", lateness).select("scan_id", "file", "ts").groupBy("scan_id")
    return keyed.applyInPandasWithState(fold, f"scan_id {kind}, files bigint, done boolean", "files array<string>, last bigint", "update", GroupStateTimeout.EventTimeTimeout)


def live_timings(lines: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(scan_id, name, day, seconds): total of each stage's log lines (ts, scan_id, value) as they come, a
    row a day, so that days behind the watermark leave the state. total_timings() adds the days up."""
    found = lambda i: F.regexp_extract("value", TIMING, i)
    timed = lines.withWatermark("ts", lateness) if lines.isStreaming else lines
    t = timed.select("scan_id", F.window("ts", "1 day").alias("w"), F.split(found(2), ", ")[0].alias("name"), duration_seconds(found(1)).alias("seconds"))
    t = t.where("seconds IS NOT NULL AND name <> '' AND NOT startswith(name, 'cmd')").groupBy("scan_id", "name", "w").agg(F.sum("seconds").alias("seconds"))
    return t.select("scan_id", "name", F.col("w.start").alias("day"), "seconds")


def total_timings(days: DataFrame) -> DataFrame:
    """(scan_id, name, seconds) of what live_timings() has put out."""
    return days.groupBy("scan_id", "name").agg(F.sum("seconds").alias("seconds"))


def reindex(updates: DataFrame, changes: str, checkpoint: str, order: str = "ts") -> StreamingQuery:
    """Runs over the updates that are there (id, order, ...): of each batch the last row of an id is
    written below the folder `changes`, in a part of its own that a repeated batch replaces. A batch costs
    what it changes; the index itself is not rewritten. reindexed() is the index with the changes."""

    def put(batch: DataFrame, n: int) -> None:
        ix.last_by_id(batch, order).write.mode("overwrite").parquet(f"{changes}/batch={n}")

    return updates.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reindexed(index: DataFrame, changes: DataFrame, order: str = "ts") -> DataFrame:
    """index with the last change of each id put in; written out from time to time, it takes the place of
    the index and the changes read so far."""
    last = ix.last_by_id(changes.withColumn(order, F.struct("batch", order)), order)
    return ix.append(index, last.drop(order, "batch"))


def aligned_frames(frames: DataFrame, samples: DataFrame, tolerance_us: int, lateness: str = "10 seconds") -> DataFrame:
    """(scan_id, frame_id, ts, near_us): frames (scan_id, frame_id, ts) with the time of the nearest sample
    (scan_id, ts) within the tolerance, of two as near the later. As a stream: append mode, frames come
    out when the watermark has passed them."""
    f, s = frames.withWatermark("ts", lateness), samples.select(F.col("scan_id").alias("s_scan"), F.col("ts").alias("s_ts")).withWatermark("s_ts", lateness)
    edge = F.expr(f"INTERVAL {tolerance_us / 1e6:.6f} SECONDS")
    near = f.join(s, (F.col("scan_id") == F.col("s_scan")) & (F.col("s_ts") >= F.col("ts") - edge) & (F.col("s_ts") <= F.col("ts") + edge))
    us = F.unix_micros("s_ts")
    pairs = near.select("scan_id", "frame_id", "ts", F.struct(F.abs(us - F.unix_micros("ts")).alias("gap"), (-us).alias("late")).alias("p"))  # one event time goes on
    best = pairs.groupBy("scan_id", "frame_id", "ts").agg(F.min("p").alias("b"))
    return best.select("scan_id", "frame_id", "ts", (-F.col("b.late")).alias("near_us"))


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """What a stream gives for the input that is there: the in-memory table `name` (for tests and small
    results)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What an append stream gives for the input that is there, as Parquet files."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def run_updates(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Final state of an update-mode stream: every batch's rows are written with its number, and the last
    row of a key counts."""

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(path)

    q = stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = stream.sparkSession.read.parquet(path)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (*keys, "_batch"))), "_batch").alias("r"))
    return last.select(*keys, "r.*")
