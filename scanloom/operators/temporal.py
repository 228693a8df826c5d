"""Sensor streams of a scan: frames (scan_id, frame_id, ts, ...) and inertial samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_buckets(rows: DataFrame, key: str, ts: str, bucket_rows: int) -> DataFrame:
    """rows with `_bucket`: the time of a key, from its first to its last row, in even parts of about
    bucket_rows rows."""
    at = F.col(ts).cast("double")
    span = rows.groupBy(F.col(key).alias("_key")).agg(F.min(at).alias("_from"), F.max(at).alias("_to"), F.ceil(F.count("*") / bucket_rows).alias("_parts"))
    j = rows.join(span, F.expr(f"`{key}` <=> _key"))
    part = F.floor(F.try_divide(at - F.col("_from"), F.col("_to") - F.col("_from")) * F.col("_parts"))
    return j.withColumn("_bucket", F.least(F.coalesce(part, F.lit(0)), F.col("_parts") - 1)).drop("_key", "_from", "_to", "_parts")


def asof_nearest(frames: DataFrame, samples: DataFrame, key: str = "scan_id", ts: str = "ts", values: list[str] | None = None, bucket_rows: int = 100_000) -> DataFrame:
    """frames with the sample nearest in time (columns near_ts and `values`): of two at the same distance
    the later one; before the first and after the last sample these; nulls for scans without samples and
    for frames without a time.

    The time of a scan is dealt into buckets. Each takes over the last sample before it and the first one
    after it, which a window over buckets, not rows, finds across empty ones. Then a bucket is one sort of
    both sides by time: the last sample before and the first one after are running windows, so no pair of a
    frame and a sample is formed, and a scan with a third of all rows is many tasks. Of samples with equal
    time the one that is largest by its values counts."""
    values = values or [c for c in samples.columns if c not in (key, ts)]
    kept = samples.where(F.col(ts).isNotNull()).groupBy(key, ts).agg(F.max(F.struct(*values)).alias("_v"))
    s = kept.select(key, F.col(ts), F.struct(F.col(ts).alias("t"), F.col("_v").alias("v")).alias("_s"), F.lit(None).cast(frames.select(F.struct("*")).schema[0].dataType).alias("_f"))
    f = frames.select(key, F.col(ts), F.lit(None).cast(s.schema["_s"].dataType).alias("_s"), F.struct("*").alias("_f"))
    both = in_buckets(s.unionByName(f), key, ts, bucket_rows)
    ends = both.groupBy(key, "_bucket").agg(F.min("_s").alias("first"), F.max("_s").alias("last"))
    by = Window.partitionBy(key).orderBy("_bucket")
    before = F.last("last", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("first", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))
    carried = ends.select(key, "_bucket", before.alias("_before"), after.alias("_after"))
    taken = carried.select(key, "_bucket", F.explode(F.array("_before", "_after")).alias("_s")).where("_s IS NOT NULL")
    taken = taken.select(key, F.col("_s.t").alias(ts), "_s", F.lit(None).cast(both.schema["_f"].dataType).alias("_f"), "_bucket")
    w = Window.partitionBy(key, "_bucket").orderBy(ts)
    back = F.last("_s", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_s", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    met = both.unionByName(taken).select("*", back.alias("_b"), ahead.alias("_a")).where("_f IS NOT NULL")
    pick = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).when(F.col(ts) - F.col("_b.t") < F.col("_a.t") - F.col(ts), F.col("_b")).otherwise(F.col("_a"))
    out = met.select("_f", F.when(F.col(ts).isNotNull(), pick).alias("_p"))
    return out.select("_f.*", F.col("_p.t").alias("near_ts"), *(F.col(f"_p.v.{v}").alias(v) for v in values))


def valid_poses(frames: DataFrame) -> DataFrame:
    """Frames whose pose is not marked invalid (minus infinity)."""
    return frames.where("pose[0] <> double('-Infinity')")


def valid_samples(samples: DataFrame, needed: list[str] = ()) -> DataFrame:
    """Samples with a time, and non-zero vectors (struct x, y, z) in the needed columns."""
    out = samples.where("ts <> 0")
    for c in needed:
        out = out.where(f"{c}.x <> 0 OR {c}.y <> 0 OR {c}.z <> 0")
    return out


def enough_signal(samples: DataFrame, column: str, more_than: int = 10) -> DataFrame:
    """(scan_id, ok): whether over `more_than` samples have a non-zero vector."""
    v = F.col(column)
    return samples.groupBy("scan_id").agg((F.count_if((v.x != 0) | (v.y != 0) | (v.z != 0)) > more_than).alias("ok"))


def merged_capture(depth: DataFrame, color: DataFrame, decoded: DataFrame, most: int) -> DataFrame:
    """Frames of a raw capture: as many as the shortest of the three tables (scan_id, frame_id, ...) has;
    depth (d) at or beyond `most` is 0; seconds (t) become microseconds (ts)."""
    n = lambda x, name: x.groupBy("scan_id").agg(F.count("*").alias(name))
    counts = n(depth, "a").join(n(color, "b"), "scan_id").join(n(decoded, "c"), "scan_id").select("scan_id", F.least("a", "b", "c").alias("n"))
    kept = depth.join(counts, "scan_id").where("frame_id < n").drop("n")
    return kept.withColumns({"d": F.when(F.col("d") >= most, 0).otherwise(F.col("d")), "ts": (F.col("t") * 1e6).cast("bigint")})


def every_nth(frames: DataFrame, skip: int) -> DataFrame:
    return frames.where(F.col("frame_id") % skip == 0)


def rotate(pose: str, v: tuple[Column, Column, Column]) -> tuple[Column, ...]:
    """The pose's rotation (row-major 4 x 4) of a vector."""
    m = lambda i: F.col(pose)[i]
    return tuple(m(4 * r) * v[0] + m(4 * r + 1) * v[1] + m(4 * r + 2) * v[2] for r in range(3))


def up_vector(frames: DataFrame, source: str = "views") -> DataFrame:
    """(scan_id, x, y, z): mean of the frames' world-up vectors, normalised. views: R (0, -1, 0);
    gravity: R (g.y, g.x, g.z) / |g|; accel: R (-a / |a|); frames carry the sample already. A zero sample
    has no direction and makes its scan's vector NaN, as 0 / 0 does; valid_samples() leaves such out."""
    if source == "views":
        v = (F.lit(0.0), F.lit(-1.0), F.lit(0.0))
    else:
        c = F.col("gravity" if source == "gravity" else "acceleration")
        n = F.sqrt(c.x * c.x + c.y * c.y + c.z * c.z)
        per = lambda x: F.when(n != 0, x / n).otherwise(x * float("inf"))  # noqa: E731  by zero too, where / is an error
        v = (per(c.y), per(c.x), per(c.z)) if source == "gravity" else (per(-c.x), per(-c.y), per(-c.z))
    x, y, z = rotate("pose", v)
    total = valid_poses(frames).groupBy("scan_id").agg(F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(z).alias("z"))
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return total.select("scan_id", *(F.try_divide(c, length).alias(c) for c in ("x", "y", "z")))


def appended(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two sequences as one, the second's frames numbered on."""
    n = first.groupBy("scan_id").agg((F.max("frame_id") + 1).alias("n"))
    moved = second.join(n, "scan_id", "left").withColumn("frame_id", F.col("frame_id") + F.coalesce("n", F.lit(0))).drop("n")
    return first.unionByName(moved)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_first, only_second): rows, with their repeats, that only one sequence has."""
    x, y = a.exceptAll(b).agg(F.count("*").alias("only_first")), b.exceptAll(a).agg(F.count("*").alias("only_second"))
    return x.join(y, F.lit(True))


def frame_steps(frames: DataFrame) -> DataFrame:
    """frames (scan_id, frame_id, x, y, z) with the distance to the frame before."""
    w = Window.partitionBy("scan_id").orderBy("frame_id")
    step = lambda c: F.col(c) - F.lag(c).over(w)
    return frames.withColumn("step", F.sqrt(step("x") * step("x") + step("y") * step("y") + step("z") * step("z")))
