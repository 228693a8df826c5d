"""Queries on frames and inertial samples: events of type view are frames, clicks are samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import temporal as tp
from . import bindings as b
from .registry import query

_POSE = "array({x}, {y}, 0D, 0D, -({y}), {x}, 0D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 0D, 1D)"


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Poses turn about z by a step of a sixteenth an event; every tenth is invalid."""
    x, y = "cos(event_id % 16 * 0.39D)", "sin(event_id % 16 * 0.39D)"
    pose = f"CASE WHEN event_id % 10 = 0 THEN array_repeat(double('-Infinity'), 16) ELSE {_POSE.format(x=x, y=y)} END AS pose"
    return b.table(spark, d, "events").where("event_type = 'view'").selectExpr("user_id AS scan_id", "event_id AS frame_id", "unix_micros(cast(ts AS timestamp)) AS ts", pose)


def samples(spark: SparkSession, d: str) -> DataFrame:
    v = "named_struct('x', cast(event_id % 3 AS double), 'y', value, 'z', cast(event_id % 5 AS double))"
    return b.table(spark, d, "events").where("event_type = 'click'").selectExpr("user_id AS scan_id", "CASE WHEN event_id % 50 = 0 THEN 0 ELSE unix_micros(cast(ts AS timestamp)) END AS ts", "value", f"{v} AS gravity", f"CASE WHEN user_id % 2 = 0 THEN {v} ELSE named_struct('x', 0D, 'y', 0D, 'z', 0D) END AS acceleration")


_F = "f AS (SELECT user_id AS scan_id, event_id AS frame_id, epoch_us(ts) AS ts FROM events WHERE event_type = 'view'), s AS (SELECT user_id AS scan_id, epoch_us(ts) AS ts, value, event_id FROM events WHERE event_type = 'click' AND event_id % 50 <> 0)"
_NEAR = f"""{_F}, n AS (SELECT f.scan_id, frame_id, f.ts, s.ts AS near_ts, s.value, s.event_id, row_number() OVER (PARTITION BY f.scan_id, frame_id ORDER BY abs(s.ts - f.ts), s.ts DESC) AS k FROM f LEFT JOIN s ON s.scan_id = f.scan_id)"""


@query(f"WITH {_NEAR} SELECT scan_id, frame_id, ts, near_ts, round(value, 6) AS value FROM n WHERE k = 1")
def jn13_imu_asof(spark: SparkSession, d: str) -> DataFrame:
    near = tp.asof_nearest(frames(spark, d).select("scan_id", "frame_id", "ts"), tp.valid_samples(samples(spark, d)).select("scan_id", "ts", "value"))
    return near.select("scan_id", "frame_id", "ts", "near_ts", F.round("value", 6).alias("value"))


@query("SELECT user_id AS scan_id, event_id AS frame_id FROM events WHERE event_type = 'view' AND event_id % 10 <> 0")
def flt3_valid_poses(spark: SparkSession, d: str) -> DataFrame:
    return tp.valid_poses(frames(spark, d)).select("scan_id", "frame_id")


@query("SELECT user_id AS scan_id, count(*) AS n FROM events WHERE event_type = 'click' AND event_id % 50 <> 0 AND user_id % 2 = 0 AND (event_id % 3 <> 0 OR value <> 0 OR event_id % 5 <> 0) GROUP BY 1")
def flt4_valid_samples(spark: SparkSession, d: str) -> DataFrame:
    return tp.valid_samples(samples(spark, d), ["acceleration"]).groupBy("scan_id").agg(F.count("*").alias("n"))


@query("SELECT user_id AS scan_id, count(*) FILTER (user_id % 2 = 0 AND (event_id % 3 <> 0 OR value <> 0 OR event_id % 5 <> 0)) > 10 AS ok FROM events WHERE event_type = 'click' GROUP BY 1")
def flt5_enough_signal(spark: SparkSession, d: str) -> DataFrame:
    return tp.enough_signal(samples(spark, d), "acceleration")


_UP = "SELECT scan_id, round(x / nullif(sqrt(x * x + y * y + z * z), 0), 6) AS x, round(y / nullif(sqrt(x * x + y * y + z * z), 0), 6) AS y, round(z / nullif(sqrt(x * x + y * y + z * z), 0), 6) AS z FROM u"


@query(f"WITH u AS (SELECT user_id AS scan_id, -sum(sin(event_id % 16 * 0.39)) AS x, -sum(cos(event_id % 16 * 0.39)) AS y, 0.0 AS z FROM events WHERE event_type = 'view' AND event_id % 10 <> 0 GROUP BY 1) {_UP}")
def agg30_up_vector_views(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(tp.up_vector(frames(spark, d)))


@query(f"""WITH {_NEAR}, g AS (SELECT scan_id, frame_id, value AS gx, (event_id % 3)::double AS gy, (event_id % 5)::double AS gz FROM n WHERE k = 1 AND frame_id % 10 <> 0),
h AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS m, cos(frame_id % 16 * 0.39) AS c, sin(frame_id % 16 * 0.39) AS s FROM g),
u AS (SELECT scan_id, sum((gx * c + gy * s) / m) AS x, sum((-gx * s + gy * c) / m) AS y, sum(gz / m) AS z FROM h GROUP BY 1) {_UP}""")
def agg30_up_vector_gravity(spark: SparkSession, d: str) -> DataFrame:
    near = tp.asof_nearest(frames(spark, d), tp.valid_samples(samples(spark, d)).select("scan_id", "ts", "gravity"))
    return _rounded(tp.up_vector(near, "gravity"))


def _rounded(u: DataFrame) -> DataFrame:
    return u.select("scan_id", *((F.round(c, 6) + 0.0).alias(c) for c in ("x", "y", "z")))


@query("WITH c AS (SELECT user_id AS scan_id, least(count(*) FILTER (event_type = 'view'), count(*) FILTER (event_type = 'click'), count(*) FILTER (event_type = 'purchase')) AS n FROM events GROUP BY 1), v AS (SELECT user_id AS scan_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_id, event_id FROM events WHERE event_type = 'view') SELECT scan_id, frame_id, CASE WHEN event_id % 100 >= 90 THEN 0 ELSE event_id % 100 END AS d, event_id * 1000000 AS ts FROM v JOIN c USING (scan_id) WHERE frame_id < n")
def src18_merged_capture(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = b.table(spark, d, "events")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    of = lambda t: e.where(F.col("event_type") == t).select(F.col("user_id").alias("scan_id"), number.alias("frame_id"), F.col("event_id").cast("double").alias("t"), F.expr("event_id % 100").alias("d"))
    return tp.merged_capture(of("view"), of("click"), of("purchase"), 90).select("scan_id", "frame_id", "d", "ts")


@query("SELECT user_id AS scan_id, event_id AS frame_id FROM events WHERE event_type = 'view' AND event_id % 7 = 0")
def src17_frame_skip(spark: SparkSession, d: str) -> DataFrame:
    return tp.every_nth(frames(spark, d), 7).select("scan_id", "frame_id")


@query("WITH a AS (SELECT user_id AS scan_id, event_id AS frame_id FROM events WHERE event_type = 'view'), m AS (SELECT scan_id, max(frame_id) + 1 AS n FROM a GROUP BY 1) SELECT * FROM a UNION ALL SELECT user_id, event_id + coalesce(n, 0) FROM events LEFT JOIN m ON scan_id = user_id WHERE event_type = 'click'")
def set4_appended_sequence(spark: SparkSession, d: str) -> DataFrame:
    clicks = b.table(spark, d, "events").where("event_type = 'click'").selectExpr("user_id AS scan_id", "event_id AS frame_id")
    return tp.appended(frames(spark, d).select("scan_id", "frame_id"), clicks)


@query("SELECT count(*) FILTER (event_id % 3 = 0) AS only_first, count(*) FILTER (event_id % 4 = 0) AS only_second FROM events WHERE event_type = 'view' AND NOT (event_id % 3 = 0 AND event_id % 4 = 0)")
def set5_sequence_differences(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("scan_id", "frame_id")
    return tp.differences(f.where("frame_id % 4 <> 0"), f.where("frame_id % 3 <> 0"))


@query(f"WITH {b.POINTS_SQL} SELECT scan_id, vertex_id AS frame_id, round(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) + power(z - lag(z) OVER w, 2)), 6) AS step FROM pts WINDOW w AS (PARTITION BY scan_id ORDER BY vertex_id)")
def win8_frame_steps(spark: SparkSession, d: str) -> DataFrame:
    p = b.points(spark, d).withColumnRenamed("vertex_id", "frame_id")
    return tp.frame_steps(p).select("scan_id", "frame_id", F.round("step", 6).alias("step"))
