"""Queries on the scan index: finding, grouping, deriving, upserting, stages and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import scan_index as ix
from . import bindings as b
from .registry import query

_QUERY = {"group": {"$ne": "nyuv2"}, "sceneType": {"$in": ["BUILDING", "MACHINERY"]}, "deviceName": {"$exists": "true"}, "id": {"$regex": "[02468]$"}, "_": 17}
_WHERE = "grp IS DISTINCT FROM 'nyuv2' AND sceneType IN ('BUILDING', 'MACHINERY') AND deviceName IS NOT NULL AND regexp_matches(id, '[02468]$')"


@query(f"WITH {b.INDEX_SQL} SELECT id, sceneType, deviceName FROM scans WHERE {_WHERE}")
def flt1_index_query(spark: SparkSession, d: str) -> DataFrame:
    return ix.find(b.scan_index(spark, d), _QUERY).select("id", "sceneType", "deviceName")


@query(f"WITH {b.INDEX_SQL} SELECT id, floorArea FROM scans WHERE grp IS DISTINCT FROM 'nyuv2' ORDER BY floorArea DESC, id LIMIT 50 OFFSET 20")
def srt2_index_page(spark: SparkSession, d: str) -> DataFrame:
    return ix.page(b.scan_index(spark, d), {"group": {"$ne": "nyuv2"}}, {"floorArea": -1, "id": 1}, 50, 20).select("id", "floorArea")


@query(f"WITH {b.INDEX_SQL} SELECT count(*) AS total, count(*) FILTER ({_WHERE}) AS matching FROM scans")
def srt2_index_totals(spark: SparkSession, d: str) -> DataFrame:
    return ix.totals(b.scan_index(spark, d), _QUERY)


@query(f"WITH {b.INDEX_SQL} SELECT id, sceneType, userName FROM scans")
def srt1_index_sort(spark: SparkSession, d: str) -> DataFrame:
    return ix.sorted_by(b.scan_index(spark, d), {"userName": 1, "id": -1}).select("id", "sceneType", "userName")


@query(f"WITH {b.INDEX_SQL} SELECT DISTINCT t AS value FROM (SELECT unnest(tags) AS t FROM scans UNION ALL SELECT 'outdoor') WHERE t <> ''")
def flt8_facet_values(spark: SparkSession, d: str) -> DataFrame:
    return ix.facet_values(b.scan_index(spark, d), "tags", ["outdoor", ""])


@query(f"WITH {b.INDEX_SQL} SELECT id, userName FROM scans WHERE contains(lower(userName), 'an')")
def flt8_column_filter(spark: SparkSession, d: str) -> DataFrame:
    return ix.column_filter(b.scan_index(spark, d), "userName", "AN").select("id", "userName")


@query(f"WITH {b.INDEX_SQL} SELECT id, num, deviceId, sceneType FROM scans")
def prj8_visible_fields(spark: SparkSession, d: str) -> DataFrame:
    scans = b.scan_index(spark, d).select("id", "num", "deviceId", "sceneType", "path", "userName")
    return ix.visible(scans, ["PATH", "userName", "password"])


@query(f"WITH {b.INDEX_SQL} SELECT id, grp || '.' || id AS modelId, coalesce(numColorFrames, numTransforms) AS numColorFrames, round(coalesce(numColorFrames, numTransforms) / 30.0, 6) AS scanSecs, round(floorArea / nullif(floorAreaFilled, 0), 6) AS floorAreaRatio FROM scans")
def prj7_derived_fields(spark: SparkSession, d: str) -> DataFrame:
    out = ix.derived(b.scan_index(spark, d))
    return out.select("id", "modelId", "numColorFrames", F.round("scanSecs", 6).alias("scanSecs"), F.round("floorAreaRatio", 6).alias("floorAreaRatio"))


@query(f"WITH {b.INDEX_SQL} SELECT id, CASE WHEN num % 2 = 0 THEN '/files' || path || '/' || id || '.mp4' END AS videoUrl, CASE WHEN num % 3 = 0 THEN '/files' || path || '/' || id || '_thumb.png' END AS previewUrl FROM scans")
def prj7_media_urls(spark: SparkSession, d: str) -> DataFrame:
    i = b.scan_index(spark, d).withColumn("files", F.expr("filter(array(CASE WHEN num % 2 = 0 THEN named_struct('name', concat(id, '.mp4')) END, CASE WHEN num % 3 = 0 THEN named_struct('name', concat(id, '_thumb.png')) END), f -> f IS NOT NULL)"))
    return ix.media(i, "/files").select("id", "videoUrl", "previewUrl")


@query(f"WITH {b.INDEX_SQL} SELECT id, 'scans/staging' AS subgroup FROM scans")
def prj9_subgroup(spark: SparkSession, d: str) -> DataFrame:
    return ix.with_subgroup(b.scan_index(spark, d)).select("id", "subgroup")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_mktsegment END AS sceneName FROM customer")
def prj11_scene_names(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "customer").selectExpr("c_custkey AS id", "concat(c_mktsegment, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_7' ELSE '3 ' END) AS sceneLabel")
    return ix.named_scenes(c).select("id", "sceneName")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS createdAt FROM orders")
def prj12_created_at(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 5 = 0 THEN 'scene' ELSE concat(date_format(o_orderdate, 'yyyy-MM-dd_HH-mm-ss'), '__AB') END AS name")
    return o.select("id", sc.created_at(F.col("name")).alias("createdAt"))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM customer")
def prj13_boolean_strings(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "customer").selectExpr("c_custkey AS id", "CASE c_custkey % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'False' ELSE 'maybe' END AS flag")
    return ix.normalised_booleans(c, ["flag"])


@query(f"WITH {b.INDEX_SQL} SELECT deviceId, count(*) AS count, list_sort(list(DISTINCT deviceName) FILTER (deviceName IS NOT NULL)) AS names FROM scans GROUP BY 1")
def agg21_scans_by_device(spark: SparkSession, d: str) -> DataFrame:
    return ix.grouped(b.scan_index(spark, d), "deviceId", {"deviceName": "names"})


@query(f"WITH {b.INDEX_SQL} SELECT deviceName, count(*) AS count, list_sort(list(DISTINCT deviceId)) AS ids FROM scans WHERE deviceName IS NOT NULL GROUP BY 1")
def agg21_scans_by_device_name(spark: SparkSession, d: str) -> DataFrame:
    return ix.grouped(b.scan_index(spark, d), "deviceName", {"deviceId": "ids"})


@query(f"WITH {b.INDEX_SQL} SELECT sceneName, count(*) AS count, list_sort(list(DISTINCT sceneType) FILTER (sceneType IS NOT NULL)) AS types FROM scans WHERE sceneName IS NOT NULL GROUP BY 1")
def agg22_scans_by_scene(spark: SparkSession, d: str) -> DataFrame:
    return ix.grouped(b.scan_index(spark, d), "sceneName", {"sceneType": "types"})


@query(f"WITH {b.INDEX_SQL} SELECT sceneType, count(*) AS count, count(DISTINCT sceneName) AS scenes FROM scans WHERE grp <> 'nyuv2' AND sceneType IS NOT NULL GROUP BY 1")
def agg23_scans_by_scene_type(spark: SparkSession, d: str) -> DataFrame:
    return ix.scene_types(b.scan_index(spark, d))


@query(f"WITH {b.INDEX_SQL} SELECT userName, count(*) AS count FROM scans GROUP BY 1")
def agg24_scans_by_user(spark: SparkSession, d: str) -> DataFrame:
    return ix.grouped(b.scan_index(spark, d), "userName")


@query(f"WITH {b.INDEX_SQL} SELECT t AS member, count(*) AS count FROM (SELECT unnest(tags) AS t FROM scans) GROUP BY 1")
def agg25_scans_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return ix.grouped_by_member(b.scan_index(spark, d), "tags")


@query(f"WITH {b.INDEX_SQL} SELECT round(sum(coalesce(numColorFrames, 0)), 6)::double AS sum_numColorFrames, round(sum(floorArea) / count(*), 4) AS avg_price, round(sum(coalesce(numColorFrames, 0)) / count(*), 6) AS avg_numColorFrames FROM scans")
def agg26_footer(spark: SparkSession, d: str) -> DataFrame:
    i = b.scan_index(spark, d).withColumn("price", F.concat(F.lit("$"), F.format_number("floorArea", 6)))
    return ix.footer(i, ["numColorFrames"], ["price", "numColorFrames"]).select(F.round("sum_numColorFrames", 6).alias("sum_numColorFrames"), F.round("avg_price", 4).alias("avg_price"), F.round("avg_numColorFrames", 6).alias("avg_numColorFrames"))


@query("SELECT user_id AS frame_key, round(avg(event_id % 100 / 100.0), 6) AS avg_coverage FROM events GROUP BY 1")
def agg35_coverage_average(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events").selectExpr("user_id AS frame_key", "event_id % 100 / 100.0D AS coverage")
    return e.groupBy("frame_key").agg(F.round(F.sum(F.coalesce("coverage", F.lit(0.0))) / F.count("*"), 6).alias("avg_coverage"))


_HALVES = "WITH old AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 < 2), new AS (SELECT c_custkey AS id, upper(c_mktsegment) AS name FROM customer WHERE c_custkey % 3 > 0)"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = b.table(spark, d, "customer")
    return c.where("c_custkey % 3 < 2").selectExpr("c_custkey AS id", "c_name AS name"), c.where("c_custkey % 3 > 0").selectExpr("c_custkey AS id", "upper(c_mktsegment) AS name")


@query(f"{_HALVES} SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)")
def set1_index_upsert(spark: SparkSession, d: str) -> DataFrame:
    return ix.append(*_halves(spark, d))


@query(f"WITH {b.INDEX_SQL} SELECT id, grp AS \"group\" FROM scans WHERE grp <> 'nyuv2' UNION ALL SELECT 'new' || num, 'nyuv2' FROM scans WHERE num % 100 = 0")
def set2_populate_group(spark: SparkSession, d: str) -> DataFrame:
    i = b.scan_index(spark, d)
    new = i.where("num % 100 = 0").selectExpr("concat('new', num) AS id", "'nyuv2' AS `group`")
    return ix.populate(i.select("id", "group"), new, "group", "nyuv2")


@query(f"{_HALVES} SELECT id, 2 AS count FROM old JOIN new USING (id)")
def set2_duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return ix.duplicate_ids(ix.populate(old.withColumn("group", F.lit("g")), new, None))


@query(f"{_HALVES} SELECT coalesce(o.id, n.id) AS id, coalesce(n.name, o.name) AS name FROM old o FULL JOIN new n ON o.id = n.id")
def set3_edit_metadata(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return ix.edit(old, old, new, ["name"])[1]


@query(f"{_HALVES} SELECT o.id, coalesce(n.name, o.name) AS name FROM old o LEFT JOIN new n ON o.id = n.id")
def jn9_metadata_overlay(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return ix.overlay(old, new, ["name"])


@query(f"{_HALVES} SELECT o.id, coalesce(n.name, o.name) AS name, length(c_name) AS verts FROM old o LEFT JOIN new n ON o.id = n.id LEFT JOIN customer ON c_custkey = o.id AND c_custkey % 2 = 0")
def jn8_combine_stats(spark: SparkSession, d: str) -> DataFrame:
    old, new = _halves(spark, d)
    return ix.combine(old, new, b.table(spark, d, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey AS id", "length(c_name) AS verts"))


@query(f"{_HALVES} SELECT id FROM new WHERE id NOT IN (SELECT id FROM old)")
def jn8_ignored_ids(spark: SparkSession, d: str) -> DataFrame:
    return ix.ignored(*_halves(spark, d))


@query("SELECT c_nationkey AS id, arg_max(c_name, c_custkey) AS name FROM customer GROUP BY 1")
def src12_last_row_by_id(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "customer").selectExpr("c_nationkey AS id", "c_name AS name", "c_custkey AS position")
    return ix.last_by_id(c, "position").select("id", "name")


def _queue(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "orders").where("o_custkey % 7 = 0").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("added")).selectExpr("concat('scene', lpad(cast(o_custkey AS string), 6, '0')) AS id", "CASE WHEN o_custkey % 3 = 0 THEN 'worker' END AS lock", "cast(n % 4 AS int) AS priority", "added")


_QUEUE = "queue AS (SELECT 'scene' || lpad(o_custkey::varchar, 6, '0') AS id, CASE WHEN o_custkey % 3 = 0 THEN 'worker' END AS lock, (count(*) % 4)::int AS priority, max(o_orderkey) AS added FROM orders WHERE o_custkey % 7 = 0 GROUP BY o_custkey)"


@query(f"WITH {b.INDEX_SQL}, {_QUEUE} SELECT scans.id, queue.id IS NOT NULL AS queued, lock IS NOT NULL AS running, priority FROM scans LEFT JOIN queue USING (id)")
def jn10_scans_with_queue(spark: SparkSession, d: str) -> DataFrame:
    return ix.with_queue(b.scan_index(spark, d), _queue(spark, d)).select("id", "queued", "running", "priority")


@query(f"WITH {b.INDEX_SQL}, {_QUEUE} SELECT queue.id, lock, priority, added, userName FROM queue LEFT JOIN (SELECT * FROM scans WHERE num % 2 = 0) s USING (id)")
def jn10_queue_with_scans(spark: SparkSession, d: str) -> DataFrame:
    return ix.queue_scans(_queue(spark, d), b.scan_index(spark, d).where("num % 2 = 0").select("id", "userName"))


@query(f"WITH {_QUEUE} SELECT id, lock, priority, added FROM queue ORDER BY lock DESC NULLS LAST, priority DESC, added, id LIMIT 20")
def srt3_queue_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return ix.queue_order(_queue(spark, d), 20)


@query(f"WITH {_QUEUE} SELECT max(priority) + 1 AS front, min(priority) - 1 AS back FROM queue")
def srt4_priority_bounds(spark: SparkSession, d: str) -> DataFrame:
    return ix.priority_bounds(_queue(spark, d))


_STAGES = [(1, "upload", [], ["${id}.1-URGENT"], "all", False, 0), (2, "convert", ["${id}.1-URGENT"], ["${id}.2-HIGH", "${id}.3-MEDIUM"], "any", False, 2), (3, "thumb", ["${id}.2-HIGH"], ["${id}.4-NOT SPECIFIED"], "all", True, 0), (4, "mesh", ["${id}.1-URGENT", "${id}.2-HIGH"], ["${id}.3-MEDIUM", "${id}.5-LOW"], "all", False, 3)]


def _stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_STAGES, "pos int, name string, inputs array<string>, outputs array<string>, output_check string, optional boolean, substeps int")


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = b.table(spark, d, "orders")
    files = o.groupBy(F.col("o_custkey").alias("scan_id"), F.concat(F.col("o_custkey").cast("string"), F.lit("."), "o_orderpriority").alias("name")).agg(F.expr("max(CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_totalprice END)").alias("size"), F.unix_millis(F.max(F.col("o_orderdate").cast("timestamp"))).alias("mtime"))
    return o.select(F.col("o_custkey").alias("scan_id")).distinct(), files


_FILES = "files AS (SELECT o_custkey AS scan_id, o_custkey || '.' || o_orderpriority AS name, max(CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_totalprice END) AS size, epoch_ms(max(o_orderdate)) AS mtime FROM orders GROUP BY ALL), sc AS (SELECT DISTINCT o_custkey AS scan_id FROM orders)"
_STAGE_ROWS = ", ".join(f"({p}, '{n}', {i}, {o}, '{c}', {str(op).lower()})" for p, n, i, o, c, op, _ in _STAGES).replace("[]", "[]::varchar[]")
_STATUS = f"""{_FILES}, st(pos, name, inputs, outputs, chk, optional) AS (VALUES {_STAGE_ROWS}),
ofile AS (SELECT sc.scan_id, st.pos, f.size > 0 AS ok, f.mtime FROM sc CROSS JOIN (SELECT pos, unnest(outputs) AS n FROM st) st LEFT JOIN files f ON f.scan_id = sc.scan_id AND f.name = replace(st.n, '${{id}}', sc.scan_id::varchar)),
ifile AS (SELECT sc.scan_id, st.pos, f.size > 0 AS ok, f.mtime FROM sc CROSS JOIN (SELECT pos, unnest(inputs) AS n FROM st) st LEFT JOIN files f ON f.scan_id = sc.scan_id AND f.name = replace(st.n, '${{id}}', sc.scan_id::varchar)),
o AS (SELECT scan_id, pos, bool_or(coalesce(ok, false)) AS o_any, bool_and(coalesce(ok, false)) AS o_all, min(mtime) FILTER (ok) AS oldest FROM ofile GROUP BY ALL),
i AS (SELECT scan_id, pos, bool_and(coalesce(ok, false)) AS i_all, max(mtime) FILTER (ok) AS newest FROM ifile GROUP BY ALL),
status AS (SELECT sc.scan_id, st.pos, st.name, st.optional, CASE WHEN (chk = 'any' AND o_any) OR (chk = 'all' AND o_all) THEN true WHEN coalesce(i_all, true) AND NOT optional THEN false END AS ok,
  coalesce(((chk = 'any' AND o_any) OR (chk = 'all' AND o_all)) AND oldest < newest, false) AS outdated FROM sc CROSS JOIN st LEFT JOIN o ON o.scan_id = sc.scan_id AND o.pos = st.pos LEFT JOIN i ON i.scan_id = sc.scan_id AND i.pos = st.pos)"""


@query(f"WITH {_STATUS} SELECT * FROM status")
def idx4_stage_status(spark: SparkSession, d: str) -> DataFrame:
    return ix.stage_status(_stages(spark), *_files(spark, d))


@query(f"WITH {_STATUS}, r AS (SELECT *, sum(CASE WHEN NOT optional AND NOT coalesce(ok, false) THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id ORDER BY pos) AS f FROM status) SELECT scan_id, arg_max(name, pos) FILTER (f = 0 AND ok) AS last_ok FROM r GROUP BY 1")
def win6_last_ok_stage(spark: SparkSession, d: str) -> DataFrame:
    return ix.last_ok_stage(ix.stage_status(_stages(spark), *_files(spark, d)))


@query(f"WITH {_STATUS} SELECT scan_id, arg_min(name, pos) FILTER (NOT optional AND NOT coalesce(ok, false) AND pos >= 2) AS next FROM status GROUP BY 1")
def idx5_next_step(spark: SparkSession, d: str) -> DataFrame:
    return ix.next_step(ix.stage_status(_stages(spark), *_files(spark, d)), 2)


@query(f"WITH {_FILES} SELECT scan_id, bool_or(name LIKE '%URGENT' AND size > 0) AS is_scan FROM files GROUP BY 1")
def idx1_scan_detection(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)[1]
    return ix.has_scan(files.withColumn("name", F.regexp_replace("name", "1-URGENT$", "sens")))


@query(f"WITH {_FILES} SELECT scan_id, max(mtime) AS updated, arg_max(name, (mtime, name)) AS newest FROM files GROUP BY 1")
def agg18_last_modified(spark: SparkSession, d: str) -> DataFrame:
    return ix.last_modified(_files(spark, d)[1])


@query(f"WITH {_FILES} SELECT scan_id, max(mtime) > 900000000000 AS newer FROM files GROUP BY 1")
def agg19_modified_after(spark: SparkSession, d: str) -> DataFrame:
    return ix.modified_after(_files(spark, d)[1], 900000000000)


@query(f"WITH {_FILES} SELECT scan_id, scan_id || '/' || name AS path FROM files WHERE name LIKE '%.5-LOW' OR name LIKE '%.2-HIGH'")
def flt11_wanted_files(spark: SparkSession, d: str) -> DataFrame:
    return ix.wanted_files(_files(spark, d)[1], [".5-LOW", ".2-HIGH"])


def _log(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "events").selectExpr("user_id AS scan_id", "event_id AS line_no", """CASE WHEN event_id % 13 = 0 THEN 'noise' WHEN event_id % 11 = 0 THEN concat('Time=0:00:', lpad(cast(event_id % 60 AS string), 2, '0'), ' for cmd="x"')
ELSE concat('Time=', event_id % 3, ':', lpad(cast(event_id % 60 AS string), 2, '0'), ':', lpad(cast(event_id % 59 AS string), 2, '0'), '.5 for ', event_type, event_id % 2 + 1, ', cmd="run"') END AS value""")


_TIMES = "t AS (SELECT user_id AS scan_id, event_type || (event_id % 2 + 1) AS name, arg_max((event_id % 3) * 3600 + (event_id % 60) * 60 + event_id % 59 + 0.5, event_id)::double AS seconds FROM events WHERE event_id % 13 <> 0 AND event_id % 11 <> 0 GROUP BY ALL)"


@query(f"WITH {_TIMES} SELECT * FROM t")
def win9_log_times(spark: SparkSession, d: str) -> DataFrame:
    return ix.log_times(_log(spark, d))


@query(f"WITH {_TIMES} SELECT scan_id, name[:-2] AS stage, sum(seconds) AS seconds FROM t WHERE name[:-2] IN ('view', 'click') GROUP BY ALL UNION ALL SELECT scan_id, name, seconds FROM t WHERE name = 'purchase1'")
def agg20_stage_timings(spark: SparkSession, d: str) -> DataFrame:
    stages = spark.createDataFrame([("view", 2), ("click", 3), ("purchase1", 0)], "name string, substeps int")
    return ix.stage_timings(ix.log_times(_log(spark, d)), stages)


@query(f"WITH {_TIMES}, s AS (SELECT scan_id, sum(seconds) AS seconds FROM t GROUP BY 1) SELECT scan_id, seconds, (floor(seconds)::bigint // 3600) || ':' || lpad((floor(seconds)::bigint % 3600 // 60)::varchar, 2, '0') || ':' || lpad((floor(seconds)::bigint % 60)::varchar, 2, '0') AS text FROM s")
def scl2_total_times(spark: SparkSession, d: str) -> DataFrame:
    return ix.total_times(ix.log_times(_log(spark, d))).select("scan_id", "seconds", sc.hms(F.col("seconds")).alias("text"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM orders")
def scl3_iso_times(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "orders").select("o_orderkey", sc.millis_iso(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("iso"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN printf('%.1fB', (o_orderkey % 1000)::double) WHEN o_orderkey % 3 = 1 THEN printf('%.1fKiB', (o_orderkey % 1000 + 1)::double) ELSE printf('%.1fMiB', (o_orderkey % 1000 + 1)::double) END AS size FROM orders")
def scl4_natural_size(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 1000 WHEN 1 THEN (o_orderkey % 1000 + 1) * 1024 ELSE (o_orderkey % 1000 + 1) * 1048576 END AS n")
    return o.select("o_orderkey", sc.natural_size(F.col("n").cast("double")).alias("size"))


@query("SELECT s_suppkey, md5(s_name) = md5(CASE WHEN s_suppkey % 4 = 0 THEN 'x' ELSE s_name END) AS ok FROM supplier")
def scl5_checksums(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.files import verify

    s = b.table(spark, d, "supplier")
    manifest = s.selectExpr("s_suppkey AS path", "md5(CASE WHEN s_suppkey % 4 = 0 THEN 'x' ELSE s_name END) AS md5")
    return verify(s.selectExpr("s_suppkey AS path", "encode(s_name, 'utf-8') AS content"), manifest).select(F.col("path").alias("s_suppkey"), "ok")


@query("SELECT c_custkey, try_cast(CASE WHEN c_custkey % 3 = 0 THEN ' ' || c_custkey ELSE c_name END AS bigint) IS NOT NULL AS is_int FROM customer")
def scl7_int_literals(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN concat(' ', c_custkey) ELSE c_name END AS s")
    return c.select("c_custkey", sc.is_int(F.col("s")).alias("is_int"))


@query(f"WITH {_FILES}, {_TIMES}, s AS (SELECT scan_id AS id, sum(seconds) AS secs FROM t GROUP BY 1), f AS (SELECT scan_id AS id, max(mtime) AS updatedAt, sum(size) AS total FROM files GROUP BY 1) SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'set' WHEN c_custkey % 2 = 0 THEN 'done' ELSE c_mktsegment END AS sceneName, updatedAt, round(total, 2) AS totalSize, secs AS totalSecs FROM customer LEFT JOIN f ON f.id = c_custkey LEFT JOIN s ON s.id = c_custkey WHERE c_custkey % 4 <> 1")
def idx2_assembled_records(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "customer")
    props, processed = c.selectExpr("c_custkey AS id", "c_mktsegment AS sceneName"), c.where("c_custkey % 4 <> 1").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 2 = 0 THEN 'done' END AS sceneName")
    fixed = c.where("c_custkey % 3 = 0").selectExpr("c_custkey AS id", "'set' AS sceneName")
    out = ix.assembled(props, processed, fixed, _files(spark, d)[1], ix.log_times(_log(spark, d)))
    return out.select("id", "sceneName", "updatedAt", F.round("totalSize", 2).alias("totalSize"), "totalSecs")


@query("SELECT c_custkey AS scan_id, s_name AS name, s_nationkey AS fx FROM customer JOIN (SELECT s_suppkey % 17 AS k, arg_min(s_name, s_suppkey) AS s_name, arg_min(s_nationkey, s_suppkey) AS s_nationkey FROM supplier GROUP BY 1) ON k = c_custkey % 40 UNION ALL SELECT c_custkey, '', NULL FROM customer WHERE c_custkey % 40 NOT IN (SELECT s_suppkey % 17 FROM supplier)")
def jn12_device_calibration(spark: SparkSession, d: str) -> DataFrame:
    s = b.table(spark, d, "supplier")
    scans = b.table(spark, d, "customer").selectExpr("c_custkey AS scan_id", "c_custkey % 40 AS deviceId")
    return ix.calibration_of(scans, s.selectExpr("s_suppkey % 17 AS deviceId", "s_name AS name", "s_suppkey AS position"), s.selectExpr("s_name AS name", "s_nationkey AS fx"))


@query("SELECT DISTINCT user_id AS scan_id FROM events WHERE user_id % 3 <> 0 OR user_id IN (SELECT user_id FROM events WHERE event_type = 'click' AND event_id % 50 = 0)")
def flt10_pending_scans(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events").selectExpr("user_id AS scan_id", "event_id AS frame_id", "event_type")
    return ix.pending(e, e.where("scan_id % 3 = 0"), e.where("NOT (event_type = 'click' AND frame_id % 50 = 0)"))
