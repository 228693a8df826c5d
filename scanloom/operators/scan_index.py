"""The scan index: queries, groupings, derived fields, upserts, and pipeline states of scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import boolean_string, scene_name, subgroup, template

PAGE, MOST = 5000, 10000


def predicate(query: dict) -> Column:
    """A document-store query as a column: values for equality; $ne (keeps rows without the field), $in,
    $nin, $exists, $regex, $lt, $lte, $gt, $gte in a dict; $or a list of queries. Parameters that begin
    with an underscore, and $sort, $limit, $skip, are no conditions."""
    ops = {
        "$ne": lambda c, v: ~c.eqNullSafe(v), "$in": lambda c, v: c.isin(v), "$nin": lambda c, v: ~F.coalesce(c.isin(v), F.lit(False)),
        "$exists": lambda c, v: c.isNotNull() if str(v).lower() == "true" else c.isNull(), "$regex": lambda c, v: c.rlike(v),
        "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v,
    }
    parts = [F.lit(True)]
    for field, want in query.items():
        if field == "$or":
            parts.append(reduce(lambda a, b: a | b, map(predicate, want)))
        elif field[:1] not in ("_", "$"):
            parts += [ops[op](F.col(field), v) for op, v in want.items()] if isinstance(want, dict) else [F.col(field).eqNullSafe(want)]
    return reduce(lambda a, b: a & b, parts)


def find(index: DataFrame, query: dict) -> DataFrame:
    return index.where(predicate(query))


def sorted_by(index: DataFrame, sort: dict[str, int] | None = None) -> DataFrame:
    """1 ascending, -1 descending; without any, createdAt descending."""
    return index.orderBy(*(F.asc(k) if int(v) > 0 else F.desc(k) for k, v in (sort or {"createdAt": -1}).items()))


def page(index: DataFrame, query: dict, sort: dict[str, int], limit: int = PAGE, skip: int = 0) -> DataFrame:
    """A page of the matches; at most MOST rows."""
    return sorted_by(find(index, query), sort).offset(int(skip)).limit(min(int(limit), MOST))


def totals(index: DataFrame, query: dict) -> DataFrame:
    """(total, matching) in one pass."""
    return index.agg(F.count("*").alias("total"), F.count_if(predicate(query)).alias("matching"))


def column_filter(index: DataFrame, column: str, text: str) -> DataFrame:
    return index.where(F.contains(F.lower(F.col(column)), F.lit(text.lower())))


def facet_values(index: DataFrame, column: str, include: list[str] = ()) -> DataFrame:
    """Distinct values of a column (arrays flattened, empty ones dropped) and those of include, sorted."""
    kind = index.schema[column].dataType.simpleString()
    values = index.select((F.explode(column) if kind.startswith("array") else F.col(column)).alias("value"))
    more = index.sparkSession.createDataFrame([(x,) for x in include], "value string")
    return values.unionByName(more).where("value IS NOT NULL AND value <> ''").distinct().orderBy("value")


def visible(index: DataFrame, hidden: list[str]) -> DataFrame:
    """index as it is read from outside: without the hidden fields (case aside; unknown ones do no harm)."""
    gone = {h.lower() for h in hidden}
    return index.select(*(F.col(f"`{c}`") for c in index.columns if c.lower() not in gone))


def derived(index: DataFrame) -> DataFrame:
    """modelId, numColorFrames with its fallback, scanSecs at 30 frames a second, floorAreaRatio."""
    frames = F.coalesce("numColorFrames", "numTransforms")
    return index.withColumns({"modelId": F.concat("group", F.lit("."), "id"), "numColorFrames": frames, "scanSecs": frames / F.lit(30.0), "floorAreaRatio": F.try_divide("floorArea", "floorAreaFilled")})


def media(index: DataFrame, root: str) -> DataFrame:
    """URLs of video and preview where files has them; files itself is hidden."""
    has = lambda suffix: F.exists("files", lambda f: f["name"] == F.concat(F.col("id"), F.lit(suffix)))
    url = lambda suffix: F.when(has(suffix), F.concat(F.lit(root), F.col("path"), F.lit("/"), F.col("id"), F.lit(suffix)))
    return index.withColumns({"videoUrl": url(".mp4"), "previewUrl": F.coalesce(url("_thumb.png"), url(".png"))}).drop("files")


def with_subgroup(index: DataFrame) -> DataFrame:
    return index.withColumn("subgroup", subgroup(F.col("path"), F.col("id")))


def named_scenes(index: DataFrame, label: str = "sceneLabel") -> DataFrame:
    return index.withColumn("sceneName", F.coalesce("sceneName", scene_name(F.col(label)))) if "sceneName" in index.columns else index.withColumn("sceneName", scene_name(F.col(label)))


def normalised_booleans(index: DataFrame, columns: list[str]) -> DataFrame:
    return index.withColumns({c: boolean_string(F.col(c)) for c in columns})


def scene_type_ids(scans: DataFrame, types: DataFrame) -> DataFrame:
    """(scan_id, type_id): type stripped and lower-cased, looked up in (name, id); -1 if absent."""
    return scans.withColumn("name", F.lower(F.trim("type"))).join(types.select("name", F.col("id").alias("type_id")), "name", "left").select("scan_id", F.coalesce("type_id", F.lit(-1).cast("bigint")).alias("type_id"))


# --- groupings


def grouped(index: DataFrame, key: str, distinct: dict[str, str] | None = None) -> DataFrame:
    """(key, count, ...): rows by a column, missing keys dropped; distinct: column -> name of its sorted
    distinct values."""
    sets = [F.array_sort(F.collect_set(c)).alias(n) for c, n in (distinct or {}).items()]
    return index.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("count"), *sets)


def scene_types(index: DataFrame, excluded: str = "nyuv2") -> DataFrame:
    """Scans and distinct scene names by scene type, one group left out."""
    return index.where(~F.col("group").eqNullSafe(excluded) & F.col("sceneType").isNotNull()).groupBy("sceneType").agg(F.count("*").alias("count"), F.count_distinct("sceneName").alias("scenes"))


def grouped_by_member(index: DataFrame, array: str) -> DataFrame:
    """(member, count) over the members of an array column."""
    return index.select(F.explode(array).alias("member")).groupBy("member").agg(F.count("*").alias("count"))


def footer(index: DataFrame, sums: list[str] = (), averages: list[str] = ()) -> DataFrame:
    """Sums, and averages in which missing values count as 0; '$' and ',' in strings do not matter."""
    number = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), "[$,]", "").try_cast("double"), F.lit(0.0))
    return index.agg(*(F.sum(number(c)).alias(f"sum_{c}") for c in sums), *(F.try_divide(F.sum(number(c)), F.count("*")).alias(f"avg_{c}") for c in averages))


# --- upserts


def append(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old and new; new wins by key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def populate(index: DataFrame, new: DataFrame, replace: str | list[str] | None, group: str | None = None) -> DataFrame:
    """new after removal of: the group (replace "group"), all ("all"), listed ids, or nothing (None)."""
    kept = index.where(~F.col("group").eqNullSafe(group)) if replace == "group" else index.limit(0) if replace == "all" else index.where(~F.col("id").isin(list(replace))) if replace else index
    return kept.unionByName(new, allowMissingColumns=True)


def duplicate_ids(index: DataFrame) -> DataFrame:
    return index.groupBy("id").agg(F.count("*").alias("count")).where("count > 1")


def overlay(index: DataFrame, meta: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """index with the metadata's fields where these are not missing."""
    m = meta.select(key, *(F.col(c).alias(f"_meta_{c}") for c in columns))
    return index.join(m, key, "left").withColumns({c: F.coalesce(f"_meta_{c}", c) for c in columns}).drop(*(f"_meta_{c}" for c in columns))


def edit(index: DataFrame, meta: DataFrame, patch: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(index, meta) after a patch (id, columns): metadata is inserted or updated, scans only updated."""
    p = patch.select("id", *(F.col(c).alias(f"_new_{c}") for c in columns))
    new_meta = meta.join(p, "id", "full_outer").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*meta.columns)
    return overlay(index, patch, columns), new_meta


def combine(first: DataFrame, *more: DataFrame, key: str = "id") -> DataFrame:
    """first with the fields of later tables, the last present value winning; empty strings are values."""
    for m in more:
        shared = [c for c in m.columns if c != key]
        old = [c for c in shared if c in first.columns]
        joined = first.join(m.select(key, *(F.col(c).alias(f"_new_{c}") for c in shared)), key, "left")
        first = joined.withColumns({c: F.coalesce(f"_new_{c}", c) if c in old else F.col(f"_new_{c}") for c in shared}).drop(*(f"_new_{c}" for c in shared))
    return first


def ignored(first: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    return other.join(first.select(key), key, "left_anti").select(key)


def last_by_id(rows: DataFrame, position: str, key: str = "id") -> DataFrame:
    """Rows of which for each key only the last by position stays."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(position)))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


# --- queue


def with_queue(scans: DataFrame, queue: DataFrame) -> DataFrame:
    """scans with queued, running (it holds a lock) and priority."""
    q = queue.select("id", F.lit(True).alias("queued"), F.col("lock").isNotNull().alias("running"), "priority")
    return scans.join(q, "id", "left").fillna(False, ["queued", "running"])


def queue_order(queue: DataFrame, n: int | None = None) -> DataFrame:
    """Locked first, then by priority, then by age."""
    out = queue.orderBy(F.col("lock").desc_nulls_last(), F.desc("priority"), "added", "id")
    return out if n is None else out.limit(n)


def queue_scans(queue: DataFrame, scans: DataFrame) -> DataFrame:
    """The queue with its scans; unknown ones are stubs with nothing but the id."""
    return queue_order(queue.join(scans, "id", "left"))


def priority_bounds(queue: DataFrame) -> DataFrame:
    """Priorities to put a task behind all and before all others."""
    return queue.agg((F.coalesce(F.max("priority"), F.lit(0)) + 1).alias("front"), (F.coalesce(F.min("priority"), F.lit(0)) - 1).alias("back"))


# --- files and stages


def has_scan(files: DataFrame) -> DataFrame:
    """(scan_id, is_scan): whether a non-empty capture, sensor or mesh file lies there."""
    wanted = F.col("name").rlike(r"\.(imu|depth|h264|sens|ply)$") & (F.col("size") > 0)
    return files.groupBy("scan_id").agg(F.bool_or(wanted).alias("is_scan"))


def last_modified(files: DataFrame) -> DataFrame:
    return files.groupBy("scan_id").agg(F.max("mtime").alias("updated"), F.max_by("name", F.struct("mtime", "name")).alias("newest"))


def modified_after(files: DataFrame, millis: int) -> DataFrame:
    """(scan_id, newer): null where there are no files with a time."""
    return files.groupBy("scan_id").agg((F.max("mtime") > millis).alias("newer"))


def wanted_files(files: DataFrame, suffixes: list[str]) -> DataFrame:
    ok = reduce(lambda a, b: a | b, (F.endswith("name", F.lit(s)) for s in suffixes))
    return files.where(ok).select("scan_id", F.concat_ws("/", "scan_id", "name").alias("path"))


def _present(stages: DataFrame, scans: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """(scan_id, pos, any, all, oldest, newest) of each stage's files of one kind."""
    asked = stages.select("pos", F.explode(column).alias("name"))
    named = scans.select("scan_id").join(F.broadcast(asked), F.lit(True)).withColumn("name", template(F.col("name"), F.col("scan_id").cast("string")))
    there = named.join(files.select("scan_id", "name", "size", "mtime"), ["scan_id", "name"], "left")
    ok = F.coalesce(F.col("size") > 0, F.lit(False))
    return there.groupBy("scan_id", "pos").agg(F.bool_or(ok).alias("any"), F.bool_and(ok).alias("all"), F.min(F.when(ok, F.col("mtime"))).alias("oldest"), F.max(F.when(ok, F.col("mtime"))).alias("newest"))


def stage_status(stages: DataFrame, scans: DataFrame, files: DataFrame) -> DataFrame:
    """(scan_id, pos, name, optional, ok, outdated): ok is true if all (output_check 'any': some) outputs
    are there and not empty, false if the inputs are but the outputs not and the stage is required, else
    null; outdated if an output is older than the newest input. stages (a few rows) is broadcast."""
    out = _present(stages, scans, files, "outputs").select("scan_id", "pos", F.col("any").alias("out_any"), F.col("all").alias("out_all"), F.col("oldest").alias("out_oldest"))
    ins = _present(stages, scans, files, "inputs").select("scan_id", "pos", F.col("all").alias("in_all"), F.col("newest").alias("in_newest"))
    every = scans.select("scan_id").join(F.broadcast(stages.select("pos", "name", "output_check", "optional")), F.lit(True))
    j = every.join(out, ["scan_id", "pos"], "left").join(ins, ["scan_id", "pos"], "left")
    done = F.coalesce(F.when(F.col("output_check") == "any", F.col("out_any")).otherwise(F.col("out_all")), F.lit(False))
    ok = F.when(done, True).when(F.coalesce("in_all", F.lit(True)) & ~F.col("optional"), False)
    return j.select("scan_id", "pos", "name", "optional", ok.alias("ok"), F.coalesce(done & (F.col("out_oldest") < F.col("in_newest")), F.lit(False)).alias("outdated"))


def last_ok_stage(status: DataFrame) -> DataFrame:
    """(scan_id, last_ok): the last stage that is ok before the first required one that is not."""
    failed = F.when(~F.col("optional") & ~F.coalesce("ok", F.lit(False)), 1).otherwise(0)
    so_far = F.sum(failed).over(Window.partitionBy("scan_id").orderBy("pos"))
    good = status.withColumn("f", so_far).withColumn("good", (F.col("f") == 0) & F.coalesce("ok", F.lit(False)))
    return good.groupBy("scan_id").agg(F.max_by(F.when(F.col("good"), F.col("name")), F.when(F.col("good"), F.col("pos"))).alias("last_ok"))


def next_step(status: DataFrame, from_pos: int = 0) -> DataFrame:
    """(scan_id, next): the first required stage from from_pos on that is not ok; null if none is left."""
    todo = ~F.col("optional") & ~F.coalesce("ok", F.lit(False)) & (F.col("pos") >= from_pos)
    return status.groupBy("scan_id").agg(F.min_by(F.when(todo, F.col("name")), F.when(todo, F.col("pos"))).alias("next"))


# --- logs


def log_times(lines: DataFrame) -> DataFrame:
    """(scan_id, name, seconds): of lines (scan_id, line_no, value) "Time=H:MM:SS for name, ..."; the
    last line of each name counts, lines without a name or malformed ones do not."""
    from ..functions.scalars import TIMING, duration_seconds

    what = F.regexp_extract("value", TIMING, 2)
    name = F.split(what, ", ")[0]
    t = lines.select("scan_id", "line_no", name.alias("name"), duration_seconds(F.regexp_extract("value", TIMING, 1)).alias("seconds"))
    t = t.where("seconds IS NOT NULL AND name <> '' AND NOT startswith(name, 'cmd')")
    return t.groupBy("scan_id", "name").agg(F.max_by("seconds", "line_no").alias("seconds"))


def stage_timings(times: DataFrame, stages: DataFrame) -> DataFrame:
    """(scan_id, stage, seconds): a stage's own time, or the sum of its substeps name1 to nameN."""
    parts = stages.select(F.col("name").alias("stage"), F.explode(F.when(F.col("substeps") > 0, F.transform(F.sequence(F.lit(1), F.greatest("substeps", F.lit(1))), lambda i: F.concat("name", i.cast("string")))).otherwise(F.array("name"))).alias("name"))
    return times.join(parts, "name").groupBy("scan_id", "stage").agg(F.sum("seconds").alias("seconds"))


def total_times(times: DataFrame) -> DataFrame:
    return times.groupBy("scan_id").agg(F.sum("seconds").alias("seconds"))


def assembled(props: DataFrame, processed: DataFrame, fixed: DataFrame, files: DataFrame, times: DataFrame, everything: bool = False) -> DataFrame:
    """Index records by id: fields of props, of processed over these, of fixed over both (where present);
    updatedAt, file flags and sizes, and total seconds. Scans without a processed row only on demand."""
    base = combine(props, processed, fixed)
    has = lambda suffix: F.bool_or(F.endswith("name", F.lit(suffix)) & (F.col("size") > 0))
    f = files.groupBy(F.col("scan_id").alias("id")).agg(F.max("mtime").alias("updatedAt"), has(".ply").alias("hasPly"), has("_thumb.png").alias("hasThumbnail"), F.sum("size").alias("totalSize"))
    t = total_times(times).select(F.col("scan_id").alias("id"), F.col("seconds").alias("totalSecs"))
    kept = base if everything else base.join(processed.select("id"), "id", "left_semi")
    return kept.join(f, "id", "left").join(t, "id", "left")


def calibration_of(scans: DataFrame, devices: DataFrame, parameters: DataFrame) -> DataFrame:
    """(scan_id, name, ...): a scan's calibration: that of its deviceId's first row by position in devices
    (deviceId, name, position), '' without one, with the parameters (name, ...) of that name."""
    first = devices.groupBy("deviceId").agg(F.min_by("name", "position").alias("name"))
    named = scans.select("scan_id", "deviceId").join(first, "deviceId", "left").select("scan_id", F.coalesce("name", F.lit("")).alias("name"))
    return named.join(parameters, "name", "left").select("scan_id", *parameters.columns)


def pending(frames: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(scan_id): scans of frames (scan_id, frame_id) for which one of two outputs lacks frames."""
    n = lambda df, name: df.groupBy("scan_id").agg(F.count("*").alias(name))
    done = n(frames, "n").join(n(first, "a"), "scan_id").join(n(second, "b"), "scan_id").where("a >= n AND b >= n")
    return frames.select("scan_id").distinct().join(done, "scan_id", "left_anti")
