"""Scalar expressions on columns. Null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_of_instance(id_: Column) -> Column:
    """Label of an instance id, label * 1000 + instance."""
    return F.floor(id_ / 1000).cast("bigint")


def panoptic_label(id_: Column) -> Column:
    """As label_of_instance, but ids below 1000 are labels themselves."""
    return F.when(id_ < 1000, id_.cast("bigint")).otherwise(label_of_instance(id_))


def sdf_distance(value: Column, truncation: float) -> Column:
    return F.least(F.abs(value), F.lit(float(truncation)))


def sdf_known(value: Column) -> Column:
    return F.when(value >= -1, 1).otherwise(-1)


def occupancy(value: Column) -> Column:
    return F.when(value == 2, 1).otherwise(value)


#: The forms of a scene label with a take's digit and of a log line "Time=H:MM:SS for name, ...".
SCENE_TAKE = r"^(.*?)[-_]?[0-9]\s*$"
TIMING = r"Time=([:.0-9]+)\s+for\s+(.+)"


def scene_name(label: Column) -> Column:
    """Label without one trailing digit and the _ or - before it."""
    return F.when(label.rlike(SCENE_TAKE), F.regexp_extract(label, SCENE_TAKE, 1)).otherwise(label)


def created_at(scan_id: Column) -> Column:
    """ISO time from an id with a date part YYYY-MM-DD_HH-MM-SS; null without one."""
    date, time = F.regexp_extract(scan_id, r"(\d{4}-\d{2}-\d{2})_(\d{2}-\d{2}-\d{2})", 1), F.regexp_extract(scan_id, r"(\d{4}-\d{2}-\d{2})_(\d{2}-\d{2}-\d{2})", 2)
    return F.when(date != "", F.concat(date, F.lit("T"), F.replace(time, F.lit("-"), F.lit(":")), F.lit("Z")))


def boolean_string(value: Column) -> Column:
    """'true' and 'false' in any case as booleans; null for other strings."""
    return F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False)


def subgroup(path: Column, id_: Column) -> Column:
    """Path without the id (first place) and without slashes at the ends; null if nothing is left."""
    at = F.call_function("instr", path, id_)
    rest = F.when(at > 0, F.concat(F.substring(path, F.lit(1), at - 1), F.substring(path, at + F.length(id_), F.length(path)))).otherwise(path)
    return F.nullif(F.regexp_replace(rest, r"^[/\\]+|[/\\]+$", ""), F.lit(""))


def template(text: Column, id_: Column) -> Column:
    return F.replace(text, F.lit("${id}"), id_)


def duration_seconds(text: Column) -> Column:
    """H:MM:SS(.f) as seconds; null where malformed."""
    parts = F.split(text, ":")
    ok = text.rlike(r"^\d+:\d{1,2}:\d{1,2}(\.\d+)?$")
    return F.when(ok, parts[0].cast("double") * 3600 + parts[1].cast("double") * 60 + parts[2].cast("double"))


def hms(seconds: Column) -> Column:
    """Whole seconds as H:MM:SS."""
    s = F.floor(seconds).cast("bigint")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.floor((s % 3600) / 60).cast("bigint"), s % 60)


def millis_iso(millis: Column) -> Column:
    """Epoch milliseconds as ISO text; the session's time zone is to be UTC."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def secs_iso(secs: Column) -> Column:
    return millis_iso((secs * 1000).cast("bigint"))


def natural_size(n: Column) -> Column:
    """Bytes with one decimal in the largest unit of 1024 that leaves less than 1024."""
    out = F.concat(F.format_string("%.1f", n / F.lit(1024.0**8)), F.lit("YiB"))
    for k, unit in reversed(list(enumerate(["", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei", "Zi"]))):
        out = F.when(F.abs(n) < 1024.0 ** (k + 1), F.concat(F.format_string("%.1f", n / F.lit(1024.0**k)), F.lit(unit + "B"))).otherwise(out)
    return out


def is_int(text: Column) -> Column:
    return F.trim(text).try_cast("bigint").isNotNull()


def category(label: Column) -> Column:
    """What stands before the first colon."""
    return F.split(label, ":")[0]


def grayscale(r: Column, g: Column, b: Column) -> Column:
    return (0.299 * r + 0.587 * g + 0.114 * b) / 255.0


def depth_metres(d: Column, shift: float = 1000.0) -> Column:
    """Raw depth in metres; 0 is invalid and gives null."""
    return F.when(d != 0, d / F.lit(float(shift)))


def instance_colour(id_: Column) -> Column:
    return F.struct((id_ % 256).alias("r"), (F.floor(id_ / 256).cast("bigint") % 256).alias("g"), (F.floor(id_ / 65536).cast("bigint") % 256).alias("b"))


def rotate_depth(d: Column) -> Column:
    """Raw depth with its three low bits moved to the top."""
    return F.shiftright(d, 3).bitwiseAND(0x1FFF).bitwiseOR(F.shiftleft(d.bitwiseAND(7), 13))


def unrotate_depth(d: Column) -> Column:
    return F.shiftleft(d, 3).bitwiseAND(0xFFF8).bitwiseOR(F.shiftright(d, 13).bitwiseAND(7))


def quaternion_matrix(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Row-major 3 x 3 rotation of a unit quaternion."""
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )
