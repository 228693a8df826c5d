"""Planes of a scan's points, and the one transform that puts a scan on its floor.

Points are (scan_id, x, y, z, and normals nx, ny, nz where planes are asked for). Matrices are
array<double>, row-major; an alignment is a table (scan_id, matrix) that moves points, other meshes of
the scan and camera poses alike.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import product, transform
from .tables import settled

# --- planes


def _unit(names: tuple[str, str, str]) -> tuple[Column, ...]:
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in names[1:]), F.col(names[0]) * F.col(names[0])))
    return tuple(F.try_divide(F.col(c), length) for c in names)


def _offset(of: str = "") -> Column:
    return F.col(f"{of}nx") * F.col(f"{of}x") + F.col(f"{of}ny") * F.col(f"{of}y") + F.col(f"{of}nz") * F.col(f"{of}z")


def plane_clusters(points: DataFrame, least: int = 500, near: float = 0.05, cosine: float = 0.9) -> DataFrame:
    """(scan_id, nx, ny, nz, offset, x, y, z, n): planes (unit normal, offset = normal . mean point) that at
    least `least` points belong to.

    Points are counted by cells of rounded normal and offset. The mean planes of cells with an eighth of
    `least` or more lead, unless a larger cell next to them agrees (normal within `cosine`, plane within
    `near` of the mean point), as where the border of cells cuts a plane. Then a point belongs to the
    largest leader that it agrees with itself, and each plane is the mean of its points; this is done twice,
    as the first planes are means of parts. Cells are fewer than points, and only large ones are sent to their
    neighbours. A scan may hold most of the points, so none is shuffled: they meet the leaders where they are read."""
    step = math.sqrt(2 * (1 - cosine))
    keys = ["cx", "cy", "cz", "co"]
    cell = [F.round(F.col(f"n{c}") / step).cast("int").alias(f"c{c}") for c in "xyz"] + [F.round(_offset() / near).cast("bigint").alias("co")]
    mine = points.select("scan_id", "nx", "ny", "nz", "x", "y", "z")
    means = lambda: (F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("nx", "ny", "nz", "x", "y", "z")))
    units = lambda: (u.alias(f"n{c}") for c, u in zip("xyz", _unit(("nx", "ny", "nz")), strict=True))
    cells = settled(mine.select("*", *cell).groupBy("scan_id", *keys).agg(*means()).where(F.col("n") >= max(1, least // 8)))
    large = cells.select("scan_id", *keys, "n", *units(), "x", "y", "z", F.xxhash64(*keys).alias("cell"))
    around = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(keys, at, strict=True))) for at in itertools.product((-1, 0, 1), repeat=4) if any(at)))
    sent = large.select("*", F.explode(around).alias("a")).select("scan_id", *((F.col(k) + F.col(f"a.{k}")).alias(k) for k in keys), *(F.col(c).alias(f"l_{c}") for c in ("cell", "n", "nx", "ny", "nz", "x", "y", "z")))
    met = large.join(sent, ["scan_id", *keys]).where(_agrees(F.col, lambda c: F.col(f"l_{c}"), near, cosine))
    led = met.where((F.col("l_n") > F.col("n")) | (F.col("l_n") == F.col("n")) & (F.col("l_cell") < F.col("cell"))).select("scan_id", "cell").distinct()
    leaders = settled(large.join(led, ["scan_id", "cell"], "left_anti").drop(*keys))
    unit = mine.select("scan_id", "x", "y", "z", *units())
    for last in (False, True):
        found = members(unit, leaders, near, cosine).where(F.col("n") >= (least if last else max(1, least // 8)))
        leaders = settled(found.select("scan_id", "cell", "n", *units(), "x", "y", "z"))
    return leaders.select("scan_id", "nx", "ny", "nz", _offset().alias("offset"), "x", "y", "z", "n")


#: Planes of all scans up to which they are sent to every task (100,000 are 6 MB); more are joined.
FEW = 100_000


def members(unit: DataFrame, leaders: DataFrame, near: float, cosine: float, few: int = FEW) -> DataFrame:
    """(scan_id, cell, n, and means of nx, ny, nz, x, y, z) of the points of each leader (a table: scan_id, cell,
    n, unit normal, mean point), a point counting for the largest one of its scan that it agrees with."""
    names = ["nx", "ny", "nz", "x", "y", "z"]
    if leaders.count() > few:
        lists = leaders.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("n", "cell", *names)), asc=False).alias("l"))
        to = F.get(F.filter("l", lambda a: _agrees(F.col, lambda c: a[c], near, cosine)), F.lit(0))["cell"]
        met = _dealt(unit, lists).select("*", to.alias("cell")).where("cell IS NOT NULL")
        return met.groupBy("scan_id", "cell").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in names))
    of: dict = {}
    for r in sorted(leaders.collect(), key=lambda r: (r.n, r.cell), reverse=True):
        of.setdefault(r.scan_id, []).append((r.cell, np.array([r[c] for c in names], float)))
    sent = unit.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        kind = None
        for b in batches:
            scans = b.column("scan_id").dictionary_encode()
            kind = scans.type.value_type
            rows, codes = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names]), scans.indices.to_numpy(zero_copy_only=False)
            for code, scan in enumerate(scans.dictionary.to_pylist()):
                left = rows if len(scans.dictionary) == 1 and not scans.null_count else rows[:, codes == code]
                for cell, p in sent.value.get(scan, ()):
                    dot = left[0] * p[0] + (left[1] * p[1] + left[2] * p[2])
                    off = p[0] * (left[3] - p[3]) + (p[1] * (left[4] - p[4]) + p[2] * (left[5] - p[5]))
                    hit = (dot > cosine) & (np.abs(off) < near)
                    if hit.any():
                        n, s = sums.get((scan, cell), (0, 0.0))
                        sums[scan, cell] = n + int(hit.sum()), s + left[:, hit].sum(1)
                        left = left[:, ~hit]
        if sums:
            data = np.stack([s for _, s in sums.values()], 1)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], kind), pa.array([k[1] for k in sums], pa.int64()), pa.array([n for n, _ in sums.values()], pa.int64()), *map(pa.array, data)], ["scan_id", "cell", "m", *names])

    parts = unit.select("scan_id", *names).mapInArrow(run, f"scan_id {unit.schema['scan_id'].dataType.simpleString()}, cell bigint, m bigint, " + ", ".join(f"{c} double" for c in names))
    n = F.sum("m")
    return parts.groupBy("scan_id", "cell").agg(n.alias("n"), *((F.sum(c) / n).alias(c) for c in names))


def _dealt(points: DataFrame, lists: DataFrame, salts: int = 64) -> DataFrame:
    """points with the list of their scan. The points of a scan are dealt to `salts` keys, each with a copy of
    the list, as one scan may hold most of them."""
    each = lists.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    return points.withColumn("_s", salt).join(each, ["scan_id", "_s"]).drop("_s")


def _met(points: DataFrame, planes: DataFrame, few: int = FEW) -> DataFrame:
    """points with each of the planes (a table) of their scan, a row a pair; the planes are sent to the points where they
    are few."""
    if planes.count() <= few:
        return points.join(F.broadcast(planes), "scan_id")
    rest = [c for c in planes.columns if c != "scan_id"]
    lists = planes.groupBy("scan_id").agg(F.collect_list(F.struct(*rest)).alias("_l"))
    return _dealt(points, lists).select(*points.columns, F.inline("_l"))


def _agrees(of, plane, near: float, cosine: float) -> Column:
    """Whether a point with a unit normal belongs to a plane, both given by their columns' names."""
    dot = sum((of(f"n{c}") * plane(f"n{c}") for c in "yz"), of("nx") * plane("nx"))
    off = sum((plane(f"n{c}") * (of(c) - plane(c)) for c in "yz"), plane("nx") * (of("x") - plane("x")))
    return (dot > cosine) & (F.abs(off) < near)


def largest(clusters: DataFrame, top: int) -> DataFrame:
    """The `top` clusters of each scan by size; of equal ones those with the lower offset, then normal."""
    place = F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("n"), "offset", "nx", "ny", "nz"))
    return clusters.withColumn("_k", place).where(F.col("_k") <= top).drop("_k")


def bounding(clusters: DataFrame, points: DataFrame, margin: float = 0.1, behind: int = 100) -> DataFrame:
    """clusters (a table) with at most `behind` points of their scan further than `margin` behind the plane. A
    scan has few clusters (each of many points), so a point meets few and counts are summed before they move."""
    key = F.xxhash64("nx", "ny", "nz", "offset").alias("_p")
    planes = clusters.select("scan_id", key, *(F.col(c).alias(f"p_{c}") for c in ("nx", "ny", "nz", "offset")))
    side = F.col("p_nx") * F.col("x") + F.col("p_ny") * F.col("y") + F.col("p_nz") * F.col("z") - F.col("p_offset")
    full = _met(points.select("scan_id", "x", "y", "z"), planes).where(side < -margin).groupBy("scan_id", "_p").agg(F.count("*").alias("b")).where(F.col("b") > behind)
    return clusters.withColumn("_p", key).join(full, ["scan_id", "_p"], "left_anti").select(*clusters.columns)


def eigen(matrix: Column, sweeps: int = 8) -> Column:
    """Struct (values, vectors) of a symmetric 3 x 3 matrix (array of 9): Jacobi rotations of each pair of
    axes in turn. vectors holds eigenvector k in entries k, 3 + k and 6 + k."""
    start = F.struct(matrix.alias("a"), F.array(*(F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9))).alias("v"))

    def bound(value: Column, use) -> Column:
        return F.transform(F.array(value), use)[0]  # named once, not written out at every use

    def turned(acc: Column, p: int, q: int) -> Column:
        a, v = (lambda i, j: acc["a"][3 * i + j]), (lambda i, j: acc["v"][3 * i + j])
        theta = F.try_divide(a(q, q) - a(p, p), 2 * a(p, q))
        tangent = bound(theta, lambda x: F.coalesce(F.when(x >= 0, 1.0).otherwise(-1.0) / (F.abs(x) + F.sqrt(x * x + 1)), F.lit(0.0)))

        def made(turn: Column) -> Column:
            t, c, s, r = turn["t"], turn["c"], turn["s"], 3 - p - q
            new = {(p, p): a(p, p) - t * a(p, q), (q, q): a(q, q) + t * a(p, q), (p, q): F.lit(0.0), (r, r): a(r, r), (r, p): c * a(r, p) - s * a(r, q), (r, q): s * a(r, p) + c * a(r, q)}
            both = new | {(j, i): x for (i, j), x in new.items()}
            axes = {(i, p): c * v(i, p) - s * v(i, q) for i in range(3)} | {(i, q): s * v(i, p) + c * v(i, q) for i in range(3)} | {(i, r): v(i, r) for i in range(3)}
            grid = [(i, j) for i in range(3) for j in range(3)]
            return F.struct(F.array(*(both[x] for x in grid)).alias("a"), F.array(*(axes[x] for x in grid)).alias("v"))

        cosine = bound(tangent, lambda t: F.struct(t.alias("t"), (1 / F.sqrt(t * t + 1)).alias("c")))
        return bound(bound(cosine, lambda x: F.struct(x["t"].alias("t"), x["c"].alias("c"), (x["t"] * x["c"]).alias("s"))), made)

    def step(acc: Column, k: Column) -> Column:
        return F.when(k == 0, turned(acc, 0, 1)).when(k == 1, turned(acc, 0, 2)).otherwise(turned(acc, 1, 2))

    return F.aggregate(F.array(*(F.lit(k) for _ in range(sweeps) for k in range(3))), start, step, lambda acc: F.struct(F.array(*(acc["a"][4 * i] for i in range(3))).alias("values"), acc["v"].alias("vectors")))


def refined(planes: DataFrame, points: DataFrame, near: float = 0.05, cosine: float = 0.9) -> DataFrame:
    """planes (a table of plane_clusters() rows, few a scan) with the normal of least variance of the points that belong
    to them: normal within `cosine`, plane within `near`. One pass of sums over the points; the normal keeps
    its side, and stays where the points span no plane (the second variance is not over four times the
    least)."""
    few = planes.withColumn("_p", F.xxhash64("nx", "ny", "nz", "offset"))
    of = few.select("scan_id", "_p", *(F.col(c).alias(f"p_{c}") for c in ("nx", "ny", "nz", "x", "y", "z")))
    met = _met(points.select("scan_id", "x", "y", "z", *(u.alias(f"n{c}") for c, u in zip("xyz", _unit(("nx", "ny", "nz")), strict=True))), of)
    dot = sum((F.col(f"n{c}") * F.col(f"p_n{c}") for c in "yz"), F.col("nx") * F.col("p_nx"))
    d = {c: F.col(c) - F.col(f"p_{c}") for c in "xyz"}
    side = sum((F.col(f"p_n{c}") * d[c] for c in "yz"), F.col("p_nx") * d["x"])
    pairs = [a + b for a, b in itertools.combinations_with_replacement("xyz", 2)]
    sums = met.where((dot > cosine) & (F.abs(side) < near)).groupBy("scan_id", "_p").agg(
        F.count("*").alias("_n"), *(F.sum(d[c]).alias(f"s{c}") for c in "xyz"), *(F.sum(d[x[0]] * d[x[1]]).alias(f"s{x}") for x in pairs)
    )
    spread = lambda x: F.col(f"s{x}") - F.col(f"s{x[0]}") * F.col(f"s{x[1]}") / F.col("_n")
    matrix = F.array(*(spread("".join(sorted(a + b))) for a in "xyz" for b in "xyz"))
    solved = sums.select("scan_id", "_p", eigen(matrix).alias("e"), *((F.col(f"s{c}") / F.col("_n")).alias(f"d{c}") for c in "xyz"))
    at = F.array_position("e.values", F.array_min("e.values")).cast("int") - 1
    by_size = F.array_sort("e.values")
    axis = solved.where((by_size[1] > 4 * by_size[0]) & (by_size[1] > 0)).select("scan_id", "_p", "dx", "dy", "dz", *(F.element_at("e.vectors", at + 3 * i + 1).alias(f"e{c}") for i, c in enumerate("xyz")))
    j = few.join(axis, ["scan_id", "_p"], "left")
    flip = F.when(sum((F.col(f"e{c}") * F.col(f"n{c}") for c in "yz"), F.col("ex") * F.col("nx")) < 0, -1.0).otherwise(1.0)
    j = j.withColumns({f"n{c}": F.coalesce(flip * F.col(f"e{c}"), F.col(f"n{c}")) for c in "xyz"} | {c: F.col(c) + F.coalesce(f"d{c}", F.lit(0.0)) for c in "xyz"})
    return j.withColumn("offset", _offset()).select(*planes.columns)


def ground_planes(points: DataFrame, least: int = 500, near: float = 0.05, cosine: float = 0.9, margin: float = 0.1, behind: int = 100) -> DataFrame:
    """plane_clusters() row of each scan's ground: the largest plane that looks up (0.8 of its normal) and has
    hardly anything behind it, its normal refined."""
    c = bounding(settled(plane_clusters(points, least, near, cosine)), points, margin, behind)
    return refined(settled(largest(c.where("nz > 0.8"), 1)), points, near, cosine)


# --- boxes


def hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise; one or two points where all are equal or in line."""
    xy = np.unique(xy, axis=0)
    if len(xy) > 64:  # what lies inside the hull of the extremes in eight directions is no corner
        turn = np.arange(8) * (np.pi / 4)
        ends = xy[np.unique((xy @ np.array([np.cos(turn), np.sin(turn)])).argmax(0))]
        c = ends.mean(0)
        ends = ends[np.argsort(np.arctan2(*(ends - c).T[::-1]))]
        edge = np.roll(ends, -1, 0) - ends
        inside = np.ones(len(xy), bool)
        for a, e in zip(ends, edge, strict=True):
            inside &= e[0] * (xy[:, 1] - a[1]) - e[1] * (xy[:, 0] - a[0]) > 1e-9 * (abs(e[0]) + abs(e[1]))
        xy = xy[~inside] if len(ends) > 2 else xy

    def half(rows: list) -> list:
        out: list = []
        for x, y in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append((x, y))
        return out[:-1]

    rows = xy.tolist()
    return np.array(half(rows) + half(rows[::-1]) if len(rows) > 2 else rows)


def least_box(corners: np.ndarray) -> tuple[float, float]:
    """(angle, area): the turn about z in degrees, from 0 to under 90, after which the upright box around the
    hull is least. It has a side along the hull's; of equal areas (nine digits) the smallest angle."""
    edge = np.roll(corners, -1, 0) - corners
    edge = edge[(edge != 0).any(1)]
    if not len(edge):
        return 0.0, 0.0
    angle = np.degrees(-np.arctan2(edge[:, 1], edge[:, 0])) % 90.0
    angle = np.where(np.abs(angle - 90.0) < 1e-9, 0.0, angle)
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    u, v = np.outer(corners[:, 0], c) - np.outer(corners[:, 1], s), np.outer(corners[:, 0], s) + np.outer(corners[:, 1], c)
    area = np.ptp(u, axis=0) * np.ptp(v, axis=0)
    best = np.lexsort((np.round(angle, 9), np.round(area, 9)))[0]
    return float(angle[best]), float(area[best])


def oriented_box(points: DataFrame) -> DataFrame:
    """(scan_id, angle, area): the turn about z that gives the least ground area, exactly. Every task keeps
    the hulls of the scans it reads, a few corners each, and only these corners are brought together."""
    kind = points.schema["scan_id"].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hulls: dict = {}
        for b in batches:
            for scan, rows in b.groupby("scan_id", dropna=False):
                xy = rows[["x", "y"]].to_numpy(float)
                xy = xy[np.isfinite(xy).all(1)]
                hulls[scan] = hull(np.concatenate([hulls[scan], xy]) if scan in hulls else xy)
        for scan, xy in hulls.items():
            yield pd.DataFrame({"scan_id": [scan] * len(xy), "x": xy[:, 0], "y": xy[:, 1]}) if len(xy) else pd.DataFrame({"scan_id": [], "x": [], "y": []})

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        angle, area = least_box(hull(rows[["x", "y"]].to_numpy(float)))
        return pd.DataFrame({"scan_id": rows["scan_id"].iloc[:1], "angle": [angle], "area": [area]})

    corners = points.select("scan_id", F.col("x").cast("double"), F.col("y").cast("double")).mapInPandas(partial, f"scan_id {kind}, x double, y double")
    return corners.groupBy("scan_id").applyInPandas(whole, f"scan_id {kind}, angle double, area double")


# --- alignment


def upright(ux: Column, uy: Column, uz: Column) -> Column:
    """The rotation that takes a unit vector to z: about u x z, as 1 + [v] + [v]^2 / (1 + cos); half a turn
    about x for one that points down."""
    zero, one = F.lit(0.0), F.lit(1.0)
    vx, vy, f = uy, -ux, F.try_divide(one, 1 + uz)
    rows = [1 - f * vy * vy, f * vx * vy, vy, zero, f * vx * vy, 1 - f * vx * vx, -vx, zero, -vy, vx, 1 - f * (vx * vx + vy * vy), zero]
    half = [F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0)]
    end = [zero, zero, zero, one]
    return F.when(uz > -1 + 1e-9, F.array(*rows, *end)).otherwise(F.array(*half, *end))


def about_z(degrees: Column) -> Column:
    c, s, zero, one = F.cos(F.radians(degrees)), F.sin(F.radians(degrees)), F.lit(0.0), F.lit(1.0)
    return F.array(c, -s, zero, zero, s, c, zero, zero, zero, zero, one, zero, zero, zero, zero, one)


def moved_by(x: Column, y: Column, z: Column) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(one, zero, zero, x, zero, one, zero, y, zero, zero, one, z, zero, zero, zero, one)


def chained(table: DataFrame, step: DataFrame, matrix: Column) -> DataFrame:
    """table (scan_id, matrix) with each matrix multiplied from the left by the one made of its scan's row of
    step; scans that step lacks keep theirs. The rows, one a scan, are a table, so the steps before are not
    done again."""
    made = step.select(F.col("scan_id").alias("_s"), matrix.alias("_step"))
    j = table.join(made, F.expr("scan_id <=> _s"), "left")
    return settled(j.select("scan_id", F.when(F.col("_step").isNull(), F.col("matrix")).otherwise(product(F.col("_step"), F.col("matrix"))).alias("matrix")))


def alignments(points: DataFrame, up: DataFrame, scans: DataFrame, least: int = 500) -> DataFrame:
    """(scan_id, matrix) of the scans that are processed, valid and not aligned yet (scan_id and these flags):
    first the scan's up-vector (scan_id, ux, uy, uz) becomes z; where points have normals, the refined
    normal of the ground plane then found (scans without one stay as they are); then the turn about z with
    the least ground area; then everything moves to where x, y and z begin at 0. Points are read once for
    each of these; what is passed on is a matrix a scan."""
    todo = scans.where("processed AND valid AND NOT aligned").select("scan_id")
    mine = points.join(todo, "scan_id", "left_semi")
    table = settled(up.join(todo, "scan_id", "left_semi").select("scan_id", upright(F.col("ux"), F.col("uy"), F.col("uz")).alias("matrix")))
    mine = mine.join(table.select("scan_id"), "scan_id", "left_semi")
    if {"nx", "ny", "nz"} <= set(points.columns):
        floor = ground_planes(moved(mine, table), least)
        table = chained(table, floor, upright(F.col("nx"), F.col("ny"), F.col("nz")))
    table = chained(table, oriented_box(moved(mine, table)), about_z(F.col("angle")))
    low = moved(mine, table).groupBy("scan_id").agg(*(F.min(c).alias(c) for c in "xyz"))
    return chained(table, low, moved_by(-F.col("x"), -F.col("y"), -F.col("z")))


def moved(points: DataFrame, table: DataFrame) -> DataFrame:
    """points, normals too if they have them, moved by their scan's matrix; scans without one stay."""
    matrices = table.select("scan_id", F.col("matrix").alias("_m"))
    if not {"nx", "ny", "nz"} <= set(points.columns):
        return transform(points, table, divide=False).select(*points.columns)
    j = points.join(matrices, "scan_id", "left")
    keep = lambda made, c: F.when(F.col("_m").isNull(), F.col(c)).otherwise(made)
    m = lambda i: F.col("_m")[i]
    new = {}
    for i, c in enumerate("xyz"):
        turned = [sum((m(4 * i + k) * F.col(f"{n}{d}") for k, d in ((1, "y"), (2, "z"))), m(4 * i) * F.col(f"{n}x")) for n in ("", "n")]
        new |= {c: keep(turned[0] + m(4 * i + 3), c), f"n{c}": keep(turned[1], f"n{c}")}
    return j.withColumns(new).select(*points.columns)


def moved_poses(frames: DataFrame, table: DataFrame) -> DataFrame:
    """frames (scan_id, pose, ...) whose valid poses are multiplied by their scan's matrix; invalid ones (minus
    infinity) and those of scans without one stay."""
    j = frames.join(table.select("scan_id", F.col("matrix").alias("_m")), "scan_id", "left")
    stays = F.col("_m").isNull() | (F.col("pose")[0] == F.lit(float("-inf")))
    return j.withColumn("pose", F.when(stays, F.col("pose")).otherwise(product(F.col("_m"), F.col("pose")))).select(*frames.columns)


def aligned(points: DataFrame, up: DataFrame, scans: DataFrame, least: int = 500) -> DataFrame:
    """points of the scans that alignments() moves."""
    table = alignments(points, up, scans, least)
    return moved(points.join(table.select("scan_id"), "scan_id", "left_semi"), table)
