"""Geometry of point and depth-pixel tables. Matrices are array<double>, row-major."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def identity() -> Column:
    return F.array(*(F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)))


def apply(m: Column, x: Column, y: Column, z: Column, divide: bool = False) -> tuple[Column, Column, Column]:
    r = [m[4 * i] * x + m[4 * i + 1] * y + m[4 * i + 2] * z + m[4 * i + 3] for i in range(4)]
    return tuple(c / r[3] for c in r[:3]) if divide else tuple(r[:3])


def transform(points: DataFrame, matrices: DataFrame, divide: bool = True) -> DataFrame:
    """points (scan_id, x, y, z, ...) moved by their scan's matrix (scan_id, matrix); the identity where
    there is none. divide: homogeneous."""
    j = points.join(matrices.select("scan_id", F.col("matrix").alias("_m")), "scan_id", "left").withColumn("_m", F.coalesce("_m", identity()))
    x, y, z = apply(F.col("_m"), F.col("x"), F.col("y"), F.col("z"), divide)
    return j.withColumns({"x": x, "y": y, "z": z}).drop("_m")


def product(a: Column, b: Column) -> Column:
    """4 x 4 matrix product."""
    return F.array(*(sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)))


def rigid_inverse(m: Column) -> Column:
    t = lambda i: -(m[i] * m[3] + m[4 + i] * m[7] + m[8 + i] * m[11])
    rows = [[m[i], m[4 + i], m[8 + i], t(i)] for i in range(3)]
    return F.array(*(c for r in rows for c in r), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def move_trajectory(frames: DataFrame, t: Column) -> DataFrame:
    """Valid poses become t * pose, invalid ones (minus infinity) stay."""
    return frames.withColumn("pose", F.when(F.col("pose")[0] != F.lit(float("-inf")), product(t, F.col("pose"))).otherwise(F.col("pose")))


def bounding_boxes(points: DataFrame) -> DataFrame:
    return points.groupBy("scan_id").agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))))


def floored(points: DataFrame) -> DataFrame:
    """Each scan moved so that its lowest z is 0 and its box is centred in x and y."""
    j = points.join(bounding_boxes(points), "scan_id")
    moved = {c: F.col(c) - (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in ("x", "y")} | {"z": F.col("z") - F.col("min_z")}
    return j.withColumns(moved).select(*points.columns)


def positive_quadrant(points: DataFrame) -> DataFrame:
    j = points.join(bounding_boxes(points), "scan_id")
    return j.withColumns({c: F.col(c) - F.col(f"min_{c}") for c in ("x", "y", "z")}).select(*points.columns)


def voxel_quantise(points: DataFrame, size: float) -> DataFrame:
    """(scan_id, ix, iy, iz, vertex_id, n): cells of edge `size`, the first point of each and their number."""
    cell = {f"i{c}": F.floor(F.col(c) / size).cast("bigint") for c in ("x", "y", "z")}
    return points.withColumns(cell).groupBy("scan_id", "ix", "iy", "iz").agg(F.min("vertex_id").alias("vertex_id"), F.count("*").alias("n"))


def voxel_lookup(points: DataFrame, voxels: DataFrame, grids: DataFrame) -> DataFrame:
    """points with the value of the voxel (scan_id, ix, iy, iz, value) that they lie in, by the scan's grid
    (scan_id, world2grid, nx, ny, nz); indices clamped to the grid, 0 for empty cells."""
    j = points.join(grids, "scan_id")
    g = apply(F.col("world2grid"), F.col("x"), F.col("y"), F.col("z"))
    at = {f"i{c}": F.greatest(F.lit(0), F.least(F.floor(v).cast("bigint"), F.col(f"n{c}") - 1)) for c, v in zip("xyz", g, strict=True)}
    return j.withColumns(at).join(voxels, ["scan_id", "ix", "iy", "iz"], "left").select(*points.columns, F.coalesce("value", F.lit(0)).alias("value"))


def lut_fit(pairs: DataFrame, x_cells: int, y_cells: int, z_cells: int, z_max: float, stripe: int = 8) -> DataFrame:
    """(ix, iy, iz, mult): depth correction by cell of (x / 2, y / 2, depth): the ratio that fits observed
    to real best; depth cell 0 and those beyond the last do not count, empty cells are 1, and the right
    `stripe` columns copy the one left of them."""
    iz = F.floor(F.col("observed") / z_max * z_cells).cast("int")
    fit = pairs.select(F.floor(F.col("x") / 2).cast("int").alias("ix"), F.floor(F.col("y") / 2).cast("int").alias("iy"), iz.alias("iz"), "observed", "real").where(f"iz BETWEEN 1 AND {z_cells - 1}")
    fit = fit.groupBy("ix", "iy", "iz").agg(F.try_divide(F.sum(F.col("observed") * F.col("real")), F.sum(F.col("real") * F.col("real"))).alias("mult"))
    spark, src = pairs.sparkSession, x_cells - stripe - 1
    grid = spark.range(x_cells * y_cells * z_cells).selectExpr(f"cast(id % {x_cells} AS int) AS ix", f"cast(id div {x_cells} % {y_cells} AS int) AS iy", f"cast(id div {x_cells * y_cells} AS int) AS iz")
    grid = grid.withColumn("from", F.when(F.col("ix") > src, src).otherwise(F.col("ix")))
    return grid.join(fit.withColumnRenamed("ix", "from"), ["from", "iy", "iz"], "left").select("ix", "iy", "iz", F.coalesce("mult", F.lit(1.0)).alias("mult"))


def lut_apply(pixels: DataFrame, lut: DataFrame, cells: tuple[int, int, int], z_max: float, broadcast_bytes: int = 256 << 20) -> DataFrame:
    """pixels (..., x, y, d) with d divided by the table's trilinear value at (x / 2, y / 2, d); beyond the
    last cell the last one counts, a cell that the table lacks is 1. The table is packed by column, each
    with its right and lower neighbours, so a pixel meets one row of it and is not moved; a table of more
    than broadcast_bytes (32 bytes a cell) is joined as Spark sees fit."""
    nx, ny, nz = cells
    whole = F.map_from_entries(F.collect_list(F.struct("iz", "mult")))
    column = lut.groupBy("ix", "iy").agg(whole.alias("m")).select("ix", "iy", F.transform(F.sequence(F.lit(0), F.lit(nz - 1)), lambda i: F.coalesce(F.get(F.map_values("m"), F.array_position(F.map_keys("m"), i).cast("int") - 1), F.lit(1.0))).alias("c"))
    packed = column
    for name, dx, dy in (("right", 1, 0), ("low", 0, 1), ("both", 1, 1)):
        there = column.select(F.col("ix").alias("jx"), F.col("iy").alias("jy"), F.col("c").alias(name))
        packed = packed.join(there, (F.col("jx") == F.least(F.col("ix") + dx, F.lit(nx - 1))) & (F.col("jy") == F.least(F.col("iy") + dy, F.lit(ny - 1))), "left").drop("jx", "jy")
    names = {c: f"_lut_{c}" for c in ("ix", "iy", "c", "right", "low", "both")}
    packed = packed.withColumnsRenamed(names)
    packed = F.broadcast(packed) if 32 * nx * ny * nz <= broadcast_bytes else packed
    at = [F.col("x") / 2.0, F.col("y") / 2.0, F.col("d") / z_max * nz]
    low = [F.least(F.floor(a).cast("int"), F.lit(n - 1)) for a, n in zip(at, cells, strict=True)]
    fx, fy, fz = (F.when(F.floor(a) >= n - 1, 0.0).otherwise(a - F.floor(a)) for a, n in zip(at, cells, strict=True))
    below = F.least(low[2] + 1, F.lit(nz - 1))
    along = lambda c: F.coalesce((1 - fz) * F.get(names[c], low[2]) + fz * F.get(names[c], below), F.lit(1.0))
    value = (1 - fx) * (1 - fy) * along("c") + fx * (1 - fy) * along("right") + (1 - fx) * fy * along("low") + fx * fy * along("both")
    met = pixels.join(packed, (low[0] == F.col("_lut_ix")) & (low[1] == F.col("_lut_iy")), "left")
    return met.withColumn("d", F.col("d") / value).select(*pixels.columns)


def back_project(depth: DataFrame, frames: DataFrame, k: tuple[float, float, float, float], shift: float = 1000.0) -> DataFrame:
    """World points of depth pixels (scan_id, frame_id, y, x, d): d = 0 is skipped, invalid poses are the
    identity. k: fx, fy, cx, cy."""
    return _world(depth, frames, k, shift).select("scan_id", "frame_id", "y", "x", "wx", "wy", "wz")


def coloured_points(
    depth: DataFrame, frames: DataFrame, colour: DataFrame, k: tuple[float, float, float, float], t: list[float], k2: tuple[float, float, float, float],
    size: tuple[int, int], shift: float = 1000.0,
) -> DataFrame:
    """back_project() with the colour (r, g, b) of the pixel of colour (scan_id, frame_id, y, x, r, g, b; of
    `size`) that the point falls on as the colour camera sees it (moved by t, then k2), rounded half up;
    0 outside, behind that camera, and where that pixel is missing."""
    gx, gy, ex, ey = k2
    seen = apply(F.array(*map(F.lit, map(float, t))), F.col("_x"), F.col("_y"), F.col("_z"))
    at = lambda a, f, e: F.floor(F.try_divide(f * a, seen[2]) + e + 0.5).cast("bigint")
    world = _world(depth, frames, k, shift)
    spot = world.withColumns({"_u": at(seen[0], gx, ex), "_v": at(seen[1], gy, ey), "_front": seen[2] > 0})
    inside = F.col("_front") & F.col("_u").between(0, size[1] - 1) & F.col("_v").between(0, size[0] - 1)
    spot = spot.withColumns({"_u": F.when(inside, F.col("_u")), "_v": F.when(inside, F.col("_v"))})
    there = colour.select("scan_id", "frame_id", F.col("y").alias("_v"), F.col("x").alias("_u"), "r", "g", "b")
    met = spot.join(there, ["scan_id", "frame_id", "_v", "_u"], "left")
    return met.select("scan_id", "frame_id", "y", "x", "wx", "wy", "wz", *(F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"))


def _world(depth: DataFrame, frames: DataFrame, k: tuple[float, float, float, float], shift: float) -> DataFrame:
    """depth pixels with their point in the camera (_x, _y, _z) and in the world (wx, wy, wz)."""
    fx, fy, cx, cy = k
    pose = F.when(F.col("pose")[0] == F.lit(float("-inf")), identity()).otherwise(F.col("pose"))
    j = depth.where("d <> 0").join(frames.select("scan_id", "frame_id", pose.alias("_m")), ["scan_id", "frame_id"])
    z = F.col("d") / F.lit(shift)
    j = j.withColumns({"_x": (F.col("x") - cx) * z / fx, "_y": (F.col("y") - cy) * z / fy, "_z": z})
    wx, wy, wz = apply(F.col("_m"), F.col("_x"), F.col("_y"), F.col("_z"))
    return j.withColumns({"wx": wx, "wy": wy, "wz": wz}).drop("_m")


def reproject(depth: DataFrame, k: tuple, t: list[float], k2: tuple, size: tuple[int, int]) -> DataFrame:
    """(scan_id, frame_id, y, x, z): depth (metres in d) seen by a second camera; of several the nearest."""
    fx, fy, cx, cy = k
    gx, gy, ex, ey = k2
    z = F.col("d")
    px, py, pz = apply(F.array(*map(F.lit, map(float, t))), (F.col("x") - cx) * z / fx, (F.col("y") - cy) * z / fy, z)
    p = depth.where("d > 0").select("scan_id", "frame_id", F.floor(gx * px / pz + ex + 0.5).cast("bigint").alias("u"), F.floor(gy * py / pz + ey + 0.5).cast("bigint").alias("v"), pz.alias("z"))
    p = p.where(f"u BETWEEN 0 AND {size[1] - 1} AND v BETWEEN 0 AND {size[0] - 1} AND z > 0")
    return p.groupBy("scan_id", "frame_id", F.col("v").alias("y"), F.col("u").alias("x")).agg(F.min("z").alias("z"))


def undistort(pixels: DataFrame, k: tuple, coefficients: tuple, size: tuple[int, int], value: str = "value") -> DataFrame:
    """(scan_id, frame_id, y, x, value): each target pixel takes the nearest source pixel of its distorted
    position: three radial (k1, k2, k3) and two tangential terms (p1, p2)."""
    fx, fy, cx, cy = k
    k1, k2, p1, p2, k3 = coefficients
    grid = pixels.sparkSession.range(size[0] * size[1]).selectExpr(f"id div {size[1]} AS ty", f"id % {size[1]} AS tx")
    x, y = (F.col("tx") - cx) / fx, (F.col("ty") - cy) / fy
    r = x * x + y * y
    radial = 1 + r * (k1 + r * (k2 + r * k3))
    u = (x * radial + 2 * p1 * x * y + p2 * (r + 2 * x * x)) * fx + cx
    v = (y * radial + p1 * (r + 2 * y * y) + 2 * p2 * x * y) * fy + cy
    source = grid.select("ty", "tx", F.floor(v + 0.5).cast("bigint").alias("y"), F.floor(u + 0.5).cast("bigint").alias("x"))
    return pixels.join(source, ["y", "x"]).select("scan_id", "frame_id", F.col("ty").alias("y"), F.col("tx").alias("x"), value)


def plane_pairs(pixels: DataFrame, planes: DataFrame, k: tuple, most_degrees: float = 25.0) -> DataFrame:
    """Training pairs (frame_id, x, y, observed, real): depth on the ray through a pixel where it meets
    the frame's plane (frame_id, nx, ny, nz, offset; n . p = offset); frames tilted further are skipped,
    rays along the plane keep the observed depth."""
    fx, fy, cx, cy = k
    flat = planes.where(F.abs(F.col("nz")) > math.cos(math.radians(most_degrees)))
    j = pixels.where("d > 0").join(flat, "frame_id")
    along = F.col("nx") * (F.col("x") - cx) / fx + F.col("ny") * (F.col("y") - cy) / fy + F.col("nz")
    real = F.when(F.abs(along) < 1e-6, F.col("d")).otherwise(F.col("offset") / along)
    return j.select("frame_id", "x", "y", F.col("d").alias("observed"), real.alias("real"))


def depth_bins(frames: DataFrame, width: float, most_degrees: float = 25.0) -> DataFrame:
    """(bin, n) of the plane distances of near-frontal frames (nz, offset)."""
    flat = frames.where(F.abs(F.col("nz")) > math.cos(math.radians(most_degrees)))
    return flat.groupBy(F.floor(F.col("offset") / width).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def greatest_steps(frames: DataFrame, most_degrees: float = 25.0) -> DataFrame:
    """(scan_id, step): by how much the plane's distance grows most from one frame (scan_id, frame_id, nz,
    offset) to the next, near-frontal one; at least 0."""
    step = F.col("offset") - F.lag("offset").over(Window.partitionBy("scan_id").orderBy("frame_id"))
    near = F.abs(F.col("nz")) > math.cos(math.radians(most_degrees))
    stepped = frames.select("scan_id", F.when(near, step).alias("step"))
    return stepped.groupBy("scan_id").agg(F.greatest(F.lit(0.0), F.coalesce(F.max("step"), F.lit(0.0))).alias("step"))


def rigid_transforms(pairs: DataFrame) -> DataFrame:
    """(key, r, t): rotation (9) and translation (3) that take x to y best, for pairs (key, x0..x2, y0..y2):
    two aggregations (centroids; nine product sums), then a 3 x 3 decomposition of one row a key."""
    names = [f"{a}{i}" for a in "xy" for i in range(3)]
    mid = pairs.groupBy("key").agg(*(F.avg(c).alias(f"m{c}") for c in names))
    c = pairs.join(mid, "key")
    sums = c.groupBy("key", *(f"m{x}" for x in names)).agg(F.array(*(F.sum((F.col(f"x{i}") - F.col(f"mx{i}")) * (F.col(f"y{j}") - F.col(f"my{j}"))) for i in range(3) for j in range(3))).alias("h"))

    @pandas_udf("array<double>")
    def rotation(h: pd.Series) -> pd.Series:
        def one(x: np.ndarray) -> list[float]:
            u, _, vt = np.linalg.svd(np.asarray(x).reshape(3, 3))
            flip = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))])
            return (vt.T @ flip @ u.T).ravel().tolist()

        return h.map(one)

    r = sums.withColumn("r", rotation("h"))
    t = F.array(*(F.col(f"my{i}") - sum((F.col("r")[3 * i + k] * F.col(f"mx{k}") for k in range(1, 3)), F.col("r")[3 * i] * F.col("mx0")) for i in range(3)))
    return r.select("key", "r", t.alias("t"))


def column_samples(voxels: DataFrame, reach: int = 15, levels: int = 62, extent: tuple[int, int] = (0, 0)) -> DataFrame:
    """(scan_id, cx, cy, dx, dy, iz, value): of each occupied column inside the margin the voxels within
    `reach` columns, below `levels`. Voxels are sent to the blocks of `reach` columns that they touch."""
    size = reach + 1
    v = voxels.where(F.col("iz") < levels)
    columns = v.select("scan_id", F.col("ix").alias("cx"), F.col("iy").alias("cy")).distinct()
    columns = columns.where((F.col("cx") >= reach) & (F.col("cy") >= reach) & (F.col("cx") < extent[0] - reach) & (F.col("cy") < extent[1] - reach))
    c = columns.withColumns({"bx": F.floor(F.col("cx") / size), "by": F.floor(F.col("cy") / size)})
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    sent = v.select("*", F.explode(around).alias("a")).withColumns({"bx": F.floor(F.col("ix") / size) + F.col("a.i"), "by": F.floor(F.col("iy") / size) + F.col("a.j")})
    j = c.join(sent, ["scan_id", "bx", "by"]).where(f"abs(ix - cx) <= {reach} AND abs(iy - cy) <= {reach}")
    return j.select("scan_id", "cx", "cy", (F.col("ix") - F.col("cx")).alias("dx"), (F.col("iy") - F.col("cy")).alias("dy"), "iz", "value")


def not_finite(points: DataFrame, columns: list[str]) -> DataFrame:
    """(scan_id, bad): rows of each scan with a null, NaN or infinite value in the columns."""
    bad = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in columns]
    any_ = bad[0]
    for b in bad[1:]:
        any_ = any_ | b
    return points.groupBy("scan_id").agg(F.count_if(any_).alias("bad"))


def calibrated_depth(depth: DataFrame, colour: DataFrame, lut: DataFrame, cells: tuple[int, int, int], z_max: float, k: tuple, lens: tuple, k2: tuple, lens2: tuple, t: list[float], size: tuple[int, int]) -> DataFrame:
    """The chain of one capture: depth (metres, value) undistorted by its lens, corrected by the table,
    seen from the colour camera, and dropped where the undistorted colour (value) is black."""
    flat = undistort(depth, k, lens, size).withColumnRenamed("value", "d").where("d > 0")
    right = lut_apply(flat, lut, cells, z_max)
    seen = reproject(right, k, t, k2, size)
    black = undistort(colour, k2, lens2, size).where("value = 0").select("scan_id", "frame_id", "y", "x")
    return seen.join(black, ["scan_id", "frame_id", "y", "x"], "left_anti")
