"""Pixel tables (frame_key, y, x, ...), a pixel once.

A stencil deals the pixels to square tiles, each to its own and to those whose margin it lies in; a task
rebuilds a tile as arrays and runs the window over them, one step of the window for all pixels at a
time. What is shuffled is each pixel about (1 + 2 radius / side)^2 times, at most 2.25; a group is one
tile, however large a frame is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import settled


def panoptic_segments(pixels: DataFrame) -> DataFrame:
    """Area and bounding box (x, y, w, h) of each instance of a frame."""
    box = pixels.groupBy("frame_key", "instance").agg(F.count("*").alias("area"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return box.select("frame_key", "instance", "area", "x", "y", (F.col("x1") - F.col("x") + 1).alias("w"), (F.col("y1") - F.col("y") + 1).alias("h"))


def instance_to_label(pixels: DataFrame, of: DataFrame) -> DataFrame:
    """(frame_key, y, x, label, object): label by of (instance, label_id), 0 if unknown; objects from 1."""
    return pixels.join(of, "instance", "left").select("frame_key", "y", "x", F.coalesce("label_id", F.lit(0)).alias("label"), (F.col("instance") + 1).alias("object"))


class Tile:
    """Arrays of one tile's core (shape, from top and left on) and its margin: `present` marks the pixels that
    there are, a null is NaN."""

    def __init__(self, rows: pd.DataFrame, top: int, left: int, shape: tuple[int, int], radius: int) -> None:
        self.shape, self.radius = shape, radius
        self.y, self.x = rows["y"].to_numpy() - top + radius, rows["x"].to_numpy() - left + radius
        self.rows, self.present = rows, np.zeros((shape[0] + 2 * radius, shape[1] + 2 * radius), bool)
        self.present[self.y, self.x] = True

    def grid(self, column: str) -> np.ndarray:
        values = self.rows[column].to_numpy()
        values = values.astype(float) if values.dtype.kind not in "iu" else values
        out = np.zeros(self.present.shape, values.dtype)
        out[self.y, self.x] = values
        return out

    def steps(self, radius: int | None = None) -> Iterator[tuple[int, int, Callable[[np.ndarray], np.ndarray]]]:
        """(dy, dx, what): for each place in the window what(grid) is the grid as seen from the core."""
        r, (h, w) = self.radius if radius is None else radius, self.shape
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                y, x = self.radius + dy, self.radius + dx
                yield dy, dx, lambda grid, y=y, x=x: grid[y : y + h, x : x + w]

    def core(self, grid: np.ndarray) -> np.ndarray:
        r, (h, w) = self.radius, self.shape
        return grid[r : r + h, r : r + w]


def stencil(pixels: DataFrame, radius: int, run: Callable[[Tile], dict[str, np.ndarray]], made: str) -> DataFrame:
    """(frame_key, y, x, made...): run() gives arrays over a tile's core; pixels that there are come out. The
    core is the box of the tile's own pixels, so small frames and borders take no work for what is not there."""
    side = max(64, 4 * radius)
    reach = lambda c: F.sequence(F.floor((F.col(c) - radius) / side), F.floor((F.col(c) + radius) / side))
    dealt = pixels.withColumn("tile_y", F.explode(reach("y"))).withColumn("tile_x", F.explode(reach("x")))
    kind = pixels.schema["frame_key"].dataType.simpleString()

    def tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at = rows[["y", "x"]].to_numpy()
        own = at[(at // side == [key[1], key[2]]).all(1)]
        if not len(own):
            return pd.DataFrame({c: [] for c in ("frame_key", "y", "x", *(f.split()[0] for f in made.split(", ")))})
        (top, left), (bottom, right) = own.min(0), own.max(0)
        near = ((at >= [top - radius, left - radius]) & (at <= [bottom + radius, right + radius])).all(1)
        t = Tile(rows if near.all() else rows[near], top, left, (bottom - top + 1, right - left + 1), radius)
        y, x = np.nonzero(t.core(t.present))
        out = {k: v[y, x] for k, v in run(t).items()}
        return pd.DataFrame({"frame_key": [key[0]] * len(y), "y": y + top, "x": x + left} | out)

    return dealt.groupBy("frame_key", "tile_y", "tile_x").applyInPandas(tile, f"frame_key {kind}, y bigint, x bigint, {made}")


def without_isolated(pixels: DataFrame, radius: int = 2, least: float = 0.2) -> DataFrame:
    """(frame_key, y, x, label): 0 where less than `least` of the pixels around (those that there are,
    itself included) have the same label; no label is label 0. The input image is judged, not the output."""

    def run(t: Tile) -> dict[str, np.ndarray]:
        label = t.grid("label")
        own = t.core(label)
        same, all_ = np.zeros(own.shape, int), np.zeros(own.shape, int)
        for _, _, seen in t.steps():
            there = seen(t.present)
            all_ += there
            same += there & (seen(label) == own)
        return {"label": np.where(same >= least * all_, own, 0)}

    return stencil(pixels.select("frame_key", "y", "x", F.coalesce("label", F.lit(0)).alias("label")), radius, run, "label bigint")


def resample_nearest(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """A frame of size (h, w) at (h, w) of `to`, each target pixel the nearest source pixel."""
    spark = pixels.sparkSession
    rows = spark.range(to[0]).select(F.col("id").alias("ty"), F.floor((F.col("id") + 0.5) * size[0] / to[0]).cast("bigint").alias("y"))
    columns = spark.range(to[1]).select(F.col("id").alias("tx"), F.floor((F.col("id") + 0.5) * size[1] / to[1]).cast("bigint").alias("x"))
    return pixels.join(F.broadcast(rows), "y").join(F.broadcast(columns), "x").drop("y", "x").withColumnsRenamed({"ty": "y", "tx": "x"})


def resample_bilinear(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], value: str = "value") -> DataFrame:
    """(frame_key, y, x, value): corners weighted by distance, null ones left out of both sums."""
    spark = pixels.sparkSession

    def axis(n: int, m: int, name: str) -> DataFrame:
        at = F.col("id") * ((n - 1) / max(m - 1, 1))
        low = F.floor(at).cast("bigint")
        ends = F.array(F.struct(low.alias("s"), (1 - (at - low)).alias("w")), F.struct(F.least(low + 1, F.lit(n - 1)).alias("s"), (at - low).alias("w")))
        return spark.range(m).select(F.col("id").alias(f"t{name}"), F.explode(ends).alias("e")).select(f"t{name}", F.col("e.s").alias(name), F.col("e.w").alias(f"w{name}")).where(f"w{name} > 0")

    joined = pixels.where(F.col(value).isNotNull()).join(F.broadcast(axis(size[0], to[0], "y")), "y").join(F.broadcast(axis(size[1], to[1], "x")), "x")
    w = F.col("wy") * F.col("wx")
    return joined.groupBy("frame_key", F.col("ty").alias("y"), F.col("tx").alias("x")).agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value))


def smoothed(t: Tile, column: str, sigma_d: float, sigma_r: float) -> np.ndarray:
    """Weighted mean of the valid pixels within ceil(2 sigma_d), NaN where the pixel itself is not valid."""
    values = t.grid(column)
    valid = t.present & ~np.isnan(values)
    values = np.where(valid, values, 0.0)
    own = t.core(values)
    top, bottom = np.zeros(own.shape), np.zeros(own.shape)
    for dy, dx, seen in t.steps(math.ceil(2 * sigma_d)):
        there = seen(values)
        w = np.exp(-(dy * dy + dx * dx) / (2.0 * sigma_d * sigma_d) - (there - own) ** 2 / (2.0 * sigma_r * sigma_r)) * seen(valid)
        top += w * there
        bottom += w
    return np.where(t.core(valid), top / np.maximum(bottom, 1e-300), np.nan)


def bilateral(pixels: DataFrame, sigma_d: float, sigma_r: float, value: str = "value") -> DataFrame:
    """(frame_key, y, x, value): weighted mean of the valid (not null) pixels within ceil(2 sigma_d)."""
    valid = pixels.where(F.col(value).isNotNull()).select("frame_key", "y", "x", F.col(value).cast("double").alias(value))
    return stencil(valid, math.ceil(2 * sigma_d), lambda t: {value: smoothed(t, value, sigma_d, sigma_r)}, f"{value} double")


def vote(pixels: DataFrame, radius: int, scale: float, sigma_d: float = 5.0, sigma_r: float = 0.1) -> DataFrame:
    """(frame_key, y, x, instance) of pixels (frame_key, y, x, instance, depth, intensity): the instance
    with the largest vote around, votes weighing nearness in the image, in depth and in intensity (a
    missing one counts as no difference); ties go to the lowest instance; no instance is instance 0."""

    def run(t: Tile) -> dict[str, np.ndarray]:
        names, slot = np.unique(t.rows["instance"].to_numpy(), return_inverse=True)
        slots = np.zeros(t.present.shape, int)
        slots[t.y, t.x] = slot.ravel()
        depth, light = t.grid("depth"), scale * t.grid("intensity")
        votes = np.zeros((len(names), t.shape[0] * t.shape[1]))
        at, k = np.arange(votes.shape[1]), 1.0 / (2.0 * sigma_r * sigma_r)
        for dy, dx, seen in t.steps():
            gap = np.nan_to_num(seen(depth) - t.core(depth)) ** 2 + np.nan_to_num(seen(light) - t.core(light)) ** 2
            w = np.exp(-(dy * dy + dx * dx) / (2.0 * sigma_d * sigma_d) - k * gap) * seen(t.present)
            votes[seen(slots).ravel(), at] += w.ravel()
        return {"instance": names[np.round(votes, 9).argmax(axis=0)].reshape(t.shape)}

    of = pixels.select("frame_key", "y", "x", F.coalesce("instance", F.lit(0)).cast("bigint").alias("instance"), F.col("depth").cast("double").alias("depth"), F.col("intensity").cast("double").alias("intensity"))
    return stencil(of, radius, run, "instance bigint")


def two_pass(pixels: DataFrame, size: tuple[int, int], coarse: tuple[int, int] = (240, 320), radii: tuple[int, int] = (12, 10), scales: tuple[float, float] = (10.0, 4.0)) -> DataFrame:
    """(frame_key, y, x, instance): intensity and depth are smoothed (6 and 2 pixels, 0.1), vote() runs at
    the coarse size with a wide window, then at full size with a narrower one on the first one's result."""

    def run(t: Tile) -> dict[str, np.ndarray]:
        return {"depth": smoothed(t, "depth", 2.0, 0.1), "intensity": smoothed(t, "intensity", 6.0, 0.1)}

    of = pixels.select("frame_key", "y", "x", F.col("depth").cast("double").alias("depth"), F.col("intensity").cast("double").alias("intensity"))
    smooth = stencil(of, 12, run, "depth double, intensity double")
    smooth = settled(smooth.select("frame_key", "y", "x", *(F.nanvl(c, F.lit(None)).alias(c) for c in ("depth", "intensity"))))  # read three times
    at = ["frame_key", "y", "x"]
    small = resample_nearest(pixels.select(*at, "instance"), size, coarse)
    for c in ("depth", "intensity"):
        small = small.join(resample_bilinear(smooth.select(*at, c), size, coarse, c), at, "left")
    first = resample_nearest(vote(small, radii[0], scales[0]), coarse, size)
    return vote(smooth.join(first, at), radii[1], scales[1])


def consistent(pixels: DataFrame, parity: bool = False) -> DataFrame:
    """(frame_key, y, x, label): 0 where rendered and captured depth (metres) differ by over 0.2 + 0.01
    of the captured one. parity: the margin in millimetres, as the tool that it stands for has it."""
    margin = F.lit(0.2) + 0.01 * F.col("depth") * (1000.0 if parity else 1.0)
    off = F.coalesce(F.abs(F.col("rendered") - F.col("depth")) > margin, F.lit(False))
    return pixels.select("frame_key", "y", "x", F.when(off, 0).otherwise(F.col("label")).alias("label"))


def scaled_lookup(pixels: DataFrame, other: DataFrame, size: tuple[int, int], other_size: tuple[int, int], value: str) -> DataFrame:
    """pixels with `value` of other at round(scale * coordinate), scale = (n - 1) / (m - 1)."""
    at = lambda c, k: F.floor(F.col(c) * ((other_size[k] - 1) / max(size[k] - 1, 1)) + 0.5).cast("bigint")
    o = other.select("frame_key", F.col("y").alias("oy"), F.col("x").alias("ox"), value)
    return pixels.withColumns({"oy": at("y", 0), "ox": at("x", 1)}).join(o, ["frame_key", "oy", "ox"], "left").drop("oy", "ox")


def seen_labels(
    drawn: DataFrame, captured: DataFrame, size: tuple[int, int], depth_size: tuple[int, int], captured_only: bool = False,
    least: float = 0.2, share: float = 0.01,
) -> DataFrame:
    """(frame_key, y, x, label) of drawn pixels (frame_key, y, x, label, depth; metres, of a frame of `size`)
    held against captured depth (frame_key, y, x, depth; of depth_size): 0 where both depths are known (not
    0) and differ by over least + share of the captured one. The drawn depth is brought to the captured
    raster first, and both are looked up at the label's place in it. captured_only: also 0 where nothing was
    captured."""
    at = ["frame_key", "y", "x"]
    drawn = settled(drawn.select(*at, "label", "depth"))  # read twice below, and often dear to draw
    there = resample_nearest(drawn.select(*at, F.col("depth").alias("rendered")), size, depth_size)
    known = captured.where("depth <> 0").select(*at, F.col("depth").alias("captured"))
    both = there.join(known, at, "full").select(*at, F.struct("rendered", "captured").alias("depths"))
    met = scaled_lookup(drawn.select(*at, "label"), both, size, depth_size, "depths")
    off = F.abs(F.col("depths.rendered") - F.col("depths.captured")) > least + share * F.col("depths.captured")
    off = F.coalesce((F.col("depths.rendered") != 0) & off, F.lit(False))
    if captured_only:
        off = off | F.col("depths.captured").isNull()
    return met.select(*at, F.when(off, 0).otherwise(F.col("label")).alias("label"))


def jitter(chunks: DataFrame, most: int, size: int, seed: int = 0) -> DataFrame:
    """Voxels (sample_id, ix, iy, iz, ...) shifted by an offset of up to `most` a sample and axis; those that
    leave the grid go. The offset is the first 32 bits of the MD5 of "sample:seed:axis", modulo the number of
    offsets, so any engine gives the same."""

    def step(axis: str) -> Column:
        digest = F.md5(F.concat_ws(":", F.col("sample_id").cast("string"), F.lit(str(seed)), F.lit(axis)))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % (2 * most + 1) - most

    moved = chunks.withColumns({c: F.col(c) + step(c) for c in ("ix", "iy", "iz")})
    return moved.where(" AND ".join(f"{c} BETWEEN 0 AND {size - 1}" for c in ("ix", "iy", "iz")))
