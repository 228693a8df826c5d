"""Labelled meshes drawn into the frames of their scan.

Faces lie in the cells of an octree over their scan, as deep as the number of faces asks for; every cell
has the box of its faces, and so has every cell two levels above. A frame meets the upper boxes first,
then the boxes inside those that its view touches, then the faces of what is left: a face is joined only
to frames that see its surroundings, and the joins are by cell, so a large scan is shared out.

Faces and frames meet by upper cell, so a task holds the faces of one surrounding together. It draws them
itself and passes on only its nearest pixels, however many faces these were taken from; the one shuffle
after that holds pixels, not faces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .mesh import corners
from .tables import settled

#: Rounding of coordinates and depths that a test for leaving something out allows for.
ROOM = 1e-6


def in_cells(faces: DataFrame, cell_faces: int = 512, deepest: int = 10) -> DataFrame:
    """faces (scan_id, x0..z2, ...) with their octree cell and the one two levels above. The depth of a
    scan's tree is such that a surface fills cells of about cell_faces; a scan in one point has one cell."""
    mid = [(F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2")) / 3 for c in "xyz"]
    box = faces.groupBy("scan_id").agg(F.count("*").alias("_n"), *(f(m).alias(f"_{a}{c}") for c, m in zip("xyz", mid, strict=True) for a, f in (("lo", F.min), ("hi", F.max))))
    edge = F.greatest(*(F.col(f"_hi{c}") - F.col(f"_lo{c}") for c in "xyz"))
    level = F.greatest(F.lit(0), F.least(F.lit(deepest), F.ceil(F.log(F.col("_n") / cell_faces) / F.log(F.lit(4.0))))).cast("int")
    box = box.select("scan_id", level.alias("_level"), edge.alias("_edge"), *(f"_lo{c}" for c in "xyz"))
    at = faces.join(box, "scan_id")
    side = 1 << deepest
    spot = [F.when(F.col("_edge") > 0, F.least(F.floor((m - F.col(f"_lo{c}")) / F.col("_edge") * side), F.lit(side - 1))).otherwise(F.lit(0)).cast("bigint") for c, m in zip("xyz", mid, strict=True)]
    at = at.withColumns({f"_i{c}": s for c, s in zip("xyz", spot, strict=True)})

    def cell(above: int) -> Column:
        drop = F.expr(f"{deepest} - greatest(0, _level - {above})")
        parts = [F.call_function("shiftright", F.col(f"_i{c}"), drop) for c in "xyz"]
        return (parts[0] * (1 << deepest) + parts[1]) * (1 << deepest) + parts[2]

    return at.withColumns({"cell": cell(0), "upper": cell(2)}).select(*faces.columns, "cell", "upper")


def boxes(rows: DataFrame, keys: list[str], low: dict[str, Column], high: dict[str, Column]) -> DataFrame:
    return rows.groupBy("scan_id", *keys).agg(*(F.min(c).alias(f"lo_{n}") for n, c in low.items()), *(F.max(c).alias(f"hi_{n}") for n, c in high.items()))


CAMERA = [f"m{i}" for i in range(12)]


def views(frames: DataFrame, k: tuple, size: tuple[int, int], near: float, far: float) -> DataFrame:
    """(scan_id, frame_id, m0..m11, a0_x..a5_1): the upper rows of w2c, and for each of the six sides of the
    view the plane, in the world, that is not negative inside."""
    fx, fy, cx, cy = k
    height, width = size
    sides = [(fx, 0.0, cx, 0.0), (-fx, 0.0, width - 1 - cx, 0.0), (0.0, fy, cy, 0.0), (0.0, -fy, height - 1 - cy, 0.0), (0.0, 0.0, 1.0, -near), (0.0, 0.0, -1.0, far)]
    rows = frames.select("scan_id", "frame_id", *(F.coalesce(F.col("w2c")[i].cast("double"), F.lit(float("nan"))).alias(m) for i, m in enumerate(CAMERA)))
    along = lambda side, j: sum((F.lit(side[r]) * F.col(f"m{4 * r + j}") for r in (1, 2)), F.lit(side[0]) * F.col(f"m{j}"))
    return rows.select("*", *((along(side, j) + F.lit(side[3] if j == 3 else 0.0)).alias(f"a{n}_{c}") for n, side in enumerate(sides) for j, c in enumerate("xyz1")))


def touched() -> Column:
    """Whether a box (lo_x..hi_z) may hold a point that the camera sees: it is not beyond any one side."""
    seen = F.lit(True)
    for n in range(6):
        most = sum((F.greatest(F.col(f"a{n}_{c}") * F.col(f"lo_{c}"), F.col(f"a{n}_{c}") * F.col(f"hi_{c}")) for c in "xyz"), F.col(f"a{n}_1"))
        seen = seen & (most >= -ROOM * (1 + F.abs(F.col(f"a{n}_1"))))
    return seen


def in_view(faces: DataFrame, frames: DataFrame, k: tuple, size: tuple[int, int], near: float, far: float, cell_faces: int = 512) -> DataFrame:
    """faces (scan_id, x0..z2, ...) joined to the frames (scan_id, frame_id, w2c) whose view touches the box
    of their cell, with the upper rows of w2c as m0..m11."""
    placed = in_cells(faces, cell_faces)
    low, high = ({c: f(*(F.col(f"{c}{i}") for i in range(3))) for c in "xyz"} for f in (F.least, F.greatest))
    inner = boxes(placed, ["upper", "cell"], low, high)
    outer = boxes(inner, ["upper"], {c: F.col(f"lo_{c}") for c in "xyz"}, {c: F.col(f"hi_{c}") for c in "xyz"})
    looking = views(frames, k, size, near, far)
    planes = [c for c in looking.columns if c != "scan_id"]
    wide = outer.join(looking, "scan_id").where(touched()).select("scan_id", "upper", *planes)
    close = inner.join(wide, ["scan_id", "upper"]).where(touched()).groupBy("scan_id", "upper", "frame_id", *CAMERA).agg(F.collect_list("cell").alias("_cells"))
    return placed.join(close.hint("merge"), ["scan_id", "upper"]).where(F.array_contains("_cells", F.col("cell"))).drop("upper", "cell", "_cells")


def on_screen(met: DataFrame, k: tuple, size: tuple[int, int], near: float, far: float) -> DataFrame:
    """Faces with their corners in the frame (u0..w2, depths d0..d2) and the range of its pixels that they
    may cover (ul, uh, wl, wh); those with a corner out of depth, or between pixels, go."""
    fx, fy, cx, cy = k
    m = lambda i: F.col(f"m{i}")
    at = []
    for i in range(3):
        p = [m(4 * r) * F.col(f"x{i}") + m(4 * r + 1) * F.col(f"y{i}") + m(4 * r + 2) * F.col(f"z{i}") + m(4 * r + 3) for r in range(3)]
        at += [(F.try_divide(fx * p[0], p[2]) + cx).alias(f"u{i}"), (F.try_divide(fy * p[1], p[2]) + cy).alias(f"w{i}"), p[2].alias(f"d{i}")]
    # generated, so that the conditions below are not carried into the join that gave these rows: as a join's
    # condition they are one method that is too long to be compiled at run time
    gone = {*CAMERA, *(f"{c}{i}" for c in "xyz" for i in range(3))}
    met = met.select(*(c for c in met.columns if c not in gone), F.inline(F.array(F.struct(*at))))
    met = met.where(" AND ".join(f"d{i} BETWEEN {near} AND {far}" for i in range(3)))
    low = lambda c: F.greatest(F.lit(0), F.ceil(F.least(*(F.col(f"{c}{i}") for i in range(3))))).cast("int")
    high = lambda c, n: F.least(F.lit(n - 1), F.floor(F.greatest(*(F.col(f"{c}{i}") for i in range(3))))).cast("int")
    ranges = {"ul": low("u"), "uh": high("u", size[1]), "wl": low("w"), "wh": high("w", size[0])}
    return met.withColumns(ranges).where("ul <= uh AND wl <= wh").withColumn("area", _area()).where("area <> 0")


def _area() -> Column:
    return (F.col("u1") - F.col("u0")) * (F.col("w2") - F.col("w0")) - (F.col("u2") - F.col("u0")) * (F.col("w1") - F.col("w0"))


def _first(key: np.ndarray, depth: np.ndarray, face: np.ndarray, spots: int) -> np.ndarray:
    """Of rows with equal keys (below spots) that with the least depth, then face, as places."""
    if spots > 1 << 22:
        found, key = np.unique(key, return_inverse=True)
        spots = len(found)
    least = np.full(spots, np.inf)
    np.minimum.at(least, key, depth)
    at = np.flatnonzero(depth == least[key])
    at = at[np.lexsort((face[at], key[at]))]
    new = np.ones(len(at), bool)
    new[1:] = key[at][1:] != key[at][:-1]
    return at[new]


def _views_of(t: pa.Table) -> tuple[np.ndarray, int]:
    """A number for each scan and frame of t, and how many there are."""
    codes = [t.column(c).combine_chunks().dictionary_encode() for c in ("scan_id", "frame_id")]
    codes = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in codes]
    both = codes[0].indices.to_numpy().astype(np.int64) * len(codes[1].dictionary) + codes[1].indices.to_numpy()
    found, view = np.unique(both, return_inverse=True)
    return view, len(found)


def nearest_pixels(drawn: DataFrame, values: list[str], size: tuple[int, int], samples: int = 1 << 20) -> DataFrame:
    """(scan_id, frame_id, y, x, values, depth) of on_screen() faces, each pixel with the nearest of them
    (of equal depths, to nine digits, the smaller face_id). A task draws its rows, about `samples` pixels of
    their bounding boxes at a time, and keeps the nearest pixels of up to as many again before it passes them
    on, so what is shuffled follows the frames, not the faces."""
    height, width = size
    keep = ["scan_id", "frame_id", *values, "face_id"]
    schema = drawn.select(*keep, F.lit(0).cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("x"), F.lit(0.0).alias("depth")).schema
    kind = to_arrow_schema(schema)

    def pixels(t: pa.Table) -> Iterator[pa.Table]:
        view, n = _views_of(t)
        c = {k: t.column(k).to_numpy() for k in ("u0", "u1", "u2", "w0", "w1", "w2", "d0", "d1", "d2", "area", "ul", "uh", "wl", "wh", "face_id")}
        wide = (c["uh"] - c["ul"] + 1).astype(np.int64)
        ends = np.cumsum(wide * (c["wh"] - c["wl"] + 1))
        start = 0
        while start < len(ends):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + samples, "right")))
            each = np.diff(ends[start:stop], prepend=done)
            row = np.repeat(np.arange(start, stop), each)
            place = np.arange(ends[stop - 1] - done) - np.repeat(np.cumsum(each) - each, each)
            y, x = c["wl"][row] + place // wide[row], c["ul"][row] + place % wide[row]
            u0, w0, m = c["u0"][row], c["w0"][row], c["area"][row]
            b1 = ((x - u0) * (c["w2"][row] - w0) - (c["u2"][row] - u0) * (y - w0)) / m
            b2 = ((c["u1"][row] - u0) * (y - w0) - (x - u0) * (c["w1"][row] - w0)) / m
            some = (b1 >= 0) & (b2 >= 0) & (b1 + b2 <= 1)
            row, y, x, b1, b2 = row[some], y[some], x[some], b1[some], b2[some]
            depth = 1 / ((1 - b1 - b2) / c["d0"][row] + b1 / c["d1"][row] + b2 / c["d2"][row])
            depth = np.floor(depth * 1e9 + 0.5) / 1e9
            at = _first((view[row] * height + y) * width + x, depth, c["face_id"][row], n * height * width)
            yield t.select(keep).take(pa.array(row[at])).append_column("y", pa.array(y[at])).append_column("x", pa.array(x[at])).append_column("depth", pa.array(depth[at])).cast(kind)
            start = stop

    def nearest(held: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(held).combine_chunks()
        view, n = _views_of(t)
        c = {k: t.column(k).to_numpy() for k in ("y", "x", "depth", "face_id")}
        return t.take(pa.array(_first((view * height + c["y"]) * width + c["x"], c["depth"], c["face_id"], n * height * width)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for t in pixels(pa.Table.from_batches([batch])) if batch.num_rows else ():
                held, n = held + [t], n + t.num_rows
                if n >= samples:
                    held = [nearest(held)]
                    n = held[0].num_rows
                    if n >= samples // 2:
                        yield from held[0].to_batches(max_chunksize=1 << 16)
                        held, n = [], 0
        if n:
            yield from nearest(held).to_batches(max_chunksize=1 << 16)

    best = drawn.mapInArrow(draw, schema).groupBy("scan_id", "frame_id", "y", "x").agg(F.min(F.struct("depth", "face_id", *values)).alias("b"))
    return best.select("scan_id", "frame_id", "y", "x", *(f"b.{v}" for v in values), "b.depth")


def project(faces: DataFrame, vertices: DataFrame, labels: DataFrame, frames: DataFrame, k: tuple, size: tuple[int, int], near: float = 0.1, far: float = 15.0, cell_faces: int = 512) -> DataFrame:
    """(scan_id, frame_id, y, x, label, depth): labelled faces drawn into frames (scan_id, frame_id, w2c), each
    pixel the nearest face there. A face has the label (scan_id, vertex_id, value) of its first corner."""
    of = labels.select("scan_id", F.col("vertex_id").alias("v0"), F.col("value").alias("label"))
    painted = corners(faces, vertices).join(of, ["scan_id", "v0"]).select("scan_id", "face_id", "label", *(f"{c}{i}" for c in "xyz" for i in range(3)))
    met = in_view(settled(painted), frames, k, size, near, far, cell_faces)  # read for boxes and for faces
    return nearest_pixels(on_screen(met, k, size, near, far), ["label"], size)
