"""Neighbours: in feature space, and among points through a hash grid."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import settled

def k_nearest(queries: DataFrame, base: DataFrame, k: int, block_rows: int = 20_000) -> DataFrame:
    """(query_id, rank, id, distance) of (query_id, vec) and (id, vec): exact, Euclidean, ties to the
    smaller id. Both sides are dealt out in blocks that meet once, a block pair returning k rows for each
    of its queries; no pair of rows is ever made."""
    nq, nb = max(1, -(-queries.count() // block_rows)), max(1, -(-base.count() // block_rows))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("query_id", "vec", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("qb"), blocks(nb).alias("bb"))
    b = base.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int").alias("bb"), blocks(nq).alias("qb"))

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "id": [], "distance": []}
        if len(left) and len(right):
            x, ids = np.stack(right["vec"].to_numpy()).astype(float), right["id"].to_numpy()
            for qid, v in zip(left["query_id"], left["vec"], strict=True):
                d = np.sqrt(((x - np.asarray(v, float)) ** 2).sum(1))
                edge = np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]
                some = np.flatnonzero(d <= edge)
                top = some[np.lexsort((ids[some], d[some]))][:k]
                out["query_id"] += [qid] * len(top)
                out["id"] += ids[top].tolist()
                out["distance"] += d[top].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "id": "int64", "distance": "float64"})

    found = q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInPandas(near, "query_id bigint, id bigint, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _cells(points: DataFrame, edge: float) -> DataFrame:
    return points.withColumns({f"_{c}": F.floor(F.col(c) / edge).cast("bigint") for c in ("x", "y", "z")})


def first_edges(source: DataFrame, limit: float, most: int) -> DataFrame:
    """(scan_id, edge, steps): for each scan the limit halved so often (steps) that its fullest cell, as on a
    surface, holds about `most` source points."""
    full = _cells(source.select("scan_id", "x", "y", "z"), limit).groupBy("scan_id", "_x", "_y", "_z").count().groupBy("scan_id").agg(F.max("count").alias("n"))
    steps = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / most) / 2)).cast("int")
    return settled(full.select("scan_id", steps.alias("steps"), (F.lit(float(limit)) / F.pow(F.lit(2.0), steps)).alias("edge")))


def nearest_k(targets: DataFrame, source: DataFrame, k: int, limit: float, most: int = 32, rounds: int = 1) -> DataFrame:
    """Targets (scan_id, vertex_id, x, y, z, ...) with their k nearest source points (same columns, as r_...)
    within `limit`, the distance and the place k; of equal distances the smaller id first. Targets that find
    fewer than k go on with twice the limit, `rounds` times in all.

    The cells begin so fine that a full one holds about `most` points: a target meets the 27 cells around it,
    and is done where k points are no further than a cell's edge, which the 27 cover. The others go on with
    cells twice as wide. So the rows that meet follow the targets, not the square of the density."""
    starts = first_edges(source, limit, most)
    longest = starts.agg(F.max("steps")).first()[0]
    top = float(limit) * 2.0 ** (rounds - 1)
    right = [c for c in source.columns if c != "scan_id"]
    out, left = None, targets.join(starts.select("scan_id"), "scan_id", "left_semi")
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(m).alias("m")) for i in (-1, 0, 1) for j in (-1, 0, 1) for m in (-1, 0, 1)))
    for step in range((longest or 0) + rounds):
        edges = starts.select("scan_id", F.least(F.col("edge") * 2.0**step, F.lit(top)).alias("_e"))
        cell = lambda df, e=edges: df.join(e, "scan_id").withColumns({f"_{c}": F.floor(F.col(c) / F.col("_e")).cast("bigint") for c in "xyz"})
        sent = cell(left).select("*", F.explode(around).alias("_a")).withColumns({"_x": F.col("_x") + F.col("_a.i"), "_y": F.col("_y") + F.col("_a.j"), "_z": F.col("_z") + F.col("_a.m")}).drop("_a")
        there = cell(source).select("scan_id", "_x", "_y", "_z", *(F.col(c).alias(f"r_{c}") for c in right))
        d = lambda c: (F.col(c) - F.col(f"r_{c}")) * (F.col(c) - F.col(f"r_{c}"))
        pairs = sent.join(there, ["scan_id", "_x", "_y", "_z"]).withColumn("distance", F.sqrt(d("x") + d("y") + d("z"))).where("distance <= _e")
        place = F.row_number().over(Window.partitionBy("scan_id", "vertex_id").orderBy("distance", "r_vertex_id"))
        best = pairs.withColumn("k", place).where(F.col("k") <= k).drop("_x", "_y", "_z")
        best = settled(best.withColumn("_last", F.col("_e") >= top))
        sure = best.where("_last") if step + 1 == (longest or 0) + rounds else best.join(best.where(F.col("k") == k).select("scan_id", "vertex_id").union(best.where("_last").select("scan_id", "vertex_id")).distinct(), ["scan_id", "vertex_id"], "left_semi")
        sure = sure.drop("_e", "_last")
        out = sure if out is None else out.unionByName(sure)
        done = sure.select("scan_id", "vertex_id").distinct().union(left.join(edges.where(F.col("_e") >= top), "scan_id", "left_semi").select("scan_id", "vertex_id"))
        left = settled(left.join(done, ["scan_id", "vertex_id"], "left_anti"))
        if left.isEmpty():
            break
    return out


def nearest_vertex(targets: DataFrame, source: DataFrame, edge: float, rounds: int = 12) -> DataFrame:
    """(scan_id, vertex_id, nearest, distance): the nearest source vertex of each target; what has none
    within `edge` is tried again with twice the edge, at most `rounds` times."""
    at = ["scan_id", "vertex_id", "x", "y", "z"]
    return nearest_k(targets.select(*at), source.select(*at), 1, edge, rounds=rounds).select("scan_id", "vertex_id", F.col("r_vertex_id").alias("nearest"), "distance")


def close_links(points: DataFrame, eps: float, by_rows: int = 1024) -> DataFrame:
    """(scan_id, a, b): links that connect what chains of points (scan_id, vertex_id, x, y, z) at most eps
    apart connect, as few as that takes. Points of a cell with a diagonal of eps are all close to its first;
    two cells near each other need one link, if they have a pair at all. Pairs of cells with up to by_rows
    pairs of points are rows; denser ones are compared in a task, which returns a row. All of it grows with
    the points, so all joins are by merge and nothing passes the driver."""
    p = _cells(points.select("scan_id", "vertex_id", "x", "y", "z"), eps / math.sqrt(3.0) * (1 - 1e-9))
    at = ["_x", "_y", "_z"]
    cells = p.groupBy("scan_id", *at).agg(F.min("vertex_id").alias("first"), F.count("*").alias("n"))
    stars = p.join(cells.hint("merge"), ["scan_id", *at]).where("vertex_id <> first").select("scan_id", F.col("first").alias("a"), F.col("vertex_id").alias("b"))
    half = [s for s in itertools.product(range(-2, 3), repeat=3) if s > (0, 0, 0)]
    moved = cells.select("scan_id", *at, "n", F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"d{c}") for c, v in zip(at, s, strict=True))) for s in half))).alias("s"))
    moved = moved.select("scan_id", *at, F.col("n").alias("m"), *((F.col(c) + F.col(f"s.d{c}")).alias(f"o{c}") for c in at))
    there = cells.select("scan_id", *(F.col(c).alias(f"o{c}") for c in at), "n")
    near = moved.join(there.hint("merge"), ["scan_id", *(f"o{c}" for c in at)])
    other = p.select("scan_id", *(F.col(c).alias(f"o{c}") for c in at), *(F.col(c).alias(f"r_{c}") for c in ("vertex_id", "x", "y", "z")))
    key = ["scan_id", *at, *(f"o{c}" for c in at)]
    d = lambda c: (F.col(c) - F.col(f"r_{c}")) * (F.col(c) - F.col(f"r_{c}"))
    few = near.where(F.col("m") * F.col("n") <= by_rows).select(*key).join(p.hint("merge"), ["scan_id", *at]).join(other.hint("merge"), ["scan_id", *(f"o{c}" for c in at)])
    few = few.where(F.sqrt(d("x") + d("y") + d("z")) <= eps).groupBy(*key).agg(F.min(F.struct(F.col("vertex_id").alias("a"), F.col("r_vertex_id").alias("b"))).alias("l")).select("scan_id", "l.a", "l.b")
    dense = settled(near.where(F.col("m") * F.col("n") > by_rows).select(*key, F.monotonically_increasing_id().alias("pair")))

    def first_pair(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = (np.stack([np.asarray(t.column(c), float) for c in names], 1) for t, names in ((left, ("x", "y", "z")), (right, ("r_x", "r_y", "r_z"))))
        step = max(1, (1 << 20) // max(len(y), 1))
        at = np.empty((0, 2), int)
        for i in range(0, len(x), step):
            d = np.sqrt((x[i : i + step, None, 0] - y[None, :, 0]) ** 2 + (x[i : i + step, None, 1] - y[None, :, 1]) ** 2 + (x[i : i + step, None, 2] - y[None, :, 2]) ** 2)
            at = np.argwhere(d <= eps)[:1] + [i, 0]
            if len(at):
                break
        one, two = left.take(at[:, 0]), right.take(at[:, 1])
        return pa.table({"scan_id": one.column("scan_id"), "a": one.column("vertex_id"), "b": two.column("r_vertex_id")})

    kind = points.schema["scan_id"].dataType.simpleString()
    lefts = dense.join(p.hint("merge"), ["scan_id", *at]).select("pair", "scan_id", "vertex_id", "x", "y", "z")
    rights = dense.join(other.hint("merge"), ["scan_id", *(f"o{c}" for c in at)]).select(F.col("pair").alias("r_pair"), "r_vertex_id", "r_x", "r_y", "r_z")
    many = lefts.groupBy("pair").cogroup(rights.groupBy("r_pair")).applyInArrow(first_pair, f"scan_id {kind}, a bigint, b bigint")
    return stars.unionByName(few).unionByName(many)


def transfer_labels(source: DataFrame, target: DataFrame, threshold: float, most_angle: float = 0.5) -> DataFrame:
    """(scan_id, vertex_id, object_id) for target vertices (x, y, z, normal nx, ny, nz): of the three
    nearest labelled source vertices within the threshold the first whose normal is within most_angle;
    else the object that three such share; else 0."""
    dot = F.col("nx") * F.col("r_nx") + F.col("ny") * F.col("r_ny") + F.col("nz") * F.col("r_nz")
    near = nearest_k(target, source.where("object_id > 0"), 3, threshold).withColumn("fits", dot > math.cos(most_angle))
    best = near.groupBy("scan_id", "vertex_id").agg(F.min_by(F.when(F.col("fits"), F.col("r_object_id")), F.when(F.col("fits"), F.col("k"))).alias("first"), F.count("*").alias("n"), F.min("r_object_id").alias("low"), F.max("r_object_id").alias("high"))
    chosen = F.coalesce("first", F.when((F.col("n") == 3) & (F.col("low") == F.col("high")), F.col("low")))
    return target.select("scan_id", "vertex_id").join(best.select("scan_id", "vertex_id", chosen.alias("o")), ["scan_id", "vertex_id"], "left").select("scan_id", "vertex_id", F.coalesce("o", F.lit(0)).alias("object_id"))
