"""Meshes as tables: normals, edges, areas, components, cleaning, over-segmentation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .spatial import close_links
from .tables import settled


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """faces with the coordinates of their corners, x0..z2."""
    for k in range(3):
        v = vertices.select("scan_id", F.col("vertex_id").alias(f"v{k}"), *(F.col(c).alias(f"{c}{k}") for c in "xyz"))
        faces = faces.join(v, ["scan_id", f"v{k}"])
    return faces


def _cross() -> tuple[Column, Column, Column]:
    a = [F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"]
    b = [F.col(f"{c}2") - F.col(f"{c}0") for c in "xyz"]
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _norm(v: tuple[Column, ...]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(scan_id, vertex_id, nx, ny, nz): plain mean of the unit normals of a vertex's faces, not
    normalised again; degenerate faces do not count."""
    n = _cross()
    f = corners(faces, vertices).select("scan_id", "v0", "v1", "v2", *(F.try_divide(c, _norm(n)).alias(name) for c, name in zip(n, ("nx", "ny", "nz"), strict=True))).where("nx IS NOT NULL")
    return f.select("scan_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"), "nx", "ny", "nz").groupBy("scan_id", "vertex_id").agg(*(F.avg(c).alias(c) for c in ("nx", "ny", "nz")))


def edges(faces: DataFrame) -> DataFrame:
    """(scan_id, face_id, a, b): three a face, repeats kept."""
    e = F.array(*(F.struct(F.col(f"v{i}").alias("a"), F.col(f"v{j}").alias("b")) for i, j in ((0, 1), (0, 2), (2, 1))))
    return faces.select("scan_id", "face_id", F.explode(e).alias("e")).select("scan_id", "face_id", "e.a", "e.b")


def edge_weights(faces: DataFrame, vertices: DataFrame, normals: DataFrame) -> DataFrame:
    """(scan_id, face_id, a, b, w): 1 - n1 . n2, squared where the edge is convex (n2 . d > 0)."""
    e = edges(faces)
    for k in ("a", "b"):
        p = vertices.join(normals, ["scan_id", "vertex_id"]).select("scan_id", F.col("vertex_id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("x", "y", "z", "nx", "ny", "nz")))
        e = e.join(p, ["scan_id", k])
    d = [F.col(f"{c}_b") - F.col(f"{c}_a") for c in "xyz"]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    dot = sum((F.col(f"n{c}_a") * F.col(f"n{c}_b") for c in "yz"), F.col("nx_a") * F.col("nx_b"))
    up = F.try_divide(F.col("nx_b") * d[0] + F.col("ny_b") * d[1] + F.col("nz_b") * d[2], length)
    return e.select("scan_id", "face_id", "a", "b", F.when(F.coalesce(up > 0, F.lit(False)), (1 - dot) * (1 - dot)).otherwise(1 - dot).alias("w"))


def segment_areas(faces: DataFrame, vertices: DataFrame, segments: DataFrame) -> DataFrame:
    """(scan_id, seg_id, area) of the faces that lie in one segment with all corners."""
    f = corners(faces, vertices)
    for k in range(3):
        f = f.join(segments.select("scan_id", F.col("vertex_id").alias(f"v{k}"), F.col("seg_id").alias(f"s{k}")), ["scan_id", f"v{k}"])
    inside = f.where("s0 = s1 AND s1 = s2")
    return inside.groupBy("scan_id", F.col("s0").alias("seg_id")).agg(F.sum(0.5 * _norm(_cross())).alias("area"))


def _forest(scan: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scan, node, root) of the nodes of some pairs: the smallest node that these connect them to."""
    s, v = np.concatenate([scan, scan]), np.concatenate([a, b])
    order = np.lexsort((v, s))
    s, v = s[order], v[order]
    new = np.ones(len(v), bool)
    new[1:] = (s[1:] != s[:-1]) | (v[1:] != v[:-1])
    at = np.empty(len(v), np.int64)
    at[order] = np.cumsum(new) - 1
    s, v = s[new], v[new]
    root, x, y = np.arange(len(v)), at[: len(a)], at[len(a) :]
    while len(x):
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return s, v, v[root]


def _contracted(pairs: DataFrame, most: int) -> DataFrame:
    """(scan_id, node, root) with a row for each node that a task meets among about `most` pairs, root the
    smallest node that these connect it to: what the pairs connect, so do the rows."""
    schema = pairs.select("scan_id", F.col("a").alias("node"), F.col("a").alias("root")).schema
    kind = to_arrow_schema(schema)

    def solved(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        code = t.column("scan_id").combine_chunks().dictionary_encode()
        code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
        s, v, r = _forest(code.indices.to_numpy(), t.column("a").to_numpy(), t.column("b").to_numpy())
        found = pa.table([code.dictionary.take(pa.array(s)), pa.array(v), pa.array(r)], names=kind.names).cast(kind)
        yield from found.to_batches(max_chunksize=1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = held + [batch], n + batch.num_rows
            if n >= most:
                yield from solved(held)
                held, n = [], 0
        if n:
            yield from solved(held)

    return pairs.select("scan_id", "a", "b").where("scan_id IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL").mapInArrow(run, schema)


def components(pairs: DataFrame, task_pairs: int = 1 << 20) -> DataFrame:
    """(scan_id, node, root): connected components of undirected (scan_id, a, b), root the smallest node.

    Tasks first connect what they hold, task_pairs pairs at a time. A node that several of them have takes the
    least of their roots, and links of that to the others are all that is left to connect, which _rounds()
    does: where neighbours lie together, as in a mesh, few."""
    stars = _contracted(pairs, task_pairs).distinct()
    stars = settled(stars.withColumn("low", F.min("root").over(Window.partitionBy("scan_id", "node"))))
    over = _rounds(stars.where("low <> root").select("scan_id", F.col("low").alias("a"), F.col("root").alias("b")))
    top = over.select("scan_id", F.col("node").alias("root"), F.col("root").alias("top")).hint("merge")
    return settled(stars.where("low = root").join(top, ["scan_id", "root"], "left").select("scan_id", "node", F.coalesce("top", "root").alias("root")))


def _rounds(pairs: DataFrame) -> DataFrame:
    """components() of pairs. Every round each node takes the least label around it and then that label's own,
    so a chain of n takes log n rounds; a round is two joins by node and a table."""
    both = settled(pairs.select("scan_id", "a", "b").union(pairs.select("scan_id", F.col("b"), F.col("a"))).distinct())
    label = settled(both.groupBy("scan_id", F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        around = both.join(label.select("scan_id", F.col("node").alias("b"), F.col("root").alias("r")).hint("merge"), ["scan_id", "b"]).groupBy("scan_id", F.col("a").alias("node")).agg(F.min("r").alias("r"))
        low = label.join(around.hint("merge"), ["scan_id", "node"]).select("scan_id", "node", F.col("root").alias("old"), F.least("root", "r").alias("new"))
        hop = low.select("scan_id", F.col("node").alias("new"), F.col("new").alias("far"))
        now = settled(low.join(hop.hint("merge"), ["scan_id", "new"], "left").select("scan_id", "node", "old", F.least("new", F.coalesce("far", "new")).alias("root")))
        label = now.select("scan_id", "node", "root")
        if now.where("old <> root").isEmpty():
            return label


def drop_small_pieces(faces: DataFrame, least: int) -> DataFrame:
    """faces without those of components of fewer than `least` faces."""
    e = edges(faces)
    roots = components(e)
    of = faces.join(roots.withColumnRenamed("node", "v0"), ["scan_id", "v0"])
    size = of.groupBy("scan_id", "root").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return of.join(size, ["scan_id", "root"], "left_semi").select(*faces.columns)


def merge_close(vertices: DataFrame, faces: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) with vertices within eps of each other, in chains too, made their smallest one;
    faces that lose a corner go."""
    to = components(close_links(vertices, eps))  # joined by merge: as many as vertices, however small its files
    out = faces
    for k in range(3):
        out = out.join(to.select("scan_id", F.col("node").alias(f"v{k}"), F.col("root").alias("r")).hint("merge"), ["scan_id", f"v{k}"], "left").withColumn(f"v{k}", F.coalesce("r", f"v{k}")).drop("r")
    gone = to.where("node <> root").select("scan_id", F.col("node").alias("vertex_id")).hint("merge")
    return vertices.join(gone, ["scan_id", "vertex_id"], "left_anti"), out.where("v0 <> v1 AND v1 <> v2 AND v0 <> v2").select(*faces.columns)


def distinct_faces(faces: DataFrame) -> DataFrame:
    """Of faces with the same corners the first by face_id."""
    key = F.array_sort(F.array("v0", "v1", "v2"))
    best = faces.groupBy("scan_id", key.alias("k")).agg(F.min("face_id").alias("face_id"))
    return faces.join(best.select("scan_id", "face_id"), ["scan_id", "face_id"], "left_semi")


def referenced(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertices that some face has."""
    used = faces.select("scan_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id")).distinct()
    return vertices.join(used, ["scan_id", "vertex_id"], "left_semi")


def dense_ids(rows: DataFrame, by: list[str], out: str) -> DataFrame:
    """rows with a gapless number from 0 a scan, by the columns `by` (which tell a scan's rows apart). Rows
    are sorted in ranges; a range counts its rows of each scan, the counts of the ranges before are added up
    (a row a scan and range), and a row's number is that and its place in its range."""
    ranged = rows.repartitionByRange("scan_id", *by).sortWithinPartitions("scan_id", *by).withColumn("_at", F.monotonically_increasing_id())
    placed = settled(ranged)
    part = F.shiftright("_at", 33).alias("_part")
    counts = placed.groupBy("scan_id", part).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("scan_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("scan_id").alias("_s"), "_part", "_first", F.coalesce(before, F.lit(0)).alias("_start"))
    numbered = placed.withColumn("_of", F.shiftright("_at", 33)).join(starts, F.expr("scan_id <=> _s AND _of = _part"))
    return numbered.withColumn(out, F.col("_start") + F.col("_at") - F.col("_first")).select(*rows.columns, out)


def renumbered(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces): the vertices that some face has, and faces, with vertex_id gapless from 0 a scan in
    the old order; faces with a corner that is no vertex go."""
    kept = dense_ids(referenced(vertices, faces), ["vertex_id"], "_new")
    out = faces
    for k in range(3):
        out = out.join(kept.select("scan_id", F.col("vertex_id").alias(f"v{k}"), F.col("_new").alias(f"_n{k}")), ["scan_id", f"v{k}"])
    out = out.withColumns({f"v{k}": F.col(f"_n{k}") for k in range(3)}).select(*faces.columns)
    return kept.withColumn("vertex_id", F.col("_new")).select(*vertices.columns), out


def over_segment(weights: DataFrame, k: float, least: int) -> DataFrame:
    """(scan_id, vertex_id, seg_id): graph segmentation of a scan's edges (scan_id, a, b, w). The order
    of merges is sequential by nature, so a scan is a group; scans, of bounded size, run side by side."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["w", "a", "b"])
        ids, ends = np.unique(rows[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        ends = ends.reshape(-1, 2)
        parent, size, limit = list(range(len(ids))), [1] * len(ids), [float(k)] * len(ids)

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def union(a: int, b: int) -> int:
            if size[a] < size[b]:
                a, b = b, a
            parent[b] = a
            size[a] += size[b]
            return a

        for (a, b), w in zip(ends.tolist(), rows["w"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b and w <= limit[a] and w <= limit[b]:
                c = union(a, b)
                limit[c] = w + k / size[c]
        for a, b in ends.tolist():
            a, b = root(a), root(b)
            if a != b and min(size[a], size[b]) < least:
                union(a, b)
        top = np.array([root(x) for x in range(len(ids))])
        first = pd.Series(ids).groupby(top).transform("min")
        return pd.DataFrame({"scan_id": rows["scan_id"].iloc[0], "vertex_id": ids, "seg_id": first})

    kind = weights.schema["scan_id"].dataType.simpleString()
    return weights.select("scan_id", "a", "b", "w").groupBy("scan_id").applyInPandas(one, f"scan_id {kind}, vertex_id bigint, seg_id bigint")
