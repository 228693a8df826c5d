"""Approximate nearest neighbours by an inverted multi-index.

The two halves of every vector are quantised by codebooks of their own (k-means on a sample of at
most `sample_rows` rows, the only part fitted on a sample); a vector's cell is its pair of centroids.
Every row is indexed. A query visits cells by ascending sum of the two centroid distances, a heap
giving the next pair, until the cells hold `budget` rows; these are ranked by the exact distance on
the original vectors in double precision.

The budget is measured, not guessed: for at most `probe_queries` of the queries the true neighbours
are found by brute force over all rows, and the budget is the number of rows after which the wanted
share of them has been met. Rows are dealt out in blocks of whole cells, a cell above the block size
over several, so one cell with a third of all rows is shared out exactly. Queries are dealt to parts by
their own cells in the same way: those of a part visit much the same cells, and a row is sent only to
the parts of which a query visits its block.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part. Ties go to the smaller id (null ids last). Fewer than k candidates: all of them. Repeated
rows are candidates each; a row is no candidate of its own. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, discard

#: Stands for a null id, which so comes last among ties; turned back into null at the end.
NO_ID = (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, v) of the vectors that take part, as a table."""
    fit = vectors.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fit = fit.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite_of("v") & F.exists("v", lambda x: x != 0))
    rows = cut(fit.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(2).collect()
    return rows if len(lengths) < 2 else rows.where(F.size("v") == lengths[0].d)


def finite_of(v: str):
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, d)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of at most k clusters."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = nearest(x, c)
        count = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)


@dataclass
class MultiIndex:
    """Two codebooks and the number of rows in each cell (codes squared): all that is broadcast."""

    left: np.ndarray
    right: np.ndarray
    sizes: np.ndarray
    budget: int = 0
    recall: float = 0.0

    def cells(self, x: np.ndarray) -> np.ndarray:
        half = self.left.shape[1]
        return nearest(x[:, :half], self.left) * len(self.right) + nearest(x[:, half:], self.right)

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Cells that hold rows, by ascending summed squared distance of the pair of centroids."""
        half = self.left.shape[1]
        a, b = ((self.left - q[:half]) ** 2).sum(1), ((self.right - q[half:]) ** 2).sum(1)
        ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        sa, sb = a[ia].tolist(), b[ib].tolist()
        heap, width = [(sa[0] + sb[0], 0, 0)], len(self.right)
        while heap:
            _, i, j = heapq.heappop(heap)
            cell = int(ia[i]) * width + int(ib[j])
            if self.sizes[cell]:
                yield cell
            if j + 1 < len(sb):
                heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(sa):
                heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))

    def within(self, q: np.ndarray, budget: int) -> list[int]:
        out, held = [], 0
        for cell in self.visit(q):
            out.append(cell)
            held += int(self.sizes[cell])
            if held >= budget:
                break
        return out


def top(q: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and exact distances of the k rows of x nearest to q, ties to the smaller id. A dot
    product picks who may be among them, with room for its rounding."""
    d = (x * x).sum(1) - 2 * (x @ q)
    d[rows == own] = np.inf
    k = min(k, int(np.isfinite(d).sum()))
    if k <= 0:
        return np.empty(0, np.int64), np.empty(0)
    edge = np.partition(d, k - 1)[k - 1]
    some = np.flatnonzero(d <= edge + 1e-9 * (1 + abs(edge) + float(q @ q)))
    exact = np.sqrt(((x[some] - q) ** 2).sum(1))
    order = np.lexsort((ids[some], exact))[:k]
    return some[order], exact[order]


def build(rows: DataFrame, codes: int | None = None, sample_rows: int = 20_000) -> tuple[MultiIndex, DataFrame]:
    """The index without budget, and rows with their cell as a table."""
    spark, n = rows.sparkSession, rows.count()
    share = min(1.0, 1.1 * sample_rows / max(n, 1))
    sample = rows.where(F.pmod(F.xxhash64("row", "vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").limit(sample_rows).collect()
    x = np.array([r.v for r in sample] or [[0.0, 0.0]])
    half, k = (x.shape[1] + 1) // 2, codes or int(np.clip(np.sqrt(n / 64), 4, 256))
    index = MultiIndex(k_means(x[:, :half], k), k_means(x[:, half:], k), np.zeros(0, np.int64))
    shared, d = spark.sparkContext.broadcast(index), x.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = shared.value.cells(matrix(b.column("v"), d)) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.int32())], [*b.schema.names, "cell"])

    placed = cut(rows.mapInArrow(run, "row bigint, vec_id bigint, v array<double>, cell int"), "cells")
    index.sizes = np.zeros(len(index.left) * len(index.right), np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most a row a cell
        index.sizes[r.cell] = r["count"]
    return index, placed


def calibrate(index: MultiIndex, placed: DataFrame, queries: DataFrame, k: int, recall: float, probe_queries: int = 64) -> None:
    """Sets index.budget, and index.recall as measured on the probes."""
    probes = queries.orderBy(F.xxhash64("row", F.lit("probe"))).limit(probe_queries).collect()
    if not probes:
        index.budget, index.recall = 1, 1.0
        return
    d = len(probes[0].v)
    shared = placed.sparkSession.sparkContext.broadcast((np.array([p.v for p in probes]), np.array([p.row for p in probes])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, own = shared.value
        for b in batches:
            x, ids, rows, cells = matrix(b.column("v"), d), b.column("vec_id").to_numpy(zero_copy_only=False), b.column("row").to_numpy(), b.column("cell").to_numpy()
            out = []
            for i, q in enumerate(qs):
                at, score = top(q, x, ids, rows, own[i], k)
                out.append(pd.DataFrame({"q": i, "vec_id": ids[at], "score": score, "cell": cells[at]}))
            yield pa.RecordBatch.from_pandas(pd.concat(out).astype({"q": "int64", "cell": "int64", "vec_id": "int64"}), preserve_index=False)

    best = placed.mapInArrow(run, "q bigint, vec_id bigint, score double, cell bigint")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("rank") <= k).collect()
    met: list[dict[int, int]] = []
    for p in probes:
        held, after = 0, {}
        for cell in index.visit(np.array(p.v)):
            held += int(index.sizes[cell])
            after[cell] = held
        met.append(after)
    need = sorted(met[r.q][r.cell] for r in best)
    if not need:
        index.budget, index.recall = 1, 1.0
        return
    index.budget = need[min(len(need) - 1, int(np.ceil(recall * len(need))))]
    index.recall = sum(x <= index.budget for x in need) / len(need)


def in_blocks(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For cells of these sizes the first block of each and how many it is shared out over: whole cells,
    in order, to blocks of about `most`; a larger cell to several of its own."""
    first, spans, at, room = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, most
    for cell, size in enumerate(sizes.tolist()):
        if size > room and room < most:
            at, room = at + 1, most
        first[cell], spans[cell] = at, max(1, -(-size // most))
        room -= size
        if room <= 0:
            at, room = at + int(spans[cell]), most
    return first, spans


def dealt(cell: np.ndarray, row: np.ndarray, first: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The block of each row of a cell."""
    return first[cell] + (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % spans[cell]


def search(vectors: DataFrame, every: int = 100, k: int = 10, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 16_384, query_rows: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by `every`."""
    rows = usable(vectors, id_col, vector_col)
    spark = rows.sparkSession
    index, placed = build(rows)
    queries = placed.where((F.col("vec_id") % every == 0) & (F.col("vec_id") != NO_ID))
    calibrate(index, placed, queries, k, recall)
    d = index.left.shape[1] + index.right.shape[1]
    first, spans = in_blocks(index.sizes, block_rows)
    asking = np.zeros(len(index.sizes), np.int64)
    for r in queries.groupBy("cell").count().collect():  # at most a row a cell
        asking[r.cell] = r["count"]
    shared = spark.sparkContext.broadcast((index, first, spans, *in_blocks(asking, query_rows)))

    def deal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, spans, *_ = shared.value
        for b in batches:
            block = dealt(b.column("cell").to_numpy(), b.column("row").to_numpy(), first, spans)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block)], [*b.schema.names, "block"])

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, first, spans, part_first, part_spans = shared.value
        kind = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("v", pa.list_(pa.float64())), ("block", pa.int64()), ("cells", pa.list_(pa.int32())), ("part", pa.int64())])
        for b in batches:
            parts = dealt(b.column("cell").to_numpy(), b.column("row").to_numpy(), part_first, part_spans).tolist()
            for q, id_, vec, part in zip(b.column("row").to_pylist(), b.column("vec_id").to_pylist(), matrix(b.column("v"), d), parts, strict=True):
                by: dict[int, list[int]] = {}
                for cell in index.within(vec, index.budget):
                    for s in range(int(spans[cell])):
                        by.setdefault(int(first[cell]) + s, []).append(cell)
                yield pa.RecordBatch.from_pylist([{"q": q, "query_id": id_, "v": vec, "block": x, "cells": c, "part": part} for x, c in by.items()], kind)

    asked = cut(queries.mapInArrow(deal_queries, "q bigint, query_id bigint, v array<double>, block bigint, cells array<int>, part bigint"), "asked")
    visits = asked.select(F.col("block").alias("at"), F.col("part").alias("visiting")).distinct()
    held = placed.mapInArrow(deal_rows, "row bigint, vec_id bigint, v array<double>, cell int, block bigint")
    held = held.join(visits, held.block == visits.at).select("row", "vec_id", "v", "cell", "block", F.col("visiting").alias("part"))

    def rank(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"q": [], "query_id": [], "vec_id": [], "score": []}).astype({"q": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})
        order = np.argsort(rows["cell"].to_numpy(), kind="stable")
        x, ids, own, cell = np.stack(rows["v"].to_numpy())[order], rows["vec_id"].to_numpy()[order], rows["row"].to_numpy()[order], rows["cell"].to_numpy()[order]
        out = []
        for q, id_, vec, cells in zip(asked["q"], asked["query_id"], asked["v"], asked["cells"], strict=True):
            lo, hi = np.searchsorted(cell, cells, "left"), np.searchsorted(cell, cells, "right")
            some = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
            at, score = top(np.asarray(vec), x[some], ids[some], own[some], q, k)
            out.append((np.full(len(at), q), np.full(len(at), id_), ids[some[at]], score))
        return pd.DataFrame(dict(zip(("q", "query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    near = held.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(rank, "q bigint, query_id bigint, vec_id bigint, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
