"""Exact search by largest inner product over a vector-approximation file.

A vector's components are integers, floor(scale * x). The approximation file holds a byte a component:
the cell of an even grid of at most 2 ** bits cells between the component's least and largest value.
For a query the cells of a vector bound its score from below and above, and the two bounds differ from
the score at the cells' corners by sums that depend on the query alone.

1. The file is scanned for lower bounds; the (k + 1)th largest of a query over the whole file is a
   score that k + 1 rows reach, hence a floor under which nothing is needed.
2. The file is scanned again; rows whose upper bound reaches the floor of some query of a block are the
   only ones whose exact vectors are read (a join by row).
3. A query goes through those by descending upper bound until its (k + 1)th best exact score is above
   the next bound.

Queries and rows meet in blocks of bounded size, a block pair returning k + 1 rows a query at most, and
no pair of rows is ever a row. Equal vectors are one entry with their k + 1 smallest ids, so a group of
copies costs one entry, whoever asks; equal queries are asked once.

Queries are the rows whose id is divisible by `every`. A row is no candidate of its own; repeated rows
are candidates each, and a repeated query row has a ranking each. Ties go to the smaller id, null ids
last (they ask nothing). Fewer than k candidates: all of them. Vectors that are null, hold null or
non-finite components, or are of another length than most take no part, nor do those with a component
of 2 ** 19 or more in size (their scores may not fit 64 bits). An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .multi_index import NO_ID, finite_of
from .shared import cut

MOST = 2.0**19
#: Of bounds held at once: queries of a block times rows of a step.
CELLS_AT_ONCE = 4 << 20
FLOOR = "qid bigint, low bigint"
NEED = "qb int, rb int, vid bigint"
FOUND = "qid bigint, score bigint, vec_id bigint, row bigint"


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(row, vec_id, v) of the vectors that take part, as integers, as a table."""
    x = F.col(vector_col).cast("array<double>")
    fit = vectors.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("vec_id"), x.alias("x"))
    fit = fit.where(F.col("x").isNotNull() & (F.size("x") > 0) & finite_of("x") & F.forall("x", lambda c: F.abs(c) < MOST))
    whole = F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c).cast("int"))
    rows = cut(fit.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("v")), "integers")
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(2).collect()
    return rows if len(lengths) < 2 else rows.where(F.size("v") == lengths[0].d)


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(vid, v, ids) of the distinct vectors, ids being the k + 1 smallest (vec_id, row) of each. The limit
    is applied before rows move, too."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id", "row"))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    ids = F.array_sort(F.collect_list(F.struct("vec_id", "row")))
    return cut(few.groupBy("v").agg(ids.alias("ids")).select(F.monotonically_increasing_id().alias("vid"), "v", "ids"), "entries")


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def grid(distinct: DataFrame, d: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The lowest value and the cells' width of each component: two rows a batch reach the driver's sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"), d)
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["i", "low", "high"])

    ends = distinct.select("v").mapInArrow(run, "i int, low bigint, high bigint").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ends = ends.orderBy("i").collect()  # a row a component
    low, high = (np.array([r[c] for r in ends], np.int64) for c in ("low", "high"))
    return low, np.maximum(1, -(-(high - low + 1) // (1 << bits)))


class Bounds:
    """Bounds of the scores of a block of queries for rows given by their cells. Sums are exact in doubles
    up to 2 ** 53; beyond that the bounds are widened by their rounding."""

    def __init__(self, q: np.ndarray, low: np.ndarray, width: np.ndarray) -> None:
        q = q.astype(np.float64)
        self.by_cell = np.ascontiguousarray((q * width).T)
        self.least = q @ low.astype(np.float64) + np.minimum(q, 0) @ (width - 1.0)
        self.gap = np.abs(q) @ (width - 1.0)
        size = np.abs(q) @ (np.abs(low) + 256.0 * width)
        self.slack = np.where(size < 2.0**52, 0.0, size * 2.0**-40)

    def lower(self, code: np.ndarray) -> np.ndarray:
        """Rows x queries."""
        return code.astype(np.float64) @ self.by_cell + (self.least - self.slack)

    def upper(self, code: np.ndarray) -> np.ndarray:
        return code.astype(np.float64) @ self.by_cell + (self.least + self.gap + self.slack)


def steps(n: int, queries: int) -> Iterator[slice]:
    step = max(1, CELLS_AT_ONCE // max(queries, 1))
    yield from (slice(a, min(a + step, n)) for a in range(0, n, step))


def codes_of(table: pa.Table, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(-1, d)


def certain(upper: np.ndarray, exact, many: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of entries with these upper bounds (each counting `many` rows) those that may be among the best k,
    and their scores: read by descending bound until the kth score is above the next bound."""
    order = np.argsort(-upper, kind="stable")
    read, scores, want = 0, np.empty(0, np.int64), max(32, 4 * k)
    while read < len(order):
        scores = np.concatenate([scores, exact(order[read : read + want])])
        read = len(scores)
        best = np.argsort(-scores, kind="stable")
        enough = np.searchsorted(np.cumsum(many[order[best]]), k)
        if enough < len(best):
            kth = scores[best[enough]]
            if read == len(order) or upper[order[read]] < kth:
                keep = scores >= kth
                return order[:read][keep], scores[keep]
        want *= 2
    return order[:read], scores


def search(
    vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, bits: int = 8, id_col: str = "vec_id",
    vector_col: str = "embedding", block_rows: int = 8_192, query_rows: int = 8_192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of every query."""
    rows = usable(vectors, id_col, vector_col, scale)
    spark = rows.sparkSession
    asking = rows.where((F.col("vec_id") != NO_ID) & (F.col("vec_id") % every == 0))
    distinct = entries(rows, k)
    asked = cut(asking.groupBy("v").agg(F.min("row").alias("qid")), "asked")
    n, nq = distinct.count(), asked.count()
    if not nq:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    d = len(distinct.first().v)
    low, width = grid(distinct, d, bits)
    nb, nqb = -(-n // block_rows), -(-nq // query_rows)
    shared = spark.sparkContext.broadcast((low, width))

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, width = shared.value
        for b in batches:
            cells = ((matrix(b.column("v"), d) - low) // width).astype(np.uint8)
            at = np.arange(b.num_rows + 1, dtype=np.int32) * d
            packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(at), pa.py_buffer(cells.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("vid"), packed], ["vid", "code"])

    dealt = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    everywhere = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    file = cut(distinct.select("vid", "v").mapInArrow(quantise, "vid bigint, code binary").withColumn("rb", dealt("vid", nb)), "approximations")
    cells = file.withColumn("qb", everywhere(nqb)).groupBy("qb", "rb")
    queries = asked.select("qid", "v", dealt("qid", nqb).alias("qb"))

    def lows(q: pa.Table, r: pa.Table) -> pa.Table:
        best = np.empty((0, q.num_rows))
        if q.num_rows and r.num_rows:
            code, bounds = codes_of(r, d), Bounds(matrix(q.column("v").combine_chunks(), d), *shared.value)
            for at in steps(len(code), q.num_rows):
                both = np.concatenate([best, bounds.lower(code[at])])
                best = np.partition(both, len(both) - k - 1, axis=0)[-k - 1 :] if len(both) > k + 1 else both
        ids = np.repeat(np.asarray(q.column("qid"), np.int64)[None], len(best), 0)
        return pa.table({"qid": pa.array(ids.ravel()), "low": pa.array(np.floor(best).astype(np.int64).ravel())})

    found = queries.withColumn("rb", everywhere(nb)).groupBy("qb", "rb").cogroup(cells).applyInArrow(lows, FLOOR)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("low")))
    floors = found.withColumn("place", place).where(F.col("place") <= k + 1).where(F.col("place") == k + 1).select(F.col("qid").alias("q"), F.col("low").alias("floor"))
    floored = cut(queries.join(floors, F.col("qid") == F.col("q"), "left").drop("q"), "floors")
    under = lambda t: t.column("floor").to_pandas().fillna(float("-inf")).to_numpy(np.float64)

    def needs(q: pa.Table, r: pa.Table) -> pa.Table:
        some = np.zeros(r.num_rows, bool)
        if q.num_rows and r.num_rows:
            code, bounds, floor = codes_of(r, d), Bounds(matrix(q.column("v").combine_chunks(), d), *shared.value), under(q)
            for at in steps(len(code), q.num_rows):
                some[at] = (bounds.upper(code[at]) >= floor).any(1)
        kept = r.filter(pa.array(some)) if r.num_rows else r
        return kept.select(["qb", "rb", "vid"]).cast(pa.schema([("qb", pa.int32()), ("rb", pa.int32()), ("vid", pa.int64())]))

    asks = floored.withColumn("rb", everywhere(nb)).groupBy("qb", "rb")
    needed = asks.cogroup(cells).applyInArrow(needs, NEED)
    read = needed.join(distinct, "vid").select("qb", "rb", "v", "ids")

    def best(q: pa.Table, r: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("qid", "score", "vec_id", "row")}
        if q.num_rows and r.num_rows:
            x, asking = matrix(r.column("v").combine_chunks(), d).astype(np.int64), matrix(q.column("v").combine_chunks(), d).astype(np.int64)
            (low, width), floor, ids = shared.value, under(q), r.column("ids").to_pylist()
            code, many = (x - low) // width, np.array([len(i) for i in ids])
            for at in steps(q.num_rows, len(x)):
                top = Bounds(asking[at], low, width).upper(code).T
                for qid, vec, up, least in zip(q.column("qid").to_pylist()[at], asking[at], top, floor[at], strict=True):
                    some = np.flatnonzero(up >= least)
                    got, scores = certain(up[some], lambda i, some=some, vec=vec: x[some[i]] @ vec, many[some], k + 1)
                    pairs = sorted((-s, e["vec_id"], e["row"]) for i, s in zip(some[got].tolist(), scores.tolist(), strict=True) for e in ids[i])[: k + 1]
                    for c, values in zip(out, ([qid] * len(pairs), [-p[0] for p in pairs], [p[1] for p in pairs], [p[2] for p in pairs]), strict=True):
                        out[c] += values
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    near = asks.cogroup(read.groupBy("qb", "rb")).applyInArrow(best, FOUND)
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "row"))).where(F.col("place") <= k + 1)
    lists = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "row"))).alias("near"))
    whose = asking.join(asked.select("qid", F.col("v").alias("qv")), F.col("v") == F.col("qv")).select("qid", F.col("vec_id").alias("query_id"), F.col("row").alias("own"))
    each = whose.join(lists, "qid").select("query_id", F.posexplode(F.slice(F.filter("near", lambda e: e.row != F.col("own")), 1, k)).alias("i", "e"))
    return each.select("query_id", (F.col("i") + 1).alias("rank"), F.nullif("e.vec_id", F.lit(NO_ID)).alias("vec_id"), (-F.col("e.less")).alias("score"))
