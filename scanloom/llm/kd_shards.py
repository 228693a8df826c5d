"""Shards of near-equal bytes by k-d tree partitioning.

Rows are points whose dimensions follow from the text: bytes, characters, CRC-32, so equal texts lie
on one point and stay together. A node is split at the weighted median of its widest dimension (its
extent against that of all rows): the tree's nodes of one level are split together, and the cut of
each is found by 256-fold bisection, every round being one aggregation of at most 256 sums for each
node and dimension. The next widest dimension is taken where a cut leaves more than two thousandths of
the node out of balance, and the best of all where none does better. A point that outweighs what a
side may hold cannot be cut by the dimensions: then its rows are cut by a hash of the id.

Sizes are UTF-8 bytes + 1. Null texts weigh 1 and have CRC-32 zero, like empty ones. Null and
repeated ids are rows like others. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard

DIMS = ("size", "chars", "crc", "spread")
BINS = 256


def points(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.char_length(text).cast("bigint").alias("chars"), F.crc32(text).alias("crc"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("spread")), 32).alias("spread"),
    )


def _leaf(cuts: dict[int, tuple[str, int]]) -> Column:
    """The node that a row has reached; root 1, children 2n (at or below the cut) and 2n + 1."""
    node = F.lit(1)
    for n in sorted(cuts):
        dim, at = cuts[n]
        node = F.when(node == n, F.when(F.col(dim) <= at, 2 * n).otherwise(2 * n + 1)).otherwise(node) if n > 1 else F.when(F.col(dim) <= at, 2).otherwise(3)
    return node


def _best_cuts(rows: DataFrame, want: dict[tuple[int, str], tuple[int, int, float]]) -> dict[tuple[int, str], tuple[int, float]]:
    """want: (node, dimension) -> (low, high, share of the weight wanted at or below the cut). The cut
    and how far from its goal the weight below is, as a share of the node."""
    low = {k: v[0] - 1 for k, v in want.items()}  # at or below low: too little; below is the weight there
    high = {k: v[1] for k, v in want.items()}
    below, above, total = dict.fromkeys(want, 0), {}, {}
    while open_ := [k for k in want if high[k] - low[k] > 1 or k not in total]:
        aggregates = []
        for n, dim in open_:
            lo, hi = low[n, dim], high[n, dim]
            step = max(1, -(-(hi - lo) // BINS))
            bin_ = F.floor((F.col(dim) - lo - 1) / step).cast("int")
            inside = (F.col("node") == n) & (F.col(dim) > lo) & (F.col(dim) <= hi)
            aggregates.append(F.when(inside, F.struct(F.lit(n).alias("n"), F.lit(dim).alias("dim"), bin_.alias("bin"))))
        sums = rows.select("size", F.explode(F.filter(F.array(*aggregates), lambda x: x.isNotNull())).alias("k")).groupBy("k").agg(F.sum("size").alias("w")).collect()  # BINS a node and dimension
        for k in open_:
            lo, hi = low[k], high[k]
            step = max(1, -(-(hi - lo) // BINS))
            got = sorted((r.k.bin, r.w) for r in sums if (r.k.n, r.k.dim) == k)
            if k not in total:
                total[k] = sum(w for _, w in got)
                above[k] = total[k]
            goal, run = total[k] * want[k][2], below[k]
            edge = (lo, run)
            for b, w in got:
                if run + w >= goal:
                    low[k], below[k] = max(edge[0], lo + b * step), run
                    high[k], above[k] = min(hi, lo + (b + 1) * step), run + w
                    break
                run += w
                edge = (lo + (b + 1) * step, run)
            else:
                low[k], high[k] = hi - 1, hi
    out = {}
    for k, (first, _, share) in want.items():
        goal = total[k] * share
        under = abs(below[k] - goal) if low[k] >= first else float("inf")
        over = abs(above[k] - goal) if above[k] < total[k] else float("inf")
        out[k] = (low[k] if under <= over else high[k], min(under, over) / max(total[k], 1))
    return out


def assign(rows: DataFrame, shards: int, tolerance: float = 0.002) -> DataFrame:
    """rows of points() with a column shard. The tree's cuts, at most shards - 1, are all that the
    driver holds."""
    cuts: dict[int, tuple[str, int]] = {}
    leaves = {1: shards}  # node -> leaves below it
    extent = lambda r, d: r[f"{d}_high"] - r[f"{d}_low"] + 1 if r[f"{d}_low"] is not None else 1
    ends = [f(d).alias(f"{d}_{n}") for d in DIMS for n, f in (("low", F.min), ("high", F.max))]
    whole = rows.agg(*ends).first()
    while open_ := {n: m for n, m in leaves.items() if m > 1}:
        placed = rows.withColumn("node", _leaf(cuts))
        found = {r.node: r for r in placed.groupBy("node").agg(*ends).collect()}  # a row a node
        want = {(n, d): (found[n][f"{d}_low"], found[n][f"{d}_high"], (m // 2) / m) for n, m in open_.items() if n in found for d in DIMS}
        best = _best_cuts(placed.where(F.col("node").isin([*open_])), want) if want else {}
        for n, m in open_.items():
            if n in found:
                wide = sorted(DIMS[:-1], key=lambda d: -extent(found[n], d) / extent(whole, d))
                dim = next((d for d in wide if best[n, d][1] <= tolerance), None) or min(wide, key=lambda d: best[n, d][1])
                if best[n, dim][1] > 0.03 and best[n, "spread"][1] < best[n, dim][1]:
                    dim = "spread"  # a point that no cut of the dimensions can share out
                cuts[n] = (dim, best[n, dim][0])
            else:
                cuts[n] = ("size", 0)
            del leaves[n]
            leaves |= {2 * n: m // 2, 2 * n + 1: m - m // 2}
    order = {n: i for i, n in enumerate(sorted(leaves, key=lambda n: bin(n)[3:]))}
    node = _leaf(cuts)
    named = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
    return rows.withColumn("shard", F.element_at(named, node) if shards > 1 else F.lit(0))


def with_slots(rows: DataFrame, parts: int = 1024) -> DataFrame:
    """rows (id, crc, shard, ...) with slot, gapless from 0 in each shard: rows are numbered within
    (shard, part of a hash) and shifted by the sizes of the parts before, a table of shards x parts."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "crc"), F.lit(parts)).cast("int"))
    from pyspark.sql import Window

    counts = rows.groupBy("shard", "part").count()
    shift = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("shift"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "crc"))
    return rows.withColumn("own", own).join(F.broadcast(shift), ["shard", "part"]).withColumn("slot", (F.col("shift") + F.col("own") - 1).cast("bigint")).drop("part", "own", "shift")


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, size, text_crc32, shard, slot) per row of docs."""
    rows = cut(points(docs, id_col, text_col), "points")
    placed = cut(with_slots(assign(rows, shards)), "placed")
    discard(rows)
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), "slot")
