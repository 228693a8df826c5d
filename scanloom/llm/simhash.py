"""Near-duplicate documents by SimHash and a trie self-join of the fingerprints.

Fingerprints are made in Arrow batches from whole texts. Distinct fingerprints are dealt to subtrees of
their binary trie, one trie for each block of bits that a pair may have in common, and every subtree is
joined with itself: pairs of nodes go down together, the bits in which they differ add up, and a pair
above the budget goes no further. A task returns a spanning forest of its links, at most one row for each fingerprint that it holds, so a large group costs no more rows
than it has members; distinct fingerprints have at most 2,080 partners within two bits.

Null texts count as empty; texts without words have fingerprint zero, linked like any other. Rows
with null doc_id keep their row and get a component; a component's id is the smallest doc_id that is
not null (null if there is none). Repeated rows stay. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_map import with_columns
from .shared import components, cut, free_name, hex64

_ONES = np.uint64(0x0101010101010101)


def bits_over_half(hashes: np.ndarray) -> int:
    """The 64-bit word whose bit b is set if over half of the hashes have it. Eight bits are counted
    at once, one in each byte, over runs of at most 255 hashes."""
    n = len(hashes)
    starts = np.arange(0, n, 255)
    out = 0
    for b in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(b)) & _ONES, starts)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for lane in np.flatnonzero(2 * counts > n):
            out |= 1 << (8 * int(lane) + b)
    return out


def shingles(text: bytes | None, width: int = 3) -> np.ndarray:
    """Digests of the width-word shingles of a text in UTF-8, A-Z lowered, repeats included
    (bytes.split() splits at exactly the six ASCII white-space characters); a text of fewer words, but
    not none, is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[s:e], 42) for s, e in spans), np.uint64, len(words) - width + 1)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of the shingles; zero without words."""
    hashes = shingles(text, width)
    return bits_over_half(hashes) if len(hashes) else 0


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", width: int = 3) -> DataFrame:
    """docs with one more bigint column, the fingerprint's 64 bits."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], [*batch.schema.names, out])

    return docs.mapInArrow(run, f"{fields}, `{out}` bigint")


def trie_links(a: np.ndarray, budget: int, depth: int = 0, runs: np.ndarray | None = None, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions i < j with at most budget differing bits between a[i] and a[j]. a is sorted, or
    the positions runs[k] to runs[k + 1] are, each run below one trie node of this depth; then pairs are
    those within a run. At most about `most` node pairs are open at once at any depth."""
    ones: dict[int, np.ndarray] = {}

    def split(d: int) -> np.ndarray:
        if d not in ones:
            ones[d] = np.concatenate(([0], np.cumsum((a >> np.uint64(63 - d)) & np.uint64(1)))).astype(np.int64)
        return ones[d]

    runs = np.array([0, len(a)]) if runs is None else runs
    first = np.stack((runs[:-1], runs[1:], runs[:-1], runs[1:], np.zeros(len(runs) - 1, np.int64)), 1)
    stack = [(depth, first[x : x + most]) for x in range(0, len(first), most)]
    while stack:
        d, open_ = stack.pop()
        alo, ahi, blo, bhi, diff = open_.T
        small = (ahi - alo) * (bhi - blo) <= 32
        if d == 64:
            small[:] = True
        if small.any():
            s = open_[small]
            na, nb = s[:, 1] - s[:, 0], s[:, 3] - s[:, 2]
            each = na * nb
            pair = np.repeat(np.arange(len(s)), each)
            k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            i, j = s[pair, 0] + k // nb[pair], s[pair, 2] + k % nb[pair]
            near = (np.bitwise_count(a[i] ^ a[j]) <= budget) & (i < j)
            if near.any():
                yield i[near], j[near]
        rest = open_[~small]
        if not len(rest):
            continue
        c = split(d)
        alo, ahi, blo, bhi, diff = rest.T
        am, bm = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        same = (alo == blo) & (ahi == bhi)
        children = [np.stack(x, 1) for x in ((alo, am, blo, bm, diff), (am, ahi, bm, bhi, diff), (alo, am, bm, bhi, diff + 1))]
        children.append(np.stack((am, ahi, blo, bm, diff + 1), 1)[~same])
        down = np.concatenate(children)
        down = down[(down[:, 1] > down[:, 0]) & (down[:, 3] > down[:, 2]) & (down[:, 4] <= budget)]
        stack += [(d + 1, down[x : x + most]) for x in range(0, len(down), most)]


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n positions the smallest position that the links join it to. Links are folded in
    one batch after another; none is kept."""
    root = np.arange(n)
    for u, v in links:
        while True:
            ru, rv = root[u], root[v]
            apart = ru != rv
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(ru, rv)[apart], np.minimum(ru, rv)[apart])
            while (root != root[root]).any():
                root = root[root]
    return root


def turned(v: Column, shared: int, by: int) -> Column:
    """v with the bits below the first `shared` rotated left by so many."""
    if not by:
        return v
    rest = 64 - shared
    low = v.bitwiseAND(F.lit((1 << rest) - 1 if rest < 64 else -1))
    moved = F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, rest - by))
    return moved if rest == 64 else v.bitwiseAND(F.lit(-(1 << rest))).bitwiseOR(moved.bitwiseAND(F.lit((1 << rest) - 1)))


def near_links(prints: DataFrame, budget: int = 2, leaf: int = 1 << 15) -> DataFrame:
    """prints: distinct bigint column fp. Links (u, v) whose connected components are those of all pairs
    within `budget` bits; every link joins two of one component.

    Of budget + 1 blocks of bits a pair within the budget has one without a difference. So the trie is
    built once for each block, the block's bits turned to the top, and only subtrees of equal tops are
    joined with themselves: a fingerprint is dealt budget + 1 times, whatever their number. Subtrees of
    over `leaf` fingerprints are dealt again in the same way by the bits below, so a dense region goes
    deeper and the others do not."""
    now, shared, found = prints.select("fp", F.col("fp").alias("v"), F.lit(0).cast("bigint").alias("path")), 0, None
    while True:
        width = max(1, (64 - shared) // (budget + 1))
        turns = F.array(*(F.struct((F.col("path") * (budget + 1) + k).alias("path"), turned(F.col("v"), shared, k * width).alias("v")) for k in range(budget + 1)))
        shared = min(64, shared + width)
        dealt = now.select("fp", F.explode(turns).alias("t")).select("fp", "t.v", "t.path", F.shiftrightunsigned("t.v", 64 - shared).alias("top"))
        large = cut(dealt.groupBy("path", "top").count().where(f"count > {leaf}").select("path", "top"), "large")
        again = shared < 48 and not large.isEmpty()  # below, a subtree has 2**16 fingerprints at most
        these = dealt.join(large, ["path", "top"], "left_anti") if again else dealt
        links = these.select("path", "top", "v", "fp").repartition("path", "top").sortWithinPartitions("path", "top").mapInArrow(_subtrees(budget, shared), "u bigint, v bigint")
        found = links if found is None else found.union(links)
        if not again:
            return found
        now = cut(dealt.join(large, ["path", "top"], "left_semi").select("fp", "v", "path"), "dense")


def _subtrees(budget: int, depth: int, most: int = 1 << 18):
    """mapInArrow: (path, top, v, fp) in order of path and top -> links (u, v), some whole subtrees at a
    time."""

    def joined(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        path, v, fp = t["path"].to_numpy(), t["v"].to_numpy().view(np.uint64), t["fp"].to_numpy()
        order = np.lexsort((v, path))
        path, v, fp = path[order], v[order], fp[order]
        top = v >> np.uint64(64 - depth)
        new = np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (top[1:] != top[:-1]), [True])))
        root = forest(len(v), trie_links(v, budget, depth, new))
        moved = np.flatnonzero(root != np.arange(len(v)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= most:
                path, top = b.column("path").to_numpy(), b.column("top").to_numpy()
                inside = np.flatnonzero((path != path[-1]) | (top != top[-1]))  # the last subtree may go on
                if len(inside):
                    held[-1] = b.slice(0, int(inside[-1]) + 1)
                    yield joined(held)
                    held = [b.slice(int(inside[-1]) + 1)]
                    n = held[0].num_rows
        if held:
            yield joined(held)

    return run


def classes(prints: DataFrame, id_col: str, budget: int = 2) -> DataFrame:
    """prints: rows (id_col, fp), kept in a table. One row (fp, component) per fingerprint; component
    is the smallest id of its class."""
    least = cut(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "prints")
    roots = components(near_links(least.select("fp"), budget))
    named = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = named.groupBy("root").agg(F.min("least").alias("component"))
    return named.join(of, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 2, width: int = 3) -> DataFrame:
    """One row (id_col, fingerprint, component_id) per row of docs."""
    made = with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "fp", width)
    prints = cut(made.select("id", "fp"), "fingerprints")
    return prints.join(classes(prints, "id", budget), "fp").select(F.col("id").alias(id_col), hex64(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 2, width: int = 3) -> DataFrame:
    """The rows of docs, all columns, of which each near-duplicate class keeps one: that with the
    smallest id (nulls last; among equal ids the first as read)."""
    fp, row = free_name(docs, "fp"), free_name(docs, "row")
    made = cut(with_fingerprint(docs, text_col, fp, width).withColumn(row, F.monotonically_increasing_id()), "fingerprints")
    prints = made.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    of = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    roots = components(near_links(of.select("fp"), budget))
    named = of.join(roots, of.fp == roots.node, "left").select("first", F.coalesce("root", "fp").alias("root"))
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return made.join(kept, row, "left_semi").drop(fp, row)


#: Bands and minima a band: a pair at a similarity of 0.8 shares no band with probability
#: (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
_ODD, _FLIP = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.array([[[1]], [[0]]], np.uint64)


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key for each band of MinHash minima of a set of shingles (none for the empty set)."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for first in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[None, first : first + 1024] ^ _FLIP) * _ODD).min(axis=1), out=least)
    raw, step = least.tobytes(), 8 * ROWS
    return [xxhash.xxh64_intdigest(raw[k * step : (k + 1) * step], k) for k in range(BANDS)]


#: Tokens that more sets of a block pair than this hold are counted by a matrix product, others one by one.
FEW = 24


def similar_forest(a: list[np.ndarray], b: list[np.ndarray] | None, similarity: float) -> list[tuple[int, int]]:
    """Of sets a and b (b after a in numbering; None: a with itself) the pairs with a Jaccard similarity of
    `similarity` or more, as few as hold each linked group together: (member, its first). Every pair is
    judged by its exact overlap: tokens that many sets hold by a product of 0/1 matrices, the others, each in
    few sets, added pair by pair."""
    both = a if b is None else a + b
    size = np.array([len(x) for x in both])
    if not size.sum():
        return []
    own = np.repeat(np.arange(len(both)), size)
    token, held = np.unique(np.concatenate(both), return_inverse=True)
    df = np.bincount(held)
    n, first = len(a), 0 if b is None else len(a)
    m = len(both) - first
    wide = np.flatnonzero(df > FEW)
    column = np.full(len(token), -1)
    column[wide] = np.arange(len(wide))
    rare = (df[held] > 1) & (df[held] <= FEW)
    order = np.argsort(held[rare], kind="stable")
    rows, starts = own[rare][order], np.flatnonzero(np.r_[True, np.diff(held[rare][order]) > 0]) if rare.any() else np.empty(0, int)
    ends = np.r_[starts[1:], len(rows)]
    left, right = [], []
    for gap in range(FEW):  # in a token's list, each with the one `gap` places on
        at = np.arange(len(rows) - gap)
        at = at[at + gap < np.repeat(ends, ends - starts)[at]] if len(rows) else at
        i, j = rows[at], rows[at + gap]
        keep = (i < n) & (j >= first) if b is not None else i != j
        left.append(i[keep])
        right.append(j[keep] - first)
    pairs, counts = np.unique(np.concatenate(left).astype(np.int64) * m + np.concatenate(right), return_counts=True)
    label = np.arange(len(both))
    step = max(1, (4 << 20) // max(m, 1))
    common = column[held] >= 0
    for top in range(0, n, step):
        some = slice(top, min(top + step, n))
        over = np.zeros((some.stop - top, m), np.float32)
        for c in range(0, len(wide), 2048):
            inside = common & (column[held] >= c) & (column[held] < c + 2048)
            grid = np.zeros((len(both), min(2048, len(wide) - c)), np.float32)
            grid[own[inside], column[held][inside] - c] = 1
            over += grid[some] @ grid[first:].T
        mine = (pairs >= top * m) & (pairs < some.stop * m)
        over.ravel()[pairs[mine] - top * m] += counts[mine]
        near = over >= (1 - 1e-9) * similarity * (size[some, None] + size[None, first:] - over)
        near &= (over > 0) & (np.arange(first, len(both))[None] > np.arange(top, some.stop)[:, None])
        for i in np.flatnonzero(near.any(1)):
            met = np.unique(label[np.r_[top + i, first + np.flatnonzero(near[i])]])
            if len(met) > 1:
                label[np.isin(label, met[1:])] = met[0]
    return [(i, int(x)) for i, x in enumerate(label) if i != x]


def keep_one_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, firsts: int = 16, block_shingles: int = 1 << 20, block_texts: int = 4096,
) -> DataFrame:
    """The rows of docs, all columns, of which each class of texts linked by a Jaccard similarity of
    `similarity` or more (of their sets of `width`-word shingles, as 64-bit hashes) keeps one: that with the
    smallest id (nulls last; among equal ids the first as read). Texts with equal sets of shingles are one;
    texts without words too. Null and empty texts have no words; an empty table gives an empty result.

    The first candidates are the links of near_links(), as in op1: fingerprints of three-word shingles at 2 or
    fewer differing bits, found in the trie's subtrees. The exact check follows, since such texts may be less
    similar. Pairs at 0.8 differ in up to 11 bits, where the trie prunes nothing; further candidates, beside
    it, are therefore those that share a MinHash band and of which the smaller set of shingles has `similarity` times
    the larger one's size or more (no pair can do with less). In a bucket of up to firsts + 1 texts all pairs
    are judged. In a larger one all texts are judged against one text (the smallest that two steps through
    such buckets reach, so buckets of much the same texts have the same one), and by their Jaccard distance
    to it they are dealt into bins of half of 1 - similarity, and these into blocks of bounded size. The
    distance is a metric: texts whose distances to the one text differ by more than 1 - similarity are no
    pair, and texts that are both linked to it are one class already. All other pairs of blocks are judged, each in a task that
    returns a forest of links, so no pair that shares a band is left out, a group of near copies costs rows
    in proportion to its size, and no pair of a large bucket is ever a row."""
    row, same, keys, size, fp = (free_name(docs, x) for x in ("row", "same", "keys", "size", "fp"))

    def start():
        def make(column: pa.Array) -> list[pa.Array]:
            sets = [np.unique(shingles(t.as_py(), width)) for t in column.cast(pa.binary())]
            kept = pa.array([np.array(band_keys(s), np.uint64).view(np.int64) for s in sets], pa.list_(pa.int64()))
            return [pa.array([xxhash.xxh128_hexdigest(s.tobytes()) for s in sets], pa.string()), kept, pa.array([len(s) for s in sets], pa.int64()), pa.array(np.fromiter((fingerprint(t.as_py()) for t in column.cast(pa.binary())), np.uint64, len(column)).view(np.int64))]

        return make

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = (np.unique(shingles(t.as_py(), width)) for t in (a, b))
                over = len(np.intersect1d(x, y, assume_unique=True))
                out.append(1.0 - over / (len(x) + len(y) - over))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(out, pa.float64())], ["u", "v", "far"])

    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    made = cut(with_columns(numbered, text_col, [(same, "string"), (keys, "array<bigint>"), (size, "bigint"), (fp, "bigint")], start), "shingles")
    rows = made.select(F.col(id_col).alias("id"), F.col(row).alias("row"), F.col(same).alias("same"))
    of = cut(rows.groupBy("same").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")), "texts")
    one = of.select(F.col("first.row").alias(row))
    texts = made.join(one, row, "left_semi").select(F.col(row).alias("node"), F.col(text_col).cast("binary").alias("text"), F.col(keys).alias("keys"), F.col(size).alias("size"))
    prints = cut(made.join(one, row, "left_semi").select(F.col(row).alias("node"), F.col(fp).alias("fp")), "prints")
    least = prints.groupBy("fp").agg(F.min("node").alias("u"))
    at = lambda c: least.select(F.col("fp").alias(c), F.col("u").alias(f"{c}_node"))
    across = near_links(least.select("fp")).join(at("u"), "u").join(at("v"), "v").select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v"))
    by_trie = prints.join(least, "fp").where("u <> node").select("u", F.col("node").alias("v")).union(across)

    def led_by_all(some: DataFrame) -> DataFrame:
        """(u, v): all pairs of small buckets whose sizes allow a link."""
        other = some.select("key", F.col("node").alias("u"), F.col("size").alias("other"))
        enough = F.least("size", "other") >= (1 - 1e-9) * similarity * F.greatest("size", "other")
        return some.join(other, "key").where((F.col("u") < F.col("node")) & enough).select("u", F.col("node").alias("v"))

    bands = cut(texts.select("node", "size", F.explode("keys").alias("key")), "bands")
    large = cut(bands.groupBy("key").count().where(F.col("count") > firsts + 1).select("key"), "large")
    left = cut(bands.join(large, "key", "left_semi").select("node", "size", "key"), "left")
    lowest = lambda some, by, c, name: some.groupBy(by).agg(F.min(c).alias(name))
    one_hop = lowest(left.join(lowest(left, "key", "node", "m"), "key"), "node", "m", "m")
    pivots = lowest(left.join(one_hop, "node"), "key", "m", "u")
    led = cut(left.join(pivots, "key").where("u <> node").select("key", "u", F.col("node").alias("v"), "size"), "led")
    small = led_by_all(bands.join(large, "key", "left_anti")).select("u", "v")
    pairs = cut(by_trie.union(small).union(led.select("u", "v")).distinct(), "pairs")
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    judged = cut(both.select("u", "v", "a", "b").mapInArrow(distances, "u bigint, v bigint, far double"), "judged")
    reach = 1 - similarity + 1e-9
    links = judged.where(F.col("far") <= reach).select("u", "v")

    # the rest of the large buckets: (key, bin, part) are blocks, pairs of blocks meet in a task
    width_ = (1 - similarity) / 2
    bin_ = F.floor(F.greatest(F.lit(0.0), F.col("far") - 1e-9) / width_).cast("int")
    binned = cut(led.join(judged, ["u", "v"]).select("key", F.col("v").alias("node"), bin_.alias("bin"), "size"), "binned")
    parts = binned.groupBy("key", "bin").agg(F.greatest(F.ceil(F.sum("size") / block_shingles), F.ceil(F.count("*") / block_texts)).cast("int").alias("parts"))
    blocks = parts.select("key", "bin", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = blocks.select("key", *(F.col(c).alias(f"o_{c}") for c in ("bin", "part")))
    later = (F.col("o_bin") > F.col("bin")) | (F.col("o_bin") == F.col("bin")) & (F.col("o_part") >= F.col("part"))
    meet = blocks.join(other, "key").where(later & (F.col("o_bin") - F.col("bin") <= 2) & (F.col("o_bin") >= 2))
    meet = cut(meet.select("key", "bin", "part", "o_bin", "o_part", F.monotonically_increasing_id().alias("meeting")), "meetings")
    sides = meet.select("key", "bin", "part", "meeting", F.lit(0).alias("side")).union(meet.where("bin <> o_bin OR part <> o_part").select("key", "o_bin", "o_part", "meeting", F.lit(1)))
    placed = binned.join(parts, ["key", "bin"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    present = placed.join(sides, ["key", "bin", "part"]).select("meeting", "side", "node")

    def met(rows: pa.Table) -> pa.Table:
        node, side = rows.column("node").to_numpy(), rows.column("side").to_numpy()
        order = np.lexsort((node, side))
        sets = [np.unique(shingles(rows.column("text")[int(i)].as_py(), width)) for i in order]
        n = int((side == 0).sum())
        found = similar_forest(sets[:n], sets[n:] if n < len(sets) else None, similarity)
        return pa.table({"u": pa.array([node[order[r]] for _, r in found], pa.int64()), "v": pa.array([node[order[i]] for i, _ in found], pa.int64())})

    more = present.join(texts.select("node", "text"), "node").groupBy("meeting").applyInArrow(met, "u bigint, v bigint")
    roots = components(links.union(cut(more, "links")))
    named = of.join(roots, F.col("first.row") == roots.node, "left").select("first", F.coalesce("root", "first.row").alias("root"))
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return made.join(kept, row, "left_semi").select(*docs.columns)
