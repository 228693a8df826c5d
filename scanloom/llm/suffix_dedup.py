"""Removal of repeated strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of `length` bytes that covers it starts anywhere else too. The same sort finds
repeated passages of words: there a symbol is a word (a 32-bit code), for strings it is a byte.
Suffixes that can share their first `length` symbols are brought together in buckets and only these
are sorted:

1. A window's anchor is the leftmost smallest hash of the grams inside; equal windows have equal
   anchors, so a bucket is the suffixes with one anchor hash. Of every text (once, however many copies)
   a run of windows with one anchor is one row, a digest of its symbols and its number of copies.
2. Anchors met once are dropped. A bucket of which all runs have one digest repeats as a whole. Only
   buckets of several digests need symbols: one copy of each digest is fetched.
3. These are split by their windows' distance to the anchor, `grain` at a time, and by a hash of the
   symbols that all windows of the part share; a part holds the suffixes that agree in length - grain + 1
   symbols at least. A part of one digest is settled by its number of copies. Tasks sort the others, one
   block of parts at a time: the suffixes of the cover sample (positions whose distance to the anchor is
   in a difference cover modulo `cover`) are ranked first, and a suffix is sorted by its first symbols up
   to the next sample, that sample's rank, and the few symbols behind. So long ties cost one comparison
   of ranks, and memory is that of a block.
4. A part of over `part_rows` rows is split again by longer shared strings: a quarter of the grain, and
   so on. At a grain of one a part is one window, where nothing is left to sort; Spark counts these
   with map-side sums. So no task gathers a large part.

Texts are tables bucketed by digest in the shared folder; what is joined to them is moved, they are
not. Counts by anchor are tables of their own, so that a skewed join with them is split by Spark; these
tables grow with the data and are never broadcast.
Null texts count as empty. Null and repeated ids are rows like others; equal texts repeat each other.
Texts below `length` bytes stay whole. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard, fresh_path, remove

#: Bytes of a gram.
GRAM = 32
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def difference_cover(v: int) -> list[int]:
    """Residues of which every residue modulo v is a difference: the next one taken is that which adds
    most differences, the smallest of these."""
    have, seen = [0], {0}
    while len(seen) < v:
        gain = lambda x: len({(x - y) % v for y in have} | {(y - x) % v for y in have} | seen)
        best = max(range(v), key=lambda x: (gain(x), -x))
        seen |= {(best - y) % v for y in have} | {(y - best) % v for y in have}
        have.append(best)
    return sorted(have)


#: Which bytes part words: ASCII white space.
SPACE = np.array([chr(b).isspace() and b not in range(0x1C, 0x20) and b < 128 for b in range(256)])
BASE = 0x100000001B3


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    of = lambda x: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64))))
    return of(BASE), of(pow(BASE, -1, 1 << 64))


def word_codes(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """32-bit codes of the words of texts, one after another, and where each text ends among them."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)  # a blank before, between and after
    up, down = powers(max(1 << 18, 1 << len(data).bit_length()))
    space = SPACE[data]
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    total = np.cumsum(data * up[: len(data)])
    code = (total[end - 1] - total[begin - 1]) * down[begin]
    code ^= code >> np.uint64(29)
    code *= ODD[0]
    borders = np.cumsum([len(t) + 1 for t in texts])
    return (code >> np.uint64(32)).astype("<u4").tobytes(), np.searchsorted(begin, borders)


@dataclass(frozen=True)
class Scale:
    """What is sorted. length, grain and cover count symbols, unit is the bytes of one."""

    length: int
    unit: int = 1
    grain: int = 64
    cover: int = 32

    def symbols(self, texts: list[bytes]) -> tuple[bytes, np.ndarray]:
        """The symbols of texts one after another, and where each text ends among them."""
        return word_codes(texts) if self.unit == 4 else (b"".join(texts), np.cumsum([len(t) for t in texts]))

    @property
    def kind(self) -> np.dtype:
        return np.dtype(f"<u{self.unit}")

    @property
    def ahead(self) -> np.ndarray:
        """From a residue to the next sample position."""
        residues = difference_cover(self.cover)
        return np.array([min((r - x) % self.cover for r in residues) for x in range(self.cover)])


def strings(length: int) -> Scale:
    return Scale(length)


def passages(words: int) -> Scale:
    """Words are what is between ASCII white space."""
    return Scale(words, 4, 16, 8)


def gram_hashes(data: bytes, unit: int = 1) -> np.ndarray:
    n, step = len(data), 8 // unit
    x = np.ndarray(((n - 8) // unit + 1,), "<u8", data, strides=(unit,))
    m = (n - GRAM) // unit + 1
    h = x[:m] * ODD[0]
    for k, odd in ((step, ODD[1]), (2 * step, ODD[2]), (3 * step, ODD[3])):
        h += x[k : k + m] * odd
    h ^= h >> np.uint64(32)
    h *= ODD[4]
    return h


def anchor_runs(data: bytes, ends: np.ndarray, scale: Scale) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data: the symbols of texts one after another, ends their ends. Runs of windows with one anchor,
    within a text: text, first window, last window, anchor (offsets in data), the anchor's hash."""
    empty, length = (np.empty(0, np.int64),) * 5, scale.length
    if len(data) < length * scale.unit:
        return empty
    h, width = gram_hashes(data, scale.unit), length - GRAM // scale.unit + 1
    n = len(h) - width + 1
    low = np.uint64(0xFFFFFFFF)
    place = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)  # hash above, position below
    np.bitwise_or(h & ~low, np.arange(len(h), dtype=np.uint64), out=place[: len(h)])
    place = place.reshape(-1, width)
    left = np.minimum.accumulate(place, axis=1).ravel()
    right = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.minimum(right[:n], left[width - 1 : width - 1 + n]) & low
    begins = np.concatenate(([0], ends[:-1]))
    stops = np.maximum(ends - length + 1, begins)  # behind a text's last window
    new = np.union1d(np.flatnonzero(at[1:] != at[:-1]) + 1, np.concatenate((begins, stops)))
    new = new[new < n]
    text = np.searchsorted(begins, new, "right") - 1
    last = np.concatenate((new[1:], [n])) - 1
    own = new < stops[text]
    new, at = new[own], at[new[own]].astype(np.int64)
    return text[own], new, last[own], at, (h[at] >> np.uint64(1)).astype(np.int64)


RUNS = "key binary, lo bigint, span int, off int, h bigint, digest binary, n bigint"


def _runs(scale: Scale, block_bytes: int = 1 << 17):
    """mapInArrow: (key, text, n) -> RUNS. Blocks of texts are small, so that their arrays stay in the
    processor's caches."""
    names, length, unit = [f.split()[0] for f in RUNS.split(", ")], scale.length, scale.unit

    def columns_of(texts: list[bytes]) -> tuple:
        data, ends = scale.symbols(texts)
        text, lo, hi, at, h = anchor_runs(data, ends, scale)
        begins = np.concatenate(([0], ends[:-1]))
        span, off, view, digest = hi - lo, at - lo, memoryview(data), xxhash.xxh3_128_digest
        digests = [digest(view[a * unit : (b + length) * unit], o << 16 | b - a) for a, b, o in zip(lo.tolist(), hi.tolist(), off.tolist(), strict=True)]
        return text, lo - begins[text], span, off, h, digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, texts, first, held = [], [], 0, 0
            for k, t in enumerate(b.column("text")):
                texts.append(t.as_py())
                held += len(texts[-1])
                if held >= block_bytes or k == b.num_rows - 1:
                    text, *rest = columns_of(texts)
                    made.append((text + first, *rest))
                    texts, first, held = [], k + 1, 0
            if not made:
                continue
            text, lo, span, off, h = (np.concatenate(x) for x in list(zip(*made, strict=True))[:5])
            digests, own = [d for m in made for d in m[5]], pa.array(text)
            columns = [b.column("key").take(own), pa.array(lo.astype(np.int64)), pa.array(span.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(h), pa.array(digests, pa.binary()), b.column("n").take(own)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


PARTS = "part bigint, h bigint, digest binary, n bigint, dist int, j int, bytes binary"
PART_KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
FOUND = "h bigint, digest binary, first int, last int"


def split(h: int, digest: bytes, n: int, dist: int, first: int, data: bytes, scale: Scale, grain: int) -> Iterator[tuple]:
    """The PARTS rows of the windows over data: the first, numbered `first`, has this distance to the
    anchor, the next ones one less each. Windows of one row have distances in one grain."""
    unit, length = scale.unit, scale.length
    span, j = len(data) // unit - length, 0
    while j <= span:
        cell = (dist - j) // grain
        core = dist - cell * grain
        end = min(span, core)
        shared = data[core * unit : (core + length - grain + 1) * unit]
        key = xxhash.xxh3_64_intdigest(shared, (h ^ cell) & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
        yield key, h, digest, n, dist - j, first + j, data[j * unit : (end + length) * unit]
        j = end + 1


def _parts(scale: Scale):
    """mapInArrow: (text, asked) -> PARTS of the runs asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = scale.unit
        for b in batches:
            rows: list[tuple] = []
            edge, flat = b.column("asked").offsets.to_pylist(), b.column("asked").flatten()
            asked = [flat.field(k).to_pylist() for k in ("h", "digest", "n", "off", "lo", "span")]
            for text, x, y in zip(b.column("text"), edge, edge[1:], strict=False):
                data, _ = scale.symbols([text.as_py()])
                for h, digest, n, off, lo, span in zip(*(a[x - edge[0] : y - edge[0]] for a in asked), strict=True):
                    rows += split(h, digest, n, off, 0, data[lo * unit : (lo + span + scale.length) * unit], scale, scale.grain)
                if len(rows) >= 20_000:
                    yield _part_rows(rows)
                    rows = []
            if rows:
                yield _part_rows(rows)

    return run


def _finer(scale: Scale, grain: int):
    """mapInArrow: PARTS -> PARTS by a finer grain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x for h, digest, n, dist, j, data in zip(*(b.column(c).to_pylist() for c in ("h", "digest", "n", "dist", "j", "bytes")), strict=True) for x in split(h, digest, n, dist, j, data, scale, grain)]
            for k in range(0, len(rows), 20_000):
                yield _part_rows(rows[k : k + 20_000])

    return run


def _part_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), PART_KINDS, strict=True)], [f.split()[0] for f in PARTS.split(", ")])


def ranks(rows: np.ndarray) -> np.ndarray:
    """Rank of each row among the distinct ones."""
    rows = np.ascontiguousarray(rows)
    flat = rows.view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel()
    return np.unique(flat, return_inverse=True)[1].ravel()


def repeated_windows(parts: np.ndarray, dist: np.ndarray, n: np.ndarray, slices: list[bytes], scale: Scale) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a block of whole parts, sorted by cover-sample ranks: for each its slice, its place
    in the slice, and whether it occurs twice or more within its part."""
    length, cover, table = scale.length, scale.cover, scale.ahead
    size = np.array([len(s) // scale.unit for s in slices])
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(slices) + b"\0" * (cover * scale.unit), scale.kind)
    count = size - length + 1
    own = np.repeat(np.arange(len(slices)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    away = dist[own] - place  # distance to the anchor; aligned windows have the same
    ahead = table[-away % cover]
    sample, inverse = np.unique(begin[own] + place + ahead, return_inverse=True)
    tie = length - cover + 1
    view = np.lib.stride_tricks.sliding_window_view(data, tie)
    rank = ranks(view[sample])[inverse.ravel()]
    window = begin[own] + place
    ends = np.lib.stride_tricks.sliding_window_view(data, cover)
    step = np.arange(cover)
    head = np.where(step < ahead[:, None], ends[window], 0).astype(scale.kind)
    tail = np.where(step < (cover - 1 - ahead)[:, None], ends[window + ahead + tie], 0).astype(scale.kind)
    order = np.stack((parts[own], away, rank), 1).astype(np.int64)
    same = ranks(np.concatenate([x.view(np.uint8).reshape(len(own), -1) for x in (order, head, tail)], 1))
    return own, place, np.bincount(same, weights=n[own])[same] >= 2


def _sorted(scale: Scale, block_bytes: int = 8 << 20, sort_bytes: int = 1 << 20):
    """mapInArrow over parts in order of their key: repeated runs of windows (FOUND)."""

    def block(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        key, slices = t["part"].to_numpy(), t["bytes"].to_pylist()
        for k in _blocks(key, slices):
            own, place, twice = repeated_windows(key[k], t["dist"].to_numpy()[k], t["n"].to_numpy()[k], slices[k], scale)
            own, place = own[twice], place[twice]
            if not len(own):
                continue
            new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1))))
            last = np.concatenate((new[1:], [len(own)])) - 1
            at = own[new] + k.start
            j = t["j"].to_numpy()[at]
            yield pa.RecordBatch.from_arrays([t["h"].combine_chunks().take(pa.array(at)), t["digest"].combine_chunks().take(pa.array(at)), pa.array((j + place[new]).astype(np.int32)), pa.array((j + place[last]).astype(np.int32))], ["h", "digest", "first", "last"])

    def _blocks(key: np.ndarray, slices: list[bytes]) -> Iterator[slice]:
        start, held = 0, 0
        for i, s in enumerate(slices):
            if held >= sort_bytes and key[i] != key[i - 1]:
                yield slice(start, i)
                start, held = i, 0
            held += len(s)
        if start < len(slices):
            yield slice(start, len(slices))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            weight += b.nbytes
            if weight >= block_bytes:
                key = b.column("part").to_numpy()
                cut_at = int(np.searchsorted(key, key[-1]))  # the last part may go on
                if cut_at:
                    held[-1] = b.slice(0, cut_at)
                    yield from block(held)
                    held = [b.slice(cut_at)]
                    weight = held[0].nbytes
        if held:
            yield from block(held)

    return run


def _windows(scale: Scale):
    """mapInArrow: parts -> a row for each window, with its digest."""
    length, unit = scale.length, scale.unit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, digest, n, j, text in zip(*(b.column(c).to_pylist() for c in ("h", "digest", "n", "j", "bytes")), strict=True):
                m = len(text) // unit - length + 1
                view = memoryview(text)
                yield pa.RecordBatch.from_arrays([pa.array([h] * m), pa.array([digest] * m, pa.binary()), pa.array([n] * m), pa.array(range(j, j + m), pa.int32()), pa.array([xxhash.xxh3_128_digest(view[x * unit : (x + length) * unit]) for x in range(m)], pa.binary())], ["h", "digest", "n", "j", "window"])

    return run


def settled(parts: DataFrame, scale: Scale, part_rows: int, grain: int) -> DataFrame:
    """FOUND of parts, a table. Parts above part_rows are split by finer grains."""
    sizes = cut(parts.groupBy("part").agg(F.count("*").alias("rows"), F.sum("n").alias("all")).where("all >= 2"), "sizes").hint("merge")
    windows = F.expr(f"octet_length(bytes) div {scale.unit} - {scale.length}")
    alone = parts.where("n >= 2").select("part", "h", "digest", F.col("j").alias("first"), (F.col("j") + windows).cast("int").alias("last"))
    alone = alone.join(sizes.where("rows = 1").select("part"), "part", "left_semi").select("h", "digest", "first", "last")
    some = parts.join(sizes.where(f"rows > 1 AND rows <= {part_rows}").select("part"), "part", "left_semi").select(*parts.columns)
    found = alone.union(some.repartition("part").sortWithinPartitions("part").mapInArrow(_sorted(scale), FOUND))
    large = sizes.where(f"rows > {part_rows}").select("part")
    if large.isEmpty():
        return found
    rest = parts.join(large, "part", "left_semi").select(*parts.columns)
    if grain > 1:
        return found.union(settled(cut(rest.mapInArrow(_finer(scale, grain // 4), PARTS), "parts"), scale, part_rows, grain // 4))
    single = rest.mapInArrow(_windows(scale), "h bigint, digest binary, n bigint, j int, window binary")
    twice = single.groupBy("window").agg(F.sum("n").alias("all")).where("all >= 2").select("window")
    return found.union(single.join(twice, "window", "left_semi").selectExpr("h", "digest", "j AS first", "j AS last"))


def repeated(texts: DataFrame, scale: Scale, part_rows: int) -> DataFrame:
    """texts: a table (key, text, n) of distinct texts and their numbers of copies. (key, runs): the
    ranges [start, end) of each text's symbols that repeated strings cover."""
    runs = cut(texts.mapInArrow(_runs(scale), RUNS), "runs")
    often = cut(runs.groupBy("h").agg(F.sum("n").alias("all")).where("all >= 2").select("h"), "often").hint("merge")
    met = cut(runs.join(often, "h", "left_semi"), "met")
    discard(runs)
    kinds = cut(met.groupBy("h", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("key", "lo", "span", "off")).alias("one")), "kinds")
    several = cut(kinds.groupBy("h").agg(F.count("*").alias("digests")).where("digests > 1").select("h"), "several").hint("merge")
    whole = kinds.where("n >= 2").join(several, "h", "left_anti").selectExpr("h", "digest", "0 AS first", "one.span AS last")
    asked = kinds.join(several, "h", "left_semi").selectExpr("one.key AS key", "struct(h, digest, n, one.lo AS lo, one.span AS span, one.off AS off) AS r")
    asked = asked.groupBy("key").agg(F.collect_list("r").alias("asked"))  # as many as a text has anchors
    parts = cut(texts.join(asked.hint("shuffle_hash"), "key").select("text", "asked").mapInArrow(_parts(scale), PARTS), "parts")
    found = settled(parts, scale, part_rows, scale.grain)
    spread = cut(whole.union(found).groupBy("h", "digest").agg(F.collect_list(F.struct("first", "last")).alias("w")), "windows").hint("merge")
    discard(parts)
    covered = met.join(spread, ["h", "digest"]).select("key", F.explode("w").alias("w"), "lo")
    covered = cut(covered.selectExpr("key", f"struct(lo + w.first AS start, lo + w.last + {scale.length} AS end) AS run").groupBy("key").agg(F.collect_list("run").alias("runs")), "covered")
    discard(met)
    return covered


def merged(runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal ranges that a list column's runs cover."""
    row = np.repeat(np.arange(len(runs)), np.diff(np.asarray(runs.offsets)))
    flat = runs.flatten()
    start, end = np.asarray(flat.field("start")), np.asarray(flat.field("end"))
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    apart = np.int64(1) << 40  # texts lie so far from one another that ranges of two never meet
    reach = np.maximum.accumulate(end + row * apart)
    new = np.flatnonzero(np.concatenate(([True], (start + row * apart)[1:] > reach[:-1])))
    return row[new], start[new], reach[np.concatenate((new[1:], [len(row)])) - 1] - row[new] * apart


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, runs) -> (key, spans, kept_sha256, kept)."""
    for b in batches:
        row, start, end = merged(b.column("runs"))
        edge = np.searchsorted(row, np.arange(b.num_rows + 1))
        kept = []
        for k, text in enumerate(b.column("text")):
            text, spans = text.as_py(), slice(int(edge[k]), int(edge[k + 1]))
            kept.append(b"".join(text[a:z] for a, z in zip([0, *end[spans].tolist()], [*start[spans].tolist(), len(text)], strict=True)))
        spans = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"]))
        yield pa.RecordBatch.from_arrays([b.column("key"), spans, pa.array([sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())], ["key", "spans", "kept_sha256", "kept"])


def _without_text(clean):
    return lambda batches: (b.drop_columns(["kept"]) for b in clean(batches))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, runs) -> (key, total): how many symbols the runs cover."""
    for b in batches:
        row, start, end = merged(b.column("runs"))
        total = np.bincount(row, weights=end - start, minlength=b.num_rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(total)], ["key", "total"])


SPANS = "array<struct<start:bigint,end:bigint>>"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, part_rows: int = 20_000, passage_words: int | None = None, keep_text: bool = False) -> DataFrame:
    """One row (id_col, n_bytes, spans, sha256, kept_sha256) per row of docs: removed byte ranges of the
    input, SHA-256 of the whole text and of what is left. passage_words: also passage_words, how many of
    the text's words lie in passages of so many words that occur again, long enough in bytes or not (they
    are reported, not removed). keep_text: also kept, the bytes that are left."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256))
    key = F.substring(F.unhex("sha"), 1, 16)
    name, path = f"texts_{uuid.uuid4().hex}", fresh_path(spark, "texts")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = min(length, 2 * passage_words - 1) if passage_words else length
    distinct = rows.where(F.octet_length("text") >= least).select(key.alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    try:
        distinct.write.bucketBy(buckets, "key").option("path", path).format("parquet").saveAsTable(name)
        texts = spark.table(name)
        found = texts.join(repeated(texts, strings(length), part_rows).hint("shuffle_hash"), "key").select("key", "text", "runs")
        kept = ", kept binary" if keep_text else ""
        done = cut(found.mapInArrow(_cleaned if keep_text else _without_text(_cleaned), f"key binary, spans {SPANS}, kept_sha256 string{kept}"), "cleaned")
        if passage_words:
            words = repeated(texts, passages(passage_words), part_rows).mapInArrow(_totals, "key binary, total bigint")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)
    light = rows.select("id", F.octet_length("text").cast("bigint").alias("n_bytes"), "sha", key.alias("key"), *(["text"] if keep_text else []))
    made = light.join(done, "key", "left")
    columns = [F.col("id").alias(id_col), "n_bytes", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.col("sha").alias("sha256"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    if passage_words:
        made = made.join(words, "key", "left")
        columns.append(F.coalesce("total", F.lit(0)).cast("bigint").alias("passage_words"))
    return made.select(*columns, *([F.coalesce("kept", "text").alias("kept")] if keep_text else []))
