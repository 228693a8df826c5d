"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of 13 consecutive words of every benchmark item (an item of fewer words,
but not none, is one window). They are searched by length: a table of two-word blocks says how far
the window may move on, a block that ends some pattern selects its bucket by the suffix and then by
the first block, and the words themselves confirm an occurrence.

Benchmark items reach the tasks in blocks of at most `block_bytes` of text; a benchmark above one
block is searched block after block, the documents between two blocks being a table in the shared
folder, so no block's size depends on the benchmark's.

Null and empty texts have no words and are clean. A null item_id marks hits but is not listed; items
with equal ids count once. Repeated documents stay. Other columns of docs pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_map import with_columns
from .shared import cut, free_name
from .suffix_dedup import merged

#: A-Z become a-z; every other ASCII character that is no digit or lower-case letter parts words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


class WuManber:
    """Patterns of one length: word windows, each kept once with the items that have it."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.windows: dict[tuple, set[int]] = {}
        self.buckets: dict[tuple, dict[tuple, list[tuple]]] = defaultdict(lambda: defaultdict(list))

    def add(self, item: int, window: tuple) -> None:
        held = self.windows.setdefault(window, set())
        held.add(item)
        if len(held) > 1:
            return
        n, b = self.length, self.block
        for at in range(n - b + 1):
            key, left = window[at : at + b], n - b - at
            if left < self.shift.get(key, self.far):
                self.shift[key] = left
        self.buckets[window[n - b :]][window[:b]].append(window)

    def find(self, words: list[bytes]) -> Iterable[tuple[int, set[int]]]:
        """(start, items) of every occurrence."""
        n, b, far, shift, buckets = self.length, self.block, self.far, self.shift, self.buckets
        end, total = n, len(words)
        while end <= total:
            key = (words[end - 2], words[end - 1]) if b == 2 else (words[end - 1],)
            move = shift.get(key, far)
            if move:
                end += move
                continue
            start = end - n
            for window in buckets[key].get(tuple(words[start : start + b]), ()):
                if tuple(words[start:end]) == window:
                    yield start, self.windows[window]
            end += 1


def matchers(texts: list[bytes | None], window: int) -> list[WuManber]:
    """One matcher for each pattern length."""
    made: dict[int, WuManber] = {}
    for i, w in enumerate(map(words_of, texts)):
        if w:
            n = min(window, len(w))
            m = made.setdefault(n, WuManber(n))
            for s in range(len(w) - n + 1):
                m.add(i, tuple(w[s : s + n]))
    return list(made.values())


def search(words: list[bytes], found: list[WuManber]) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged spans of hit words [start, end) and the items that occur."""
    spans, items = [], set()
    for m in found:
        for start, held in m.find(words):
            items |= held
            spans.append((start, start + m.length))
    merged: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged, items


SPANS = "array<struct<start:int,end:int>>"


def overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_bytes: int = 4 << 20) -> DataFrame:
    """docs with n_words, hit_spans (word positions) and hit_items (distinct ids as strings), under
    these names or the next free ones; see columns_of()."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    names = columns_of(docs)
    for k in range(blocks):
        some = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast([(r.id, None if r.text is None else bytes(r.text)) for r in some.collect()])

        def start(shared=shared):
            known = shared.value
            found = matchers([t for _, t in known], window)

            def make(texts: pa.Array) -> list[pa.Array]:
                n, spans, ids = [], [], []
                for t in texts.cast(pa.binary()):
                    w = words_of(t.as_py())
                    s, i = search(w, found)
                    n.append(len(w))
                    spans.append([{"start": a, "end": b} for a, b in s])
                    ids.append(sorted({known[x][0] for x in i} - {None}))
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                return [pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(ids, pa.list_(pa.string()))]

            return make

        if k == 0:
            docs = with_columns(docs, text_col, list(zip(names, ("bigint", SPANS, "array<string>"), strict=True)), start)
            continue
        more = [free_name(docs, x) for x in ("more_words", "more_spans", "more_items")]
        docs = with_columns(cut(docs, "decontaminate"), text_col, list(zip(more, ("bigint", SPANS, "array<string>"), strict=True)), start)
        docs = docs.withColumn(more[1], F.concat(names[1], more[1])).withColumn(names[2], F.array_sort(F.array_union(names[2], more[2]))).drop(names[1], more[0], more[2])
        docs = with_columns(docs, more[1], [(names[1], SPANS)], lambda: _merged).drop(more[1])
    return docs


def _merged(spans: pa.Array) -> list[pa.Array]:
    """Lists of spans with those that touch made one."""
    row, start, end = merged(spans)
    edge = np.searchsorted(row, np.arange(len(spans) + 1)).astype(np.int32)
    both = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["start", "end"])
    return [pa.ListArray.from_arrays(pa.array(edge), both)]


def columns_of(docs: DataFrame) -> tuple[str, str, str]:
    return tuple(free_name(docs, x) for x in ("n_words", "hit_spans", "hit_items"))


def n_hit(spans: str):
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda acc, x: acc + (x.end - x.start))


def contaminated(words: str, spans: str):
    return (n_hit(spans) > 0) & (20 * n_hit(spans) >= F.col(words))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """docs without those of which a twentieth of the words or more lie in benchmark windows."""
    words, spans, items = columns_of(docs)
    return overlaps(docs, benchmark, **kw).where(~contaminated(words, spans)).drop(words, spans, items)
