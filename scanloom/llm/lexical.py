"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

Terms are runs of letters, digits and non-ASCII characters with A-Z in lower case. A document's score
for an item sums, over the item's distinct terms, weight * ((1000000000 * tf) div (1000 * tf + 8 * m))
in 64-bit integers: the weight is floor(1000 * ln((2 N + 2) / (2 df + 1))) and m = 10 + (90 n N) div L,
with N documents that have terms, L terms in all, n terms of the document.

The documents are read once for a block of items. Every task writes segments of an inverted index:
postings of the items' terms, of bounded number, documents in order, and the counts that N, L and df
are summed from. Segments are then ranked where they are read. For an item the short lists of a segment
are taken term at a time into summed accumulators; these are one sorted iterator with a largest score,
beside the long lists with theirs. Documents are taken in order, a run of them at a time: lists whose
largest scores together stay below the item's kth best so far cannot bring a document in and are only
looked up for the documents that others bring, as long as what is missing can still matter. The kth best
goes on from segment to segment of a task; a task returns k rows an item, which one window merges.

Items reach the tasks in blocks of about `block_bytes` of terms, so no block's size depends on the
number of items; each block is one more pass. Null and empty texts have no terms: such items have no
rows, such documents are never found. Equal scores go by ascending doc_id (null ids last). Repeated
documents are found each; a repeated item has a ranking each. Documents that score 0 are not returned.
Other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_map import MOST_BYTES, with_columns
from .decontaminate import words_of
from .multi_index import NO_ID
from .shared import cut, discard

INDEX = "n_docs bigint, n_terms bigint, terms array<int>, counts array<int>, doc_ids binary, lengths binary, docs binary, tfs binary"
RANKED = "item bigint, item_id bigint, doc_id bigint, score bigint"


@dataclass
class Segment:
    """Postings of the known terms in some documents, in the order in which these come."""

    vocabulary: dict[bytes, int]
    n_docs: int = 0
    n_terms: int = 0
    ids: array = field(default_factory=lambda: array("q"))
    lengths: array = field(default_factory=lambda: array("q"))
    docs: array = field(default_factory=lambda: array("i"))
    terms: array = field(default_factory=lambda: array("i"))
    tfs: array = field(default_factory=lambda: array("i"))

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        words = words_of(text)
        if not words:
            return
        self.n_docs, self.n_terms = self.n_docs + 1, self.n_terms + len(words)
        counts = Counter(words)
        some = counts.keys() & self.vocabulary.keys()
        if some:
            self.docs.extend([len(self.ids)] * len(some))
            self.terms.extend([self.vocabulary[w] for w in some])
            self.tfs.extend([counts[w] for w in some])
            self.ids.append(NO_ID if doc_id is None else doc_id)
            self.lengths.append(len(words))

    def batch(self) -> pa.RecordBatch:
        terms, docs, tfs = (np.frombuffer(a, np.int32) for a in (self.terms, self.docs, self.tfs))
        order = np.argsort(terms, kind="stable")
        own, counts = np.unique(terms, return_counts=True)
        row = {
            "n_docs": self.n_docs, "n_terms": self.n_terms, "terms": own.tolist(), "counts": counts.tolist(), "doc_ids": self.ids.tobytes(),
            "lengths": self.lengths.tobytes(), "docs": docs[order].tobytes(), "tfs": tfs[order].tobytes(),
        }
        kinds = [pa.int64()] * 2 + [pa.list_(pa.int32())] * 2 + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], list(row))


def index(docs: DataFrame, vocabulary, most_postings: int) -> DataFrame:
    """Segments (INDEX) of docs (doc_id, text) for a broadcast vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        now = Segment(known)
        for whole in batches:
            step = max(1, whole.num_rows * MOST_BYTES // max(whole.nbytes, 1))
            for first in range(0, whole.num_rows, step):
                some = whole.slice(first, step)
                for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").cast(pa.binary()), strict=True):
                    now.add(doc_id, text.as_py())
                    if len(now.docs) >= most_postings:
                        yield now.batch()
                        now = Segment(known)
        if now.n_docs:
            yield now.batch()

    return docs.mapInArrow(run, INDEX)


class Best:
    """The k best (score, id) so far: highest score first, equal ones by id."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """The score that a document must reach."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


Postings = tuple[np.ndarray, np.ndarray, int]


def accumulate(short: list[Postings]) -> Postings:
    """Term at a time: short lists as one of summed scores."""
    docs, at = np.unique(np.concatenate([d for d, _, _ in short]), return_inverse=True)
    scores = np.zeros(len(docs), np.int64)
    np.add.at(scores, at, np.concatenate([s for _, s, _ in short]))
    return docs, scores, int(scores.max())


def hybrid(lists: list[Postings], ids: np.ndarray, best: Best, short: int, run: int = 8_192) -> None:
    """Brings the documents of a segment into best. Lists of up to `short` postings become accumulators."""
    few = [x for x in lists if len(x[0]) <= short]
    lists = [x for x in lists if len(x[0]) > short] + ([accumulate(few)] if few else [])
    lists.sort(key=lambda x: x[2])
    reach = np.cumsum([x[2] for x in lists])
    at, step = 0, min(256, run)
    while True:
        least = best.least
        leading = int(np.searchsorted(reach, least, "left"))  # those before stay below `least` even together
        if leading == len(lists):
            return
        heads = [(docs, scores, int(np.searchsorted(docs, at))) for docs, scores, _ in lists[leading:]]
        heads = [h for h in heads if h[2] < len(h[0])]
        if not heads:
            return
        at = min(int(docs[p]) for docs, _, p in heads)  # skips what no leading list has
        end = min(at + step, len(ids))
        sums, met = np.zeros(end - at, np.int64), np.zeros(end - at, bool)
        for docs, scores, p in heads:
            q = p + int(np.searchsorted(docs[p:], end))
            sums[docs[p:q] - at] += scores[p:q]
            met[docs[p:q] - at] = True
        some = np.flatnonzero(met)
        score, some = sums[some], some + at
        for j in range(leading - 1, -1, -1):
            keep = score + reach[j] >= least
            some, score = some[keep], score[keep]
            if not len(some):
                break
            docs, scores, _ = lists[j]
            p = np.minimum(np.searchsorted(docs, some), len(docs) - 1)
            score = score + np.where(docs[p] == some, scores[p], 0)
        keep = score >= least
        if keep.any():
            best.add(score[keep], ids[some[keep]])
        at, step = end, min(2 * step, run)


def lists_of(row: dict, weights: np.ndarray, n: int, total: int) -> tuple[dict[int, Postings], np.ndarray]:
    """The scored lists of a segment by term, and its documents' ids."""
    lengths = np.frombuffer(row["lengths"], np.int64)
    if len(lengths) and int(lengths.max()) * 90 * n < 1 << 63:
        m = 10 + 90 * lengths * n // max(total, 1)
    else:
        m = np.array([10 + 90 * x * n // max(total, 1) for x in lengths.tolist()], np.int64)
    docs, tf = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int32).astype(np.int64)
    terms, counts = np.array(row["terms"], np.int64), np.array(row["counts"], np.int64)
    scores = np.repeat(weights[terms], counts) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]))
    ends = np.cumsum(counts)
    made = {}
    for t, a, b in zip(terms.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
        if weights[t] > 0:
            made[t] = (docs[a:b], scores[a:b], int(scores[a:b].max()))
    return made, np.frombuffer(row["doc_ids"], np.int64)


def ranked(segments: DataFrame, query, k: int) -> DataFrame:
    """RANKED rows of the segments, k an item and task at most; query: broadcast (items, weights, N, L)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n, total = query.value
        best = [Best(k) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                lists, ids = lists_of(batch.slice(i, 1).to_pylist()[0], weights, n, total)
                for (_, _, terms), own in zip(items, best, strict=True):
                    if met := [lists[t] for t in terms if t in lists]:
                        hybrid(met, ids, own, max(16, len(ids) // 64))
        out = [(item, item_id, b) for (item, item_id, _), b in zip(items, best, strict=True) if len(b.ids)]
        if out:
            n_each = [len(b.ids) for *_, b in out]
            columns = [np.repeat([o[0] for o in out], n_each), [o[1] for o, m in zip(out, n_each, strict=True) for _ in range(m)]]
            columns += [np.concatenate([b.ids for *_, b in out]), np.concatenate([b.scores for *_, b in out])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "item_id", "doc_id", "score"])

    return segments.mapInArrow(run, RANKED)


def items_of(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, terms) of the items that have terms, as a table: distinct terms, sorted."""

    def start():
        return lambda texts: [pa.array([sorted(set(words_of(t.as_py()))) for t in texts.cast(pa.binary())], pa.list_(pa.binary()))]

    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text"))
    return cut(with_columns(rows, "text", [("terms", "array<binary>")], start).drop("text").where(F.size("terms") > 0), "items")


def search(
    docs: DataFrame, benchmark: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_bytes: int = 8 << 20, most_postings: int = 1 << 19,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    spark = docs.sparkSession
    items = items_of(benchmark, item_id, item_text)
    size = items.agg(F.sum(F.aggregate("terms", F.lit(0).cast("bigint"), lambda a, t: a + F.length(t) + 24))).first()[0]
    blocks = max(1, -(-(size or 0) // block_bytes))
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = spark.createDataFrame([], RANKED)
    for block in range(blocks):
        asked = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        if not asked:
            continue
        vocabulary = {bytes(t): i for i, t in enumerate(sorted({bytes(t) for r in asked for t in r.terms}))}
        known = spark.sparkContext.broadcast(vocabulary)
        segments = cut(index(texts, known, most_postings), "segments")
        n, total = segments.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        weights = np.zeros(len(vocabulary), np.int64)
        held = segments.select(F.explode(F.arrays_zip("terms", "counts")).alias("e")).groupBy("e.terms").agg(F.sum("e.counts").alias("df"))
        for r in held.collect():  # at most a row a term of the block
            weights[r.terms] = math.floor(1000 * math.log((2 * n + 2) / (2 * r.df + 1)))
        query = spark.sparkContext.broadcast(([(r.item, r.item_id, [vocabulary[bytes(t)] for t in r.terms]) for r in asked], weights, n or 0, total or 0))
        found = found.union(cut(ranked(segments, query, k), "ranked"))
        discard(segments)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")
