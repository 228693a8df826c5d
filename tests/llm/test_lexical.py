"""Lexical search against plain loops: many copies, ties, frequent terms, several segments and blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from scanloom.llm import lexical, queries

from .helpers import SCHEMA, awkward

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id bigint, text string, doc_id int, score int, rank string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def slow(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total, df = len(held), sum(x[2] for x in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in held:
            m = 100 - 90 + ((90 * size * n) // total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    text = lambda n: " ".join(words[min(int(rng.expovariate(0.05)), 119)] for _ in range(n))
    rows = [(i, text(rng.randint(1, 60)), "en", "s", 1) for i in range(700)]
    rows += [(5000 + i, "w3 w9 Éa w9 the same text W90", "en", "hot", 1) for i in range(400)]
    rows += [(8000 + i, "W0," * (i + 1), "en", "s", 1) for i in range(5)]
    return rows + awkward(20)


ASKED = [(1, "w3 w9 w90 éa Éa"), (2, "w0"), (3, "w0 w1 w2 w3 w4 w119 w118 stone river 42"), (4, None), (5, " .,"), (6, "unknownword"), (3, "W118-w117"), (None, "日本 naïve x-y")]
ASKED += [(10 + i, f"w{i} w{(i * 7) % 120} w{(i * i) % 120} w{i + 1}") for i in range(12)]


@pytest.mark.parametrize("how", [{}, {"most_postings": 150}, {"block_bytes": 200}, {"k": 3}])
def test_against_loops(spark, how):
    docs = spark.createDataFrame(corpus(), SCHEMA).withColumns({"item_id": queries.F.lit(1), "terms": queries.F.lit("x")}).repartition(5)
    asked = spark.createDataFrame([(*r, 1, 2, "z") for r in ASKED], ITEMS).repartition(2)
    got = lexical.search(docs, asked, **how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == slow([(r[0], r[1]) for r in corpus()], ASKED, how.get("k", 10))


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(corpus(), SCHEMA), spark.createDataFrame([], ITEMS)
    assert lexical.search(docs, none).collect() == []
    assert lexical.search(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(*r, 1, 2, "z") for r in ASKED], ITEMS)).collect() == []


@pytest.mark.parametrize("short", [0, 5, 40, 1000])
def test_hybrid_keeps_what_all_lists_give(short):
    rng = np.random.default_rng(short)
    for _ in range(30):
        n = 300
        lists = [(np.sort(rng.choice(n, m, replace=False)).astype(np.int32), rng.integers(1, 50, m)) for m in rng.integers(1, n, 6)]
        total = np.zeros(n, np.int64)
        for d, s in lists:
            total[d] += s
        ids = rng.permutation(n)
        best = lexical.Best(7)
        lexical.hybrid([(d, s, int(s.max())) for d, s in lists], ids, best, short, run=16)
        want = [i for i in np.lexsort((ids, -total)) if total[i] > 0][:7]
        assert best.ids.tolist() == ids[want].tolist() and best.scores.tolist() == total[want].tolist()


def test_registered(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*r, 1, 2, "z") for r in ASKED], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.queries()["op11_ranked_search"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == slow([(r[0], r[1]) for r in corpus()], ASKED)
