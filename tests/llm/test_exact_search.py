"""Exact top-k search against plain loops: hot vectors, near copies, ties, awkward rows."""

import math
import random

import numpy as np
import pytest

from scanloom.llm import exact_top_k, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int, row int, v string, qid int"


def rows_with(vectors):
    return [(i, v, 1, 7, "x", 9) for i, v in vectors]


def some(seed=3):
    rng = random.Random(seed)
    vec = lambda: [rng.gauss(0, 0.13) for _ in range(12)]
    hot = vec()
    out = [(i, vec()) for i in range(400)] + [(1000 + i, hot) for i in range(250)]
    out += [(2000 + i, [x + rng.random() * 1e-3 for x in hot]) for i in range(200)]
    out += [(3000, None), (3001, [0.1, None] + [0.0] * 10), (3050, [math.nan] * 12), (3100, [math.inf] * 12), (3150, [0.5]), (3200, [0.0] * 12), (3250, [])]
    return out + [(50, vec()), (100, out[100][1]), (None, hot), (None, vec())]


def slow(vectors, every=50, k=5, scale=256):
    whole = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in vectors if v and len(v) == 12 and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(whole):
        if i is not None and i % every == 0:
            scored = [(-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0) for m, (j, v) in enumerate(whole) if m != n]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [{}, {"bits": 1}, {"bits": 3, "block_rows": 50, "query_rows": 4}, {"k": 40}])
def test_against_all_pairs(spark, how):
    got = exact_top_k.search(spark.createDataFrame(rows_with(some()), SCHEMA).repartition(5), **how)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == slow(some(), k=how.get("k", 5))


def test_few_and_none(spark):
    few = [(0, [1.0] * 12), (7, [0.5] * 12)]
    assert sorted(map(tuple, exact_top_k.search(spark.createDataFrame(rows_with(few), SCHEMA)).collect())) == [(0, 1, 7, 12 * 256 * 128)]
    assert exact_top_k.search(spark.createDataFrame([], SCHEMA)).collect() == []
    assert exact_top_k.search(spark.createDataFrame(rows_with([(3, [1.0] * 12)]), SCHEMA)).collect() == []
    assert exact_top_k.search(spark.createDataFrame(rows_with([(0, [1.0] * 12)]), SCHEMA)).collect() == []


def test_bounds_enclose_scores():
    rng = np.random.default_rng(5)
    for wide in (300, 1 << 26):
        x, q = rng.integers(-wide, wide, (200, 16)), rng.integers(-wide, wide, (9, 16))
        low = x.min(0)
        for bits in (1, 4, 8):
            width = np.maximum(1, -(-(x.max(0) - low + 1) // (1 << bits)))
            b, code, exact = exact_top_k.Bounds(q, low, width), (x - low) // width, x @ q.T
            assert code.max() < 1 << bits and (b.lower(code) <= exact).all() and (exact <= b.upper(code)).all()


def test_reads_until_certain():
    upper, score, read = np.array([9.0, 8, 7, 6, *[1.0] * 200]), np.array([5, 8, 7, 2, *[1] * 200]), []
    got, scores = exact_top_k.certain(upper, lambda i: read.extend(i.tolist()) or score[i], np.ones(204, int), 3)
    assert sorted(scores.tolist()) == [5, 7, 8] and set(got.tolist()) == {0, 1, 2} and len(read) < 204


def test_registered(spark, tmp_path):
    vectors = some(8)
    spark.createDataFrame(rows_with(vectors), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.queries()["op12_exact_top_k"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == slow(vectors)
