"""Repeated strings, licenses, shards, toxicity, the pipeline."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanloom.llm import kd_shards, licenses, suffix_dedup, toxicity

from .helpers import awkward, documents


def slow_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out.append((len(b), sum(cover), sum(1 for i, c in enumerate(cover) if c and (not i or not cover[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("part_rows", [20_000, 1])
def test_repeats(spark, part_rows):
    rng = random.Random(4)
    rnd = lambda n: "".join(rng.choice("abcdef é") for _ in range(n))
    base = [rnd(900) for _ in range(5)]
    texts = []
    for _ in range(60):
        s = ""
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 600)
            s += rnd(rng.randint(0, 30)) + rng.choice(base)[a : a + rng.randint(100, 700)]
        texts.append(s)
    texts += ["a" * 1500, "ab" * 900, rnd(399), base[0][:400], base[0][1:401], "line of text repeated " * 60, None, "", base[1], base[1]]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = suffix_dedup.remove_repeats(documents(spark, rows, True), part_rows=part_rows).collect()
    mine = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in got}
    assert [mine[i] for i in range(len(texts))] == slow_repeats(texts, 400)


def test_repeats_of_other_lengths_and_empty(spark):
    rows = awkward(20)
    got = suffix_dedup.remove_repeats(documents(spark, [(i, *r[1:]) for i, r in enumerate(rows)]), length=120).collect()
    mine = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in got}
    assert [mine[i] for i in range(len(rows))] == slow_repeats([r[1] for r in rows], 120)
    assert suffix_dedup.remove_repeats(documents(spark, [])).collect() == []
    assert len(suffix_dedup.remove_repeats(documents(spark)).collect()) == len(awkward())


def slow_passages(texts, n):
    data = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in data for i in range(len(w) - n + 1))
    out = []
    for w in data:
        cover = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                cover[i : i + n] = [True] * n
        out.append(sum(cover))
    return out


@pytest.mark.parametrize("part_rows", [20_000, 1])
def test_repeated_passages(spark, part_rows):
    rng = random.Random(9)
    rnd = lambda n: [rng.choice("ab cd efg a é of the river 12".split()) + str(rng.randint(0, 9)) for _ in range(n)]
    base = [rnd(200) for _ in range(4)]
    texts = []
    for _ in range(60):
        w = []
        for _ in range(rng.randint(0, 3)):
            a, b = rng.randint(0, 120), rng.choice(base)
            w += rnd(rng.randint(0, 20)) + b[a : a + rng.randint(40, 80)]
        texts.append(" ".join(w))
    texts += ["x " * 130, "x y\t" * 100, " ".join(base[0][:51]), "\n".join(base[0][3:54]), " ".join(base[1][:50]), None, "", " \n", texts[0], texts[0]]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = suffix_dedup.remove_repeats(documents(spark, rows, True), part_rows=part_rows, passage_words=51, keep_text=True).collect()
    assert [r.passage_words for r in sorted(got, key=lambda r: r.doc_id)] == slow_passages(texts, 51)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        edges = [0, *(x for s in r.spans for x in (s.start, s.end)), len(data)]
        assert bytes(r.kept) == b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2])) and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_difference_cover():
    for v in (8, 32, 64):
        d = suffix_dedup.difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v)) and len(d) < v // 2 + 2


def test_shards(spark):
    rows = awkward(400)
    got = kd_shards.shard(documents(spark, rows, True), 8).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == sorted((d if d is not None else -1, size(t), zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_shards_are_near_equal_and_keep_groups(spark):
    rng = random.Random(1)
    rows = [(i, "x%d" % (i // 3) * rng.randint(1, 60), "en", "s", 1) for i in range(6000)]
    got = kd_shards.shard(documents(spark, rows), 8).collect()
    total = Counter()
    for r in got:
        total[r.shard] += r.size
    assert len(total) == 8 and max(total.values()) < 1.03 * min(total.values())
    text = {i: t for i, t, *_ in rows}
    where = {}
    for r in got:
        where.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_shards_split_a_group_that_is_too_large(spark):
    rows = [(i, "the same text" if i % 2 else f"text {i}", "en", "s", 1) for i in range(4000)]
    total = Counter()
    for r in kd_shards.shard(documents(spark, rows), 8).collect():
        total[r.shard] += r.size
    assert len(total) == 8 and max(total.values()) < 1.35 * min(total.values())
    assert kd_shards.shard(documents(spark, []), 8).collect() == []
    assert {r.shard for r in kd_shards.shard(documents(spark, rows[:1]), 8).collect()} <= set(range(8))


def test_licenses(spark):
    rows = [
        (1, "Released under the MIT License.", "en", "a", 1), (2, "Some prose here.\nIt goes on for a while. Licensed under the Apache License, Version 2.0.\nMore.", "en", "a", 1), (3, "plain text of the river to the sea", "en", "a", 1),
        (4, None, None, None, None), (5, "", "de", "b", 0), (6, "All rights reserved", "de", "b", 1), (7, "nothing of the kind", "fr", "c", 1), (None, "x", "en", "a", 1),
    ]
    docs = documents(spark, rows, True)
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    got = {r.doc_id: (r.license, r.origin, r.inherited_from) for r in licenses.scan(docs, path).collect()}
    assert got[1] == ("MIT", "file", None) and got[2] == ("Apache-2.0", "own", None) and got[3] == ("MIT", "inherited", "a/en")
    assert got[4] == (None, "none", None) and got[5] == ("Proprietary", "inherited", "b/de") and got[7] == (None, "none", None) and got[None][1] == "none"
    deep = licenses.scan(docs, F.when(F.col("doc_id") == 6, "b/LICENSE").otherwise(F.concat_ws("/", "source", F.lit("deep/er"), F.col("doc_id").cast("string")))).collect()
    assert {r.doc_id: r.inherited_from for r in deep}[5] == "b"
    assert licenses.scan(documents(spark, []), F.col("source")).collect() == []


def test_license_files_and_ancestors(spark):
    """Whole license texts with a holder filled in, wrapped anew, and cut short; a long text and repeated rows."""
    full = licenses.license_texts()
    mit = full["MIT"].replace("<year>", "2020").replace("<copyright holders>", "A. Person and others")
    rows = [
        (1, mit.replace("\n", " ").replace(" the ", "\nthe "), "top", "LICENSE", 1), (2, full["GPL-3.0"], "top/sub", "COPYING", 1), (3, full["BSD-3-Clause"][200:], "top/sub/deep", "LICENSE.txt", 1),
        (4, "no word of it", "top", "a", 1), (5, "no word of it", "top/sub/other", "b", 1), (6, None, "top/sub/deep/er", "c", 1), (7, "no word of it", "else", "d", 1), (7, "no word of it", "else", "d", 1),
        (8, "the stones and the rivers of it. " * 4000 + "\nLicensed under CC BY 4.0\n", "top", "e", 1), (9, full["Apache-2.0"], "x", "f", 1), (10, full["GPL-3.0"], "x", "g", 1), (11, full["GPL-3.0"], "x", "h", 1), (12, "", "x", "i", 1),
        (13, full["MPL-2.0"], "tie", "j", 1), (14, full["CC0-1.0"], "tie", "k", 1), (15, "?", "tie", "l", 1),
    ]
    got = [(r.doc_id, r.license, r.origin, r.inherited_from) for r in licenses.scan(documents(spark, rows, True), F.concat_ws("/", "lang", "source")).collect()]
    by = {g[0]: g[1:] for g in got}
    assert len(got) == len(rows) and got.count((7, None, "none", None)) == 2
    assert [by[i] for i in (1, 2, 3)] == [("MIT", "file", None), ("GPL-3.0", "file", None), ("BSD-3-Clause", "file", None)]
    assert by[4] == ("MIT", "inherited", "top") and by[5] == ("GPL-3.0", "inherited", "top/sub") and by[6] == ("BSD-3-Clause", "inherited", "top/sub/deep")
    assert by[8][:2] == ("CC-BY-4.0", "own") and by[12] == ("GPL-3.0", "inherited", "x") and by[15] == ("CC0-1.0", "inherited", "tie")


def _toxic(n=240, seed=2):
    rng = random.Random(seed)
    plain = ["stone", "river", "walks", "evening", "green", "letters", "under", "paper", "quiet", "window"]
    bad = ["scumbag", "idiot", "loser", "idiotic", "losers"]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(3, 200))]
        if i % 3 == 0:
            for _ in range(1 + len(w) // 15):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(i % 3 == 0)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = _toxic()
    y = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    docs = documents(spark, [*rows, (9000, None, None, None, None), (9001, "", "en", "s", 1)], True)
    model = toxicity.train(docs, y)
    got = {r.doc_id: r for r in toxicity.with_score(docs, model, out="tox").withColumn("held", toxicity.held_out("doc_id")).collect()}
    assert all(0 <= r.tox <= 1 for r in got.values()) and got[9000].tox == got[9001].tox < 0.5
    held = [(got[i].tox >= 0.5) == bool(t) for i, _, t in labels if got[i].held]
    assert np.mean(held) >= 0.9 and all(got[i].held == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in labels)


def test_toxicity_reads_no_held_out_label_and_survives_without_any(spark):
    rows, labels = _toxic(60)
    kind = "doc_id bigint, quality int, toxic int"
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    scores = [[r.score for r in toxicity.with_score(documents(spark, rows), toxicity.train(documents(spark, rows), spark.createDataFrame(x, kind))).orderBy("doc_id").collect()] for x in (labels, flipped)]
    assert scores[0] == scores[1]
    none = toxicity.train(documents(spark, rows), spark.createDataFrame([], kind))
    assert {r.score for r in toxicity.with_score(documents(spark, rows), none).collect()} == {0.5}
    assert toxicity.with_score(documents(spark, []), none).collect() == []


def test_gradients():
    rng = np.random.default_rng(0)
    m = toxicity.Model.fresh()
    gates = rng.standard_normal((9, 6 * toxicity.HIDDEN)).astype(np.float32)
    ids, mask = rng.integers(0, 9, (toxicity.LENGTH, 4)), (np.arange(toxicity.LENGTH)[:, None] < np.array([32, 5, 1, 20])).astype(np.float32)
    out, kept = m.run(gates, ids, mask, keep=True)
    g, d_gates = m.back(np.ones(4, np.float32), kept, ids, mask)
    for name, at in (("zr0", (1, 2)), ("n1", (3, 4)), ("v", (5,)), ("w", (6,))):
        old, eps = m.p[name][at], 1e-2
        m.p[name][at] = old + eps
        high = m.run(gates, ids, mask)[0].sum()
        m.p[name][at] = old - eps
        low = m.run(gates, ids, mask)[0].sum()
        m.p[name][at] = old
        assert abs((high - low) / (2 * eps) - g[name][at]) < 2e-2 * max(1, abs(g[name][at]))
    x = gates.copy()
    x[3, 7] += 1e-2
    y = gates.copy()
    y[3, 7] -= 1e-2
    slope = (m.run(x, ids, mask)[0].sum() - m.run(y, ids, mask)[0].sum()) / 2e-2
    assert abs(slope - d_gates[ids == 3][:, 7].sum()) < 2e-2 * max(1, abs(slope))


def test_scores_against_plain_loops():
    m, h = toxicity.Model.fresh(), toxicity.HIDDEN
    m.calibration = (1.3, -0.2, 0.4)
    rng = random.Random(6)
    docs = [[rng.choice([b"a", b"river", b"stone", "\u00e9t\u00e9".encode(), b"x1"]) for _ in range(n)] for n in (1, 5, 32, 33, 47, 48, 49, 200)]
    s = lambda x: 1 / (1 + np.exp(-x))

    def one(words):
        x, _ = m.inputs(pa.array(words, pa.binary()))
        gates, states = x[: len(words)].astype(float) @ m.p["in"] + m.p["bias"], []
        for d in (0, 1):
            state, out = np.zeros(h), []
            for g in gates[:, 3 * h * d : 3 * h * (d + 1)][:: -1 if d else 1]:
                zr = s(g[: 2 * h] + state @ m.p[f"zr{d}"])
                c = np.tanh(g[2 * h :] + zr[h:] * (state @ m.p[f"n{d}"]))
                state = (1 - zr[:h]) * c + zr[:h] * state
                out.append(state)
            states.append(out[:: -1 if d else 1])
        both = np.concatenate(states, 1)
        e = np.exp(both @ m.p["v"])
        return (e / e.sum()) @ both @ m.p["w"] + m.p["b"][0]

    for words, got in zip(docs, m.scores(docs), strict=True):
        at = toxicity.windows(len(words))
        assert set(range(len(words))) == {k for a in at for k in range(a, min(a + toxicity.LENGTH, len(words)))}
        worst = max(one(words[a : a + toxicity.LENGTH]) for a in at)
        assert abs(got - s(1.3 * worst - 0.2 * np.log(len(at)) + 0.4)) < 1e-4


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        from scanloom.llm.shared import cut

        docs = cut(stage(spark, docs, d), name)
        if name != "bpe":
            assert docs.columns == columns and docs.count() <= n
        n = docs.count()
    assert n > 50 and docs.where("n_tokens = 0").count() <= 1


@pytest.mark.parametrize("rows", [[], [(1, 1), (2, 1), (3, 1)], [(1, 0)]])
def test_drop_toxic_keeps_all_without_both_classes(spark, tmp_path, rows):
    import corpus_pipeline

    spark.createDataFrame(rows, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark)
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()
