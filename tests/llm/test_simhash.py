import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scanloom.llm import simhash
from scanloom.llm.shared import components

from .helpers import awkward, documents, jaccard


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", "  ", "A", "a B", "a b c", "x " * 700, "İ K é A\x1cb\x85c"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def slow_classes(ids, prints, budget=2):
    n = len(ids)
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [min((x for x, r in zip(ids, root) if r == root[i] and x is not None), default=None) for i in range(n)]


@pytest.mark.parametrize("clash", [False, True])
def test_near_duplicates(spark, clash):
    rows = awkward()
    got = simhash.near_duplicates(documents(spark, rows, clash)).collect()
    prints = [slow_fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], slow_classes([r[0] for r in rows], prints)), key=repr)
    assert sorted(map(tuple, got), key=repr) == want


def test_trie_links_are_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.uint64(1) << np.uint64(b) for b in rng.integers(0, 64, 200)]
    fps = np.unique(np.concatenate([base, [base[i % 40] ^ f for i, f in enumerate(flips)], [base[i % 40] ^ f ^ flips[i - 1] for i, f in enumerate(flips)]]).astype(np.uint64))
    for most in (8, 1 << 18):
        got = {tuple(sorted(p)) for i, j in simhash.trie_links(fps, 2, most=most) for p in zip(i.tolist(), j.tolist())}
        assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2}


def test_links_across_subtrees(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(1 << 63), base ^ np.uint64((1 << 62) | 1)]))
    prints = spark.createDataFrame([(i, int(x)) for i, x in enumerate(fps.view(np.int64))], "id bigint, fp bigint")
    for leaf in (1, 3, 1000):
        links = simhash.near_links(prints.select("fp"), 2, leaf)
        got = {r.node: r.root for r in components(links).collect()}
        signed = fps.view(np.int64).tolist()
        near = {(a, b) for a in range(len(fps)) for b in range(a) if int(fps[a] ^ fps[b]).bit_count() <= 2}
        for a, b in near:
            assert got[signed[a]] == got[signed[b]]


def test_turned(spark):
    v = 0x8123456789ABCDEF - (1 << 64)
    made = spark.createDataFrame([(v,)], "v bigint").select(simhash.turned(F.col("v"), 0, 4).alias("a"), simhash.turned(F.col("v"), 16, 8).alias("b"), simhash.turned(F.col("v"), 60, 1).alias("c")).first()
    assert [f"{x % (1 << 64):016x}" for x in made] == ["123456789abcdef8", "8123" + "6789abcdef45", "8123456789abcdef"]


def test_dense_fingerprints_are_all_linked(spark):
    """A third of all fingerprints share their upper half; in the middle a chain of single bits."""
    rng = np.random.default_rng(8)
    dense = (np.uint64(0xABCD123456789012) & ~np.uint64((1 << 32) - 1)) | rng.integers(0, 1 << 32, 400, dtype=np.uint64)
    chain = np.cumsum(np.uint64(1) << rng.permutation(60).astype(np.uint64))
    fps = np.unique(np.concatenate([dense, dense[:80] ^ np.uint64(5), dense[80:160] ^ np.uint64(1 << 63), chain, rng.integers(0, 1 << 63, 700, dtype=np.uint64)]))
    prints = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    got = {r.node: r.root for r in components(simhash.near_links(prints, 2, leaf=20)).collect()}
    root = simhash.forest(len(fps), simhash.trie_links(fps, 2))
    want = {}
    for x, r in zip(fps.view(np.int64).tolist(), root.tolist(), strict=True):
        want.setdefault(r, set()).add(x)
    mine = {}
    for x in fps.view(np.int64).tolist():
        mine.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values())) and max(map(len, mine.values())) >= 60


def test_keep_one(spark):
    rows = awkward()
    kept = simhash.keep_one(documents(spark, rows, True)).collect()
    classes = slow_classes(list(range(len(rows))), [slow_fingerprint(r[1]) for r in rows])
    assert len(kept) == len(set(classes)) and len(kept[0]) == 20
    ids = [r.doc_id for r in kept]
    assert 2000 not in ids and 2001 not in ids and ids.count(None) == 1


def test_stage_drops_near_copies(spark):
    import corpus_pipeline

    def changed(k, n, steps):
        """Text k of n own words with so many of them changed, far apart."""
        w = [f"w{k}x{i}" for i in range(n)]
        for i in range(steps):
            w[10 + 12 * i] = "other"
        return " ".join(w)

    rows, kept = [], []
    for k, (n, steps) in enumerate([(300, 1), (330, 2), (200, 2), (200, 3), (194, 4), (184, 4), (180, 4), (150, 4), (400, 20)]):
        a, b = changed(k, n, 0), changed(k, n, steps)
        rows += [(2 * k, a, "en", "s", 1), (2 * k + 1, b, "en", "s", 1)]
        near = (n - 4 - 5 * steps) / (n - 4 + 5 * steps)
        assert jaccard(a, b) == near
        kept += [2 * k] + [2 * k + 1] * (near < 0.8)
    assert {17, 15} <= set(kept) and not {1, 3, 5, 7, 9, 11} & set(kept)
    rows += [(500 + i, changed(99, 300, 0) + f" end{i}", "en", "s", 1) for i in range(60)]  # a large group
    rows += [(600, None, "en", "s", 1), (601, " ", "en", "s", 1), (602, "a b", "en", "s", 1), (603, "A  b", "en", "s", 1)]
    got = corpus_pipeline.near_dedup(spark, documents(spark, rows, True), None)
    assert got.columns == documents(spark, [], True).columns
    assert sorted(r.doc_id for r in got.collect()) == sorted([*kept, 500, 600, 602])
    assert corpus_pipeline.near_dedup(spark, documents(spark, []), None).collect() == []


def test_large_buckets_of_several_classes(spark):
    """Forty copies each of three texts that share half of their words with one another."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[:140] + [f"t{k}x{i}" for i in range(60)]) for k in range(3)]
    rows = [(100 * k + i, f"{t} end{i}", "en", "s", 1) for k, t in enumerate(texts) for i in range(40)]
    assert 0.4 < jaccard(texts[0], texts[1]) < 0.8
    assert sorted(r.doc_id for r in simhash.keep_one_similar(documents(spark, rows)).collect()) == [0, 100, 200]


def around_a_passage(rng, n_pairs, passage, own, change):
    """Pairs of near copies that all hold one passage: own words each, `change` of them other in the copy."""
    words, rows = [f"p{i}" for i in range(passage)], []
    for k in range(n_pairs):
        mine = [f"o{k}x{i}" for i in range(own)]
        copy = [*mine[: own - change], *(f"c{k}x{i}" for i in range(change))]
        rows += [" ".join(words + mine), " ".join(words + copy)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", [{}, {"block_texts": 37}])
def test_no_link_is_lost_around_a_shared_passage(spark, how):
    """Pairs from 0.80 to 0.84, all others just below: every class is found, as from all pairs."""
    rng = random.Random(6)
    texts = [t for change, own in ((11, 23), (12, 14), (9, 15), (8, 30)) for t in around_a_passage(rng, 50, 100, own, change)]
    texts += [" ".join([f"p{i}" for i in range(100)] + [f"z{k // 30}y{i}" for i in range(20)] + [f"e{k}"]) for k in range(90)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    links = 0
    for i in range(len(texts)):
        for j in range(i):
            over = len(sets[i] & sets[j])
            if over >= 0.8 * (len(sets[i]) + len(sets[j]) - over):
                links += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = [i for i in range(len(texts)) if find(i) == i]
    assert links > 200 and 20 < len(want) < len(texts) - 100
    got = simhash.keep_one_similar(documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]).repartition(3), **how)
    assert sorted(r.doc_id for r in got.collect()) == want


def test_forest_of_links():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, (6, 80))
    sets = [np.unique(np.concatenate([base[k % 6][rng.random(80) < 0.93], rng.integers(0, 1 << 60, 4), base[5][:20]])) for k in range(90)]
    near = {(i, j) for i in range(90) for j in range(i) if len(o := np.intersect1d(sets[i], sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - len(o))}

    def classes(pairs, n=90):
        root = list(range(n))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    assert 50 < len(near) < 2000
    assert classes(simhash.similar_forest(sets, None, 0.8)) == classes(near)
    across = {(i, j) for i, j in near if (i < 40) != (j < 40)}
    assert classes(simhash.similar_forest(sets[:40], sets[40:], 0.8)) == classes(across)
    assert simhash.similar_forest([np.empty(0, np.uint64)], None, 0.8) == [] and simhash.similar_forest(sets[:1], sets[:1], 0.8) == [(1, 0)]


def test_empty(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
    assert simhash.keep_one(documents(spark, [])).collect() == []


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (5, 4), (4, 5), *((i, i + 1) for i in range(100, 160))], "u bigint, v bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert {k: v for k, v in got.items() if k < 10} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} and all(got[i] == 100 for i in range(100, 161))


def test_stage_takes_links_from_the_trie(spark, monkeypatch):
    """The fingerprints of the texts, each once, go through op1's subtrees; the exact check decides."""
    import corpus_pipeline

    found, search = [], simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda prints, *more: found.append(search(prints, *more)) or found[-1])
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words), " ".join(words[:1992] + ["end"]), " ".join(reversed(words)), " ".join(words)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    bits = [simhash.fingerprint(t.encode()) for t in texts]
    assert 0 < (bits[0] ^ bits[1]).bit_count() <= 2 < (bits[0] ^ bits[2]).bit_count()
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(spark, rows), None).collect()) == [0, 2]
    pair = {int(b) - (int(b) >> 63 << 64) for b in bits[:2]}
    assert {frozenset((r.u, r.v)) for r in found[0].collect()} == {frozenset(pair)}
