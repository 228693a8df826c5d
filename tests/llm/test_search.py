"""Decontamination, nearest neighbours, archives, tokens."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import bpe, decontaminate, multi_index, warc
from scanloom.llm.queries import vocabulary_path

from .helpers import awkward, documents

BENCH = [(1, "the of to Stone river Été 42 x-y the of to Stone river the of"), (2, "word"), (3, None), (4, "..."), (None, "river river stone"), (5, "日本 naïve the")]


@pytest.mark.parametrize("block_bytes", [1 << 22, 40])
def test_overlaps(spark, block_bytes):
    rows = awkward()
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    names = decontaminate.columns_of(documents(spark, rows, True))
    got = decontaminate.overlaps(documents(spark, rows, True), bench, block_bytes=block_bytes).collect()
    windows = {}
    for i, t in BENCH:
        w = decontaminate.words_of(t.encode() if t else None)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    want = []
    for d, t, *_ in rows:
        w = decontaminate.words_of(t.encode() if t else None)
        hit, items = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit[s : s + n] = [True] * n
                    items |= found
        want.append((d, len(w), sum(hit), sorted(str(x) for x in items if x is not None)))
    mine = [(r.doc_id, r[names[0]], sum(s.end - s.start for s in r[names[1]]), list(r[names[2]])) for r in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr)


def test_drop_contaminated(spark):
    bench = spark.createDataFrame(BENCH[:1], "item_id bigint, text string")
    text = BENCH[0][1]
    rows = [(1, text, "en", "s", 1), (2, "clean " * 50, "en", "s", 1), (3, "clean " * 400 + text, "en", "s", 1), (4, None, None, None, None)]
    kept = decontaminate.drop_contaminated(documents(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.columns == documents(spark).columns
    assert decontaminate.drop_contaminated(documents(spark, rows), bench.limit(0)).count() == 4
    assert decontaminate.drop_contaminated(documents(spark, []), bench).count() == 0


def _vectors(n=700, copies=40):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, 16)).astype(np.float32)
    x[100 : 100 + copies] = x[7]
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(n)]
    return rows + [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [math.nan] * 16, 1), (9004, [None, *[1.0] * 15], 1), (9005, [1.0] * 3, 1), (9006, [math.inf] * 16, 1), (None, [float(v) for v in x[7]], 1)]


def test_nearest_neighbours(spark):
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    df = df.unionByName(df.where("vec_id = 50 OR vec_id = 7")).withColumn("block", F.lit(1)).withColumn("cell", F.lit("x"))
    rows = [*rows, *(r for r in rows if r[0] in (50, 7))]
    exact = multi_index.search(df, every=50, k=10, recall=1.0, block_rows=64, query_rows=5).collect()
    good = [(i, np.asarray(v, float)) for i, v, _ in rows if v is not None and len(v) == 16 and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    want = []
    for own, (q, v) in enumerate(good):
        if q is not None and q % 50 == 0:
            d = sorted((float(np.sqrt(((v - u) ** 2).sum())), math.inf if i is None else i) for k, (i, u) in enumerate(good) if k != own)[:10]
            want += [(q, n + 1, i, round(s, 9)) for n, (s, i) in enumerate(d)]
    mine = [(r.query_id, r["rank"], math.inf if r.vec_id is None else r.vec_id, round(r.score, 9)) for r in exact]
    assert sorted(mine) == sorted(want)
    single = spark.createDataFrame([(i, [float(i % 9) + 1]) for i in range(30)], "vec_id bigint, embedding array<double>")
    assert multi_index.search(single, every=10, k=3, recall=1.0).count() == 9
    wide = multi_index.search(df, every=50, k=10, block_rows=64, query_rows=5).collect()
    found = {(r.query_id, r.vec_id) for r in wide}
    assert len(wide) == len(want) and len(found & {(q, None if i == math.inf else i) for q, _, i, _ in want}) >= 0.9 * len({(q, i) for q, _, i, _ in want})
    assert not {9001, 9002, 9003, 9004, 9005, 9006} & {r.vec_id for r in exact}


def test_few_and_no_vectors(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    assert multi_index.search(spark.createDataFrame([], kind)).collect() == []
    few = multi_index.search(spark.createDataFrame(_vectors(120, 0)[:5], kind), every=1, k=10).collect()
    assert len(few) == 20


def test_cells_are_visited_nearest_first():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 8))
    index = multi_index.MultiIndex(multi_index.k_means(x[:, :4], 6), multi_index.k_means(x[:, 4:], 6), np.ones(36, np.int64))
    q = rng.standard_normal(8)
    cost = [((index.left[c // 6] - q[:4]) ** 2).sum() + ((index.right[c % 6] - q[4:]) ** 2).sum() for c in index.visit(q)]
    assert len(cost) == 36 and cost == sorted(cost)


PAGES = [(i, f"http://h/{i}\r\nx", "payload %d " % (i % 7) * (1 + i % 90)) for i in range(200)] + [(300, None, None), (301, "http://e", ""), (299, "u", "<p>é🙂</p>\r\n\r\nWARC/1.1 \x1f"), (0, "again", "payload 0 "), (None, "no id", "single"), (None, "none", "payload 0 ")]


@pytest.mark.parametrize("split", [1, 37, 1 << 20])
def test_warc_round_trip(spark, split):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("first", F.lit(5))
    files = warc.write(pages, warc.fresh_path(spark, "t"), file_bytes=6000)
    got = warc.read(files, split).collect()
    assert len(got) == len(PAGES) and all(r.digest_ok for r in got)
    firsts = {}
    for i, _, h in PAGES:
        b = (h or "").encode()
        firsts[b] = min((x for x in (firsts.get(b), i) if x is not None), default=None)
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        revisit = firsts[b] is not None and firsts[b] != i
        want.append((str(i) if i is not None else "", len(b), warc.base32_sha1(b), "revisit" if revisit else "response", str(firsts[b]) if revisit else None, None if revisit else b))
    mine = [(r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr)


def test_warc_small_payloads_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id bigint, url string, html string")
    got = {r.record_id: r.record_type for r in warc.round_trip(pages, least_bytes=3).collect()}
    assert got == {"1": "response", "2": "response", "3": "response", "4": "revisit"}
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_tokens(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    t = Tokenizer.from_file(path)
    rows = [*awkward(), (5, "x<|endoftext|>y <|endoftext|>", "en", "s", 1), (6, "a" * 30_000, "en", "s", 1), (7, "\x1c\x1d \x85　 ٣½ don't I'LL﻿\x00  \n\n ", "en", "s", 1)]
    ids = bpe.encode(documents(spark, rows, True), path, out="packed")
    back = bpe.decode(ids.withColumn("list", bpe.ids("packed")).withColumn("n", bpe.n_tokens("packed")), path, "packed", "again").collect()
    assert len(back) == len(rows)
    for r in back:
        want = t.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.list) == want and r.n == len(want) and r.again == t.decode(want, skip_special_tokens=False) == (r.text or "")
    one = bpe.round_trip(documents(spark, rows, True), path, out="packed", decoded="again").collect()
    assert sorted((repr(r.text), bytes(r.packed), r.again) for r in one) == sorted((repr(r.text), bytes(r.packed), r.again) for r in back)
    assert bpe.encode(documents(spark, []), path).collect() == []


def plain_merges(tokens, v):
    slow = list(tokens)
    while True:
        ranked = [(v.merges[a << 32 | b], i) for i, (a, b) in enumerate(zip(slow, slow[1:], strict=False)) if a << 32 | b in v.merges]
        if not ranked:
            return slow
        rank, i = min(ranked)
        slow[i : i + 2] = [int(v.made[rank])]


def test_merges_against_plain_loop():
    import random

    import numpy as np
    import pyarrow as pa

    v = bpe.Vocabulary(vocabulary_path())
    rng = random.Random(4)
    pieces = ["".join(rng.choice("aeinth rsé") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    pieces += ["<|endoftext|>", "aaaaaaaaaaaaaaaaa", "abababababababababab" * 30]
    want = [plain_merges(v.of_byte[np.frombuffer(p.encode(), np.uint8)].tolist(), v) for p in pieces]
    want[400] = [v.special["<|endoftext|>"]]
    for k, p in enumerate(pieces):
        assert k == 400 or bpe.merge(v.of_byte[np.frombuffer(p.encode(), np.uint8)].tolist(), v) == want[k]
    for few in (0, 10_000):  # all trees together; each alone
        flat, numbers = bpe.merge_pieces(pa.array(pieces), v, few)
        ends = np.cumsum(numbers).tolist()
        assert [flat[a:z].tolist() for a, z in zip([0, *ends[:-1]], ends, strict=True)] == want


def test_long_texts_and_stray_ids(monkeypatch):
    import numpy as np

    v = bpe.Vocabulary(vocabulary_path())
    texts = ["the stones of naïve rivers " * 400, None, "", "x<|endoftext|>y" * 50, "日本 " * 300]
    whole = bpe.encode_texts(texts, v)
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "PIECES", 37)
    bits = bpe.encode_texts(texts, v)
    assert all((a == b).all() for a, b in zip(whole, bits, strict=True))
    assert bpe.decode_ids(*bits, v).to_pylist() == [t or "" for t in texts]
    half = v.of_byte[np.frombuffer("é".encode(), np.uint8)][:1]
    assert bpe.decode_ids(half, np.array([1, 0]), v).to_pylist() == ["\ufffd", ""]
    with pytest.raises(ValueError):
        bpe.decode_ids(np.array([1 << 20], np.int32), np.array([1]), v)
