"""The registered queries on awkward tables: every contract's columns against plain versions."""

import hashlib
import zlib

import numpy as np
import pytest

from scanloom.llm import decontaminate, pii, queries, warc

from .helpers import SCHEMA, awkward, jaccard
from .test_corpus import slow_passages, slow_repeats
from .test_pii import slow
from .test_search import BENCH, PAGES
from .test_simhash import slow_classes, slow_fingerprint

ROWS = [*awkward(), *((5000 + i, f"mail a{i}@b.co or 10.0.0.{i * 40}, call +1 (988) 555-2485, card 4524132264652876", "en", "s", 1) for i in range(9)), (6000, BENCH[0][1] + " end", "en", "s", 1)]
VECTORS = [(i, [float((i * 7 + k * k) % 11) - 5 for k in range(6)], i % 3) for i in range(330)] + [(400, None, 1), (401, [0.0] * 6, 1), (402, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (403, [float("nan")] * 6, 1), (404, [float("inf")] * 6, 1), (100, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 1), (None, [1.0, 2.0, 3.0, 4.0, 5.0, 6.5], 1)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    made = {
        "documents": (ROWS, SCHEMA), "benchmark": (BENCH, "item_id bigint, text string"), "pages": (PAGES, "page_id bigint, url string, html string"),
        "embeddings": (VECTORS, "vec_id bigint, embedding array<float>, label int"), "labels": ([(r[0], 1, int(i % 4 == 0)) for i, r in enumerate(ROWS)], "doc_id bigint, quality int, toxic int"),
    }
    for name, (rows, kind) in made.items():
        spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{d}/{name}.parquet")
    return str(d)


def rows_of(spark, tables, name, columns):
    made = queries.queries()[name](spark, tables)
    assert [c for c in made.columns if c in columns] == columns == made.columns[: len(columns)]
    return sorted(map(tuple, made.select(*columns).collect()), key=repr)


def utf8(text):
    return (text or "").encode()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, tables):
    prints = [slow_fingerprint(r[1]) for r in ROWS]
    want = zip([r[0] for r in ROWS], [f"{p:016x}" for p in prints], slow_classes([r[0] for r in ROWS], prints), strict=True)
    assert rows_of(spark, tables, "op1_simhash_near_dedup", ["doc_id", "fingerprint", "component_id"]) == sorted(want, key=repr)


def test_op2(spark, tables):
    got = rows_of(spark, tables, "op2_bootstrapped_pii", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
    want = []
    for i, text, *_ in ROWS:
        base = slow(text or "")
        counts = [sum(k == kind for _, kind, _ in base) for k in range(4)]
        want.append((i, *counts, sha(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()), base))
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        spans = {(int(s), pii.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in g[6].split(",") if x)}
        assert g[:6] == w[:6] and set(w[6]) <= spans
    assert [tuple(map(type, g)) for g in got][0][1:5] == (int,) * 4 and sum(g[1] for g in got) == 9


def test_op3(spark, tables):
    got = rows_of(spark, tables, "op3_warc", ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    firsts = {}
    for i, _, h in PAGES:
        firsts[utf8(h)] = min((x for x in (firsts.get(utf8(h)), i) if x is not None), default=None)
    want = []
    for i, _, h in PAGES:
        b, first = utf8(h), firsts[utf8(h)]
        revisit = first is not None and first != i
        want.append((i, len(b), warc.base32_sha1(b), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=repr)


def test_op4(spark, tables):
    got = rows_of(spark, tables, "op4_multi_index_ann", ["query_id", "rank", "vec_id", "score"])
    good = [(i, np.array(v)) for i, v, _ in VECTORS if v is not None and None not in v and np.isfinite(v).all() and any(v)]
    hits = total = 0
    for own, (q, v) in enumerate(good):
        if q is None or q % 100:
            continue
        best = sorted((float(np.sqrt(((v - u) ** 2).sum())), float("inf") if i is None else i) for k, (i, u) in enumerate(good) if k != own)[:10]
        hits, total = hits + len({(s, i) for s, i in best} & {(s, float("inf") if i is None else i) for x, _, i, s in got if x == q}), total + 10
    assert len(got) == total and hits >= 0.9 * total


def test_op5(spark, tables):
    got = rows_of(spark, tables, "op5_decontamination", ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    windows = {}
    for i, t in BENCH:
        w = decontaminate.words_of(t.encode() if t else None)
        for s in range(max(0, len(w) - 12) or bool(w)):
            windows.setdefault(tuple(w[s : s + 13]), set()).add(i)
    want = []
    for d, t, *_ in ROWS:
        w = decontaminate.words_of(t.encode() if t else None)
        hit, items = set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    items |= found
        names = sorted(str(i) for i in items - {None})
        want.append((d, len(w), len(hit), len(names), sha(",".join(names).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    assert got == sorted(want, key=repr)


def test_op6(spark, tables):
    got = rows_of(spark, tables, "op6_suffix_dedup", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "n_passage_words"])
    texts = [r[1] for r in ROWS]
    want = [(r[0], *x, x[0] - x[1], p) for r, x, p in zip(ROWS, slow_repeats(texts, 400), slow_passages(texts, 51), strict=True)]
    assert got == sorted(want, key=repr)


def test_op8(spark, tables):
    got = rows_of(spark, tables, "op8_kd_sharding", ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])
    assert sorted((g[:3] for g in got), key=repr) == sorted(((i, len(utf8(t)) + 1, zlib.crc32(utf8(t))) for i, t, *_ in ROWS), key=repr)
    assert {(g[3], g[6]) for g in got} == {("bytes", None)} and {g[4] for g in got} <= set(range(8))
    for s in {g[4] for g in got}:
        slots = sorted(g[5] for g in got if g[4] == s)
        assert slots == list(range(len(slots)))


def test_op9(spark, tables):
    got = rows_of(spark, tables, "op9_toxicity", ["doc_id", "held_out", "score", "predicted"])
    assert sorted((g[0] for g in got), key=repr) == sorted((r[0] for r in ROWS), key=repr)
    for i, held, score, predicted in got:
        assert held == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= score <= 1 and predicted == (score >= 0.5)


def test_op10(spark, tables):
    from tokenizers import Tokenizer

    got = rows_of(spark, tables, "op10_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    t = Tokenizer.from_file(queries.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    want = []
    for i, text, *_ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())))
    assert got == sorted(want, key=repr)


def test_op7(spark, tables):
    got = rows_of(spark, tables, "op7_license_scan", ["doc_id", "license", "cosine", "origin", "inherited_from"])
    assert sorted((g[0] for g in got), key=repr) == sorted((r[0] for r in ROWS), key=repr) and {g[3] for g in got} <= {"own", "file", "inherited", "none"}


def test_pipeline_against_plain_stages(spark, tables, tmp_path):
    """Without labels of both classes nothing is toxic; the other four stages in plain loops."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    d = tmp_path / "sf"
    d.mkdir()
    for name in ("documents", "benchmark"):
        (d / f"{name}.parquet").symlink_to(f"{tables}/{name}.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    got = sorted(((r.doc_id, r.lang, r.source, bytes(r.token_ids), r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(d)).collect()), key=repr)

    root = list(range(len(ROWS)))
    for i in range(len(ROWS)):
        for j in range(i):
            if root[i] != root[j] and jaccard(ROWS[i][1], ROWS[j][1]) >= 0.8:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    kept = []
    for c in set(root):
        ids = [ROWS[k][0] for k in range(len(ROWS)) if root[k] == c]
        kept.append(min((i for i in ids if i is not None), default=None))
    bench = decontaminate.matchers([t.encode() if t else None for _, t in BENCH], 13)
    t = Tokenizer.from_file(queries.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    want, by = [], {}
    for row in ROWS:
        by.setdefault(row[0], row)
    for i in kept:
        text = next(r[1] for r in ROWS if r[0] is None and r[1]) if i is None else by[i][1]
        words = decontaminate.words_of(text.encode() if text else None)
        hit = sum(e - s for s, e in decontaminate.search(words, bench)[0])
        if hit and 20 * hit >= len(words):
            continue
        clean, at = [], 0
        for s, kind, e in slow(text or ""):
            if s >= at:
                clean += [(text or "")[at:s], f"[{pii.KINDS[kind].upper()}]"]
                at = e
        clean.append((text or "")[at:])
        ids = t.encode("".join(clean), add_special_tokens=False).ids
        row = next(r for r in ROWS if r[0] is None and r[1]) if i is None else by[i]
        want.append((i, row[2], row[3], np.array(ids, "<u4").tobytes(), len(ids), sha("".join(clean).encode())))
    assert [(g[0], g[4]) for g in got] == [(w[0], w[4]) for w in sorted(want, key=repr)]
    assert got == sorted(want, key=repr)
