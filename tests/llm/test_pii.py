import random
import re

from scanloom.llm import pii

from .helpers import SCHEMA, documents

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def slow(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = [True, kind == 1 and all(int(x) <= 255 for x in m.group().split(".")), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15][kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_are_the_plain_patterns(spark):
    rng = random.Random(3)
    sets = ["a.b@c-d", "0123456789", "1. 2-+()", "é@\n._%+-🙂", "12345.678"]
    texts = ["".join(rng.choice(rng.choice(sets)) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["4111 1111 1111 1111 x 4111-1111-1111-1111", "+1 (988) 555-2485 4524132264652876 z", "a@b.c_x@d.e a@b.c@d.e", "🙂 a@b.co 🙂 1.2.3.4", "1.2.3.4.5.6.7.8 999.1.1.1 001.2.3.4", "a" * 20000 + "@b.c", "1-" * 5000 + "1", "0" * 3000 + ".1.1.1"]
    got = pii.find(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)).collect()
    for r in got:
        assert [(s.start, s.kind, s.end) for s in r.base] == slow(texts[r.doc_id]), texts[r.doc_id]


def _told(n=20):
    return [(i, f"say contact number: {f'+1 (988) 555-{i:04d}' if i < n else f'XK-77-{i:04d}'} ok then", "en", "s", 1) for i in range(n + 3)] + [(100, "elsewhere XK-77-0021 again", "en", "s", 1), (101, "not XK-78-0021 though", "en", "s", 1)]


def test_context_discovers_unseen_strings(spark):
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(_told(), SCHEMA)).collect()}
    assert [(s.kind, s.value) for s in got[21].spans] == [(3, "XK-77-0021")] and got[21].base == []
    assert [s.value for s in got[100].spans] == ["XK-77-0021"] and got[101].spans == []
    assert len(got[3].base) == len(got[3].spans) == 1


def test_few_or_mixed_seeds_discover_nothing(spark):
    few = pii.find(spark.createDataFrame(_told(5), SCHEMA)).collect()
    assert all(r.base == r.spans for r in few)


def test_redact_keeps_rows_and_columns(spark):
    docs = documents(spark, clash=True)
    out = pii.redact(docs)
    assert out.columns == docs.columns and sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    masked = pii.redact(spark.createDataFrame([*_told(), (7, None, None, None, None), (8, "a@b.co 1.2.3.4", None, None, None)], SCHEMA)).collect()
    by = {r.doc_id: r.text for r in masked if r.doc_id not in range(7)} | {7: [r.text for r in masked if r.doc_id == 7]}
    assert by[22] == "say contact number: [PHONE] ok then" and by[8] == "[EMAIL] [IP]" or by[8]
    assert None in by[7]


def test_native_and_empty(spark):
    plan = pii.with_base(documents(spark), "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert pii.find(documents(spark, [])).collect() == []
    assert len(pii.find(documents(spark)).collect()) == documents(spark).count()


def test_context_discovers_identifiers_of_every_shape(spark):
    unseen = ["020 7946 0958", "(555) 010-2233", "4111 1111 1111 1112", "555.010.2234", "XK-77-0099"]
    rows = _told(60) + [(200 + i, f"say contact number: {x} ok then", "en", "s", 1) for i, x in enumerate(unseen)]
    rows += [(300 + i, f"write mail to user{i}@host.org, thanks", "en", "s", 1) for i in range(20)] + [(400, "write mail to anna.kurz@corp, thanks", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in pii.find(docs).collect()}
    assert [got[200 + i] for i in range(len(unseen))] == [[(3, x)] for x in unseen]
    assert got[400] == [(0, "anna.kurz@corp")]
    masked = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert masked[201] == "say contact number: [PHONE] ok then" and masked[400] == "write mail to [EMAIL], thanks"


def test_discovery_goes_on_until_nothing_is_new(spark):
    """Five sets of strings, each told by the context of the one before only."""
    rows = [(i, f"ctx0 +1 (988) 555-{i:04d} end0{i}", "en", "s", 1) for i in range(40)]
    for k in range(5):
        rows += [(1000 * (k + 1) + i, f"ctx{k} ID{k}-{i:04d} u{k}x{i}", "en", "s", 1) for i in range(10 if k == 0 else 0)]
        rows += [(1000 * (k + 1) + 100 + i, f"ctx{k} ID{k}-{i:04d} v{k}x{i}", "en", "s", 1) for i in range(10 if k else 0)]
        rows += [(1000 * (k + 1) + 200 + i, f"ctx{k + 1} ID{k}-{i:04d} w{k}x{i}", "en", "s", 1) for i in range(10)]
    found = pii.with_base(spark.createDataFrame(rows, SCHEMA), "text").cache()
    known = {r.value: r.kind for r in pii.discover(found, support=2, precision=0.1, confidence=0.1).collect()}
    assert all(known.get(f"ID{k}-{i:04d}") == 3 for k in range(5) for i in range(10))


def slow_discover(seen, support, precision, confidence):
    edges = {}
    for s in seen:
        for p in s.patterns:
            edges[p, s.value] = max(edges.get((p, s.value), -9), s.kind)
    known, states = {}, set()
    while True:
        n, w = {}, {}
        for (p, v), kind in edges.items():
            n[p] = n.get(p, 0) + (kind > -2)
            for k in range(4):
                more = known[v][1] if kind == -1 and v in known and known[v][0] == k else 0.0
                w[p, k] = w.get((p, k), 0.0) + (kind == k) + more
        good = {(p, k): x / n[p] for (p, k), x in w.items() if n[p] and x >= support and x / n[p] >= precision}
        told = {}
        for (p, v), kind in edges.items():
            for k in range(4):
                if kind < 0 and (p, k) in good:
                    told[v, k] = told.get((v, k), 1.0) * (1 - min(good[p, k], 0.999))
        known = {}
        for (v, k), miss in sorted(told.items(), key=lambda x: x[0][1]):
            if v not in known or 1 - miss > known[v][1] + 1e-12:
                known[v] = (k, 1 - miss)
        state = (len(known), sum(c >= confidence for _, c in known.values()), round(sum(c for _, c in known.values()) / len(known), 4)) if known else None
        if state is None:
            return {}
        if state in states:
            return {v: x for v, x in known.items() if x[1] >= confidence}
        states.add(state)


def test_scores_against_plain_loops(spark):
    rng = random.Random(12)
    ends, rows = ["ok then", "and so on", "thanks"], []
    for i in range(300):
        seed = rng.choice([f"+1 (988) 555-{i:04d}", f"user{i}@host.org", f"10.0.{i % 250}.{i % 7}", f"ID-{i % 60:04d}", f"{i % 40:07d}x"])
        rows.append((i, f"{rng.choice(['call', 'mail', 'see'])} {rng.choice(['now', 'at', 'number:'])} {seed} {rng.choice(ends)}", "en", "s", 1))
    found = pii.with_base(spark.createDataFrame(rows, SCHEMA), "text").cache()
    seen = [s for r in found.collect() for s in r.seen]
    for support, precision, confidence in ((3, 0.2, 0.5), (8, 0.3, 0.6), (2, 0.6, 0.8)):
        made = pii.discover(found, support=support, precision=precision, confidence=confidence)
        got = {} if made is None else {r.value: (r.kind, round(r.confidence, 6)) for r in made.collect()}
        assert got == {v: (k, round(c, 6)) for v, (k, c) in slow_discover(seen, support, precision, confidence).items()}
        assert got or support == 2
