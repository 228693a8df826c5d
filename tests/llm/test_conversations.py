"""Conversation repair against an exhaustive search on small conversations, and shared-out long ones."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from scanloom.llm import conversations as c
from scanloom.llm import queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, row int, part string, edit int, copy int, kind int, line string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def faults_of(rows):
    """The first fault of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        said = BLANK.findall(text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def slow_repair(rows):
    """(cost, audit, repaired) over all edits, right to left: costs first, then the initials."""
    faults = faults_of(rows)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @cache
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 3:
            for role in ("user", "assistant"):
                if (state, role[0]) in step and (tail := best(i, role[0], inserted + 1)):
                    found.append((2 + tail[0], "I" + tail[1], ((role, ""), *tail[2])))
        if i < len(rows):
            (role, text), fault = rows[i], faults[i]
            if tail := best(i + 1, state, 0):
                found.append((3 + tail[0], "D" + tail[1], tail[2]))
            if fault not in ("blank", "duplicate"):
                for name, letter, cost in ((role, "K", 0), ("user", "R", 2), ("assistant", "R", 2)):
                    if (state, name[:1]) in step and (tail := best(i + 1, name[:1], 0)):
                        found.append((cost + (fault == "truncated") + tail[0], letter + tail[1], ((name, text), *tail[2])))
        return min(found) if found else None

    return best(0, "", 0)


def slow_report(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    said, turns = [(r, t) for _, r, t in rows], [t for t, *_ in rows if t is not None]
    faults = faults_of(said)
    bad = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))  # noqa: B905
    cost, audit, kept = slow_repair(tuple(said))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    text = "\n".join(f"{r}:{t}" for r, t in kept)
    return (conv, gaps, *(faults.count(k) for k in c.FAULTS), bad, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def some(seed, n, most=9, roles=("system", "user", "assistant", "user", "assistant", "tool", "", "admin")):
    rng = random.Random(seed)
    texts = ["Well. ", "no end", "Is it?", " \t", "", "Yes!", "Yes!", "é。", "so\n.\n", "a.b"]
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            out.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"text {conv} {turn}" + rng.choice(["", ".", "!"])))
    return out


def plain(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, role if role is not None else " ", text if text is not None else " "))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, 3, 4, "l") for r in rows], SCHEMA)


@pytest.mark.parametrize("roles", [("system", "user", "assistant"), ("tool",), ("user",), ("assistant", "system"), ("user", "assistant", "tool", "")])
def test_search_is_exhaustive(roles):
    rng = random.Random(len(roles))
    for n in [0, 1, 2, 3] + [rng.randint(2, 9) for _ in range(250)]:
        rows = tuple((rng.choice(roles), rng.choice(["x.", "y", "", "z!", "w?"]) if rng.random() < 0.3 else f"{i}" + rng.choice([".", ""])) for i in range(n))
        kind = {"": 0, "truncated": 2, "blank": 1, "duplicate": 1}
        codes = [("sua".index(r[:1]) if r[:1] and r[:1] in "sua" else 3) + 4 * kind[f] for (r, _), f in zip(rows, faults_of(rows), strict=True)]
        want = slow_repair(rows)
        cost, letters = c.solve(codes)
        assert (cost, letters.translate(str.maketrans("JS", "IR"))) == want[:2]
        for cut in range(1, n):  # the same from two pieces
            cost, pieces = c.joined([c.transfers(codes[:cut]), c.transfers(codes[cut:])])
            assert (cost, "".join(pieces)) == (want[0], letters) and len(pieces) == 2
        cost, pieces = c.joined([c.transfers([x]) for x in codes]) if n else (0, [])
        assert "".join(pieces) == letters and len(pieces) == n


def test_memory_is_bounded_where_survivors_meet():
    s, most = c.Survivors(c.START), 0
    s.advance(c.INSERTS)
    for i in range(20_000):
        s.advance(c.MOVES[[1, 2, 1, 2, 2, 1, 6, 9][i % 8]])
        most = max(most, len(s.nodes))
    assert most < 60 and len(s.done) > 19_900


def test_unresolved_ties_over_a_long_conversation():
    """Roles that fit nowhere: every way stays open until the end, and an early deletion ties with late ones."""
    s = c.Survivors(c.START)
    s.advance(c.INSERTS)
    for _ in range(20_001):
        s.advance(c.MOVES[3])
    end = s.winner()
    assert "".join(s.path(end)).translate(str.maketrans("JS", "IR")) == "D" + "R" * 20_000


def test_report(spark):
    rows = some(1, 60) + [(500, None, None, None), (501, 3, "user", None), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (502, 1, "user", "word " * 60_000 + ".")]
    rows += [(503, 1, "user", "twice."), (503, 1, "user", "twice."), (504, 5, "system", "only."), (505, None, "user", "x."), (505, None, "assistant", "y.")]
    df = frame(spark, rows).repartition(5)
    want = sorted([slow_report(k, v) for k, v in plain(rows).items()], key=repr)
    for a_part in (50_000, 7):
        got = c.report(df, df, rows_a_part=a_part)
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_long_conversation_is_shared_out(spark):
    rng = random.Random(9)
    rows = [(7, i, rng.choice(["user", "assistant", "assistant", "tool"]), f"{i % 900}" + rng.choice(".?x")) for i in range(3000)] + some(2, 10)
    done, codes, pieces = c.repair(frame(spark, rows), rows_a_part=100)
    assert pieces.where("conv_id = 7").count() > 5 and codes.groupBy("part").count().agg({"count": "max"}).first()[0] < 1500
    made = [(r.edit, r.role, r.text) for r in done.where("conv_id = 7").orderBy("row", "sub").collect()]
    said = sorted((t, r, x) for cid, t, r, x in rows if cid == 7)
    kind = {"": 0, "truncated": 2, "blank": 1, "duplicate": 1}
    codes = [({"u": 1, "a": 2}.get(r[0], 3)) + 4 * kind[f] for (_, r, _), f in zip(said, faults_of([(r, x) for _, r, x in said]), strict=True)]
    assert "".join(m[0] for m in made) == c.solve(codes)[1].translate(str.maketrans("JS", "IR"))
    kept = "".join(m[1][0] for m in made if m[0] != "D")
    assert re.fullmatch("s?(ua)+", kept) and [m[2] for m in made if m[0] != "I"] == [x for *_, x in said]


def test_empty(spark):
    assert c.report(frame(spark, []), frame(spark, [])).collect() == []


def test_registered(spark, tmp_path):
    rows = some(3, 80, roles=("system", "user", "assistant")) + [(None, 4, None, None), (900, None, "user", "x."), (901, 0, None, "y")]
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    hurt = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = (x if x is not None else " " for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            hurt[conv] += [row] * (2 if k == 3 else 1)
    want = [slow_report(k, v) for k, v in hurt.items()]
    got = queries.queries()["op13_conversation_repair"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
