"""Repair of conversation structure: the cheapest edits after which roles read (system) (user assistant)*.

Edits of a conversation's rows in order: Keep costs 0, Rerole to user or assistant 2, Delete 3, Insert of
an empty user or assistant row anywhere 2; a truncated row that is not deleted adds 1; blank rows and
repeats of an earlier (role, text) must be deleted. What stays must have the role initials
(s?(ua)+)?. Of equally cheap edits those count whose initials (D, I, K, R), in order, are ASCII-least.

It is a Viterbi search over four states (nothing yet, after the system row, after a user, after an
assistant). The survivors' decisions are a tree of backpointers with reference counts: what no survivor
needs any more goes, and when all survivors share an ancestor, the edits up to it are final and leave the
tree. A tie compares the complete unresolved suffixes; their order, and what one is longer by where one
begins the other, are carried along from row to row, so a comparison looks at the new letters only. A
state that another state beats whatever follows is given up.

A conversation of any length is shared out: rows are sorted by (conv_id, turn) into parts of bounded
size; a part solves the conversations inside it and, for the one that it begins and the one that it ends
with, the best edits from each state to each state, which one small group a conversation then joins in
the same way. Only one code a row and the edits take part in this, texts are joined to their edits by row.

Rows of equal turn are taken by role, then text; null turns come first. Null roles and texts count as one
space. A role whose initial is none of s, u and a (an empty role, too) can be reroled or deleted. A null
conv_id is a conversation. Repeated rows are repeats. An empty table gives an empty result. The edits of
one conversation are one string in report(). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = "sua"
FINE, GONE, TRUNCATED = range(3)
FAULTS = ("blank", "duplicate", "truncated")
BLANKS = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE = 3, 2, 2
Move = tuple[int, int, str, int]


def _inserts() -> list[Move]:
    """(from, to, letters, cost) between two rows, none included. I and R make users, J and S assistants;
    after equal edits only one of a pair is possible, so letters sort as their initials do."""
    stay = [(s, s, "", 0) for s in range(4)]
    one = [(s, USER, "I", INSERT) for s in (START, SYSTEM, ASSISTANT)] + [(USER, ASSISTANT, "J", INSERT)]
    return stay + one + [(s, ASSISTANT, "IJ", 2 * INSERT) for s in (START, SYSTEM)]


def _moves(role: int, fault: int) -> list[Move]:
    """What a row allows, with the inserts after it."""
    row = [(s, s, "D", DELETE) for s in range(4)]
    if fault != GONE:
        more = int(fault == TRUNCATED)
        to_user = (START, SYSTEM, ASSISTANT)
        row += [(s, USER, "R", REROLE + more) for s in to_user] + [(USER, ASSISTANT, "S", REROLE + more)]
        kept = {0: [(START, SYSTEM)], 1: [(s, USER) for s in to_user], 2: [(USER, ASSISTANT)]}
        row += [(a, b, "K", more) for a, b in kept.get(role, [])]
    return [(a, c, x + y, m + n) for a, b, x, m in row for b2, c, y, n in _inserts() if b == b2]


INSERTS = _inserts()
#: By code: role (s, u, a, other) + 4 * fault.
MOVES = [_moves(code % 4, code // 4) for code in range(12)]


class Survivors:
    """The best way to each state, their decisions a tree."""

    def __init__(self, state: int) -> None:
        self.root, self.next = 0, 1
        self.nodes = {0: [-1, "", 1, 0]}  # parent, letters, references (children, a survivor), children xor-ed
        self.tips = {state: 0}
        self.costs = {state: 0}
        self.order: dict[tuple[int, int], tuple[int, str | None]] = {}
        self.done: list[str] = []

    def compare(self, p: int, a: str, q: int, b: str) -> tuple[int, str | None]:
        """The order of survivor p followed by a, and q followed by b: -1, 0 or 1, and what the longer has
        more if it begins with the other."""
        if p != q:
            sign, rest = self.order[p, q]
            if rest is None:
                return sign, None
            a, b = (a, rest + b) if sign < 0 else (rest + a, b)
        if a == b:
            return 0, ""
        if b.startswith(a):
            return -1, b[len(a) :]
        if a.startswith(b):
            return 1, a[len(b) :]
        return (-1 if a < b else 1), None

    def advance(self, moves: list[Move]) -> None:
        best: dict[int, tuple[int, int, str]] = {}
        for p, to, letters, more in moves:
            if p in self.costs:
                cost, held = self.costs[p] + more, best.get(to)
                if held is None or cost < held[0] or cost == held[0] and self.compare(p, letters, held[1], held[2])[0] < 0:
                    best[to] = cost, p, letters
        # a state that cannot win back what it is behind; equal costs stay, their edits may come first
        ahead = min((best[s][0] + more for s, more in ((ASSISTANT, 0), (USER, INSERT)) if s in best), default=None)
        if ahead is not None:
            for s, most in ((START, ahead + DELETE), (SYSTEM, ahead)):
                if s in best and best[s][0] > most:
                    del best[s]
        order = {}
        for s, (_, p, a) in best.items():
            for t, (_, q, b) in best.items():
                if s < t:
                    sign, rest = self.compare(p, a, q, b)
                    order[s, t], order[t, s] = (sign, rest), (-sign, rest)
        tips = {s: self._node(self.tips[p], letters) for s, (_, p, letters) in best.items()}
        old, self.tips, self.order = set(self.tips.values()), tips, order
        self.costs = {s: b[0] for s, b in best.items()}
        for node in old - set(tips.values()):
            self._drop(node)
        held = set(tips.values())
        while self.nodes[self.root][2] == 1 and self.root not in held:
            child = self.nodes.pop(self.root)[3]
            self.done.append(self.nodes[child][1])
            self.nodes[child][0], self.root = -1, child

    def _node(self, parent: int, letters: str) -> int:
        if not letters:
            return parent
        made, self.next = self.next, self.next + 1
        self.nodes[made] = [parent, letters, 1, 0]
        self.nodes[parent][2] += 1
        self.nodes[parent][3] ^= made
        return made

    def _drop(self, node: int) -> None:
        self.nodes[node][2] -= 1
        while not self.nodes[node][2]:
            parent = self.nodes.pop(node)[0]
            self.nodes[parent][2] -= 1
            self.nodes[parent][3] ^= node
            node = parent

    def path(self, state: int) -> list[str]:
        """All letters of the way to a state, as they were added."""
        node, back = self.tips[state], []
        while node != self.root:
            back.append(self.nodes[node][1])
            node = self.nodes[node][0]
        return self.done + back[::-1]

    def winner(self) -> int:
        """The better one of the states in which a conversation may end."""
        ends = [s for s in (START, ASSISTANT) if s in self.costs]
        return min(ends, key=lambda s: (self.costs[s], len(ends) > 1 and self.order[s, START + ASSISTANT - s][0]))


def solve(codes: list[int]) -> tuple[int, str]:
    """(cost, letters) of a whole conversation."""
    s = Survivors(START)
    s.advance(INSERTS)
    for code in codes:
        s.advance(MOVES[code])
    end = s.winner()
    return s.costs[end], "".join(s.path(end))


def transfers(codes: list[int]) -> list[Move]:
    """The best way from each state to each state."""
    out = []
    for start in range(4):
        s = Survivors(start)
        for code in codes:
            s.advance(MOVES[code])
        out += [(start, end, "".join(s.path(end)), cost) for end, cost in s.costs.items()]
    return out


def joined(pieces: list[list[Move]]) -> tuple[int, list[str]]:
    """(cost, letters of each piece) of a conversation given by the transfers of its pieces."""
    s = Survivors(START)
    s.advance(INSERTS)
    for moves in pieces:
        s.advance(moves)
    end = s.winner()
    found = s.path(end)
    return s.costs[end], found if len(found) == len(pieces) else [found[0] + found[1], *found[2:]]


def illegal(roles: np.ndarray) -> int:
    """Neighbours other than su, ua and au."""
    a, b = roles[:-1], roles[1:]
    return int(((b == 1) & ((a == 0) | (a == 2)) | (a == 1) & (b == 2)).__invert__().sum())


PIECE = "conv_id bigint, first_row bigint, start int, stop int, cost bigint, letters string, n_illegal bigint, head int, tail int"
SOLVED = "conv_id bigint, first_row bigint, cost bigint, letters string, n_illegal bigint"


def ordered(rows: DataFrame, rows_a_part: int) -> DataFrame:
    """(row, conv_id, turn, role, text, same, initial, blank, truncated) as a table: row numbers run on in
    the order of conversations and turns within a part, which is row's upper half."""
    spark = rows.sparkSession
    said = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-said.count() // rows_a_part))
    sorted_ = said.repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.expr(f"instr('{ROLES}', substring(role, 1, 1)) - 1")
    return cut(
        sorted_.select(
            F.monotonically_increasing_id().alias("row"), "*", F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("same"),
            F.when((F.col("role") == "") | (initial < 0), 3).otherwise(initial).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
        ),
        "turns",
    )


def coded(turns: DataFrame) -> DataFrame:
    """(row, part, conv_id, turn, initial, fault, why) of ordered rows; why: the fault that counts."""
    first = turns.groupBy("conv_id", "same").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("new"))
    why = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    fault = F.when(F.col("why").isin("blank", "duplicate"), GONE).when(F.col("why") == "truncated", TRUNCATED).otherwise(FINE)
    few = turns.select("row", "conv_id", "turn", "initial", "blank", "truncated").join(first, "row", "left").withColumn("why", why)
    return cut(few.select("row", F.shiftright("row", 33).alias("part"), "conv_id", "turn", "initial", fault.alias("fault"), "why"), "codes")


def solved(codes: DataFrame) -> DataFrame:
    """SOLVED rows, one for each piece of a conversation in a part: its letters, and of the first piece the
    conversation's cost (0 of the others)."""

    def part(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        conv, row = rows.column("conv_id").to_pylist(), rows.column("row").to_numpy()
        initial, fault = rows.column("initial").to_numpy(), rows.column("fault").to_numpy()
        code = (initial + 4 * fault).tolist()
        edges = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
        out = []
        for a, b in zip(edges, edges[1:]):  # noqa: B905
            seen = (illegal(initial[a:b]), int(initial[a]), int(initial[b - 1]))
            if a == 0 or b == len(conv):
                out += [(conv[a], int(row[a]), start, stop, cost, letters, *seen) for start, stop, letters, cost in transfers(code[a:b])]
            else:
                cost, letters = solve(code[a:b])
                out.append((conv[a], int(row[a]), -1, -1, cost, letters, *seen))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
        names = [x.split()[0] for x in PIECE.split(", ")]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def join(rows: pa.Table) -> pa.Table:
        pieces: dict[int, list[dict]] = {}
        for r in rows.to_pylist():
            pieces.setdefault(r["first_row"], []).append(r)
        order = sorted(pieces)
        cost, letters = joined([[(r["start"], r["stop"], r["letters"], r["cost"]) for r in pieces[i]] for i in order])
        heads = [pieces[i][0] for i in order]
        across = [0, *(illegal(np.array([a["tail"], b["head"]])) for a, b in zip(heads, heads[1:]))]  # noqa: B905
        columns = ([heads[0]["conv_id"]] * len(order), order, [cost, *[0] * (len(order) - 1)], letters, [h["n_illegal"] + x for h, x in zip(heads, across, strict=True)])
        return pa.table({x.split()[0]: pa.array(c, pa.string() if "string" in x else pa.int64()) for x, c in zip(SOLVED.split(", "), columns, strict=True)})

    pieces = cut(codes.select("part", "row", "conv_id", "initial", "fault").groupBy("part").applyInArrow(part, PIECE), "pieces")
    whole = pieces.where("start < 0").select("conv_id", "first_row", "cost", "letters", "n_illegal")
    return cut(whole.union(pieces.where("start >= 0").groupBy("conv_id").applyInArrow(join, SOLVED)), "solved")


def edits(turns: DataFrame, pieces: DataFrame) -> DataFrame:
    """(conv_id, row, sub, edit, role, text) of all edits, in the order of (row, sub): deleted rows with what
    they held, reroled ones with their new role, inserted ones without text."""
    ops = F.transform(F.regexp_extract_all("letters", F.lit("[IJ]*[DKRS](?:[IJ]+$)?"), F.lit(0)), lambda x, i: F.struct((F.col("first_row") + i).alias("row"), x.alias("ops")))
    each = pieces.select("conv_id", F.explode(ops).alias("o")).select("conv_id", "o.row", F.posexplode(F.split("o.ops", "")).alias("sub", "op")).where("op <> ''")
    made = each.withColumn("of", F.when(~F.col("op").isin("I", "J"), F.col("row")))
    held = turns.select(F.col("row").alias("of"), F.col("role").alias("was"), F.col("text").alias("said"))
    role = F.when(F.col("op").isin("I", "R"), "user").when(F.col("op").isin("J", "S"), "assistant").otherwise(F.col("was"))
    return made.join(held, "of", "left").select("conv_id", "row", "sub", F.translate("op", "JS", "IR").alias("edit"), role.alias("role"), F.coalesce("said", F.lit("")).alias("text"))


def digests(done: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the newline-joined role:text of what is not deleted: hashed row by row as the
    sorted rows pass, however long a conversation is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            ids, digests_ = [], []
            for conv, line in zip(b.column("conv_id").to_pylist(), b.column("line"), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        ids.append(now)
                        digests_.append(state.hexdigest())
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests_, pa.string())], ["conv_id", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "sha256"])

    lines = done.where("edit <> 'D'").select("conv_id", "row", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "row", "sub").mapInArrow(run, "conv_id bigint, sha256 string")


def repair(rows: DataFrame, rows_a_part: int = 50_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edits, codes, pieces) of conversations (conv_id, turn, role, text)."""
    turns = ordered(rows, rows_a_part)
    codes = coded(turns)
    pieces = solved(codes)
    return edits(turns, pieces), codes, pieces


def report(rows: DataFrame, conversations: DataFrame, rows_a_part: int = 50_000) -> DataFrame:
    """A row for each conv_id of conversations: gaps in the turns of rows, rows by fault, illegal neighbours,
    cost and initials of the edits, and the digest of the repaired conversation."""
    done, codes, pieces = repair(rows, rows_a_part)
    turns = codes.groupBy("conv_id", "turn").agg(*(F.count_if(F.col("why") == c).alias(c) for c in FAULTS))
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps")
    counts = turns.groupBy("conv_id").agg(span, *(F.sum(c).alias(c) for c in FAULTS))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_row", "letters"))), lambda x: x.letters), "")
    found = pieces.groupBy("conv_id").agg(F.sum("n_illegal").alias("illegal"), F.sum("cost").alias("cost"), F.translate(audit, "JS", "IR").alias("audit"))
    out = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    for more in (counts, found, digests(done)):
        out = out.join(more.withColumnRenamed("conv_id", "_id"), F.expr("conv_id <=> _id"), "left").drop("_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", *(zero(c) for c in ("gaps", *FAULTS, "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(none)).alias("repaired_sha256"),
    )


def with_blanks(c: str) -> Column:
    """A column's text, one space where it is null."""
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))
