"""Byte-level BPE encoding and decoding with a published vocabulary (its path is a parameter).

A text is split at special tokens, then by the vocabulary's pattern. The distinct pieces of a batch
are merged with segment trees over the ranks of adjacent pairs: the root gives the lowest rank, the
way down prefers the left child, so ties go to the leftmost pair, and a merge changes three leaves
and the nodes above them. Pieces whose trees are of one size go through their merges together, one
merge of each at a time, as columns of an array; a few pieces (long ones, mostly) go alone. Texts
are gathered from their pieces' ids, so work is linear in text and memory is that of a batch.

Token ids are a binary column, four little-endian bytes an id (ids() unpacks it to an array). Null
texts count as empty: no ids, and decoding gives the empty text. Bytes that are not UTF-8 after
decoding arbitrary ids become U+FFFD; ids outside the vocabulary are an error. Other columns and
repeated rows pass through.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_map import with_columns

#: Fixed value: the split pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32((1 << 31) - 1)
#: Texts of more characters are split bit by bit; so many pieces are encoded at a time.
LONG_TEXT, PIECES = 1 << 20, 1 << 19


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 characters for
    themselves, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ranks:
    """The merge rank of a pair of ids, for many pairs at once: a table with open addressing."""

    ODD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pairs: np.ndarray) -> None:
        """pairs: first id << 32 | second id, in order of rank."""
        bits = max(4, int(4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        rank, at = np.arange(len(pairs), dtype=np.int32), self.place(pairs)
        while len(rank):
            free = np.flatnonzero(self.key[at] < 0)
            slot, first = np.unique(at[free], return_index=True)
            first = free[first]
            self.key[slot], self.rank[slot] = pairs[first], rank[first]
            left = np.ones(len(rank), bool)
            left[first] = False
            pairs, rank, at = pairs[left], rank[left], (at[left] + 1) & self.mask

    def place(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.view(np.uint64) * self.ODD) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs = a.astype(np.int64) << 32 | b
        at = self.place(pairs)
        met = self.key[at]
        out = np.where(met == pairs, self.rank[at], NONE)
        more = np.flatnonzero((met != pairs) & (met >= 0))
        while len(more):
            at[more] = (at[more] + 1) & self.mask
            met = self.key[at[more]]
            same = met == pairs[more]
            out[more[same]] = self.rank[at[more[same]]]
            more = more[~same & (met >= 0)]
        return out


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.of_byte = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = [vocab[a] << 32 | vocab[b] for a, b in pairs]
        self.ranks, self.merges = Ranks(np.array(keys, np.int64)), {k: rank for rank, k in enumerate(keys)}
        every = [bytes_of.get(i) for i in range(max(bytes_of) + 1)]
        self.size = np.array([-1 if t is None else len(t) for t in every], np.int64)  # -1: no such id
        self.begin = np.cumsum(np.maximum(self.size, 0)) - np.maximum(self.size, 0)
        self.flat = np.frombuffer(b"".join(t or b"" for t in every), np.uint8)
        self.split = regex.compile(PATTERN)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    """Read once by each worker."""
    return Vocabulary(path)


def merge(tokens: list[int], v: Vocabulary) -> list[int]:
    """BPE of one piece. tree[size + i] is the rank of the merge of the token at i with the next one
    that still stands, NONE without one."""
    n, none = len(tokens), int(NONE)
    if n < 2:
        return tokens
    size = 1 << (n - 1).bit_length()
    rank, made = v.merges.get, v.made.item
    tree, after, before = [none] * (2 * size), [*range(1, n), -1], [*range(-1, n - 1)]
    for i in range(n - 1):
        tree[size + i] = rank(tokens[i] << 32 | tokens[i + 1], none)
    for x in range(size - 1, 0, -1):
        tree[x] = min(tree[2 * x], tree[2 * x + 1])

    def put(i: int, value: int) -> None:
        x = size + i
        tree[x] = value
        while x > 1:
            x >>= 1
            a, b = tree[2 * x], tree[2 * x + 1]
            value = a if a <= b else b
            if tree[x] == value:
                break  # nothing changes above
            tree[x] = value

    while (best := tree[1]) != none:
        x = 1
        while x < size:
            x += x
            if tree[x] != best:
                x += 1
        i = x - size
        j = after[i]
        tokens[i] = made(best)
        k = after[i] = after[j]
        put(j, none)
        if k >= 0:
            before[k] = i
        put(i, rank(tokens[i] << 32 | tokens[k], none) if k >= 0 else none)
        p = before[i]
        if p >= 0:
            put(p, rank(tokens[p] << 32 | tokens[i], none))
    out, i = [], 0
    while i >= 0:
        out.append(tokens[i])
        i = after[i]
    return out


def merge_together(data: np.ndarray, begin: np.ndarray, count: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """As merge() for the pieces data[begin : begin + count] of two bytes or more whose trees are of one
    size. Column c of every array is piece c: tokens by place, the next and the previous place that stand,
    and the tree by node. (ids of all pieces one after another, their numbers.)"""
    n, size = len(begin), 1 << (int(count.max()) - 1).bit_length()
    step, place = np.arange(size)[:, None], np.arange(n)
    inside = step < count
    tokens = np.where(inside, v.of_byte[data[np.where(inside, begin + step, 0)]], 0).astype(np.int32)
    after = np.where(step + 1 < count, step + 1, -1).astype(np.int32)
    before = np.repeat(np.arange(-1, size - 1, dtype=np.int32)[:, None], n, 1)
    tree = np.full((2 * size, n), NONE, np.int32)
    tree[size : 2 * size - 1] = np.where(after[:-1] >= 0, v.ranks(tokens[:-1].ravel(), tokens[1:].ravel()).reshape(size - 1, n), NONE)
    for x in (size >> k for k in range(1, size.bit_length())):
        tree[x : 2 * x] = np.minimum(tree[2 * x : 4 * x : 2], tree[2 * x + 1 : 4 * x : 2])
    tokens, after, before, tree = (a.ravel() for a in (tokens, after, before, tree))  # place * n + piece
    live = np.flatnonzero(tree[n : 2 * n] != NONE)
    while len(live):
        best, x = tree[n + live], np.ones(len(live), np.int64)
        for _ in range(size.bit_length() - 1):
            x += x
            x += tree[x * n + live] != best
        i = x - size
        at = i * n + live
        j = after[at].astype(np.int64)
        one = tokens[at] = v.made[best]
        k = after[at] = after[j * n + live]
        p = before[at].astype(np.int64)
        tree[(size + j) * n + live] = NONE
        has = np.flatnonzero(k >= 0)
        to = k[has].astype(np.int64) * n + live[has]
        before[to] = i[has]
        rank = np.full(len(live), NONE, np.int32)
        rank[has] = v.ranks(one[has], tokens[to])
        tree[(size + i) * n + live] = rank
        has = np.flatnonzero(p >= 0)
        tree[(size + p[has]) * n + live[has]] = v.ranks(tokens[p[has] * n + live[has]], one[has])
        node = np.concatenate((size + i, size + j, size + p[has]))  # three leaves' ways to the root
        column = np.concatenate((live, live, live[has]))
        for _ in range(size.bit_length() - 1):
            node >>= 1
            left = 2 * node * n + column
            tree[node * n + column] = np.minimum(tree[left], tree[left + n])
        live = live[tree[n + live] != NONE]
    stands = np.zeros((size, n), bool)
    stands[0] = True
    at = place
    while len(at):  # along the chains of places that stand
        nxt = after[at].astype(np.int64)
        at = (nxt * n + at % n)[nxt >= 0]
        stands.ravel()[at] = True
    return tokens.reshape(size, n).T[stands.T], stands.sum(0)


def merge_pieces(pieces: pa.Array, v: Vocabulary, few: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all the pieces one after another, their numbers) of distinct pieces (strings)."""
    offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    data = np.frombuffer(pieces.buffers()[2], np.uint8) if offsets[-1] else np.empty(0, np.uint8)
    count, begin = np.diff(offsets), offsets[:-1]
    numbers, parts, owners = np.ones(len(count), np.int64), [], []
    single = np.flatnonzero(count == 1)
    if len(single):
        parts.append(v.of_byte[data[begin[single]]])
        owners.append(single)
    tall = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    for t in np.unique(tall[count > 1]).tolist():
        of = np.flatnonzero((tall == t) & (count > 1))
        most = max(1, (1 << 22) >> t)  # pieces whose trees are held at once
        for group in (of[x : x + most] for x in range(0, len(of), most)):
            if len(group) < few:
                made = [merge(v.of_byte[data[begin[g] : begin[g] + count[g]]].tolist(), v) for g in group]
                ids, number = np.array([*chain.from_iterable(made)], np.int32), np.array([len(m) for m in made])
            else:
                ids, number = merge_together(data, begin[group], count[group], v)
            numbers[group] = number
            parts.append(ids)
            owners.append(group)
    for s, i in v.special.items():  # a piece that equals a special token is one
        at = np.flatnonzero(count == len(s.encode()))
        at = at[[pieces[int(k)].as_py() == s for k in at]] if len(at) else at
        for k in at:
            parts, owners = _replaced(parts, owners, numbers, int(k), i)
    where = np.cumsum(numbers) - numbers
    flat = np.empty(int(numbers.sum()), np.int32)
    for ids, group in zip(parts, owners, strict=True):
        flat[ranges(where[group], numbers[group])] = ids
    return flat, numbers


def _replaced(parts: list[np.ndarray], owners: list[np.ndarray], numbers: np.ndarray, piece: int, id_: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """parts and owners with the ids of one piece replaced by id_."""
    for x, group in enumerate(owners):
        here = group == piece
        if here.any():
            parts[x], owners[x] = parts[x][~np.repeat(here, numbers[group])], group[~here]
    numbers[piece] = 1
    return [*parts, np.array([id_], np.int32)], [*owners, np.array([piece])]


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    return np.arange(int(count.sum())) + np.repeat(begin - np.cumsum(count) + count, count)


def pieces_of(text: str, v: Vocabulary) -> Iterator[list[str]]:
    parts = v.at_special.split(text) if v.at_special and any(s in text for s in v.special) else [text]
    for k, part in enumerate(parts):
        if k % 2:
            yield [part]
        elif len(part) <= LONG_TEXT:
            yield v.split.findall(part)
        else:
            found = (m.group() for m in v.split.finditer(part))
            while some := list(islice(found, PIECES)):
                yield some


def encode_texts(texts: Iterable[str | None], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, their numbers)."""
    numbers: list[int] = []
    flat: list[np.ndarray] = []
    held: list[str] = []
    spans: list[tuple[int, int]] = []  # (text, its pieces among those held)

    def settle() -> None:
        coded = pa.array(held, pa.string()).dictionary_encode()
        ids, count = merge_pieces(coded.dictionary, v)
        at = np.asarray(coded.indices)
        each = count[at]
        flat.append(ids[ranges((np.cumsum(count) - count)[at], each)])
        ends = np.concatenate(([0], np.cumsum(each)))[np.cumsum([n for _, n in spans])]
        for (text, _), a, z in zip(spans, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            numbers[text] += z - a
        held.clear()
        spans.clear()

    for text in texts:
        numbers.append(0)
        for some in pieces_of(text, v) if text else ():
            held += some
            spans.append((len(numbers) - 1, len(some)))
            if len(held) >= PIECES:
                settle()
    if held:
        settle()
    return np.concatenate(flat) if flat else np.empty(0, np.int32), np.array(numbers, np.int64)


def decode_ids(flat: np.ndarray, numbers: np.ndarray, v: Vocabulary, most: int = 1 << 18) -> pa.Array:
    """The texts of ids one after another, numbers[k] of them for text k."""
    if len(flat) and (int(flat.max()) >= len(v.size) or int(flat.min()) < 0 or int(v.size[flat].min()) < 0):
        raise ValueError("ids outside the vocabulary")
    parts = [v.flat[ranges(v.begin[some], v.size[some])] for some in (flat[x : x + most] for x in range(0, len(flat), most))]
    data = np.concatenate(parts) if parts else np.empty(0, np.uint8)
    ends = np.concatenate(([0], np.cumsum(v.size[flat])))[np.concatenate(([0], np.cumsum(numbers)))]
    texts = pa.Array.from_buffers(pa.string(), len(numbers), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:  # ids that end within a character
        view = memoryview(data)
        texts = pa.array([bytes(view[a:z]).decode("utf-8", "replace") for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())
    return texts


def packed(flat: np.ndarray, numbers: np.ndarray) -> pa.Array:
    ends = 4 * np.concatenate(([0], np.cumsum(numbers)))
    return pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat, "<i4"))])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows one after another, their numbers); a null row has none."""
    rows = [r or b"" for r in column.to_pylist()]
    return np.frombuffer(b"".join(rows), "<i4"), np.array([len(r) // 4 for r in rows], np.int64)


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with the packed ids of text_col in column `out`."""

    def start():
        v = vocabulary_of(vocabulary)
        return lambda texts: [packed(*encode_texts((t.as_py() for t in texts), v))]

    return with_columns(docs, text_col, [(out, "binary")], start)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of the packed ids in column `out`."""

    def start():
        v = vocabulary_of(vocabulary)
        return lambda column: [decode_ids(*unpacked(column), v)]

    return with_columns(df, ids_col, [(out, "string")], start)


def round_trip(docs: DataFrame, vocabulary: str, text_col: str = "text", out: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the packed ids of text_col and the text that they decode to, in one pass: one worker a
    task, and ids go to Spark once."""

    def start():
        v = vocabulary_of(vocabulary)

        def make(texts: pa.Array) -> list[pa.Array]:
            flat, numbers = encode_texts((t.as_py() for t in texts), v)
            return [packed(flat, numbers), decode_ids(flat, numbers, v)]

        return make

    return with_columns(docs, text_col, [(out, "binary"), (decoded, "string")], start)


def n_tokens(packed: str) -> Column:
    return F.expr(f"octet_length(`{packed}`) div 4")


def ids(packed: str) -> Column:
    """The packed ids as array<bigint>."""
    n = f"octet_length(`{packed}`) div 4"
    byte = lambda at: f"hex(substring(`{packed}`, 4 * i + {at}, 1))"
    one = f"cast(conv(concat({byte(4)}, {byte(3)}, {byte(2)}, {byte(1)}), 16, 10) as bigint)"
    return F.expr(f"CASE WHEN {n} > 0 THEN transform(sequence(0, {n} - 1), i -> {one}) ELSE array() END")
