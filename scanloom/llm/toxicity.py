"""Toxicity of documents: a bidirectional gated recurrent network with attention pooling.

A word's input is an embedding of the word and the mean of embeddings of its character 3- to 5-grams
(both hashed), so unseen words are judged by their letters. Windows of 32 words, 16 apart, cover the
whole text; each is read in both directions, attention pools the states, and the document's logit is
that of its worst window, calibrated with the number of windows.

The network is fitted in numpy on a bounded sample: at most `sample_rows` labelled documents of each
class, the smallest by a hash of the id, with all their windows. It begins with all windows under their
document's label and goes on with the worst windows only, as a toxic document need not be toxic
throughout. A fifth of the sample is held back from this and calibrates the logits. All documents are
then scored where they lie, without a shuffle; only the model is broadcast (a few MB, whatever the
corpus).

Null and empty texts have no words; they score as the median clean document of the sample does. Labels other than 0 and 1, and
of null ids, are left out; without labels of both classes every score is the share of label 1 (0.5
without any). Repeated rows stay; other columns pass through and are never inputs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_map import with_columns

LENGTH, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM, ROWS = 32, 16, 12, 8, 12, 1 << 15
#: ASCII that is no letter or digit parts words; the text is lower-cased before.
TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(TABLE).split()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def features(words: pa.Array, most: int = 16_384) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _features(), some words at a time."""
    parts = [_features(words.slice(k, most)) for k in range(0, len(words), most)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.zeros(1, np.int64)
    counts = np.concatenate([np.diff(p[2]) for p in parts])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(([0], np.cumsum(counts)))


def _features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words (binary): the row of each in the word table, all their character grams' rows,
    and where each word's grams begin (a last entry: their number)."""
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int32, n + 1 + words.offset)[words.offset :].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    size = np.diff(offsets)
    of = np.repeat(np.arange(n), size)
    marked = np.full(len(data) + 2 * n, 1, np.uint64)  # a mark before and after each word
    marked[np.arange(len(data)) + 2 * of + 1] = data
    start = np.cumsum(size + 2) - (size + 2)
    end = np.repeat(start + size + 2, size + 2)
    at = np.arange(len(marked))
    gram, found, owner = np.zeros(len(marked), np.uint64), [], []
    word_at = np.repeat(np.arange(n), size + 2)
    for k in range(5):
        live = len(marked) - k
        gram[:live] = gram[:live] * np.uint64(0x100000001B3) + marked[k:] + np.uint64(1)
        if k >= 2:
            ok = at[:live] + k < end[:live]
            found.append(((gram[:live][ok] ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49))
            owner.append(word_at[:live][ok])
    rows, owners = np.concatenate(found).astype(np.int32), np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=n)
    poly = np.cumprod(np.full(int(size.max(initial=0)) + 3, 0x100000001B3, np.uint64))
    inside = (at - start[word_at]).astype(np.int64)
    whole = np.add.reduceat(marked * poly[inside], start) if n else np.empty(0, np.uint64)
    return ((whole * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64), rows[order], np.concatenate(([0], np.cumsum(counts)))


def windows(n: int) -> np.ndarray:
    """First words of the windows over n words; the last window reaches the end."""
    return np.arange(0, max(1, n - LENGTH + STRIDE), STRIDE)


@dataclass
class Model:
    """Parameters p; a and b calibrate a document's logit; constant: the score of all, if not fitted;
    wordless: the logit of texts without words, that of the median clean document."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    calibration: tuple[float, float, float] = (1.0, 0.0, 0.0)
    constant: float | None = None
    wordless: float = 0.0

    @staticmethod
    def fresh(seed: int = 11) -> Model:
        r, h = np.random.default_rng(seed), HIDDEN
        f = lambda *s, scale=0.3: (r.standard_normal(s) * scale).astype(np.float32)
        p = {"word": f(ROWS, WORD_DIM, scale=0.05), "char": f(ROWS, CHAR_DIM, scale=0.3), "in": f(WORD_DIM + CHAR_DIM, 6 * h), "bias": np.zeros(6 * h, np.float32), "v": f(2 * h), "w": f(2 * h), "b": np.zeros(1, np.float32)}
        return Model(p | {f"{k}{d}": f(h, m * h) for d in (0, 1) for k, m in (("zr", 2), ("n", 1))})

    def inputs(self, words: pa.Array) -> tuple[np.ndarray, tuple]:
        """x of each distinct word, and what the way back needs. An extra last row of zeros is the pad."""
        word, grams, at = features(words)
        x = np.zeros((len(words) + 1, WORD_DIM + CHAR_DIM), np.float32)
        if len(words):
            x[:-1, :WORD_DIM] = self.p["word"][word]
            for k in range(0, len(words), 16_384):
                edge = at[k : k + 16_385]
                x[k : k + len(edge) - 1, WORD_DIM:] = np.add.reduceat(self.p["char"][grams[edge[0] : edge[-1]]], edge[:-1] - edge[0]) / np.diff(edge)[:, None]
        return x, (word, grams, at)

    def run(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows: ids and mask are (LENGTH, n), gates the words' input gates."""
        steps, n, h = len(ids), ids.shape[1], HIDDEN
        states = np.empty((steps, n, 2 * h), np.float32)
        kept: dict = {"steps": ([], [])}
        for d in (0, 1):
            zr, un, own = self.p[f"zr{d}"], self.p[f"n{d}"], np.ascontiguousarray(gates[:, 3 * h * d : 3 * h * (d + 1)])
            s = np.zeros((n, h), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                g = own[ids[t]]
                a = sigmoid(g[:, : 2 * h] + s @ zr)
                z, r, m = a[:, :h], a[:, h:], s @ un
                c = np.tanh(g[:, 2 * h :] + r * m)
                new = (c + z * (s - c)) * mask[t][:, None]
                if keep:
                    kept["steps"][d].append((t, s, z, r, m, c))
                s = new
                states[t, :, h * d : h * (d + 1)] = s
        e = np.where(mask > 0, states @ self.p["v"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=0)) * mask
        alpha = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnk->nk", alpha, states)
        return pooled @ self.p["w"] + self.p["b"][0], kept | {"states": states, "alpha": alpha, "pooled": pooled}

    def back(self, d_logit: np.ndarray, kept: dict, ids: np.ndarray, mask: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters behind the gates, and of the gates by (step, window)."""
        h, p, states, alpha = HIDDEN, self.p, kept["states"], kept["alpha"]
        g = {"w": kept["pooled"].T @ d_logit, "b": np.array([d_logit.sum()], np.float32)}
        d_pool = d_logit[:, None] * p["w"][None]
        d_alpha = np.einsum("tnk,nk->tn", states, d_pool)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        g["v"] = np.einsum("tn,tnk->k", d_e, states)
        d_states = alpha[:, :, None] * d_pool[None] + d_e[:, :, None] * p["v"]
        d_gates = np.zeros((*ids.shape, 6 * h), np.float32)
        for d in (0, 1):
            zr, un = p[f"zr{d}"], p[f"n{d}"]
            g[f"zr{d}"], g[f"n{d}"], ds = np.zeros_like(zr), np.zeros_like(un), np.zeros((ids.shape[1], h), np.float32)
            for t, s, z, r, m, c in reversed(kept["steps"][d]):
                ds = (ds + d_states[t, :, h * d : h * (d + 1)]) * mask[t][:, None]
                dc = ds * (1 - z) * (1 - c * c)
                da = np.concatenate((ds * (s - c) * z * (1 - z), dc * m * r * (1 - r)), 1)
                dm = dc * r
                d_gates[t, :, 3 * h * d : 3 * h * d + 2 * h], d_gates[t, :, 3 * h * d + 2 * h : 3 * h * (d + 1)] = da, dc
                g[f"zr{d}"] += s.T @ da
                g[f"n{d}"] += s.T @ dm
                ds = ds * z + da @ zr.T + dm @ un.T
        return g, d_gates

    def worst(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Of each document (as words): its highest window logit and its number of windows."""
        sizes = np.array([len(w) for w in docs], np.int64)
        coded = pa.array([w for d in docs for w in d], pa.binary()).dictionary_encode()
        x, _ = self.inputs(coded.dictionary)
        gates = x @ self.p["in"] + self.p["bias"]
        starts = [windows(n) for n in sizes.tolist()]
        count = np.array([len(s) for s in starts], np.int64)
        first = np.cumsum(sizes) - sizes
        begin, left = np.concatenate(starts) + np.repeat(first, count), np.repeat(sizes, count) - np.concatenate(starts)
        codes = np.append(np.asarray(coded.indices, dtype=np.int64), np.full(LENGTH, len(coded.dictionary)))
        logits = np.empty(len(begin), np.float32)
        for k in range(0, len(begin), 2048):
            b, n = begin[k : k + 2048], left[k : k + 2048]
            mask = np.arange(LENGTH)[:, None] < n[None]
            ids = np.where(mask, codes[np.minimum(np.arange(LENGTH)[:, None] + b[None], len(codes) - 1)], len(coded.dictionary))
            logits[k : k + 2048] = self.run(gates, ids, mask.astype(np.float32))[0]
        logits = np.maximum.reduceat(logits, np.cumsum(count) - count)
        return np.where(sizes > 0, logits, np.float32(self.wordless)), count

    def scores(self, docs: list[list[bytes]]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(docs), self.constant)
        logit, count = self.worst(docs)
        a, b, c = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * logit.astype(float) + b * np.log(count) + c, -40, 40)))


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            self.p[k] -= (scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def sums(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Of n rows, each the sum of the rows of x with this number in `at`."""
    out = np.zeros((n, x.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        rows, first = np.unique(at[order], return_index=True)
        out[rows] = np.add.reduceat(x[order], first)
    return out


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """How much likelier a row is in toxic documents, drawn to zero where the counts may be chance."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    sure = np.abs(odds) / np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return odds * np.clip((sure - 1.5) / 3, 0, 1)


def begin_with_odds(model: Model, pairs: np.ndarray, width: int, label: np.ndarray, word: np.ndarray, grams: np.ndarray, at: np.ndarray, most: int = 40_000) -> None:
    """Sets the first dimension of both tables to the log odds of their rows over the sample's documents;
    pairs: document * width + word, each once. Training goes on from there."""
    counts = {"word": np.zeros((2, ROWS)), "char": np.zeros((2, ROWS))}
    for k in range(0, len(pairs), most):
        d, w = pairs[k : k + most] // width, pairs[k : k + most] % width
        n = at[w + 1] - at[w]
        own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[w], n)
        for name, doc, rows in (("word", d, word[w]), ("char", np.repeat(d, n), grams[own])):
            key = np.unique(doc * ROWS + rows)
            y = label[key // ROWS] > 0
            for side in (0, 1):
                counts[name][side] += np.bincount(key[y == side] % ROWS, minlength=ROWS)
    for name, (clean, toxic) in counts.items():
        model.p[name][:, 0] = 0.3 * log_odds(toxic, clean, label.sum(), len(label) - label.sum())


def fit(samples: list[tuple[int, list[bytes]]], batch: int = 256, seed: int = 5) -> Model:
    """samples: (label, words), a document each; all its windows are read, of small samples up to eight
    times, and the worst windows three times as often, six times at least."""
    model, rng = Model.fresh(), np.random.default_rng(seed)
    starts = [windows(len(w)) for _, w in samples]
    epochs = min(8, -(-40_000 // sum(map(len, starts))))
    worst_epochs = max(6, 3 * epochs)
    doc = np.repeat(np.arange(len(samples)), [len(s) for s in starts])
    label = np.array([y for y, _ in samples], np.float32)
    coded = pa.array([w for _, ws in samples for w in ws], pa.binary()).dictionary_encode()
    pad, sizes = len(coded.dictionary), np.array([len(w) for _, w in samples])
    codes = np.append(np.asarray(coded.indices, np.int32), np.full(LENGTH, pad, np.int32))
    first = np.concatenate(starts)
    size, begin = np.minimum(sizes[doc] - first, LENGTH), first + (np.cumsum(sizes) - sizes)[doc]
    mask = (np.arange(LENGTH)[:, None] < size[None]).astype(np.float32)
    ids = np.where(mask > 0, codes[np.minimum(begin[None] + np.arange(LENGTH)[:, None], len(codes) - 1)], np.int32(pad))
    weight = np.where(label > 0, 0.5 / max(label.mean(), 1e-6), 0.5 / max(1 - label.mean(), 1e-6)).astype(np.float32)
    _, (word, grams, at) = model.inputs(coded.dictionary)
    real, at_doc = ids[mask > 0], np.broadcast_to(doc, ids.shape)[mask > 0]
    begin_with_odds(model, np.unique(at_doc * (pad + 1) + real), pad + 1, label, word, grams, at)
    adam = Adam(model.p, 0.01)

    def learn(chosen: np.ndarray) -> None:
        chosen = rng.permutation(chosen)
        for k in range(0, len(chosen), batch):
            c = chosen[k : k + batch]
            used, local = np.unique(ids[:, c], return_inverse=True)
            local = local.reshape(LENGTH, len(c))
            real = used[used < pad]
            x = np.zeros((len(used), WORD_DIM + CHAR_DIM), np.float32)
            counts = at[real + 1] - at[real]
            own = np.concatenate([np.arange(a, b) for a, b in zip(at[real], at[real + 1], strict=True)]) if len(real) else np.empty(0, np.int64)
            drop = (rng.random(len(real)) > 0.5)[:, None]
            if len(real):
                x[: len(real), :WORD_DIM] = model.p["word"][word[real]] * drop
                x[: len(real), WORD_DIM:] = np.add.reduceat(model.p["char"][grams[own]], np.cumsum(counts) - counts) / counts[:, None]
            logit, kept = model.run(x @ model.p["in"] + model.p["bias"], local, mask[:, c], keep=True)
            d = ((sigmoid(logit) - label[doc[c]]) * weight[doc[c]] / len(c)).astype(np.float32)
            g, d_gates = model.back(d, kept, local, mask[:, c])
            d_words = sums(local.ravel(), d_gates.reshape(-1, 6 * HIDDEN), len(used))
            g["in"], g["bias"] = x.T @ d_words, d_words.sum(axis=0)
            dx = d_words[: len(real)] @ model.p["in"].T
            g["word"] = sums(word[real], dx[:, :WORD_DIM] * drop, ROWS)
            g["char"] = sums(grams[own], np.repeat(dx[:, WORD_DIM:] / counts[:, None], counts, axis=0), ROWS)
            adam.step(g)

    for _ in range(epochs):
        learn(np.arange(len(doc)))
    for _ in range(worst_epochs):
        x, _ = model.inputs(coded.dictionary)
        gates = x @ model.p["in"] + model.p["bias"]
        logit = np.concatenate([model.run(gates, ids[:, k : k + 2048], mask[:, k : k + 2048])[0] for k in range(0, len(doc), 2048)])
        order = np.lexsort((-logit, doc))
        edge = np.searchsorted(doc[order], np.arange(len(samples)))
        rank = np.arange(len(doc)) - edge[doc[order]]
        learn(order[rank < np.where(label[doc[order]] > 0, 2, 3)])
    return model


def calibrate(logit: np.ndarray, count: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the label on the worst window's logit and the log of the windows' number,
    with a small ridge and steps that are halved until the loss falls."""
    mid, wide = float(np.median(logit)), float(logit.std()) or 1.0
    x = np.stack(((logit.astype(float) - mid) / wide, np.log(count), np.ones(len(logit))), 1)
    ridge = np.array([1e-3, 1e-1, 1e-3]) * weight.sum() / len(weight)
    p_of = lambda w: 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))

    def loss(w: np.ndarray) -> float:
        p = np.clip(p_of(w), 1e-15, 1 - 1e-15)
        return float(-(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum() + 0.5 * (ridge * w * w).sum())

    w, best = np.zeros(3), np.inf
    for _ in range(60):
        p = p_of(w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (p - label)) + ridge * w)
        best, size = loss(w), 1.0
        while loss(w - size * step) > best and size > 1e-6:
            size /= 2
        w = w - size * step
        if best - loss(w) < 1e-9 * (1 + best):
            break
    return float(w[0] / wide), float(w[1]), float(w[2] - w[0] * mid / wide)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 2000, least_back: int = 40) -> Model:
    """The fitted model; labels of held-out ids are never read. A document that repeats a sampled id
    counts once, by its smallest digest. A sample of which a fifth has fewer than `least_back` rows of a
    class is too small to hold any back: it fits and calibrates."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    total = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(total) < 2:
        return Model(constant=float(next(iter(total))) if total else 0.5)
    pick = lambda y: known.where(F.col("label") == y).orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(sample_rows)
    chosen = pick(0).union(pick(1))  # 2 * sample_rows rows at most, so it may be broadcast
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("id", "label", "t.text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((r["id"], r["label"], words_of(r["text"]), r["back"]) for b in batches for r in b.to_pylist()), key=lambda r: (r[0], r[2]))
        label, back = np.array([y for _, y, _, _ in rows], int), np.array([b for *_, b in rows], bool)
        if len(set(label.tolist())) < 2:
            return
        if np.bincount(label[back], minlength=2).min() < least_back:
            back[:] = False
        model = fit([(y, w) for (_, y, w, _), b in zip(rows, back, strict=True) if not b])
        if not back.any():
            back[:] = True
        logit, count = (np.concatenate(x) for x in zip(*(model.worst([w]) for _, _, w, _ in rows), strict=True))
        model.wordless = float(np.median(logit[label == 0]))
        drawn = np.bincount(label[back], minlength=2)
        weight = np.where(label == 1, total[1] / max(drawn[1], 1), total[0] / max(drawn[0], 1))
        model.calibration = calibrate(logit[back], count[back], label[back], weight[back])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], ["model"])

    back = F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(5)) == 0
    rows = texts.select("id", "label", "text", back.alias("back"))
    fitted = rows.repartition(1).mapInArrow(learn, "model binary").collect()  # the sample is bounded; the driver gets the model
    if not fitted:
        return Model(constant=total.get(1, 0) / sum(total.values()))
    return pickle.loads(fitted[0].model)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score", chunk_words: int = 150_000) -> DataFrame:
    """docs with the score of text_col."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        known = shared.value

        def chunks(column: pa.Array) -> Iterator[list[list[bytes]]]:
            held, n = [], 0
            for t in column:
                held.append(words_of(t.as_py()))
                n += len(held[-1])
                if n >= chunk_words:
                    yield held
                    held, n = [], 0
            if held:
                yield held

        return lambda column: [pa.array(np.concatenate([known.scores(c) for c in chunks(column)]) if len(column) else np.empty(0), pa.float64())]

    return with_columns(docs, text_col, [(out, "double")], start)
