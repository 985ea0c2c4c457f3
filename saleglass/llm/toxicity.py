"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the sum of a word vector (words seen often enough in training) and of character vectors (hashed
first five and seven and last three bytes), so that unseen words and compounds have an input too. The network reads windows of ``WINDOW`` words
that begin every ``STRIDE`` words; attention pools the states of both directions into one logit a window, and a
document's score is that of its highest window. Every window of every whole text is scored.

Training is by document labels: a document's logit is the smooth maximum over its windows. It uses a bounded sample
of labelled rows, ``TRAIN_ROWS`` of each label at most, among texts of at most ``TRAIN_CHARS`` characters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleglass.llm.common import documents, slices, text_or_empty

WINDOW, STRIDE = 32, 16
WIDTH, HIDDEN = 12, 8
#: Character inputs: how they are cut from a word, and the bits of their hash.
PIECES = {"head5": (slice(0, 5), 12), "head7": (slice(0, 7), 12), "tail": (slice(-3, None), 8)}
TRAIN_ROWS, TRAIN_CHARS, VOCABULARY, LEAST_SEEN = 1500, 4000, 20_000, 3
EPOCHS, LEAST_STEPS, BATCH, RATE = 6, 300, 48, 0.01
THRESHOLD = 0.7
OFF = np.float32(-30.0)

#: ASCII letters to lower case, other ASCII characters but digits to space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(FOLD).split()


class Codes(dict):
    """Word to a code of its word id and its two character hashes. Unseen words get word id 0 and are remembered
    until ``limit`` words are held, which bounds the memory of a task."""

    limit = 200_000

    def __init__(self, vocabulary: list[bytes]) -> None:
        super().__init__()
        self.base = {w: self.code(w, i + 1) for i, w in enumerate(vocabulary)}
        self.update(self.base)

    @staticmethod
    def code(word: bytes, word_id: int = 0) -> int:
        found = word_id
        for cut, bits in PIECES.values():
            found = (found << bits) | (crc32(word[cut]) & ((1 << bits) - 1))
        return found

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.limit + len(self.base):
            self.clear()
            self.update(self.base)
        self[word] = found = self.code(word)
        return found


def parts_of(codes: np.ndarray) -> dict[str, np.ndarray]:
    """The ids that a code holds, by table."""
    out = {}
    for name, (_, bits) in reversed(PIECES.items()):
        out[name] = codes & ((1 << bits) - 1)
        codes = codes >> bits
    return {"word": codes} | out


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts that lie one after another: word index of each place of each window (-1: none), and its text."""
    counts = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.cumsum(sizes) - sizes
    place = nth[:, None] * STRIDE + np.arange(WINDOW)
    return np.where(place < sizes[text][:, None], first[text][:, None] + place, -1), text


def _tanh_gates(h: np.ndarray, x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One step: update and reset gates, candidate, and the recurrent part of the candidate."""
    k = h.shape[1]
    p = h @ u
    g = 0.5 + 0.5 * np.tanh(0.5 * (x[:, : 2 * k] + p[:, : 2 * k]))
    q = p[:, 2 * k :]
    return g[:, :k], g[:, k:], np.tanh(x[:, 2 * k :] + g[:, k:] * q), q


@dataclass
class Network:
    vocabulary: list[bytes]
    p: dict[str, np.ndarray]
    #: The score of every text with a word, where labels gave nothing to learn from.
    constant: float | None = None
    tables: dict[str, np.ndarray] = field(default_factory=dict)

    def ready(self) -> Network:
        """Multiply the input weights into the vectors, gates laid out for both directions at once."""
        h = HIDDEN
        gates = [(d * 3 + g) * h + i for g in range(3) for d in range(2) for i in range(h)]
        wx = self.p["wx"][:, gates].copy()
        u = np.zeros((2 * h, 6 * h), np.float32)
        for d in range(2):
            for g in range(3):
                u[d * h : (d + 1) * h, (g * 2 + d) * h : (g * 2 + d + 1) * h] = self.p["u"][d][:, g * h : (g + 1) * h]
        half = np.ones(6 * h, np.float32)
        half[: 4 * h] = 0.5  # a logistic gate is a tanh of half the input
        self.tables = {k: np.ascontiguousarray((self.p[k] @ wx) * half, np.float32) for k in ("word", *PIECES)}
        self.tables["word"] += self.p["bx"][gates] * half
        self.tables["u"] = u * half
        return self

    def window_logits(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        h, t = HIDDEN, self.tables
        x = np.empty((len(codes) + 1, 6 * h), np.float32)
        x[:-1] = 0
        for k, ids in parts_of(codes).items():
            x[:-1] += t[k][ids]
        x[-1] = 0
        x[-1, : 2 * h] = OFF  # no word: the update gate is shut
        ahead = np.tile(np.repeat([True, False], h), 3)
        fore, back = np.ascontiguousarray(x[:, ahead]), np.ascontiguousarray(x[:, ~ahead])
        n, ids = len(place), place.T
        states = np.zeros((WINDOW + 1, n, 2 * h), np.float32)
        step = np.empty((n, 3, 2, h), np.float32)
        for k in range(WINDOW):
            step[:, :, 0] = fore[ids[k]].reshape(n, 3, h)
            step[:, :, 1] = back[ids[WINDOW - 1 - k]].reshape(n, 3, h)
            now, xs = states[k], step.reshape(n, 6 * h)
            r = now @ t["u"]
            g = np.tanh(xs[:, : 4 * h] + r[:, : 4 * h])
            g *= 0.5
            g += 0.5
            r = r[:, 4 * h :]
            r *= g[:, 2 * h :]
            r += xs[:, 4 * h :]
            np.tanh(r, out=r)
            r -= now
            r *= g[:, : 2 * h]
            np.add(now, r, out=states[k + 1])
        both = np.concatenate([states[1:, :, :h], states[:0:-1, :, h:]], 2)
        score = both @ self.p["attend"]
        score[ids < 0] = -1e9
        score -= score.max(0)
        np.exp(score, out=score)
        score /= score.sum(0)
        return (score * (both @ self.p["out"])).sum(0) + self.p["bias"][0]

    def scores(self, texts: list, codes: Codes) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in slices(texts, 400_000):
            words = [words_of(t) for t in texts[a:b]]
            sizes = np.array([len(w) for w in words], np.int64)
            if self.constant is not None:
                out[a:b] = np.where(sizes > 0, self.constant, 0.0)
                continue
            flat = np.fromiter((codes[w] for text in words for w in text), np.int64, int(sizes.sum()))
            place, text = windows(sizes)
            best = np.full(b - a, -np.inf)
            for i in range(0, len(place), 2048):
                np.maximum.at(best, text[i : i + 2048], self.window_logits(flat, place[i : i + 2048]))
            out[a:b] = np.where(best == -np.inf, 0.0, 1 / (1 + np.exp(-np.clip(best, -60, 60))))
        return out


def _forward(p: dict, codes: np.ndarray, place: np.ndarray) -> dict:
    """All states of a batch of windows, for training."""
    h, n = HIDDEN, len(place)
    c = np.where(place >= 0, codes[place], 0)
    none = place < 0
    e = sum(p[k][ids] for k, ids in parts_of(c).items())
    x = e @ p["wx"] + p["bx"]
    x[none, :h] = x[none, 3 * h : 4 * h] = OFF
    run = {"c": c, "none": none, "e": e, "steps": ([], []), "h": np.zeros((n, WINDOW, 2 * h), np.float32)}
    for d in range(2):
        now = np.zeros((n, h), np.float32)
        for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
            z, r, cand, q = _tanh_gates(now, x[:, t, d * 3 * h : (d + 1) * 3 * h], p["u"][d])
            run["steps"][d].append((t, now, z, r, cand, q))
            now = now + z * (cand - now)
            run["h"][:, t, d * h : (d + 1) * h] = now
    s = run["h"] @ p["attend"]
    s[none] = -1e9
    s = np.exp(s - s.max(1, keepdims=True))
    run["a"] = s / s.sum(1, keepdims=True)
    run["v"] = run["h"] @ p["out"]
    run["logit"] = (run["a"] * run["v"]).sum(1) + p["bias"][0]
    return run


def _backward(p: dict, run: dict, dlogit: np.ndarray) -> dict:
    h = HIDDEN
    g = {k: np.zeros_like(v) for k, v in p.items()}
    a, v, states = run["a"], run["v"], run["h"]
    pooled = (a * v).sum(1, keepdims=True)
    dv = a * dlogit[:, None]
    ds = a * (v - pooled) * dlogit[:, None]
    g["out"], g["attend"], g["bias"] = np.einsum("ntk,nt->k", states, dv), np.einsum("ntk,nt->k", states, ds), np.array([dlogit.sum()], np.float32)
    dh_all = dv[..., None] * p["out"] + ds[..., None] * p["attend"]
    dx = np.zeros((len(a), WINDOW, 6 * h), np.float32)
    for d in range(2):
        u, dh = p["u"][d], np.zeros((len(a), h), np.float32)
        for t, before, z, r, cand, q in reversed(run["steps"][d]):
            dh = dh + dh_all[:, t, d * h : (d + 1) * h]
            dcand = dh * z * (1 - cand * cand)
            dz = dh * (cand - before) * z * (1 - z)
            dr = dcand * q * r * (1 - r)
            dx[:, t, d * 3 * h : (d + 1) * 3 * h] = np.concatenate([dz, dr, dcand], 1)
            inner = np.concatenate([dz, dr, dcand * r], 1)
            g["u"][d] += before.T @ inner
            dh = dh * (1 - z) + inner @ u.T
    dx[run["none"]] = 0
    g["bx"] = dx.sum((0, 1))
    g["wx"] = np.einsum("ntk,ntj->kj", run["e"], dx)
    de = (dx @ p["wx"].T)[~run["none"]]
    c = run["c"][~run["none"]]
    for k, ids in parts_of(c).items():
        np.add.at(g[k], ids, de)
    return g


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network:
    """Fit the network on labelled texts. With one label only, every text with a word scores that label."""
    if len(set(labels)) < 2:
        return Network([], {}, float(labels[0]) if labels else 0.0)
    words = [words_of(t) for t in texts]
    y = np.array(labels, np.float32)
    seen = Counter(w for text in words for w in set(text))
    vocabulary = [w for w, _ in sorted(((w, n) for w, n in seen.items() if n >= LEAST_SEEN), key=lambda x: (-x[1], x[0]))[:VOCABULARY]]
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    h = HIDDEN
    p = {
        "word": normal(len(vocabulary) + 1, WIDTH, scale=0.1),
        **{k: normal(1 << bits, WIDTH, scale=0.02) for k, (_, bits) in PIECES.items()},
        "wx": normal(WIDTH, 6 * h, scale=WIDTH**-0.5),
        "bx": np.zeros(6 * h, np.float32),
        "u": normal(2, h, 3 * h, scale=h**-0.5),
        "attend": normal(2 * h, scale=0.3),
        "out": normal(2 * h, scale=0.3),
        "bias": np.zeros(1, np.float32),
    }
    codes = Codes(vocabulary)
    flat = np.array([codes[w] for text in words for w in text], np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    of_text, rate_bad = np.repeat(np.arange(len(words)), sizes), float(y.mean())
    for i, (k, ids) in enumerate(parts_of(flat).items()):  # start a coordinate at how far an input stands with label 1
        texts_with = np.unique(ids * len(words) + of_text)
        with_id, label = texts_with // len(words), y[texts_with % len(words)]
        n, bad = np.bincount(with_id, minlength=len(p[k])), np.bincount(with_id, label, minlength=len(p[k]))
        p[k][:, i] = np.clip((bad - n * rate_bad) / np.sqrt(n * rate_bad * (1 - rate_bad) + 1) / 5, -0.5, 2)
    place, text = windows(sizes)
    first = np.searchsorted(text, np.arange(len(words) + 1))
    usable = np.flatnonzero(np.diff(first) > 0)
    m, s, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, len(usable))))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(usable)
        for i in range(0, len(order), BATCH):
            docs = order[i : i + BATCH]
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            of = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
            run = _forward(p, flat, place[rows])
            top = np.full(len(docs), -np.inf, np.float32)
            np.maximum.at(top, of, run["logit"])
            e = np.exp(run["logit"] - top[of])
            total = np.bincount(of, e, len(docs))
            logit = (np.bincount(of, e * run["logit"], len(docs)) / total).astype(np.float32)
            dl = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y[docs]) / len(docs)
            g = _backward(p, run, (dl[of] * e / total[of]).astype(np.float32))
            step += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.01 * (g[k] * g[k] - s[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
    return Network(vocabulary, p).ready()


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Network:
    """Train on at most ``rows`` documents of each label that are not held out and have at most ``chars`` characters,
    the first in the order of a hash of their id. A document with several labels counts as toxic if one says so. Null labels and texts without a word teach nothing."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = docs.select("doc_id", F.length("text").alias("n")).where(F.col("n").between(1, chars)).join(known, "doc_id")
    sizes = sizes.dropDuplicates(["doc_id"]).withColumn("h", F.xxhash64("doc_id"))
    chosen = [sizes.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(rows) for label in (0, 1)]
    picked = chosen[0].unionByName(chosen[1]).select("doc_id", "toxic", "h")  # at most twice ``rows``
    texts = docs.select("doc_id", text_or_empty("text").alias("text")).where(F.length("text").between(1, chars))
    sample = sorted(texts.join(F.broadcast(picked), "doc_id").collect(), key=lambda r: (r["toxic"], r["h"], r["doc_id"], r["text"]))
    return train([r["text"] for r in sample], [r["toxic"] for r in sample])


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row of ``docs``. Texts without a word (null, empty, marks only) score 0. Repeated rows
    give repeated rows, an empty table none; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # bounded by VOCABULARY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        codes = Codes(network.vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.scores(batch.column(1).to_pylist(), codes))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double")


def without_toxic(docs: DataFrame, network: Network, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        codes = Codes(network.vocabulary)
        for batch in batches:
            yield batch.filter(pa.array(network.scores(batch.column(at).to_pylist(), codes) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    network = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, network).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
