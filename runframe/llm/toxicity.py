"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is cut into overlapping windows of words; all windows are scored and the highest logit decides. A word
enters as its own vector (if it is in the vocabulary) beside the mean of its character trigram vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runframe.llm.common import fold, free_name, lengths_to_starts, ranges, schema_with, texts, with_column
from runframe.llm.decontaminate import words_of

HIDDEN, WORD, CHAR, TRIGRAMS = 8, 8, 8, 4096
WINDOW, STRIDE = 32, 24


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def trigram_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character trigrams of marked words, and where each word's begin."""
    flat = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), np.uint8).astype(np.int64)
    sizes = np.array([len(w) for w in words])
    at = ranges(lengths_to_starts(sizes + 2)[:-1], sizes)
    return (flat[at] * 65599 + flat[at + 1] * 257 + flat[at + 2] * 31) % TRIGRAMS, lengths_to_starts(sizes)[:-1]


def windows(starts: np.ndarray, rows: np.ndarray, empty: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word rows [WINDOW, n], words of each window, text of each window); unused places and empty texts hold ``empty``."""
    sizes = np.diff(starts)
    count = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(sizes)), count)
    first = (np.arange(len(owner)) - lengths_to_starts(count)[owner]) * STRIDE
    length = np.clip(sizes[owner] - first, 1, WINDOW)
    at = starts[owner] + first + np.arange(WINDOW)[:, None]
    used = (np.arange(WINDOW)[:, None] < length) & (sizes[owner] > 0)
    padded = np.append(rows, empty)
    return padded[np.where(used, at, len(rows))], length, owner


class Network:
    """Weights, and passes over a batch of windows that hold rows of a table of word vectors."""

    def __init__(self, vocabulary: dict[bytes, int], seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.vocabulary = vocabulary
        self.w = {"word": np.zeros((len(vocabulary) + 1, WORD), np.float32), "char": draw(TRIGRAMS, CHAR) * 4}
        for d in ("f", "b"):
            self.w |= {f"x{d}": draw(WORD + CHAR, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32),
                       f"u{d}": draw(HIDDEN, 3 * HIDDEN)}
        self.w |= {"att": draw(2 * HIDDEN, HIDDEN), "attv": draw(HIDDEN, 1)[:, 0], "out": draw(2 * HIDDEN, 1)[:, 0],
                   "bias": np.zeros(1, np.float32)}

    def vectors(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """Input vectors of words; the last row, of no word, is zero."""
        ids = np.array([self.vocabulary.get(x, -1) for x in words] + [-1])
        x = np.zeros((len(words) + 1, WORD + CHAR), np.float32)
        x[:, :WORD] = self.w["word"][ids]  # the last vector stays zero: unknown words
        parts = ()
        if words:
            buckets, begin = trigram_rows(words)
            n = np.diff(np.append(begin, len(buckets)))
            x[:-1, WORD:] = np.add.reduceat(self.w["char"][buckets], begin, axis=0) / n[:, None]
            parts = (buckets, np.repeat(np.arange(len(words)), n), n)
        return x, (ids, parts)

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.w[f"x{d}"] + self.w[f"c{d}"] for d in "fb"}

    def forward(self, gates: dict[str, np.ndarray], rows: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logit of every window; with ``keep`` also what the backward pass needs."""
        n, h3 = rows.shape[1], HIDDEN
        states, kept = {}, {"f": [], "b": []}
        inside = np.arange(WINDOW)[:, None] < length
        for d in "fb":
            h, u = np.zeros((n, h3), np.float32), self.w[f"u{d}"]
            out = np.zeros((WINDOW, n, h3), np.float32)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                a, g = gates[d][rows[t]], h @ u
                zr = sigmoid(a[:, :2 * h3] + g[:, :2 * h3])
                z, r = zr[:, :h3], zr[:, h3:]
                new = np.tanh(a[:, 2 * h3:] + r * g[:, 2 * h3:])
                m = inside[t][:, None]
                after = np.where(m, new + z * (h - new), h)
                if keep:
                    kept[d].append((t, h, z, r, new, g[:, 2 * h3:]))
                out[t] = h = after
            states[d] = out
        both = np.concatenate([states["f"], states["b"]], 2)
        hidden = np.tanh(both @ self.w["att"])
        s = np.where(inside, hidden @ self.w["attv"], -np.inf)
        s = np.exp(s - s.max(0))
        attention = s / s.sum(0)
        pooled = np.einsum("tn,tnk->nk", attention, both)
        logit = pooled @ self.w["out"] + self.w["bias"][0]
        return (logit, (kept, both, hidden, attention, pooled, inside)) if keep else logit

    def gradients(self, x: np.ndarray, made: tuple, rows: np.ndarray, length: np.ndarray, label: np.ndarray,
                  weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross entropy of windows."""
        logit, (kept, both, hidden, attention, pooled, inside) = self.forward(self.gates(x), rows, length, keep=True)
        w, g, h3 = self.w, {}, HIDDEN
        d_logit = (weight * (sigmoid(logit) - label) / len(label)).astype(np.float32)
        g["bias"], g["out"] = d_logit.sum(keepdims=True), pooled.T @ d_logit
        d_pooled = d_logit[:, None] * w["out"]
        d_both = attention[:, :, None] * d_pooled
        d_att = np.einsum("tnk,nk->tn", both, d_pooled)
        d_s = attention * (d_att - (attention * d_att).sum(0))
        g["attv"] = np.einsum("tnk,tn->k", hidden, d_s)
        d_hidden = d_s[:, :, None] * w["attv"] * (1 - hidden ** 2)
        g["att"] = np.einsum("tnk,tnj->kj", both, d_hidden)
        d_both += d_hidden @ w["att"].T
        d_x = np.zeros_like(x)
        for d, part in (("f", d_both[:, :, :h3]), ("b", d_both[:, :, h3:])):
            u, d_u, d_a = w[f"u{d}"], np.zeros_like(w[f"u{d}"]), np.zeros((len(x), 3 * h3), np.float32)
            d_h = np.zeros_like(pooled[:, :h3])
            for t, h, z, r, new, gn in reversed(kept[d]):
                m = inside[t][:, None]
                total = d_h + part[t]
                d_new = np.where(m, total * (1 - z) * (1 - new ** 2), 0)
                d_z = np.where(m, total * (h - new) * z * (1 - z), 0)
                d_r = d_new * gn * r * (1 - r)
                gate = np.concatenate([d_z, d_r, d_new], 1)
                back = np.concatenate([d_z, d_r, d_new * r], 1)
                d_u += h.T @ back
                d_h = np.where(m, total * z, total) + back @ u.T
                np.add.at(d_a, rows[t], gate)
            g[f"u{d}"], g[f"c{d}"], g[f"x{d}"] = d_u, d_a.sum(0), x.T @ d_a
            d_x += d_a @ w[f"x{d}"].T
        ids, parts = made
        g["word"] = np.zeros_like(w["word"])
        np.add.at(g["word"], ids, d_x[:, :WORD])
        g["word"][-1] = 0
        g["char"] = np.zeros_like(w["char"])
        if parts:
            buckets, owner, n = parts
            np.add.at(g["char"], buckets, (d_x[:-1, WORD:] / n[:, None])[owner])
        return g


def _numbered(batch: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, each word's number in the row of all words, and where each text starts."""
    words = [words_of(t) for t in batch]
    number: dict[bytes, int] = {}
    rows = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64, sum(map(len, words)))
    return list(number), rows, lengths_to_starts(np.array([len(w) for w in words], np.int64))


def fit(docs: list[bytes], labels: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.02, least_share: float = 0.005,
        max_vocabulary: int = 30_000, seed: int = 5) -> Network:
    """Trains on windows of labelled texts: first any windows, later those that now score highest in their text.

    Words in fewer than ``least_share`` of the texts (or in two texts only) have no vector of their own. Small samples are
    gone through more often. At the end the bias moves to the cut that separates the texts' scores best.
    """
    from collections import Counter

    seen: Counter = Counter()
    for d in docs:
        seen.update(set(words_of(d)))
    epochs = max(epochs, min(40, 8_000 // max(1, len(docs))))
    common = sorted((w for w, n in seen.items() if n >= max(3, least_share * len(docs))), key=lambda w: (-seen[w], w))[:max_vocabulary]
    net = Network({w: i for i, w in enumerate(common)})
    if not len(docs) or labels.min() == labels.max():
        net.w["out"][:] = 0
        net.w["bias"][:] = 3.0 if len(docs) and labels[0] else -3.0
        return net
    rng = np.random.default_rng(seed)
    words, rows, starts = _numbered(docs)
    placed, length, owner = windows(starts, rows, len(words))
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    fade = 0.01 * min(1, len(docs) / 1000)
    step, share = 0, np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    for epoch in range(epochs):
        order = rng.random(placed.shape[1])
        if epoch >= 2:
            order = order * 0.3 - score_windows(net, words, placed, length)
        rank = np.lexsort((order, owner))
        place = np.arange(len(rank)) - np.searchsorted(owner[rank], owner[rank])
        chosen = rng.permutation(rank[place < 4])
        for i in range(0, len(chosen), batch):
            pick = chosen[i:i + batch]
            used, local = np.unique(placed[:, pick], return_inverse=True)
            own = [words[k] for k in used if k < len(words)]
            x, made = net.vectors(own)
            local = local.reshape(WINDOW, len(pick))
            g = net.gradients(x, made, np.where(placed[:, pick] == len(words), len(own), local), length[pick],
                              labels[owner[pick]], share[owner[pick]])
            step += 1
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                if k in ("word", "char"):  # what only a few texts say fades
                    net.w[k] *= np.float32(1 - fade)
                net.w[k] -= (rate * 0.1 ** (epoch / epochs) * (first[k] / (1 - 0.9 ** step))
                             / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    top = np.full(len(docs), -np.inf, np.float32)
    np.maximum.at(top, owner, score_windows(net, words, placed, length))
    net.w["bias"] -= best_cut(top, labels)
    return net


def best_cut(scores: np.ndarray, labels: np.ndarray) -> np.float32:
    """The middle of the gap between scores that leaves the fewest texts, equally weighted, on the wrong side."""
    order = np.argsort(scores)
    ranked, y = scores[order], labels[order]
    wrong = np.concatenate([[0], np.cumsum(y == 1)]) + np.concatenate([[0], np.cumsum(y[::-1] == 0)])[::-1]
    gaps = np.concatenate([[ranked[0] - 1], ranked, [ranked[-1] + 1]])
    width = np.diff(gaps)
    at = np.lexsort((-width, wrong))[0]
    return np.float32((gaps[at] + gaps[at + 1]) / 2)


def score_windows(net: Network, words: list[bytes], placed: np.ndarray, length: np.ndarray, block: int = 4096) -> np.ndarray:
    gates = net.gates(net.vectors(words)[0])
    return np.concatenate([net.forward(gates, placed[:, i:i + block], length[i:i + block])
                           for i in range(0, placed.shape[1], block)])


def score_texts(net: Network, batch: list[bytes]) -> np.ndarray:
    if not batch:
        return np.zeros(0)
    words, rows, starts = _numbered(batch)
    placed, length, owner = windows(starts, rows, len(words))
    top = np.full(len(batch), -np.inf)
    np.maximum.at(top, owner, score_windows(net, words, placed, length))
    return sigmoid(top)


def train(docs: DataFrame, labels: DataFrame, sample: int = 1000, id: str = "doc_id", text: str = "text",
          label: str = "toxic") -> Network:
    """Fits on at most ``sample`` labelled texts of either label, chosen by a hash of the id.

    Rows without id or label are left out; contradicting labels count as 1; of repeated ids the smallest text is read.
    """
    own = (labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).cast("long").alias("_i"))
           .agg(F.max(label).cast("int").alias("_y")))
    pick = None
    for y in (0, 1):
        some = own.where(F.col("_y") == y).orderBy(F.xxhash64("_i"), "_i").limit(sample)
        pick = some if pick is None else pick.unionByName(some)
    chosen = docs.select(F.col(id).cast("long").alias("_i"), F.coalesce(text, F.lit("")).alias("_t")).join(
        F.broadcast(pick), "_i").groupBy("_i").agg(F.min("_t").alias("_t"), F.first("_y").alias("_y"))
    rows = sorted(chosen.collect())  # at most 2 * sample texts
    return fit([r["_t"].encode() for r in rows], np.array([r["_y"] for r in rows], np.float32))


def toxicity(docs: DataFrame, net: Network, text: str = "text", out: str = "score", chars: int = 3_000_000) -> DataFrame:
    """``docs`` with the highest toxicity (0 to 1) of all windows of the whole text; a null text is empty.

    Every row gets its score, repeated ones the same; a column named ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, scores, first, size = texts(batch, text), [], 0, 0
            for i, t in enumerate(values):
                size += len(t)
                if size >= chars or i + 1 == len(values):
                    scores.append(score_texts(shared.value, values[first:i + 1]))
                    first, size = i + 1, 0
            yield with_column(batch, out, pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64()))

    return docs.mapInArrow(add, schema_with(docs, out, T.DoubleType()))


def learn_only(df: DataFrame, id: str = "doc_id") -> DataFrame:
    """Rows whose labels may be learnt from."""
    return df.where(fold(id, 5) != 0)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    net = train(docs, learn_only(labels))
    return toxicity(docs.select("doc_id", "text"), net).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more."""
    name = free_name(docs, "toxicity")
    return toxicity(docs, train(docs, learn_only(labels), **options), out=name).where(F.col(name) < 0.5).select(*docs.columns)
