"""Toxicity by a bidirectional gated recurrent network with attention pooling, over word and character inputs.

Trained in numpy on a bounded sample of labelled texts; a text's score is that of its worst window, and every window
(WINDOW words, each starting STRIDE words after the one before) of every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numtext import mix, slices, words

WINDOW, STRIDE = 24, 12
WORD_DIMS, CHAR_DIMS, HIDDEN, ATTEND = 12, 12, 10, 8
CHAR_BUCKETS = 4096
PER_CLASS = 1000
MAX_WORDS = 700
DROPPED = 0.4
THRESHOLD = 0.7
BLOCK = 4096
PART = 24
_CASE = np.arange(256, dtype=np.uint32)
_CASE[65:91] += 32


def parts(h: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray, most: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words, those of more than `most` bytes cut into parts that are words of their own: all of a long run of characters is read."""
    n = -(-(e - s) // most)
    if not len(n) or n.max() == 1:
        return h, s, e, first
    of = np.repeat(np.arange(len(h)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = s[of] + k * most
    own = np.where(n[of] > 1, mix(h[of] + (k + 1).astype(np.uint64)), h[of])
    return own, at, np.minimum(at + most, e[of]), np.concatenate([[0], np.cumsum(n)])[first]


def char_grams(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of '<word>' for each word, and how many each has (flat)."""
    length = e - s
    first = np.repeat(np.cumsum(length) - length, length)
    k = np.arange(int(length.sum())) - first
    row = np.repeat(np.arange(len(s)), length)
    at = s[row] + k
    mid = _CASE[buf[at]]
    left = np.where(k > 0, _CASE[buf[np.maximum(at - 1, 0)]], np.uint32(1))
    right = np.where(k + 1 < length[row], _CASE[buf[np.minimum(at + 1, len(buf) - 1)]], np.uint32(2))
    h = (left * np.uint32(0x9E3779B1) + mid * np.uint32(0x85EBCA77) + right * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(16)
    return (h % np.uint32(CHAR_BUCKETS)).astype(np.int64), length


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters are float32 arrays in `p`. Word vectors exist for the vocabulary only; row 0 is for all other words."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 11):
        r = np.random.default_rng(seed)
        n = lambda *shape, scale=0.3: (r.standard_normal(shape) * scale).astype(np.float32)
        self.vocabulary = np.sort(vocabulary)
        d, h = WORD_DIMS + CHAR_DIMS, HIDDEN
        self.p = {"word": n(len(vocabulary) + 1, WORD_DIMS, scale=0.1), "char": n(CHAR_BUCKETS, CHAR_DIMS), "attend": n(2 * h, ATTEND), "attend_b": np.zeros(ATTEND, np.float32), "query": n(ATTEND), "out": n(2 * h), "bias": np.zeros(1, np.float32)}
        self.p["word"][0] = 0
        for side in "fb":
            self.p |= {f"w{side}": n(d, 3 * h), f"u{side}": n(h, 3 * h), f"b{side}": np.zeros(3 * h, np.float32)}
        self.shift, self.slope = 0.0, 1.0

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """Row of each word's vector."""
        if not len(self.vocabulary):
            return np.zeros(len(ids), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, ids), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == ids, at + 1, 0)

    def inputs(self, row: np.ndarray, grams: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Vectors of distinct words: the word's own beside the mean of its trigrams'."""
        starts = np.cumsum(length) - length
        chars = np.add.reduceat(self.p["char"][grams], starts) / length[:, None] if len(length) else np.zeros((0, CHAR_DIMS), np.float32)
        return np.hstack([self.p["word"][row], chars.astype(np.float32)])

    def run(self, gates: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. gates: input parts of the gates for each distinct word and side; at: words of each window."""
        h, (n, t) = HIDDEN, at.shape
        states, saved = np.zeros((t, n, 2 * h), np.float32), {}
        for side, steps, col in (("f", range(t), 0), ("b", range(t - 1, -1, -1), h)):
            u, now, hold = self.p[f"u{side}"], np.zeros((n, h), np.float32), []
            for k in steps:
                g = gates[side][at[:, k]]
                a = now @ u
                zr = sigmoid(g[:, : 2 * h] + a[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(g[:, 2 * h :] + r * a[:, 2 * h :])
                m = mask[:, k, None]
                new = now + m * (1 - z) * (c - now)
                if keep:
                    hold.append((k, now, z, r, c, a[:, 2 * h :], m))
                now = new
                states[k, :, col : col + h] = now
            saved[side] = hold
        u = np.tanh(states @ self.p["attend"] + self.p["attend_b"])
        e = u @ self.p["query"] + np.where(mask.T > 0, 0, -1e9).astype(np.float32)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * states).sum(0)
        logit = pooled @ self.p["out"] + self.p["bias"]
        return (logit, (states, u, w, pooled, saved)) if keep else logit

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {s: x @ self.p[f"w{s}"] + self.p[f"b{s}"] for s in "fb"}

    def backward(self, d_logit: np.ndarray, held, x: np.ndarray, at: np.ndarray, row: np.ndarray, grams: np.ndarray, length: np.ndarray) -> dict[str, np.ndarray]:
        h, (states, u, w, pooled, saved) = HIDDEN, held
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["bias"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pool = d_logit[:, None] * self.p["out"]
        d_states = w[:, :, None] * d_pool
        d_w = (states * d_pool).sum(2)
        d_e = w * (d_w - (w * d_w).sum(0))
        g["query"] = np.tensordot(d_e, u, ([0, 1], [0, 1]))
        d_u = d_e[:, :, None] * self.p["query"] * (1 - u * u)
        g["attend"] = np.tensordot(states, d_u, ([0, 1], [0, 1]))
        g["attend_b"] = d_u.sum((0, 1))
        d_states = d_states + d_u @ self.p["attend"].T
        d_x = np.zeros_like(x)
        for side, col in (("f", 0), ("b", h)):
            d_gate, d_now = np.zeros((len(x), 3 * h), np.float32), np.zeros((len(at), h), np.float32)
            for k, before, z, r, c, a, m in reversed(saved[side]):
                d = d_now + d_states[k, :, col : col + h]
                d_c = m * d * (1 - z) * (1 - c * c)
                d_z = -m * d * (c - before) * z * (1 - z)
                d_r = d_c * a * r * (1 - r)
                d_in = np.hstack([d_z, d_r, d_c])
                d_a = np.hstack([d_z, d_r, d_c * r])
                g[f"u{side}"] += before.T @ d_a
                d_now = d * (1 - m * (1 - z)) + d_a @ self.p[f"u{side}"].T
                np.add.at(d_gate, at[:, k], d_in)
            g[f"w{side}"], g[f"b{side}"] = x.T @ d_gate, d_gate.sum(0)
            d_x += d_gate @ self.p[f"w{side}"].T
        np.add.at(g["word"], row, d_x[:, :WORD_DIMS])
        g["word"][0] = 0
        np.add.at(g["char"], grams, np.repeat(d_x[:, WORD_DIMS:] / length[:, None], length, axis=0))
        return g


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows, and the text of each; first: as from words(). A text's last window starts in its last STRIDE words."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][doc] + k * STRIDE, doc


def prepared(buf: np.ndarray, offsets: np.ndarray):
    """Distinct words of consecutive texts with their inputs, and for each window its words and mask."""
    h, s, e, first = parts(*words(buf, offsets, lower=True, trim=3))
    if not len(s):
        return None
    ids, one, back = np.unique(h, return_index=True, return_inverse=True)
    grams, length = char_grams(buf, s[one], e[one])
    start, doc = windows(first)
    return ids, grams, length, back.reshape(-1), start, doc, first


def window_words(back: np.ndarray, start: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = start[:, None] + np.arange(WINDOW)
    mask = at < first[1:][doc][:, None]
    return back[np.where(mask, at, start[:, None])], mask.astype(np.float32)


def logits(net: Network, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The worst window's logit of each text; -inf for texts without words."""
    out = np.full(len(offsets) - 1, -np.inf, np.float32)
    ready = prepared(buf, offsets)
    if ready is None:
        return out
    ids, grams, length, back, start, doc, first = ready
    gates = net.gates(net.inputs(net.rows(ids), grams, length))
    for lo in range(0, len(start), BLOCK):
        some = slice(lo, lo + BLOCK)
        at, mask = window_words(back, start[some], doc[some], first)
        np.maximum.at(out, doc[some], net.run(gates, at, mask))
    return out


def unlearned() -> Network:
    """Says the same of every text, where there is nothing to tell classes apart by."""
    net = Network(np.zeros(0, np.uint64))
    net.p["out"][:] = 0
    net.p["bias"][:] = -2
    return net


def fit(texts: list[str], labels: np.ndarray, steps: int = 700, batch: int = 192, seed: int = 5) -> Network:
    """Trains on windows: at first every window bears its text's label, later a toxic text's worst window only."""
    data = [t.encode() for t in texts]
    buf = np.frombuffer(b"".join(data), np.uint8)
    offsets = np.cumsum([0, *map(len, data)])
    ready = prepared(buf, offsets)
    if ready is None or labels.min(initial=1) == labels.max(initial=0):
        return unlearned()
    ids, grams, length, back, start, doc, first = ready
    seen = np.bincount(np.unique(np.stack([np.repeat(np.arange(len(texts)), np.diff(first)), back]), axis=1)[1], minlength=len(ids))
    net = Network(ids[seen >= 4])
    row, r = net.rows(ids), np.random.default_rng(seed)
    starts = np.cumsum(length) - length
    part = np.arange(len(texts)) % 5 == 4  # held back to place the threshold
    own = labels[doc]
    if len(set(own.tolist())) < 2:  # a class whose texts have no word
        return unlearned()
    if len(set(own[~part[doc]].tolist())) < 2:  # too few texts to hold any back
        part[:] = False
    toxic, clean = np.flatnonzero((own == 1) & ~part[doc]), np.flatnonzero((own == 0) & ~part[doc])
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    hard = clean
    for step in range(1, steps + 1):
        if step > steps // 3 and step % (steps // 6) == 1:
            gates = net.gates(net.inputs(row, grams, length))
            scores = np.concatenate([net.run(gates, *window_words(back, start[lo : lo + BLOCK], doc[lo : lo + BLOCK], first)) for lo in range(0, len(start), BLOCK)])
            order = np.lexsort((-scores, doc))
            worst = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
            toxic = worst[(labels[doc[worst]] == 1) & ~part[doc[worst]]]
            hard = worst[(labels[doc[worst]] == 0) & ~part[doc[worst]]]
        pick = np.concatenate([r.choice(toxic, batch // 2), r.choice(clean, batch // 4), r.choice(hard, batch // 4)])
        at, mask = window_words(back, start[pick], doc[pick], first)
        used, at = np.unique(at, return_inverse=True)
        at = at.reshape(len(pick), WINDOW)
        some_length = length[used]
        some = grams[np.repeat(starts[used], some_length) + np.arange(int(some_length.sum())) - np.repeat(np.cumsum(some_length) - some_length, some_length)]
        vectors = np.where(r.random(len(used)) < DROPPED, 0, row[used])  # now and then only the characters speak
        x = net.inputs(vectors, some, some_length)
        logit, held = net.run(net.gates(x), at, mask, keep=True)
        y = np.concatenate([np.ones(batch // 2), np.zeros(2 * (batch // 4))]).astype(np.float32)
        g = net.backward((sigmoid(logit) - y) / len(pick), held, x, at, vectors, some, some_length)
        rate = 0.02 * (1 - step / (steps + 1)) + 0.002
        for k, v in net.p.items():
            m1[k] += 0.1 * (g[k] - m1[k])
            m2[k] += 0.01 * (g[k] * g[k] - m2[k])
            v -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)
    worst = logits(net, buf, offsets)
    place(net, worst[part], labels[part]) if len(set(labels[part].tolist())) == 2 else place(net, worst, labels)
    return net


def place(net: Network, worst: np.ndarray, labels: np.ndarray) -> None:
    """Shifts logits so that THRESHOLD falls where held-back texts are told apart best (middle of the best gap; ties: the widest)."""
    cuts = np.unique(worst[np.isfinite(worst)])
    if len(cuts) < 2:
        return
    mids = (cuts[1:] + cuts[:-1]) / 2
    y = labels == 1
    tp = np.array([(worst[y] >= c).mean() for c in mids])
    fp = np.array([(worst[~y] >= c).mean() for c in mids])
    value = np.round(tp - 3 * fp, 6)  # a clean text that is called toxic costs three times as much
    good = np.flatnonzero(value == value.max())
    best = good[np.argmax(cuts[good + 1] - cuts[good])]
    net.shift = float(mids[best])


def calibrated(net: Network, logit: np.ndarray) -> np.ndarray:
    return sigmoid(logit.astype(np.float64) - net.shift + np.log(THRESHOLD / (1 - THRESHOLD)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, max_words: int = MAX_WORDS) -> Network:
    """Fits on at most about per_class texts of each class, of at most max_words words, taken by a hash of the text.

    Null labels and texts, and ids whose labels contradict each other, are left out; copies of a text count once in its class. Where a class has no
    text with a word, every text gets one score.
    """
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").drop("other")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter(F.col("text").isNotNull())
    short = rows.filter(F.size(F.split("text", r"[\x20\x09-\x0D]+")) <= max_words).withColumn("h", F.xxhash64("text"))
    keyed = short.select("id", "h").join(marks, "id")  # no text is shuffled
    totals = {r["y"]: r["n"] for r in keyed.groupBy("y").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}  # different texts: copies count once
    share = F.coalesce(*[F.when(F.col("y") == k, F.lit(min(1.0, per_class / max(1, v)))) for k, v in totals.items()], F.lit(0.0))
    sample = keyed.filter(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)).groupBy("y", "h").agg(F.min("id").alias("id"))  # about per_class rows a class
    got = sorted({(r["h"], r["text"], r["y"]) for r in short.join(F.broadcast(sample), ["id", "h"]).select("h", "text", "y").toLocalIterator()})
    return fit([t for _, t, _ in got], np.array([y for _, _, y in got], np.int64))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for every row: sigmoid of the worst window of the whole text, placed so that THRESHOLD parts the classes.
    Texts that are null or have no word score 0. Only id and text are read; ids are passed on as they are."""
    held = docs.sparkSession.sparkContext.broadcast(net)  # some 100,000 numbers
    schema = docs.select(F.col(f"`{id_col}`").alias("id"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(calibrated(held.value, logits(held.value, buf, offsets)))], names=["id", "score"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
