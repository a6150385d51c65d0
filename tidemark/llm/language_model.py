"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays that workers memory-map.

Counts are gathered before each shuffle: a task sends a shard one row with its distinct (context, word) pairs and their counts, so
a frequent word costs a few bytes per task. A shard holds the contexts in a range of hashes; its arrays are one file in
the shared folder. Order two: each order above would shuffle and store about as much again as the text is long.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numtext import mix, shard_of, slices, words
from .workspace import Workspace, dealt, shards, store_of

GATHER_BYTES = 12 << 20
BEGIN = np.uint64(0xB5297A4D3F84D5B5)
END = np.uint64(0x68E31DA4C3B2A197)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
PAIRS = "shard int, contexts binary, runs binary, words binary, counts binary"
WORDS = "shard int, words binary, counts binary, contexts binary, stats array<long>"


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with the end token after each text, the token before each (BEGIN for the first), the text of each, and
    how many tokens each text has."""
    h, _, _, first = words(buf, offsets, lower=True)
    n = np.diff(first) + 1
    last = np.cumsum(n) - 1
    out = np.full(int(n.sum()), END, np.uint64)
    body = np.ones(len(out), bool)
    body[last] = False
    out[body] = h
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[last - n + 1] = BEGIN
    return out, before, np.repeat(np.arange(len(n)), n), n


def _raw(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def pair_rows(docs: DataFrame, n: int) -> DataFrame:
    """The pairs of each stretch of text, a row per shard of the context."""

    def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        word, before = (np.concatenate(x) for x in zip(*held, strict=True))
        names, ids = np.unique(np.concatenate([word, before]), return_inverse=True)
        a, b = ids[len(word) :].astype(np.uint64), ids[: len(word)].astype(np.uint64)
        width = np.uint64(len(names))
        key, count = np.unique(a * width + b, return_counts=True)
        a, b = np.divmod(key, width)
        start = np.flatnonzero(np.diff(a, prepend=width))
        context, run = names[a[start]], np.diff(start, append=len(a))
        shard = shard_of(context, n).astype(np.int64)
        edge = np.searchsorted(shard, np.arange(n + 1))
        at = np.append(start, len(a))
        cols: list[list] = [[] for _ in range(5)]
        for k in range(n):
            lo, hi = edge[k], edge[k + 1]
            if lo < hi:
                p = slice(at[lo], at[hi])
                for col, v in zip(cols, (k, _raw(context[lo:hi], "<u8"), _raw(run[lo:hi], "<u4"), _raw(names[b[p]], "<u8"), _raw(count[p], "<u4")), strict=True):
                    col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["shard", "contexts", "runs", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, buf, offsets in slices(batches, "text"):
            held.append(tokens(buf, offsets)[:2])
            size += int(offsets[-1] - offsets[0])
            if size >= GATHER_BYTES:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    return docs.mapInArrow(run, PAIRS)


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order with the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.diff(key, prepend=~key[:1])) if len(key) else np.zeros(0, np.int64)
    return (key[start], *(np.add.reduceat(v[order], start) if len(start) else v[:0] for v in values))


def store(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line of names, types and lengths, then the arrays. Written aside and renamed, so a task may run twice."""
    where, path = store_of(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    head = " ".join(f"{k}:{v.dtype.str}:{len(v)}" for k, v in arrays.items()).encode()
    aside = f"{path}.{uuid.uuid4().hex}"
    with where.open_output_stream(aside) as out:
        out.write(head.ljust(-(-(len(head) + 1) // 64) * 64 - 1) + b"\n")
        for v in arrays.values():
            out.write(v.tobytes() + b"\0" * (-v.nbytes % 64))
    where.move(aside, path)


_mapped: dict[str, dict[str, np.ndarray]] = {}


def mapped(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a stored file, memory-mapped. From a store without files a worker first takes a copy to map, which has no name any more
    once it is open, and so goes with the worker."""
    if uri not in _mapped:
        where, path = store_of(uri)
        with open(path, "rb") if isinstance(where, pafs.LocalFileSystem) else tempfile.TemporaryFile() as f:
            if not isinstance(where, pafs.LocalFileSystem):
                with where.open_input_stream(path) as src:
                    while data := src.read(1 << 20):
                        f.write(data)
                f.seek(0)
            head = f.readline()
            at, arrays = len(head), {}
            for name, kind, size in (x.split(":") for x in head.decode().split()):
                dtype = np.dtype(kind)
                arrays[name] = np.memmap(f, dtype, "r", at, (int(size),)) if int(size) else np.zeros(0, dtype)
                at += -(-dtype.itemsize * int(size) // 64) * 64
        _mapped[uri] = arrays
    return _mapped[uri]


def lookup(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in a sorted array, and whether it does."""
    if not len(among):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return at, among[at] == keys


def histogram(count: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4."""
    return [int((count == k).sum()) for k in (1, 2, 3, 4)]


def merge_pairs(rows: DataFrame, folder: str, n: int) -> DataFrame:
    """Stores each shard's pairs and contexts; gives for each shard of words their counts and numbers of contexts there."""

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for c, r, w, k in zip(*(table.column(x).to_pylist() for x in ("contexts", "runs", "words", "counts")), strict=True):
            parts.append((np.repeat(np.frombuffer(c, "<u8"), np.frombuffer(r, "<u4")), np.frombuffer(w, "<u8"), np.frombuffer(k, "<u4").astype(np.int64)))
        context, word, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        pair = mix(context * _PAIR + word)
        order = np.argsort(pair, kind="stable")
        pair, context, word, count = pair[order], context[order], word[order], count[order]
        start = np.flatnonzero(np.diff(pair, prepend=~pair[:1]))
        pair, context, word, count = pair[start], context[start], word[start], np.add.reduceat(count, start)
        name, total, n1, n2, n3 = summed(context, count, (count == 1).astype(np.int64), (count == 2).astype(np.int64), (count > 2).astype(np.int64))
        small = lambda x: x.astype("<u4") if len(x) == 0 or x.max() < 2**32 else x.astype("<u8")
        counts = count.astype("<u1") if count.max() < 256 else np.minimum(count, 255).astype("<u1")
        large = np.flatnonzero(count > 254)
        counts[large] = 255
        store(f"{folder}/pairs-{table.column('shard')[0].as_py():06d}", {"pair": pair, "count": counts, "large_pair": pair[large], "large": count[large], "context": name, "total": small(total), "n1": small(n1), "n2": small(n2), "n3": small(n3)})
        stats = histogram(count)
        word, count, contexts = summed(word, count, np.ones(len(word), np.int64))
        edge = np.searchsorted(shard_of(word, n).astype(np.int64), np.arange(n + 1))
        out: list[list] = [[] for _ in range(5)]
        for k in range(n):
            p = slice(edge[k], edge[k + 1])
            if edge[k] < edge[k + 1] or not k:
                for col, v in zip(out, (k, _raw(word[p], "<u8"), _raw(count[p], "<u8"), _raw(contexts[p], "<u4"), stats if not k else [0, 0, 0, 0]), strict=True):
                    col.append(v)
        return pa.table([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:4]), pa.array(out[4], pa.list_(pa.int64()))], names=["shard", "words", "counts", "contexts", "stats"])

    return dealt(rows).applyInArrow(run, WORDS)


def merge_words(rows: DataFrame, folder: str) -> DataFrame:
    """Stores each shard's words; gives its sums: tokens, words, pairs, and how many words have 1, 2, 3, 4 contexts."""

    def run(table: pa.Table) -> pa.Table:
        cols = [np.concatenate([np.frombuffer(x, k) for x in table.column(c).to_pylist()]).astype(t) for c, k, t in (("words", "<u8", "<u8"), ("counts", "<u8", np.int64), ("contexts", "<u4", np.int64))]
        word, count, contexts = summed(*cols)
        store(f"{folder}/words-{table.column('shard')[0].as_py():06d}", {"word": word, "count": count, "contexts": contexts.astype("<u4")})
        return pa.table({"sums": pa.array([[int(count.sum()), len(word), int(contexts.sum()), *histogram(contexts)]], pa.list_(pa.int64()))})

    return dealt(rows).applyInArrow(run, "sums array<long>")


def discounts(n: list[int]) -> np.ndarray:
    """The modified discounts for counts 0, 1, 2, 3 and more from how many have 1, 2, 3, 4; 0.5 times the count where a class is empty."""
    d = [0.0]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    for k in (1, 2, 3):
        v = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 * k
        d.append(min(max(v, 0.05 * k), 0.95 * k))
    return np.array(d)


@dataclass
class Model:
    folder: str
    shards: int
    tokens: int
    words: int
    pairs: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    word_classes: list[int]  # words with 1, 2, 3 and more contexts

    def word_table(self, k: int) -> dict[str, np.ndarray]:
        return mapped(f"{self.folder}/words-{k:06d}")

    def pair_table(self, k: int) -> dict[str, np.ndarray]:
        return mapped(f"{self.folder}/pairs-{k:06d}")

    def by_shard(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Positions of sorted hashes, shard by shard."""
        shard = shard_of(h, self.shards).astype(np.int64)
        edge = np.searchsorted(shard, np.arange(self.shards + 1))
        for k in range(self.shards):
            if edge[k] < edge[k + 1]:
                yield k, np.arange(edge[k], edge[k + 1])

    def score(self, word: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each token in the training text, and its probability after the token before it."""
        names, ids = np.unique(np.concatenate([word, before]), return_inverse=True)
        w, c = ids[: len(word)], ids[len(word) :]
        count, contexts = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        total, free = np.zeros(len(names), np.float64), np.ones(len(names), np.float64)
        d = self.pair_discounts
        key = mix(names[c] * _PAIR + word)
        hits = np.zeros(len(word), np.int64)
        order = np.argsort(c, kind="stable")
        edge = np.searchsorted(c[order], np.arange(len(names) + 1))
        for k, at in self.by_shard(names):
            t = self.word_table(k)
            pos, ok = lookup(names[at], t["word"])
            count[at[ok]], contexts[at[ok]] = t["count"][pos[ok]], t["contexts"][pos[ok]]
            t = self.pair_table(k)
            pos, ok = lookup(names[at], t["context"])
            pos, at_ok = pos[ok], at[ok]
            total[at_ok] = t["total"][pos]
            free[at_ok] = d[1] * t["n1"][pos] + d[2] * t["n2"][pos] + d[3] * t["n3"][pos]
            own = order[edge[at[0]] : edge[at[-1] + 1]]  # tokens whose context lies in this shard
            own = own[np.argsort(key[own])]
            pos, ok = lookup(key[own], t["pair"])
            got = t["count"][pos[ok]].astype(np.int64)
            large = np.flatnonzero(got == 255)
            if len(large):
                got[large] = t["large"][np.searchsorted(t["large_pair"], key[own[ok][large]])]
            hits[own[ok]] = got
        e = self.word_discounts
        rest = e[1] * self.word_classes[0] + e[2] * self.word_classes[1] + e[3] * self.word_classes[2]
        base = 1 / (self.words + 1)
        lower = (np.maximum(contexts - e[np.minimum(contexts, 3)], 0) + rest * base) / max(1, self.pairs) if self.pairs else np.full(len(names), base)
        lower = lower[w]
        seen = total[c] > 0
        upper = (np.maximum(hits - d[np.minimum(hits, 3)], 0) + free[c] * lower) / np.where(seen, total[c], 1)
        return count[w], np.where(seen, upper, lower)


def train(docs: DataFrame, text_col: str = "text", workspace: Workspace | None = None) -> Model:
    """Counts all texts of docs; null is an empty text, which teaches that a text may end at once. No documents: a model that
    knows no word and gives every token the same probability."""
    spark = docs.sparkSession
    ws = workspace or Workspace(spark, "language-model")
    n = shards(spark)
    model = ws.path("model")
    rows = ws.table(merge_pairs(pair_rows(docs.select(F.col(f"`{text_col}`").alias("text")), n), f"{model}", n), "words")
    sums = [r["sums"] for r in merge_words(rows, model).collect()]  # a row per shard
    stats = [int(r or 0) for r in rows.select(*[F.sum(F.col("stats")[k]) for k in range(4)]).first()]
    ws.drop("words")
    total = [sum(s[k] for s in sums) for k in range(7)] if sums else [0] * 7
    # Shards that no context or word fell into have no file: give them empty ones.
    where, path = store_of(model)
    where.create_dir(path, recursive=True)
    there = {x.base_name for x in where.get_file_info(pafs.FileSelector(path))}
    z = np.zeros(0, "<u8")
    for k in range(n):
        if f"words-{k:06d}" not in there:
            store(f"{model}/words-{k:06d}", {"word": z, "count": z, "contexts": z})
        if f"pairs-{k:06d}" not in there:
            store(f"{model}/pairs-{k:06d}", {"pair": z, "count": z, "large_pair": z, "large": z, "context": z, "total": z, "n1": z, "n2": z, "n3": z})
    classes = [total[3], total[4], total[1] - total[3] - total[4]]
    return Model(model, n, total[0], total[1], total[2], discounts(stats), discounts(total[3:7]), classes)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, base_score, score) for every row, its whole text with an end token; log10 probabilities.

    Null and empty texts are the end token alone. Null and repeated ids are passed on. Other columns are not read.
    """
    schema = docs.select(F.col(f"`{id_col}`").alias("id"), *[F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known")], *[F.lit(0.0).alias(c) for c in ("base_score", "score")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offsets in slices(batches, "text", 3 << 20):
            word, before, _, n = tokens(buf, offsets)
            count, p = model.score(word, before)
            start = np.cumsum(n) - n
            base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
            add = lambda x: np.add.reduceat(x, start)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(add((count > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(np.log10(p)))], names=["id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
