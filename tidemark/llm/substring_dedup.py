"""Repeated word spans by De Bruijn compaction.

Edges of the graph are the windows of K words, nodes the K - 1 words that two windows share. Only repeated edges matter, and they
are found by sparse anchors: a window's anchor is the least of its ANCHOR-word grams, equal windows have equal anchors, so a window whose
anchor occurs once in the corpus is unique. Of the rest, a node is passed through when all its occurrences have one word
before and one word after; runs of windows over such nodes are nonbranching paths, whose windows all have the same occurrences. Joins
between documents and nodes cut the documents into occurrences of paths; each carries its source coordinates and a digest of the
words that stand there, and only occurrences with the digest of an earlier one are removed.

Documents lie in buckets, one task each, in a bucketed table; a bucket sends a shard of a hash space each hash once, however often it
occurs, so a passage that very many documents share costs one entry per bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numtext import grams, longs, shard_of, words
from .workspace import Workspace, dealt, labels, shards

WINDOW = 20
ANCHOR = 8
BUCKETS_PER_SHARD = 2
LAST = np.iinfo(np.int64).max
_ONE = np.uint64(1)
_EDGE, _MANY = np.uint64(0), np.uint64(2)  # a text's end; different words. Words are odd.


def bucketed(docs: DataFrame, ws: Workspace, n: int) -> DataFrame:
    """The documents as a bucketed table: later groupings by bucket need no shuffle of texts."""
    known = F.array(*[F.lit(x).cast("long") for x in labels(docs.sparkSession, n)])
    rows = docs.withColumn("b", known[F.pmod(F.xxhash64("id", "text"), F.size(known).cast("long")).cast("int")])
    return ws.bucketed(rows.repartition(n, "b"), "documents", "b", n)


class Bucket:
    """A bucket's documents in order of id (null last), then text, with their words."""

    def __init__(self, table: pa.Table, hashes: bool = True):
        table = table.take(pc.sort_indices(table, [("id", "ascending"), ("text", "ascending")])).combine_chunks()
        self.b = table.column("b")[0].as_py()
        self.ids = pc.fill_null(table.column("id"), LAST).to_numpy()
        self.raw = table.column("id")
        col = pc.fill_null(table.column("text"), "").cast(pa.large_string()).combine_chunks()
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
        self.offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        self.data = col.buffers()[2]
        self.buf = np.frombuffer(self.data, np.uint8) if self.data is not None else np.zeros(0, np.uint8)
        if hashes:
            self.h, self.s, self.e, self.first = words(self.buf, self.offsets)
            self.n = np.diff(self.first)

    def fits(self, k: int) -> np.ndarray:
        """Whether k words from each word on lie in one document."""
        end = np.repeat(self.first[1:], self.n)
        return np.arange(len(self.h)) + k <= end


def sliding(a: np.ndarray, k: int, least: bool) -> np.ndarray:
    """The least (or largest) of every k consecutive numbers."""
    f, width, out = (np.minimum if least else np.maximum), 1, a
    while 2 * width <= k:
        out = f(out[:-width], out[width:])
        width *= 2
    return f(out[: len(a) - k + 1], out[k - width : len(a) - width + 1])


def anchors(t: Bucket, k: int, a: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every window (0 where no window starts), and the grams."""
    if len(t.h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    g = grams(t.h, a) | _ONE  # the last bit is for counts
    least = sliding(g, k - a + 1, True)
    return np.where(t.fits(k)[: len(least)], least, np.uint64(0)), g


BLOBS = "shard int, b long, x binary, y binary"


def _by_shard(b: int, key: np.ndarray, n: int, *more: np.ndarray) -> pa.Table:
    """Rows for the shards of sorted keys."""
    edge = np.searchsorted(shard_of(key, n).astype(np.int64), np.arange(n + 1))
    ks = [k for k in range(n) if edge[k] < edge[k + 1]]
    y = [b"".join(m[edge[k] : edge[k + 1]].tobytes() for m in more) for k in ks]
    return pa.table({"shard": pa.array(ks, pa.int32()), "b": pa.array([b] * len(ks), pa.int64()), "x": pa.array([key[edge[k] : edge[k + 1]].tobytes() for k in ks], pa.binary()), "y": pa.array(y, pa.binary())})


def send_anchors(n: int, k: int, a: int):
    def run(table: pa.Table) -> pa.Table:
        t = Bucket(table)
        own, g = anchors(t, k, a)
        if not len(own):
            return _by_shard(t.b, own, n)
        width = k - a + 1
        padded = np.concatenate([np.zeros(width - 1, np.uint64), own, np.zeros(width - 1, np.uint64)])
        chosen = g[sliding(padded, width, False)[: len(g)] == g]
        key, count = np.unique(chosen, return_counts=True)
        return _by_shard(t.b, key ^ (count == 1).astype(np.uint64), n)  # last bit: whether it occurs again here

    return run


def answer_anchors(table: pa.Table) -> pa.Table:
    """To each bucket its anchors that occur more than once in the corpus."""
    bs = table.column("b").to_pylist()
    parts = [np.frombuffer(x, "<u8") for x in table.column("x").to_pylist()]
    key = np.concatenate(parts)
    of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    again = (key & _ONE).astype(bool)
    key = key | _ONE
    order = np.argsort(key, kind="stable")
    k, o = key[order], of[order]
    start = np.flatnonzero(np.diff(k, prepend=~k[:1]))
    size = np.diff(start, append=len(k))
    many = np.repeat((size > 1) | np.logical_or.reduceat(again[order], start), size)
    k, o = k[many], o[many]
    order = np.argsort(o, kind="stable")
    k, edge = k[order], np.searchsorted(o[order], np.arange(len(parts) + 1))
    use = [i for i in range(len(parts)) if edge[i] < edge[i + 1]]
    return pa.table({"b": pa.array([bs[i] for i in use], pa.int64()), "x": pa.array([k[edge[i] : edge[i + 1]].tobytes() for i in use], pa.binary())})


def _member(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a sorted array and whether keys are there; a bit table spares most searches."""
    at, ok = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    if not len(among):
        return at, ok
    bits = np.zeros(1 << 22, bool)
    bits[(among >> np.uint64(20)) & np.uint64((1 << 22) - 1)] = True
    maybe = np.flatnonzero(bits[(keys >> np.uint64(20)) & np.uint64((1 << 22) - 1)])
    p = np.minimum(np.searchsorted(among, keys[maybe]), len(among) - 1)
    at[maybe], ok[maybe] = p, among[p] == keys[maybe]
    return at, ok


def _received(answers: pa.Table, column: str = "x") -> np.ndarray:
    parts = [np.frombuffer(x, "<u8") for x in answers.column(column).to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _nodes(t: Bucket, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the K - 1 words from each word on, last bit set, and whether they lie in one document."""
    g = grams(t.h, k - 1)
    return g | _ONE, t.fits(k - 1)[: len(g)]


def send_nodes(n: int, k: int, a: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        empty = pa.table({"shard": pa.array([], pa.int32()), "b": pa.array([], pa.int64()), "x": pa.array([], pa.binary()), "y": pa.array([], pa.binary())})
        repeated = _received(answers)
        if not len(table) or not len(repeated):
            return empty
        t = Bucket(table)
        own, _ = anchors(t, k, a)
        if not len(own):
            return empty
        change = np.flatnonzero(np.diff(own, prepend=~own[:1]))
        window = np.repeat(_member(own[change], repeated)[1] & (own[change] > 0), np.diff(change, append=len(own)))
        node, _ = _nodes(t, k)
        touched = np.zeros(len(node), bool)
        touched[: len(window)] |= window
        touched[1 : len(window) + 1] |= window
        at = np.flatnonzero(touched)
        doc = np.searchsorted(t.first, at, "right") - 1
        word = t.h | _ONE
        before = np.where(at > t.first[doc], word[at - 1], _EDGE)
        after = np.where(at + k - 1 < t.first[doc + 1], word[np.minimum(at + k - 1, len(word) - 1)], _EDGE)
        key, low, high, alow, ahigh, count = _gathered(node[at], before, before, after, after, np.ones(len(at), np.int64))
        before, after = np.where(low == high, low, _MANY), np.where(alow == ahigh, alow, _MANY)
        return _by_shard(t.b, key ^ (count == 1).astype(np.uint64), n, before, after)

    return run


def _gathered(key, low, high, alow, ahigh, count):
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.diff(key, prepend=~key[:1])) if len(key) else np.zeros(0, np.int64)
    if not len(start):
        return key, low, high, alow, ahigh, count
    f = lambda g, x: g.reduceat(x[order], start)
    return key[start], f(np.minimum, low), f(np.maximum, high), f(np.minimum, alow), f(np.maximum, ahigh), f(np.add, count)


def answer_nodes(table: pa.Table) -> pa.Table:
    """To each bucket its nodes that occur more than once in the corpus; the last bit says that they branch."""
    bs = table.column("b").to_pylist()
    parts = [np.frombuffer(x, "<u8") for x in table.column("x").to_pylist()]
    sides = [np.frombuffer(y, "<u8").reshape(2, -1) for y in table.column("y").to_pylist()]
    raw = np.concatenate(parts)
    before, after = np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides])
    of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    key, low, high, alow, ahigh, count = _gathered(raw | _ONE, before, before, after, after, np.where(raw & _ONE, 2, 1))
    branch = (low != high) | (low == _MANY) | (alow != ahigh) | (alow == _MANY)
    at = np.searchsorted(key, raw | _ONE)
    keep = np.flatnonzero(count[at] > 1)
    out, o = key[at[keep]] ^ (~branch[at[keep]]).astype(np.uint64), of[keep]
    edge = np.searchsorted(o, np.arange(len(parts) + 1))
    use = [i for i in range(len(parts)) if edge[i] < edge[i + 1]]
    return pa.table({"b": pa.array([bs[i] for i in use], pa.int64()), "x": pa.array([out[edge[i] : edge[i + 1]].tobytes() for i in use], pa.binary())})


PATHS = "shard int, b long, digests binary, ids binary, docs binary, starts binary, ends binary"


def send_paths(n: int, k: int):
    """Occurrences of paths. Of those of one path in a bucket the first goes to the path's shard; the others are settled (shard -1)."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in range(7)]
        known = _received(answers)
        if len(table) and len(known):
            t = Bucket(table)
            node, fits = _nodes(t, k)
            at, ok = _member(node, np.sort(known | _ONE))
            order = np.argsort(known | _ONE, kind="stable")
            branch = ok & ((known[order] & _ONE)[at] == 1) if len(known) else ok
            ok &= fits
            window = ok[:-1] & ok[1:] & t.fits(k)[: len(ok) - 1]
            head = window & ~(np.concatenate([[False], window[:-1]]) & ~branch[:-1])
            start = np.flatnonzero(head)
            stop = np.flatnonzero(window & ~(np.concatenate([window[1:], [False]]) & ~branch[1:])) + k  # words after the last
            doc = np.searchsorted(t.first, start, "right") - 1
            data = memoryview(t.data)
            a, b = t.s[start].tolist(), t.e[stop - 1].tolist()
            digest = b"".join(hashlib.blake2b(b" ".join(bytes(data[x:y]).split()), digest_size=16).digest() for x, y in zip(a, b, strict=True))
            key = np.frombuffer(digest, "<u8").reshape(-1, 2)
            order = np.lexsort((np.arange(len(start)), key[:, 1], key[:, 0]))
            key = key[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]).any(1)
            of = np.where(fresh, shard_of(key[:, 0], n).astype(np.int64), -1)
            for s in np.unique(of):
                rows = np.flatnonzero(of == s)
                i = order[rows]
                for col, v in zip(cols, (int(s), t.b, key[rows].tobytes(), t.ids[doc[i]].tobytes(), doc[i].tobytes(), (start[i] - t.first[doc[i]]).tobytes(), (stop[i] - t.first[doc[i]]).tobytes()), strict=True):
                    col.append(v)
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["shard", "b", "digests", "ids", "docs", "starts", "ends"])

    return run


SPANS = "b long, docs binary, starts binary, ends binary"


def later_paths(table: pa.Table) -> pa.Table:
    """Spans of all occurrences of a path but the first by (id, bucket, document in it, start)."""
    n = [len(x) // 8 for x in table.column("ids").to_pylist()]
    b = np.repeat(np.array(table.column("b").to_pylist(), np.int64), n)
    key = np.concatenate([np.frombuffer(x, "<u8").reshape(-1, 2) for x in table.column("digests").to_pylist()])
    ids, docs, starts, ends = (np.concatenate([np.frombuffer(x, "<i8") for x in table.column(c).to_pylist()]) for c in ("ids", "docs", "starts", "ends"))
    order = np.lexsort((starts, docs, b, ids, key[:, 1], key[:, 0]))
    key = key[order]
    later = np.zeros(len(key), bool)
    later[1:] = (key[1:] == key[:-1]).all(1)
    rows = order[later]
    rows = rows[np.argsort(b[rows], kind="stable")]
    cut = np.split(rows, np.flatnonzero(np.diff(b[rows])) + 1) if len(rows) else []
    return pa.table({"b": pa.array([int(b[r[0]]) for r in cut], pa.int64()), **{c: pa.array([v[r].tobytes() for r in cut], pa.binary()) for c, v in (("docs", docs), ("starts", starts), ("ends", ends))}})


def cut_out(id_type: pa.DataType, with_text: bool):
    def run(table: pa.Table, spans: pa.Table) -> pa.Table:
        names = ["id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
        rows: list[list] = [[] for _ in range(3 + with_text)]
        ids = pa.array([], id_type)
        if len(table):
            t = Bucket(table, hashes=False)
            ids = t.raw
            doc, lo, hi = ((np.concatenate([np.frombuffer(x, "<i8") for x in spans.column(c).to_pylist()]) if len(spans) else np.zeros(0, np.int64)) for c in ("docs", "starts", "ends"))
            order = np.lexsort((lo, doc))
            doc, lo, hi = doc[order], lo[order], hi[order]
            edge = np.searchsorted(doc, np.arange(len(ids) + 1))
            data = memoryview(t.data) if t.data is not None else memoryview(b"")
            for i in range(len(ids)):
                w = bytes(data[t.offsets[i] : t.offsets[i + 1]]).split()
                n = len(w)
                if edge[i] < edge[i + 1]:
                    kept, at = [], 0
                    for a, b in zip(lo[edge[i] : edge[i + 1]].tolist(), hi[edge[i] : edge[i + 1]].tolist(), strict=True):
                        if a > at:
                            kept += w[at:a]
                        at = max(at, b)
                    w = kept + w[at:]
                body = b" ".join(w)
                for col, v in zip(rows, (n, n - len(w), hashlib.sha256(body).hexdigest(), body.decode()), strict=False):
                    col.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table([ids if isinstance(ids, pa.ChunkedArray) else pa.chunked_array([ids]), *(pa.chunked_array([pa.array(c, k)]) for c, k in zip(rows, kinds, strict=False))], names=names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256[, kept]) per document, without the words that a repeated window covers.

    A window of `window` words repeats when its words also start earlier: in a document of smaller id, or earlier in the same one. Rows
    that repeat an id, and rows without one (which come last), are documents in an order of their own: by bucket (a hash of id and
    text), then text. Null text has no words; shorter texts keep all theirs. Ids are whole numbers. Other columns are not read.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "substring-dedup")
    n = shards(spark)
    anchor = min(ANCHOR, max(1, window // 2))
    table = bucketed(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")), ws, BUCKETS_PER_SHARD * n)
    ws.drop()
    by = table.groupBy("b")
    sent = by.applyInArrow(send_anchors(n, window, anchor), BLOBS)
    repeated = ws.table(dealt(sent).applyInArrow(answer_anchors, "b long, x binary"), "anchors")
    sent = by.cogroup(repeated.groupBy("b")).applyInArrow(send_nodes(n, window, anchor), BLOBS)
    nodes = ws.table(dealt(sent).applyInArrow(answer_nodes, "b long, x binary"), "nodes")
    ws.drop("anchors")
    paths = ws.table(by.cogroup(nodes.groupBy("b")).applyInArrow(send_paths(n, window), PATHS), "paths")
    ws.drop("nodes")
    later = dealt(paths.filter("shard >= 0")).applyInArrow(later_paths, SPANS).unionByName(paths.filter("shard < 0").select("b", "docs", "starts", "ends"))
    later = ws.table(later, "spans")
    ws.drop("paths")
    out = by.cogroup(later.groupBy("b")).applyInArrow(cut_out(pa.int64(), with_text), "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
    return out.withColumnRenamed("id", id_col)
