"""Repeated byte spans by matching statistics against run-length indexes.

A window of WINDOW bytes is given the least of its GRAM-byte grams as anchor; equal windows have equal anchors at equal places. The windows that share
one anchor in a text are a context, at most 2 * WINDOW - GRAM bytes long. Anchors are counted in Spark; a context whose anchor occurs once holds
no repeat. Contexts that are equal as a whole are settled by grouping them (all but the first are removed), so copies of any number cost one entry. What
remains, different contexts of one anchor, is where repeats begin, end or are edited: they are ranked by place, and every pair is compared once,
level by level of a binary tree over the ranks (the earlier half indexed, the later half streamed), so a match is always an earlier one.
Index and stream are those of `run_index`. A context is removed from the first to the last window that occurs earlier.

An anchor of more than HOT different contexts does not come to one task: its windows are grouped one by one by their digest instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numtext import mix
from .run_index import RunIndex, gather
from .substring_dedup import BUCKETS_PER_SHARD, Bucket, bucketed, sliding
from .workspace import Workspace, bound_arrow_batches, flagged, shards

WINDOW = 100
GRAM = 32
HOT = 1 << 14
PIECE = 1 << 18
BATCH = 1 << 20  # bytes of one index
_SPOT = np.uint64((1 << 20) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA24BAED4963EE407, 0x9FB21C651E98DF25)]


def grams(buf: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k bytes (a multiple of 8)."""
    m = len(buf) - k + 1
    words = mix(np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,)).copy())
    out = words[:m] * _ODD[0]
    for j in range(8, k, 8):
        out += words[j : j + m] * (_ODD[j // 8 % 4] + np.uint64(2 * (j // 32)))
    return mix(out)


def contexts(buf: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of (start, end, anchor) of all contexts of consecutive texts, in bytes of buf.

    Of equal grams in a window the first is the anchor. Pieces of about PIECE bytes bound the working memory; a context on a piece's edge
    becomes two, which lets none of its windows go.
    """
    for lo in range(int(offsets[0]), int(offsets[-1]), PIECE):
        hi = min(int(offsets[-1]), lo + PIECE + window - 1)
        if hi - lo < window:
            continue
        h = grams(buf[lo:hi], gram)
        least = sliding((h & ~_SPOT) | np.arange(len(h), dtype=np.uint64), window - gram + 1, True)
        at = (least & _SPOT).astype(np.int64)
        text = np.searchsorted(offsets, np.arange(lo, lo + len(at)), "right")  # empty texts have no bytes
        at[np.arange(lo, lo + len(at)) + window > offsets[text]] = -1
        change = np.flatnonzero(np.diff(at, prepend=-2))
        stop = np.append(change[1:], len(at))
        real = at[change] >= 0
        yield change[real] + lo, stop[real] + lo + window - 1, h[at[change[real]]]


OCCURRENCES = "h long, d long, id long, b long, doc int, start int, size int"


def occurrences(window: int, gram: int):
    """A bucket's contexts: anchor, digest of the bytes, and place."""

    def run(table: pa.Table) -> pa.Table:
        t = Bucket(table, hashes=False)
        data = memoryview(t.data) if t.data is not None else memoryview(b"")
        digest = xxhash.xxh3_64_intdigest
        cols: list[list[np.ndarray]] = [[] for _ in range(5)]
        for s, e, h in contexts(t.buf, t.offsets, window, gram):
            doc = np.searchsorted(t.offsets, s, "right") - 1
            d = np.fromiter((digest(data[x:y]) for x, y in zip(s.tolist(), e.tolist(), strict=True)), np.uint64, len(s))
            for col, v in zip(cols, (h.view(np.int64), d.view(np.int64), doc, s - t.offsets[doc], e - s), strict=True):
                col.append(v)
        h, d, doc, start, size = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
        ids = t.ids[doc] if len(doc) else np.zeros(0, np.int64)
        return pa.table([pa.array(h, pa.int64()), pa.array(d, pa.int64()), pa.array(ids, pa.int64()), pa.array(np.full(len(h), t.b), pa.int64()), *(pa.array(x.astype(np.int32)) for x in (doc, start, size))], names=["h", "d", "id", "b", "doc", "start", "size"])

    return run


CONTEXTS = "h long, hot boolean, id long, b long, doc int, start int, bytes binary"


def fetch(table: pa.Table, asked: pa.Table) -> pa.Table:
    """The bytes of a bucket's contexts."""
    if not len(asked) or not len(table):
        return pa.table({"h": pa.array([], pa.int64()), "hot": pa.array([], pa.bool_()), "id": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "doc": pa.array([], pa.int32()), "start": pa.array([], pa.int32()), "bytes": pa.array([], pa.binary())})
    t = Bucket(table, hashes=False)
    asked = asked.sort_by([("doc", "ascending"), ("start", "ascending")]).combine_chunks()
    col = lambda c: asked.column(c).to_numpy().astype(np.int64)
    body, at = gather(t.buf, t.offsets[col("doc")] + col("start"), col("size"))
    got = pa.Array.from_buffers(pa.binary(), len(asked), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
    return asked.select(["h", "hot", "id", "b", "doc", "start"]).append_column("bytes", got)


SPANS = "b long, doc int, start int, stop int"


def _spaces(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Namespaces of sorted groups: (namespace, context, whether it is streamed). Two contexts of a group meet in the one level of the highest bit
    in which their ranks differ; the earlier is indexed, the later streamed."""
    head = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(head, append=len(group))
    rank = np.arange(len(group)) - np.repeat(head, size)
    many = np.repeat(size, size)
    parts = []
    for level in range(int(size.max() - 1).bit_length()):
        block = rank >> (level + 1)
        use = np.flatnonzero((block << (level + 1)) + (1 << level) < many)
        parts.append((np.stack([group[use], np.full(len(use), level), block[use]]), use, (rank[use] >> level) & 1))
    key, use, later = (np.concatenate([p[k] for p in parts], -1) for k in range(3))
    order = np.lexsort((use, *key[::-1]))
    key, use, later = key[:, order], use[order], later[order]
    space = np.cumsum((np.diff(key, axis=1, prepend=-1) != 0).any(0)) - 1
    return space, use, later.astype(bool)


def repeated_windows(buf: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of every window of a context that occurs in an earlier context of its group. Contexts are sorted by group (0, 1, ...),
    within one by place."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    if not len(group) or np.bincount(group).max() < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space, use, later = _spaces(group)
    total = np.cumsum(np.bincount(space, np.where(later, 0, size[use])))
    batch = (total // BATCH).astype(np.int64)[space]
    for lo, hi in zip(*(lambda e: (e, np.append(e[1:], len(batch))))(np.flatnonzero(np.diff(batch, prepend=-1))), strict=True):
        s, u, streamed = space[lo:hi] - space[lo], use[lo:hi], later[lo:hi]
        old, new = u[~streamed], u[streamed]
        index = RunIndex(buf, start[old], size[old], s[~streamed])
        i, off = index.statistics(buf, start[new], size[new], s[streamed], window)
        out.append((new[i], off))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _merged(owner: np.ndarray, lo: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of [lo, lo + width) of each owner, joined where they meet."""
    order = np.lexsort((lo, owner))
    owner, lo = owner[order], lo[order]
    new = np.ones(len(owner), bool)
    new[1:] = (np.diff(owner) != 0) | (np.diff(lo) > width)
    first = np.flatnonzero(new)
    return owner[first], lo[first], lo[np.append(first[1:], len(lo)) - 1] + width if len(lo) else lo


def resolve(window: int):
    """A task: contexts sorted by anchor and place become the spans of their earlier matches."""

    def spans(table: pa.Table) -> pa.RecordBatch | None:
        col = lambda c: table.column(c).to_numpy()
        body = table.column("bytes").combine_chunks()
        body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
        at = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
        group = np.cumsum(np.diff(col("h"), prepend=col("h")[0]) != 0)
        i, off = repeated_windows(np.frombuffer(body.buffers()[2], np.uint8), at[:-1], np.diff(at), group, window)
        if not len(i):
            return None
        i, lo, hi = _merged(i, off, window)
        begin = col("start")[i]
        return pa.RecordBatch.from_arrays([pa.array(col("b")[i]), pa.array(col("doc")[i]), pa.array((begin + lo).astype(np.int32)), pa.array((begin + hi).astype(np.int32))], names=["b", "doc", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        most = 8 * BATCH
        for batch in batches:
            h = batch.column("h").to_numpy()
            if held and sum(x.nbytes for x in held) >= most and len(h):
                edge = int(np.flatnonzero(h != held[-1].column("h")[-1].as_py())[0]) if (h != held[-1].column("h")[-1].as_py()).any() else len(h)
                held.append(batch.slice(0, edge))
                batch = batch.slice(edge)
                if len(batch):
                    if (out := spans(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
            if len(batch):
                held.append(batch)
        if held and (out := spans(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def windows(window: int):
    """All windows of contexts, by digest; for anchors that are too frequent for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                piece = batch.slice(lo, 1024)
                of, off, digest = [], [], []
                for i, x in enumerate(piece.column("bytes").to_pylist()):
                    for o in range(len(x) - window + 1):
                        of.append(i)
                        off.append(o)
                        digest.append(hashlib.blake2b(x[o : o + window], digest_size=16).digest())
                of = np.array(of, np.int64)
                take = lambda c: piece.column(c).take(pa.array(of))  # noqa: E731,B023
                start = (take("start").to_numpy() + np.array(off)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), take("id"), take("b"), take("doc"), pa.array(start)], names=["w", "id", "b", "doc", "start"])

    return run


def cut_out(with_bytes: bool):
    def run(table: pa.Table, spans: pa.Table) -> pa.Table:
        rows: list[list] = [[] for _ in range(5)]
        ids = pa.chunked_array([pa.array([], pa.int64())])
        if len(table):
            t = Bucket(table, hashes=False)
            ids = t.raw
            gone = np.zeros(len(t.buf) + 1, np.int32)
            if len(spans):
                base = t.offsets[spans.column("doc").to_numpy()]
                np.add.at(gone, base + spans.column("start").to_numpy(), 1)
                np.add.at(gone, base + spans.column("stop").to_numpy(), -1)
                np.cumsum(gone, out=gone)
            gone = gone[:-1] > 0
            for lo, hi in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist(), strict=True):
                own = gone[lo:hi]
                n = int(own.sum())
                body = t.buf[lo:hi][~own].tobytes() if n else t.buf[lo:hi].tobytes()
                runs = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0
                for col, v in zip(rows, (hi - lo, n, runs, hashlib.sha256(body).hexdigest(), body if with_bytes else None), strict=True):
                    col.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        cols = [ids if isinstance(ids, pa.ChunkedArray) else pa.chunked_array([ids]), *(pa.chunked_array([pa.array(c, k)]) for c, k in zip(rows, kinds, strict=True))]
        return pa.table(cols[: 5 + with_bytes], names=names[: 5 + with_bytes])

    return run


PLACE = ("id", "b", "doc", "start")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, with_bytes: bool = False) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256[, kept]) per row, without the bytes that a repeated window covers.

    A window of `window` bytes of the UTF-8 text repeats when the same bytes also start earlier: in a document of smaller id, or earlier in the same
    one. gram: a multiple of 8, at most the window. n_spans counts the maximal runs of removed bytes; `kept` are the remaining bytes, which may
    end inside a character. Rows that repeat an id, and rows without one (which come last), are documents in an order of their own: by bucket (a hash
    of id and text), then text. Null text is empty; texts shorter than the window keep all bytes. Ids are whole numbers. Other columns, whatever
    their names, are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    ws = Workspace(spark, "suffix-dedup")
    n = shards(spark)
    table = bucketed(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")), ws, BUCKETS_PER_SHARD * n)
    ws.drop()
    by = table.groupBy("b")
    place = F.struct(*PLACE)
    found = ws.table(by.applyInArrow(occurrences(window, gram), OCCURRENCES), "occurrences")
    again = ws.table(found.groupBy("h").count().filter("count > 1").select("h"), "again")
    ws.drop()
    found = ws.table(flagged(found, "h", again, "h").filter("__maybe").drop("__maybe"), "candidates")
    ws.drop("occurrences", "again")
    kinds = ws.table(found.groupBy("h", "d").agg(F.min(F.struct(*PLACE, "size")).alias("first"), F.count("*").alias("n")), "kinds")
    ws.drop()
    copies = kinds.filter("n > 1").select("h", "d", F.struct(*[F.col(f"first.{c}") for c in PLACE]).alias("first"))
    spans = [found.join(copies, ["h", "d"]).filter(place != F.col("first")).select("b", "doc", "start", (F.col("start") + F.col("size")).cast("int").alias("stop"))]
    spans[0] = ws.table(spans[0], "copied")
    ws.drop("candidates")
    mixed = kinds.groupBy("h").count().filter("count > 1").withColumn("hot", F.col("count") > hot)
    asked = ws.table(kinds.join(mixed, "h").select("h", "hot", "first.*"), "asked")
    ws.drop("kinds")
    bytes_of = ws.table(by.cogroup(asked.groupBy("b")).applyInArrow(fetch, CONTEXTS), "contexts")
    cold = bytes_of.filter("not hot").drop("hot").repartition(n, "h").sortWithinPartitions("h", *PLACE)
    spans.append(cold.mapInArrow(resolve(window), SPANS))
    if not asked.filter("hot").isEmpty():
        each = ws.table(bytes_of.filter("hot").mapInArrow(windows(window), "w binary, id long, b long, doc int, start int"), "windows")
        first = each.groupBy("w").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        spans.append(each.join(first, "w").filter(place != F.col("first")).select("b", "doc", "start", (F.col("start") + window).cast("int").alias("stop")))
    gone = spans[0]
    for more in spans[1:]:
        gone = gone.unionByName(more)
    gone = ws.table(gone, "spans")
    ws.drop("asked", "contexts", "windows", "copied")
    out = by.cogroup(gone.groupBy("b")).applyInArrow(cut_out(with_bytes), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)
    return out.withColumnRenamed("id", id_col)
