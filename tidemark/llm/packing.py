"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

Tokens are counted once, in pieces of at most `size`. The histogram has at most `size` bins, whatever the input; the driver
packs it into patterns with counts, and pieces find their place by their rank among pieces of equal length.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numtext import CACHES, trim
from .workspace import Workspace, bound_arrow_batches

CACHE_ENTRIES = 500_000
KEPT_ENTRIES = 100_000  # from one task to the next
LONG_TEXT = 1 << 20
#: Words of Latin letters that end where the tokenizer's own pattern would end them, runs of plain punctuation, other runs without
#: white space, white space. Each piece is encoded alike alone and in its text.
PIECES = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\s.,;:!?]|\Z)|[.,;:!?]+(?=\s|\Z)| ?\S+|\s+(?!\S)|\s+")
PLAIN = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+")
#: White space for Python, not for the tokenizer.
ODD_SPACE = re.compile("[\x1c-\x1f]")
CUT = re.compile(r"(?<=\S) (?=\S)")
_encoders: dict[str, Encoder] = {}
CACHES.append(_encoders)


class Encoder:
    """A byte-level BPE tokenizer with a bounded memory of pieces it has encoded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part; threads of their own cost memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before; what is used again moves on

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            trim()
            _encoders[path] = cls(path)
        return _encoders[path]

    def rest(self) -> None:
        """Between tasks: Spark hands these to idle workers in turn, and each worker keeps what it has. The pieces met first, the frequent ones, stay."""
        self.known, self.older = dict(islice(self.known.items(), KEPT_ENTRIES)), {}
        trim()

    def _learn(self, new: list[str]) -> None:
        known, rest = self.known, []
        plain = [p for p in new if PLAIN.fullmatch(p) or rest.append(p)]
        for lo in range(0, len(plain), 2000):  # many words in one call; the tokens that open with a space tell them apart
            some = plain[lo : lo + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(some):
                rest += some
                continue
            raw, at = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            known.update(zip(some, (raw[a:b] for a, b in zip(at, at[1:], strict=False)), strict=True))
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else (), strict=True):
            known[p] = array("I", e.ids).tobytes()

    def _parts(self, text: str) -> Iterator[str]:
        """A long text in parts that the tokenizer treats alike: cut before single spaces."""
        at = 0
        while len(text) - at > LONG_TEXT and (m := CUT.search(text, at + LONG_TEXT)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for lo in range(0, len(texts), 256):
            some = texts[lo : lo + 256]
            if sum(map(len, some)) <= LONG_TEXT:
                yield from self._few(some)
            else:
                for t in some:
                    yield b"".join(x for part in self._parts(t) for x in self._few([part]))

    def _few(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_ENTRIES:
            self.older, self.known = self.known, {}
        cut = [None if ODD_SPACE.search(t) else PIECES.findall(t) for t in texts]
        new = set().union(*(c for c in cut if c)).difference(self.known)
        if new:
            again = new & self.older.keys()
            self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
            self._learn(list(new - again))
        get = self.known.__getitem__
        return [array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut, strict=True)]


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids (with end_id last): (id, start, length, ids_crc32, doc_tokens, part, rank_in_part[, ids]).

    part and rank_in_part number the pieces of one length within a task; write the result before using them.
    """
    kind = dict(docs.select(F.col(f"`{id_col}`").alias("id")).dtypes)["id"]
    schema = f"id {kind}, start long, length int, ids_crc32 long, doc_tokens long, part int, rank_in_part long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = Encoder.of(tokenizer), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        tail = array("I", [end_id]).tobytes()
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            bodies: list[bytes] = []
            for i, ids in enumerate(enc.encode([t or "" for t in batch.column("text").to_pylist()])):
                ids += tail
                total = len(ids) // 4
                for start in range(0, total, size):
                    body = ids[4 * start : 4 * (start + size)]
                    n = len(body) // 4
                    for col, v in zip(rows, (i, start, n, zlib.crc32(body), total, seen[n]), strict=True):
                        col.append(v)
                    seen[n] += 1
                    if with_ids:
                        bodies.append(body)
            cols = [batch.column("id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64()), pa.array(np.full(len(rows[0]), part, np.int32)), pa.array(rows[5], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(bodies, pa.binary())] * with_ids, names=[x.split()[0] for x in schema.split(", ")])
        enc.rest()

    bound_arrow_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Patterns (count, lengths) that use every length as often as the histogram says. Lengths are placed longest first, each
    into the packs with most room; pieces that fit nowhere open packs."""
    packs: dict[int, list[tuple[int, tuple]]] = {}  # room -> (count, pattern as (pattern before, length))
    rooms = np.zeros(size + 1, bool)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            open_ = np.flatnonzero(rooms[length:])
            room = int(open_[-1]) + length if len(open_) else size
            count, before = packs[room].pop() if len(open_) else (-(-left // (size // length)), ())  # opened packs take more of the same
            use = min(count, left)
            if count > use:
                packs[room].append((count - use, before))
            if room in packs and not packs[room]:
                rooms[room] = False
            packs.setdefault(room - length, []).append((use, (before, length)))
            rooms[room - length] = room > length
            left -= use
    out = []
    for same in packs.values():
        for count, pattern in same:
            lengths = []
            while pattern:
                pattern, length = pattern
                lengths.append(length)
            out.append((count, lengths[::-1]))
    return out


def slots(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each row of slots, the first sequence of its pattern, the offset there and the pattern's count.

    The slots of one length in a pattern stand in a row. Each length opens and splits a few packs at most, so there are about three
    patterns a length, and a pattern of 2048 tokens has 63 different lengths at most: under 20 MB, however many pieces there are.
    """
    used: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for count, lengths in patterns:
        offset = 0
        for n, same in groupby(lengths):
            times = len(list(same))
            out.setdefault(n, []).append((used.get(n, 0), sequence, offset, count))
            used[n] = used.get(n, 0) + count * times
            offset += n * times
        sequence += count
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in out.items()}


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Where each piece of each document goes: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Null and empty texts are documents of the one id end_id. Repeated rows and ids are documents of their own, a null id is
    kept as it is, other columns are not read. An empty table gives no pieces. Texts of any length stream in bounded parts.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    cut = ws.table(pieces(docs, tokenizer, size, end_id, id_col, text_col, with_ids), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ws.table(counts.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    where = spark.sparkContext.broadcast(slots(shortest_pack_first(histogram, size)))  # of bounded size

    schema = ", ".join(f"{c} {t}" for c, t in cut.dtypes if c not in ("part", "rank_in_part")) + ", sequence_id long, offset long"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                n = int(length[rows[0]])
                first, base, offset, count = where.value[n]
                k = np.searchsorted(first, rank[rows], "right") - 1
                place, pack = np.divmod(rank[rows] - first[k], count[k])
                seq[rows], off[rows] = base[k] + pack, offset[k] + place * n
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    ranked = cut.join(bases.select("part", "length", "base"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("rank_in_part"))
    return ranked.select(*[c for c in cut.columns if c not in ("part", "rank_in_part")], "rank").mapInArrow(put, schema).withColumnRenamed("id", id_col)
