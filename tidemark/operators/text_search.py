"""Many names in many texts by one automaton, and substring search by an inverted index of trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES_BYTES = 1 << 20  # names that go to the tasks at once
STATES = 1 << 15  # of one automaton: some 32 MB
LANE = 2048


class Automaton:
    """All names in one pass over the bytes: a trie whose missing steps lead where the longest suffix that is a prefix of a name leads."""

    def __init__(self, names: list[bytes]):
        step, own = [[-1] * 256], [[]]
        for k, name in enumerate(names):
            at = 0
            for b in name:
                if step[at][b] < 0:
                    step[at][b] = len(step)
                    step.append([-1] * 256)
                    own.append([])
                at = step[at][b]
            own[at].append(k)
        self.step = np.array(step, np.int32)
        fall = np.zeros(len(step), np.int64)
        layer = np.array([0])
        while len(layer):  # states of one depth at a time
            parent, b = np.nonzero(self.step[layer] >= 0)
            child, parent = self.step[layer[parent], b], layer[parent]
            fall[child] = np.where(parent == 0, 0, self.step[fall[parent], b]) if layer[0] or len(layer) > 1 else 0
            miss = self.step[layer] < 0
            rest = self.step[fall[layer]] if layer[0] or len(layer) > 1 else np.zeros((1, 256), np.int32)
            self.step[layer] = np.where(miss, np.maximum(rest, 0), self.step[layer])
            for s in child.tolist():
                own[s] = own[s] + own[fall[s]]
            layer = child
        self.first = np.cumsum([0, *map(len, own)])
        self.found = np.array([k for x in own for k in x], np.int64)
        self.size = np.array([len(x) for x in names], np.int64)
        self.longest = int(self.size.max(initial=1))

    def matches(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, name, end) of all occurrences, overlapping ones too. The bytes are read in lanes that step together; each begins early enough to know
        the names that reach into it."""
        lo, hi = int(offsets[0]), int(offsets[-1])
        begin = np.arange(lo, hi, LANE)
        lead = self.longest - 1
        state = np.zeros(len(begin), np.int64)
        ends, at = [], []
        start = np.zeros(hi - lo + 1, bool)
        start[offsets - lo] = True
        for k in range(-lead, LANE):
            pos = begin + k
            live = np.flatnonzero((pos >= lo) & (pos < hi))
            p = pos[live]
            now = self.step[np.where(start[p - lo], 0, state[live]), buf[p]]
            state[live] = now
            if k >= 0:
                hit = self.first[now + 1] > self.first[now]
                ends.append(p[hit] + 1)
                at.append(now[hit])
        if not ends:
            return (np.zeros(0, np.int64),) * 3
        ends, at = np.concatenate(ends), np.concatenate(at)
        n = self.first[at + 1] - self.first[at]
        name = self.found[np.repeat(self.first[at], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        ends = np.repeat(ends, n)
        return np.searchsorted(offsets, ends - 1, "right") - 1, name, ends

    def counts(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, name, n): how often each name occurs from left to right without overlaps of its own."""
        text, name, end = self.matches(buf, offsets)
        order = np.lexsort((end, name, text))
        text, name, end = text[order], name[order], end[order]
        head = np.ones(len(text), bool)
        head[1:] = (text[1:] != text[:-1]) | (name[1:] != name[:-1])
        first = np.flatnonzero(head)
        n = np.diff(first, append=len(text))
        close = np.zeros(len(text), bool)
        close[1:] = ~head[1:] & (end[1:] - end[:-1] < self.size[name[1:]])
        group = np.cumsum(head) - 1
        for g in np.unique(group[close]).tolist():  # names that overlap themselves here: greedily
            last, count = -1, 0
            for e in end[first[g] : first[g] + n[g]].tolist():
                if e - self.size[name[first[g]]] >= last:
                    last, count = e, count + 1
            n[g] = count
        return text[first], name[first], n


def _automata(names: list[bytes]) -> Iterator[tuple[int, Automaton]]:
    lo, size = 0, 0
    for k, x in enumerate(names):
        if size + len(x) > STATES and k > lo:
            yield lo, Automaton(names[lo:k])
            lo, size = k, 0
        size += len(x)
    if lo < len(names):
        yield lo, Automaton(names[lo:])


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(key, name, mentions) for every text that holds a name: how often, without overlaps of the name with itself. Empty and null names and texts
    hold nothing; names count once.

    Texts are read where they lie, once for each NAMES_BYTES of names, which go to the tasks in order; no pairs are made but those that match.
    """
    kind = dict(texts.dtypes)[key]
    spark = texts.sparkSession
    schema = f"key {kind}, name string, mentions long"
    out, block, size = None, [], 0

    def search(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            data = [x.encode() for x in held.value]
            ready = list(_automata(data))
            for batch in batches:
                for lo in range(0, len(batch), 512):
                    piece = batch.slice(lo, 512)
                    col = piece.column("text").fill_null("").cast(pa.large_string())
                    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
                    if not len(col) or offsets[0] == offsets[-1]:
                        continue
                    buf = np.frombuffer(col.buffers()[2], np.uint8)
                    for first, a in ready:
                        i, j, n = a.counts(buf, offsets)
                        if len(i):
                            yield pa.RecordBatch.from_arrays([piece.column("key").take(pa.array(i)), pa.array(held.value[first:], pa.string()).take(pa.array(j)), pa.array(n)], names=["key", "name", "mentions"])

        return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)

    for r in names.select(name).filter(F.length(name) > 0).distinct().sort(name).toLocalIterator():
        block.append(r[0])
        size += len(r[0].encode())
        if size >= NAMES_BYTES:
            part = search(spark.sparkContext.broadcast(block))
            out, block, size = part if out is None else out.unionByName(part), [], 0
    if block or out is None:
        part = search(spark.sparkContext.broadcast(block))
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"key": key})


def trigrams(text: Column) -> Column:
    """The different runs of three characters of a text, without regard to case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?s)(?=(...))"), F.lit(1)))


def write_index(texts: DataFrame, key: str, columns: list[str], to: str, parts: int | None = None) -> None:
    """Postings (gram, column, key), sorted by gram over all files, so that a search reads the row groups of its grams only."""
    grams = [texts.select(F.explode(trigrams(F.col(c))).alias("gram"), F.lit(c).alias("column"), F.col(key).alias("key")) for c in columns]
    all_ = grams[0]
    for g in grams[1:]:
        all_ = all_.unionByName(g)
    ranged = all_.repartitionByRange(parts, "gram", "key") if parts else all_.repartitionByRange("gram", "key")
    ranged.sortWithinPartitions("gram", "key").write.mode("overwrite").option("parquet.block.size", 1 << 20).parquet(to)


def candidates(spark: SparkSession, index: str, pattern: str) -> DataFrame | None:
    """(key) of the texts with all trigrams of a pattern in one column; None for a pattern of fewer than three characters, which has none."""
    low = pattern.lower()
    grams = sorted({low[k : k + 3] for k in range(len(low) - 2)})
    if not grams:
        return None
    posted = spark.read.parquet(index).filter(F.col("gram").isin(grams))
    return posted.groupBy("key", "column").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("key").distinct()


def grounding(spark: SparkSession, texts: DataFrame, key: str, index: str, patterns: dict[str, str]) -> DataFrame:
    """Rows of texts that hold one of the patterns in its column (column -> pattern), without regard to case. Candidates come from the index and are
    verified; a pattern that the index cannot help with is looked for in all texts."""
    like = lambda c, p: F.contains(F.lower(c), F.lit(p.lower()))
    wanted = None
    for c, p in patterns.items():
        wanted = like(c, p) if wanted is None else wanted | like(c, p)
    found = [candidates(spark, index, p) for p in patterns.values()]
    if any(f is None for f in found):
        return texts.filter(wanted)
    keys = found[0]
    for f in found[1:]:
        keys = keys.unionByName(f)
    return texts.join(keys.distinct(), texts[key] == keys["key"], "left_semi").filter(wanted)
