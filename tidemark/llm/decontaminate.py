"""Benchmark decontamination within a word edit distance.

The CGK random walk embeds a window of n words into a string of 3 n symbols, whose Hamming distance follows the edit distance. Each
repetition hashes a few sampled positions of a new walk; a window and an item that agree in one repetition are
compared by exact edit distance. The number of repetitions is set, by simulation on the items themselves, for a target recall.

A text holds an item of n words if one of its windows of exactly n words has an edit distance (insertions, deletions and
substitutions of words) of at most floor(max_rate * n). Words are lower-cased (A-Z) and lose punctuation at their ends.
Only windows that share enough word pairs with the items of n words are embedded: an edit changes two pairs of neighbours at most, so
a window with fewer than n - 1 - 2 * floor(max_rate * n) pairs in common is farther from all of them, and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numtext import grams, mix, slices, words

MAX_RATE = 0.2
RECALL = 0.995
SAMPLED = 3
TRIALS, LEAST_HIT = 240, 1e-3
BLOCK_ITEMS = 4096
BLOCK_BYTES = 8 << 20
SLICE = 8 << 20
WALKS = 512
_PAD = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def walk_keys(w: np.ndarray, repetitions: int, n: int, sampled: int = SAMPLED) -> np.ndarray:
    """The LSH keys of each row of w (windows of n words), a column per repetition: CGK walks read at sampled positions."""
    rng = np.random.default_rng(n)
    take = np.zeros((3 * n, repetitions), bool)
    for r in range(repetitions):
        take[rng.choice(3 * n, min(sampled, 3 * n), replace=False), r] = True
    salt = rng.integers(0, 2**63, take.shape, dtype=np.uint64)
    last = 3 * n - 1 - take[::-1].argmax(0)
    order = np.argsort(-last, kind="stable")  # a walk ends at the last place that is read
    walking = np.searchsorted(-last[order], -np.arange(3 * n), "right").tolist()
    reads = [np.flatnonzero(t) for t in take[:, order]]
    salt = np.ascontiguousarray(salt[:, order])[:, :, None]
    key = np.zeros((repetitions, len(w)), np.uint64)
    for lo in range(0, len(w), WALKS):
        some = w[lo : lo + WALKS]
        flat = np.hstack([some, np.full((len(some), 2 * n), _PAD)]).ravel()  # no walk of 3 n steps leaves its row
        at = np.tile(np.arange(len(some)) * (3 * n), (repetitions, 1))
        symbol = np.empty(at.shape, np.uint64)
        for j, m in enumerate(walking[: int(last.max()) + 1]):
            here = symbol[:m]
            np.take(flat, at[:m], out=here, mode="clip")
            if len(rows := reads[j]):
                key[rows, lo : lo + WALKS] = mix(key[rows, lo : lo + WALKS] + here[rows])
            here ^= salt[j, :m]
            here *= _STEP
            here >>= np.uint64(63)
            at[:m] += here.view(np.int64)
    out = np.empty_like(key)
    out[order] = key
    return out.T


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Edit distance of row pairs of two arrays of n words, or more than `most` where it is larger.

    Row i of the table holds its cells i - most to i + most alone; what lies outside is farther. What stands beside b is never read by a
    cell that counts.
    """
    n, pairs = a.shape[1], len(a)
    kind = np.int16 if 2 * n + most < 1 << 15 else np.int32
    a, wide = np.ascontiguousarray(a.T), np.zeros((n + 2 * most, pairs), np.uint64)
    wide[most : most + n] = b.T
    step = np.arange(2 * most + 1, dtype=kind)[:, None]
    cells = np.repeat(np.where(step >= most, step - kind(most), kind(most + 1)).astype(kind), pairs, axis=1)
    for i in range(n):
        now = cells + (wide[i : i + 2 * most + 1] != a[i])
        np.minimum(now[:-1], cells[1:] + kind(1), out=now[:-1])
        now -= step
        far = 1
        while far <= 2 * most:  # inserted words
            np.minimum(now[far:], now[:-far], out=now[far:])
            far *= 2
        cells = now + step
    return cells[most].astype(np.int32)


@dataclass
class Group:
    """Items of one length."""

    n: int
    most: int
    items: np.ndarray  # rows of words
    number: np.ndarray  # of the item in the block
    keys: list[tuple[np.ndarray, np.ndarray]]  # for each repetition: sorted keys, row of each


class Index:
    """A block of items, by length; the lengths whose items have a word pair are bits of the pair's mask (64 lengths to a mask)."""

    def __init__(self, ids: list, texts: list[str | None], max_rate: float = MAX_RATE, recall: float = RECALL):
        data = [(t or "").encode() for t in texts]
        h, _, _, first = words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), lower=True, trim=3)
        self.ids, self.groups = ids, []
        sizes = np.diff(first)
        for n in sorted(set(sizes.tolist()) - {0}):
            number = np.flatnonzero(sizes == n)
            items = np.stack([h[first[k] : first[k] + n] for k in number])
            most = int(max_rate * n)
            keys = []
            for k in walk_keys(items, self.repetitions(items, n, most, recall), n).T:
                order = np.argsort(k, kind="stable")
                keys.append((k[order], order))
            self.groups.append(Group(n, most, items, number, keys))
        own = [np.unique([grams(w, 2) for w in g.items]) if g.n > 1 else np.zeros(0, np.uint64) for g in self.groups]
        self.pairs = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        self.masks = np.zeros((-(-len(self.groups) // 64), len(self.pairs) + 1), np.uint64)
        for c, pairs in enumerate(own):
            self.masks[c // 64, np.searchsorted(self.pairs, pairs) + 1] |= np.uint64(1 << (c % 64))
        self.tables = self._tables()

    @staticmethod
    def repetitions(items: np.ndarray, n: int, most: int, recall: float) -> int:
        """How many repetitions find an item after `most` random edits with the wanted probability, from simulated edits of the items (a
        chance below LEAST_HIT cannot be told from none there and counts as LEAST_HIT). Some items are harder than the mean: its chance counts 0.6."""
        if not most:
            return 1
        rng = np.random.default_rng(n)
        trial = np.repeat(items, -(-TRIALS // len(items)), axis=0)
        changed = []
        for row in trial:
            w = row.tolist()
            for _ in range(most):
                kind, at = rng.integers(3), int(rng.integers(len(w)))
                new = int(rng.integers(2**62))
                if kind == 0:
                    w[at] = new
                elif kind == 1:
                    w.insert(at, new)
                elif len(w) > 1:
                    del w[at]
            changed.append((w + [int(x) for x in rng.integers(2**62, size=n)])[:n])
        other = np.array(changed, np.uint64)
        hit = (walk_keys(trial, 12, n) == walk_keys(other, 12, n)).mean()
        return max(4, int(np.ceil(np.log(1 - recall) / np.log(1 - np.clip(0.6 * hit, LEAST_HIT, 0.99)))))

    def _tables(self) -> list[tuple[np.uint64, np.ndarray]]:
        """Direct-address tables from a pair's hash to its number + 1; pairs that meet in one go on to the next."""
        bits, left, out = max(12, int(np.log2(len(self.pairs) + 1)) + 6), np.arange(len(self.pairs)), []
        while len(left):
            table = np.zeros(1 << bits, np.uint32)
            salt = np.uint64(int(_STEP) * (2 * len(out) + 1) % 2**64 | 1)
            slot = (self.pairs[left] * salt) >> np.uint64(64 - bits)
            table[slot[::-1]] = left[::-1] + 1
            out.append((salt, table))
            left = left[table[slot] != left + 1]
        return out

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Each pair's number + 1 among the block's pairs, or 0."""
        out = np.zeros(len(h), np.uint32)
        known = np.concatenate([np.zeros(1, np.uint64), self.pairs])
        for salt, table in self.tables:
            got = table[(h * salt) >> np.uint64(64 - (len(table).bit_length() - 1))]
            np.copyto(out, got, where=(known[got] == h) & (got > 0))
        return out

    def search(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, first word) for every text and item that it holds: the nearest window, of these the first."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        if not len(h) or not self.groups:
            return []
        number = self.numbers(grams(h, 2))
        c32 = np.empty(len(number) + 1, np.int32)
        for c, g in enumerate(self.groups):
            if c % 64 == 0:
                mask = self.masks[c // 64][number]
            if len(h) < g.n:
                continue
            c32[0] = 0
            np.cumsum((mask >> np.uint64(c % 64)).astype(np.uint8) & np.uint8(1), out=c32[1:])
            start = np.flatnonzero(c32[g.n - 1 :] - c32[: len(c32) - g.n + 1] >= g.n - 1 - 2 * g.most) if g.n > 1 else np.flatnonzero(np.isin(h, g.items))
            if not len(start):
                continue
            doc = np.searchsorted(first, start, "right") - 1
            ok = start + g.n <= first[doc + 1]
            start, doc = start[ok], doc[ok]
            for lo in range(0, len(start), 1 << 12):
                self._match(h, g, start[lo : lo + (1 << 12)], doc[lo : lo + (1 << 12)], first, best)
        return [(d, k, dist, at) for (d, k), (dist, at) in sorted(best.items())]

    def _match(self, h: np.ndarray, g: Group, start: np.ndarray, doc: np.ndarray, first: np.ndarray, best: dict) -> None:
        w = h[start[:, None] + np.arange(g.n)]
        _, one, same = np.unique(grams(w.ravel(), g.n)[:: g.n], return_index=True, return_inverse=True)  # equal windows are compared once
        w, order = w[one], np.argsort(same, kind="stable")
        edge = np.searchsorted(same[order], np.arange(len(w) + 1))
        pairs = []
        for mine, (keys, row) in zip(walk_keys(w, len(g.keys), g.n).T, g.keys, strict=True):
            lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            n = hi - lo
            win = np.repeat(np.arange(len(w)), n)
            item = row[np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            pairs.append(win * len(g.items) + item)
        found = np.unique(np.concatenate(pairs))
        for lo in range(0, len(found), 1 << 14):
            win, item = np.divmod(found[lo : lo + (1 << 14)], len(g.items))
            far = edit_distance(w[win], g.items[item], g.most)
            for k in np.flatnonzero(far <= g.most):
                for x in order[edge[win[k]] : edge[win[k] + 1]]:
                    d, at = int(doc[x]), int(start[x] - first[doc[x]])
                    key, new = (d, int(g.number[item[k]])), (int(far[k]), at)
                    if key not in best or new < best[key]:
                        best[key] = new


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """The items in blocks of bounded number and size, one on the driver at a time."""
    ids, texts, held = [], [], 0
    for r in benchmark.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        held += len(r["t"] or "")
        if len(ids) >= BLOCK_ITEMS or held >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, max_rate: float = MAX_RATE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, distance, start_word, item_words) for every text that holds a benchmark item.

    No shuffle: each block of items (of bounded size) is broadcast and meets all texts once. Null and empty texts and items hold and
    match nothing. Repeated rows give repeated results; null ids are passed on. Other columns are not read. Either table
    may be empty. Long texts are read whole, in bounded pieces of work.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type, item_type = dict(rows.dtypes)["id"], dict(benchmark.dtypes)[item_col]
    schema = f"id {id_type}, item {item_type}, distance int, start_word long, item_words int"
    out = spark.createDataFrame([], schema)
    arrow_item = None
    for ids, texts in blocks(benchmark, item_col, item_text):
        held = spark.sparkContext.broadcast(Index(ids, texts, max_rate, recall))
        out = out.unionByName(rows.mapInArrow(_search(held), schema)) if arrow_item else rows.mapInArrow(_search(held), schema)
        arrow_item = True
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def _search(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        size = {int(k): g.n for g in index.groups for k in g.number}
        items = pa.array(index.ids)
        for batch, buf, offsets in slices(batches, "text", SLICE):
            h, _, _, first = words(buf, offsets, lower=True, trim=3)
            found = index.search(h, first)
            if found:
                doc, item, far, at = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(doc, pa.int64())), items.take(pa.array(item, pa.int64())), pa.array(far, pa.int32()), pa.array(at, pa.int64()), pa.array([size[k] for k in item], pa.int32())],
                    names=["id", "item", "distance", "start_word", "item_words"],
                )

    return run


def clean(docs: DataFrame, benchmark: DataFrame, max_rate: float = MAX_RATE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all columns, whose text holds no item. Decided row by row, so null and repeated ids are safe."""
    spark = docs.sparkSession
    out = docs
    for ids, texts in blocks(benchmark, "item_id", "text"):
        held = spark.sparkContext.broadcast(Index(ids, texts, max_rate, recall))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch, buf, offsets in slices(batches, text_col, SLICE):
                h, _, _, first = words(buf, offsets, lower=True, trim=3)
                bad = {d for d, *_ in held.value.search(h, first)}
                yield batch.filter(pa.array([i not in bad for i in range(len(batch))], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
