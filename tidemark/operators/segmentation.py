"""Splitting runs of letters by a user dictionary: a double-array trie and the cheapest path through the lattice of its words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 16 << 20  # of a dictionary that goes to the tasks
PIECE, LETTER = 8_000, 4_000  # what an unknown piece costs, and each of its letters; a word costs 1000 times the logarithm of its share
WINDOW = 1024  # places of the double array that are tried at once
SHORT, TOGETHER = 64, 8192  # runs of so many letters are split side by side, so many at a time; longer ones one by one
BITS = 7  # hold a number up to SHORT


class DoubleArray:
    """A trie in two arrays: the child of state s by letter c is base[s] + c, if check there is s. A word's number stands in `word` at its last state."""

    def __init__(self, words: list[str]):
        letters = sorted({c for w in words for c in w})
        self.code = {c: k + 1 for k, c in enumerate(letters)}
        self.longest = max(map(len, words), default=0)
        size = 2 * (len(letters) + WINDOW)
        self.base, self.check, self.word = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.check[0] = 0
        self.least: dict[int, int] = {}  # by number of children: before this place none of the windows had room for so many
        coded = sorted((tuple(self.code[c] for c in w), k) for k, w in enumerate(words))
        todo = [(0, 0, len(coded), 0)]
        while todo:
            state, lo, hi, depth = todo.pop()
            while lo < hi and len(coded[lo][0]) == depth:
                self.word[state] = coded[lo][1]
                lo += 1
            if lo == hi:
                continue
            cut = [lo, *(k for k in range(lo + 1, hi) if coded[k][0][depth] != coded[k - 1][0][depth]), hi]
            keys = [coded[k][0][depth] for k in cut[:-1]]
            at = self._room(keys)
            self.base[state] = at
            for a, b, c in zip(cut[:-1], cut[1:], keys):
                self.check[at + c] = state
                todo.append((at + c, a, b, depth + 1))
        size = int(np.flatnonzero(self.check >= 0)[-1]) + len(letters) + 2  # a letter from any state stays inside
        self._grow(size)
        self.base, self.check, self.word = self.base[:size].copy(), self.check[:size].copy(), self.word[:size].copy()

    def _room(self, keys: list[int]) -> int:
        """A base whose places for these letters are free: the first in the windows that nodes of as many children have not given up."""
        while True:
            at = max(1, self.least.get(len(keys), 1) - keys[0])
            self._grow(at + keys[-1] + WINDOW)
            free = np.ones(WINDOW, bool)
            for c in keys:
                free &= self.check[at + c : at + c + WINDOW] < 0
            k = int(free.argmax())
            if free[k]:
                if len(keys) == 1:
                    self.least[1] = max(self.least.get(1, 1), at + k + keys[0])
                return at + k
            self.least[len(keys)] = at + keys[0] + WINDOW

    def _grow(self, size: int) -> None:
        if (n := max(size, 2 * len(self.check)) - len(self.check)) > 0 and size > len(self.check):
            self.base, self.check, self.word = np.concatenate([self.base, np.zeros(n, np.int32)]), np.concatenate([self.check, np.full(n, -1, np.int32)]), np.concatenate([self.word, np.full(n, -1, np.int32)])

    def prefixes(self, codes: list[int], start: int):
        """(end, word number) of all words that begin at a place; codes: 0 for letters that no word has."""
        state = 0
        for k in range(start, len(codes)):
            to = int(self.base[state]) + codes[k]
            if not codes[k] or self.check[to] != state:
                return
            state = to
            if self.word[state] >= 0:
                yield k + 1, int(self.word[state])


class Segmenter:
    def __init__(self, words: dict[str, int]):
        """words: how often each occurs."""
        names = sorted(w for w in words if w)
        total = sum(words[w] for w in names)
        self.cost = [round(1000 * np.log(total / words[w])) for w in names]
        self.trie = DoubleArray(names)
        letters = sorted((ord(c), k) for c, k in self.trie.code.items())
        self.letters, self.codes = np.array([c for c, _ in letters], np.uint32), np.array([k for _, k in letters], np.int32)
        self.keyed = np.array(self.cost, np.int64) << 2 * BITS

    def split(self, run: str) -> list[str]:
        """The cheapest pieces of a run; of equal ones the fewest, then the longest first piece. Letters between dictionary words are one piece."""
        low = _lower(run)
        codes = [self.trie.code.get(c, 0) for c in low]
        n = len(run)
        best: list[tuple[int, int, int]] = [(0, 0, n)] * (n + 1)  # cost, pieces, end of the first piece
        gap: list[tuple[int, int, int]] = [(0, 0, n)] * (n + 1)  # the same where an unknown piece goes on
        known = best[n]
        for i in range(n - 1, -1, -1):
            ways = [(best[e][0] + self.cost[w], best[e][1] + 1, -e) for e, w in self.trie.prefixes(codes, i)]
            known = min(ways, default=None)
            on = (gap[i + 1][0] + LETTER, gap[i + 1][1], gap[i + 1][2])
            open_ = (on[0] + PIECE, on[1] + 1, -on[2])
            first = min(x for x in (known, open_) if x is not None)
            best[i] = (first[0], first[1], -first[2])
            stop = (known[0], known[1], i) if known else None  # an unknown piece may end where a word begins
            gap[i] = min((on, stop), key=lambda g: (g[0], g[1], -g[2])) if stop else on
        out, i = [], 0
        while i < n:
            out.append(run[i : best[i][2]])
            i = best[i][2]
        return out


    def split_all(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many pieces each run has, and the letters of each piece; the same as `split`, for many runs at once."""
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        first = np.cumsum(sizes) - sizes
        points = np.frombuffer("".join(map(_lower, runs)).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, points), max(0, len(self.letters) - 1))
        codes = np.where(self.letters[at] == points, self.codes[at], 0) if len(self.letters) else np.zeros(len(points), np.int32)
        counts, found = np.zeros(len(runs), np.int64), []  # found: (run, number of the piece, letters)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        short = order[sizes[order] <= SHORT]
        for lo in range(0, len(short), TOGETHER):
            some = short[lo : lo + TOGETHER]
            left, k = sizes[some], 0
            ways = self._ways(codes, first[some] + left, left)
            while len(some):
                after = ways[left, np.arange(len(left))] & ((1 << BITS) - 1)
                found.append((some, np.full(len(some), k), left - after))
                on = after > 0
                counts[some] += 1
                some, left, k, ways = some[on], after[on], k + 1, ways[:, on]
        for r in order[len(short) :].tolist():
            pieces = [len(p) for p in self.split(runs[r])]
            counts[r] = len(pieces)
            found.append((np.full(len(pieces), r), np.arange(len(pieces)), np.array(pieces)))
        out = np.zeros(int(counts.sum()), np.int64)
        base = np.cumsum(counts) - counts
        for run, k, letters in found:
            out[base[run] + k] = letters
        return counts, out

    def _ways(self, codes: np.ndarray, end: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For the last j letters of each run (a row for each j): cost, pieces and letters after the first piece of the best way, in one number
        that is the smaller the better. Runs are sorted by size; end: where each ends in codes."""
        trie, rest = self.trie, np.int64((1 << BITS) - 1)
        none, piece, letter = np.int64(1 << 62), np.int64(PIECE << 2 * BITS | 1 << BITS), np.int64(LETTER << 2 * BITS)
        best = np.zeros((int(sizes[-1]) + 1, len(sizes)), np.int64)
        gap = np.zeros(len(sizes), np.int64)  # the same where an unknown piece goes on
        for j in range(1, len(best)):
            runs = np.arange(np.searchsorted(sizes, j), len(sizes))
            known = np.full(len(runs), none)
            live, state = np.arange(len(runs)), np.zeros(len(runs), np.int32)
            for d in range(min(j, trie.longest)):
                code = codes[end[runs[live]] - j + d]
                to = trie.base[state] + code
                ok = (code > 0) & (trie.check[to] == state)
                live, state = live[ok], to[ok]
                if not len(live):
                    break
                word = trie.word[state]
                hit = word >= 0
                mine, after = live[hit], j - d - 1
                known[mine] = np.minimum(known[mine], (best[after, runs[mine]] & ~rest) + self.keyed[word[hit]] + ((1 << BITS) | after))
            on = gap[runs] + letter
            best[j, runs] = np.minimum(known, on + piece)
            gap[runs] = np.minimum(on, np.where(known < none, (known & ~rest) | j, none))  # an unknown piece may end where a word begins
        return best


def _lower(run: str) -> str:
    low = run.lower()
    return low if len(low) == len(run) else run


def dictionary(words: DataFrame, word: str, count: str) -> dict[str, int]:
    """A user dictionary for `segments`, checked to be small enough to go to every task. The words are computed once."""
    out, size = {}, 0
    for w, n in words.select(word, F.col(count).cast("long")).toLocalIterator():
        size += len((w or "").encode())
        if size > MOST_BYTES:
            raise ValueError(f"the user dictionary takes more than the {MOST_BYTES} bytes that are allowed: raise its least count")
        if w and n:
            out[w] = n
    return out


def segments(runs: Column, words: dict[str, int]) -> Column:
    """An array of runs of letters as the array of their pieces; runs that repeat in a batch are split once. The trie is built once, here."""
    held = Segmenter(words)

    @F.arrow_udf("array<string>")
    def split(column: pa.Array) -> pa.Array:
        flat = column.flatten().dictionary_encode()
        known = flat.dictionary.to_pylist()
        run = flat.indices.to_numpy(zero_copy_only=False)
        counts, letters = held.split_all(known)
        text = "".join(known).encode()  # pieces are cuts of it
        starts = np.append(np.flatnonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80), len(text))
        offsets = starts[np.append(0, np.cumsum(letters))].astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(letters), pa.py_buffer(offsets), pa.py_buffer(text))
        many = counts[run]
        ends = np.append(0, np.cumsum(many))
        taken = np.arange(ends[-1]) + np.repeat((np.cumsum(counts) - counts)[run] - ends[:-1], many)
        rows = np.append(0, np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)))
        return pa.ListArray.from_arrays(pa.array(ends[rows], pa.int32()), pieces.take(pa.array(taken)), mask=column.is_null())

    return split(runs)
