"""A run-length index: the run-compressed Burrows-Wheeler transform of many short texts, with the suffix array sampled at run ends only.

Texts belong to namespaces, and patterns are matched inside theirs: the namespace is part of every symbol, so one transform holds them all. Matching
statistics are streamed from a pattern's last byte to its first. A step inside a run of the wanted byte follows the LF mapping; elsewhere it
jumps to the nearer end of the neighbouring runs of that byte, by their sampled positions: the one that shares more with what is matched.
All patterns of a batch take their steps together, in numpy.
"""

from __future__ import annotations

import numpy as np

END = 0xFF  # no byte of UTF-8: ends each text
_PAD = 512


def gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Slices of a buffer one after the other, with `gap` END bytes after each; where each begins."""
    at = np.concatenate([[0], np.cumsum(size + gap)])
    out = np.full(at[-1], END, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at[:-1], size) + inner] = buf[np.repeat(start, size) + inner]
    return out, at


def suffix_order(text: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Positions in the order of (namespace, suffix): prefix doubling from four bytes on, over those that are still tied. A text's end sorts
    first; of two ends the earlier one."""
    n = len(text)
    v = np.where(text == END, 0, text.astype(np.int64) + 1)
    padded = np.concatenate([v, np.zeros(3, np.int64)])
    key, open_ = v, v > 0
    for j in range(1, 4):
        more = np.where(open_, padded[j : j + n], 0)
        open_ = more > 0
        key = key << 9 | more
    key = space.astype(np.int64) << 36 | key
    order = np.argsort(key)
    head = np.ones(n, bool)
    head[1:] = np.diff(key[order]) != 0
    slots = np.flatnonzero(~open_[order])
    group = np.cumsum(head)[slots]
    order[slots] = order[slots][np.lexsort((order[slots], group))]
    head[slots] = True
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 4
    while True:
        slots = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(slots):
            return order
        i = order[slots]
        both = rank[i] * n + rank[i + h]
        turn = np.argsort(both)
        i, both = i[turn], both[turn]
        new = np.ones(len(i), bool)
        new[1:] = np.diff(both) != 0
        order[slots] = i
        head[slots] |= new
        rank[i] = slots[np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))]
        h *= 2


class RunIndex:
    def __init__(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, space: np.ndarray):
        """Texts buf[start:start+size] in namespaces 0, 1, ... (all of which occur, in any order)."""
        text, at = gather(buf, start, size, 1)
        self.n = n = len(text)
        owner = np.repeat(space, size + 1)
        order = suffix_order(text, owner)
        before = np.where(order > 0, text[order - 1], END)
        code = np.where(before == END, -1, owner[order] * 256 + before.astype(np.int64))
        head = np.flatnonzero(np.diff(code, prepend=-2))
        last = np.append(head[1:], n) - 1
        runs = np.flatnonzero(code[head] >= 0)
        runs = runs[np.argsort(code[head[runs]] * n + head[runs])]
        self.start, self.last = head[runs], last[runs]
        self.code = np.append(code[self.start], -1)
        self.key = self.code[:-1] * n + self.start
        self.at_start, self.at_last = order[self.start], order[self.last]  # the samples
        spaces = int(space.max()) + 1
        ends = np.cumsum(np.bincount(space, minlength=spaces))  # a namespace's ends stand before its other suffixes
        size_of = self.last - self.start + 1
        self.to = np.cumsum(size_of) - size_of + ends[self.code[:-1] // 256]  # where LF leads from a run's start
        self.first = np.cumsum(np.bincount(owner, minlength=spaces)) - np.bincount(owner, minlength=spaces)
        self.first_at = order[self.first]
        padded = np.concatenate([text, np.full(_PAD, END, np.uint8)])
        self.words = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,)).copy()

    @property
    def runs(self) -> int:
        return len(self.start)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b share, `most` at most."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        d = 0
        while len(live):
            x = self.words[a[live] + d] ^ self.words[b[live] + d]
            out[live] += np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
            d += 8
            live = live[(x == 0) & (most[live] > d)]
        return np.minimum(out, most)

    def statistics(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray, space: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, offset) of every place from which at least `least` bytes of a pattern occur in its namespace's texts."""
        turn = np.argsort(-size, kind="stable")
        end, size, space = (start + size)[turn], size[turn], space[turn]
        q, p, length = self.first[space].copy(), self.first_at[space].copy(), np.zeros(len(turn), np.int64)
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for t in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size, -t, "left"))  # patterns longer than t
            code = space[:n] * 256 + buf[end[:n] - 1 - t]
            k = np.searchsorted(self.key, code * self.n + q[:n], "right") - 1
            known = (k >= 0) & (self.code[k] == code)
            k0 = np.maximum(k, 0)
            inside = known & (q[:n] <= self.last[k0])
            i = np.flatnonzero(inside)
            q[i] += self.to[k[i]] - self.start[k[i]]
            p[i] -= 1
            length[i] += 1
            i = np.flatnonzero(~inside)
            if len(i):
                j, have = k0[i], known[i]
                after = k[i] + 1
                follows = self.code[after] == code[i]
                after = np.minimum(after, max(0, self.runs - 1))
                zero = np.zeros(len(i), np.int64)
                lo = np.where(have, self.common(p[i], self.at_last[j], np.where(have, length[i], zero)), -1)
                hi = np.where(follows, self.common(p[i], self.at_start[after], np.where(follows, length[i], zero)), -1)
                down, up = (lo >= hi) & have, (hi > lo) & follows
                q[i] = np.where(down, self.to[j] + self.last[j] - self.start[j], np.where(up, self.to[after], q[i]))
                p[i] = np.where(down, self.at_last[j] - 1, np.where(up, self.at_start[after] - 1, p[i]))
                length[i] = np.maximum(lo, hi) + 1
            hit = np.flatnonzero(length[:n] >= least)
            if len(hit):
                hits.append((turn[hit], size[hit] - 1 - t))
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in hits]), np.concatenate([y for _, y in hits])
