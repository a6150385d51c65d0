"""Vectorised word splitting and hashing over Arrow text columns.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes. A word's hash is a polynomial over a random table of byte
values, taken from prefix sums, so that a whole batch is hashed in a few numpy passes. Lower-casing touches A-Z only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD1342543DE82EF95)
_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
#: ASCII punctuation, for words taken without the marks at their ends.
_MARK = np.zeros(256, bool)
_MARK[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


#: What operators keep in a worker from task to task; an operator that needs none of it lets it go, since workers outlive their stage.
CACHES: list[dict] = []


def trim() -> None:
    """Returns free memory to the machine, where the C library can."""
    if f := getattr(ctypes.CDLL(None), "malloc_trim", None):
        f(0)


def let_go() -> None:
    """Empties the caches and returns their memory to the machine."""
    if any(CACHES):
        for c in CACHES:
            c.clear()
        trim()


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + 64)
        inv = np.uint64(pow(int(base), -1, 2**64))
        out = []
        for b in (base, inv):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _powers[int(base)] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hash_span(buf: np.ndarray, cuts: np.ndarray, table: np.ndarray, trim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of one piece of bytes; cuts: where texts begin inside it."""
    ws = _WS[buf]
    n = len(buf)
    start = ~ws
    end = start.copy()
    start[1:] &= ws[:-1]
    end[:-1] &= ws[1:]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    start[cuts] = ~ws[cuts]
    end[cuts - 1] = ~ws[cuts - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    for _ in range(trim):
        s += (e - s > 1) & _MARK[buf[s]]
        e -= (e - s > 1) & _MARK[buf[e - 1]]
    pw, inv = powers(_P, n + 1)
    c = np.empty(n + 1, np.uint64)
    c[0] = 0
    np.cumsum(table[buf] * pw[:n], out=c[1:])
    h = (c[e] - c[s]) * inv[s]
    return mix(h + (e - s).astype(np.uint64) * _Q), s, e


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool = False, trim: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of consecutive texts: hashes, first bytes, ends (in buf), and for each text the number of its first word.
    trim: up to so many ASCII punctuation marks at either end do not belong to a word (but a word is never empty).

    Works in pieces of about CHUNK bytes, cut between texts or at white space, so that a very long text needs no more
    working memory than many short ones.
    """
    table = _LOWER if lower else _TABLE
    lo, hi = int(offsets[0]), int(offsets[-1])
    hs, ss, es = [], [], []
    pos = lo
    while pos < hi:
        to = hi
        if hi - pos > CHUNK:
            i = int(np.searchsorted(offsets, pos + CHUNK, "right")) - 1
            to = int(offsets[i])
            if to <= pos:  # one long text: cut at white space
                last = np.flatnonzero(_WS[buf[pos : pos + CHUNK]])
                to = pos + int(last[-1]) + 1 if len(last) else 0
                step = CHUNK
                while not to:
                    later = np.flatnonzero(_WS[buf[pos + step : min(hi, pos + 2 * step)]])
                    to = pos + step + int(later[0]) + 1 if len(later) else hi if pos + 2 * step >= hi else 0
                    step *= 2
        a, b = np.searchsorted(offsets, [pos, to])
        h, s, e = _hash_span(buf[pos:to], offsets[a:b] - pos, table, trim)
        hs.append(h)
        ss.append(s + pos)
        es.append(e + pos)
        pos = to
    if not hs:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    h, s, e = np.concatenate(hs), np.concatenate(ss), np.concatenate(es)
    return h, s, e, np.searchsorted(s, offsets).astype(np.int64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive words, one for each first word; the last n - 1 have none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.empty(len(h) - n + 1, np.uint64)
    qp, qi = powers(_Q, CHUNK + n + 1)
    for lo in range(0, len(out), CHUNK):
        hi = min(len(out), lo + CHUNK)
        piece = h[lo : hi + n - 1]
        c = np.empty(len(piece) + 1, np.uint64)
        c[0] = 0
        np.cumsum(piece * qp[: len(piece)], out=c[1:])
        out[lo:hi] = (c[n:] - c[:-n]) * qi[: hi - lo]
    return mix(out + np.uint64(n))


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each word, whether n words from it on lie in one text; first: as from words()."""
    ok = np.zeros(max(0, total - n + 1), bool)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            ok[a : b - n + 1] = True
    return ok


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches so that the texts of each piece take about `most` bytes, or hold one longer text."""
    let_go()
    for batch in batches:
        buf, offsets = column(batch, text)
        lo, n = 0, len(batch)
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
            hi = min(hi, n)
            yield batch.slice(lo, hi - lo), buf, offsets[lo : hi + 1]
            lo = hi


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of whole numbers; null becomes the smallest long."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.int64())
    return col.fill_null(-(2**63)).to_numpy(zero_copy_only=False) if col.null_count else col.to_numpy(zero_copy_only=False)


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n shards holds a hash; follows the hash's order, so that sorted hashes lie shard after shard."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
