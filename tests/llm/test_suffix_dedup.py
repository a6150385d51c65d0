import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, suffix_dedup
from tidemark.llm.run_index import RunIndex


def plain(rows, window):
    """Windows of documents in order, each against those seen before."""
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for o in range(len(b) - window + 1):
            w = b[o : o + window]
            if w in seen:
                gone[o : o + window] = b"\1" * window
            seen.add(w)
        runs = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def mine(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("seed", range(60))
def test_matching_statistics(seed):
    """Texts with edits of few passages, over two or nearly all bytes, in several namespaces."""
    r = random.Random(seed)
    alphabet = b"ab" if seed % 3 else bytes(range(255))
    base = [bytes(r.choice(alphabet) for _ in range(10 + seed)) for _ in range(3)]

    def edited():
        b = bytearray(r.choice(base))
        for _ in range(r.randint(0, 3)):
            b[r.randrange(len(b))] = r.choice(alphabet)
        return bytes(b[r.randrange(5) : len(b) - r.randrange(5)])

    spaces, least = r.randint(1, 4), 1 + seed % 12
    held = [(edited(), k % spaces) for k in range(max(spaces, 1 + seed % 9))]
    asked = [(edited(), r.randrange(spaces)) for _ in range(8)]
    size = np.array([len(x) for x, _ in held + asked])
    start, space, n = np.cumsum(size) - size, np.array([s for _, s in held + asked]), len(held)
    buf = np.frombuffer(b"".join(x for x, _ in held + asked), np.uint8)
    index = RunIndex(buf, start[:n], size[:n], space[:n])
    i, off = index.statistics(buf, start[n:], size[n:], space[n:], least)
    want = {(k, o) for k, (x, s) in enumerate(asked) for o in range(len(x) - least + 1) if any(s == z and x[o : o + least] in y for y, z in held)}
    assert set(zip(i.tolist(), off.tolist())) == want


def test_repetitive_texts_have_few_runs():
    text = np.frombuffer(b"the same words again and again, " * 4, np.uint8)
    buf = np.tile(text, 200)
    index = RunIndex(buf, np.arange(200) * len(text), np.full(200, len(text)), np.zeros(200, np.int64))
    assert index.runs < len(buf) / 50


@pytest.mark.parametrize("window", [40, 100])
@pytest.mark.parametrize("hot", [1, 1 << 14])
def test_against_plain(docs, corpus, window, hot):
    want = plain(corpus, window)
    assert sum(v[1] > 0 for v in want.values()) > 20
    assert mine(suffix_dedup.remove_repeats(docs, window=window, gram=24, hot=hot)) == want


def test_long_and_periodic_texts(spark):
    r = random.Random(2)
    passage = "".join(r.choice("abcdefgh ") for _ in range(230))
    long = "".join(r.choice("abcdefgh é") for _ in range(600_000))
    rows = [(1, long), (2, "x" * 900), (3, "xy" * 500), (4, passage + "!" + passage), (5, long[300_000:300_250] + "…" + long[:150]), (6, "é" * 300), (7, "q" + passage), (8, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert mine(suffix_dedup.remove_repeats(df)) == plain(rows, 100)


def test_kept_bytes(spark):
    line = "Licensed under these terms and no others, as the notice that comes with every copy of this work tells. "
    rows = [(1, "one " + line + "a"), (2, "two " + line + "b"), (3, "ü" + line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.remove_repeats(df, with_bytes=True).collect()}
    assert kept == {1: rows[0][1], 2: "twob", 3: "ü"}


def test_odd_rows(spark, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    r = random.Random(5)
    t = "".join(r.choice("abcdef ") for _ in range(150))
    rows = [(None, t), (3, t), (3, t), (4, None), (5, ""), (6, t[:99]), (7, t[:100]), (2, t[50:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("b", F.lit(1)).withColumn("h", F.lit("x"))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df).collect())
    # the smallest id stands first and keeps its bytes; of the two rows of id 3 the first keeps what is new in it
    assert got == sorted([("2", 100, 0, 0), ("3", 150, 100, 1), ("3", 150, 150, 1), ("4", 0, 0, 0), ("5", 0, 0, 0), ("6", 99, 0, 0), ("7", 100, 100, 1), ("None", 150, 150, 1)])


def test_query_against_plain(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert mine(queries.op12_suffix_dedup(spark, sf)) == plain(rows, 100)
