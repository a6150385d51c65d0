import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives, queries

from compare import same

ROWS = "id long, label long, q array<long>"


def plain(rows, anchor, positives=5, negatives=3, low=50, high=95):
    out = []
    last = lambda x: (x is None, x or 0)
    for i, (a, la, qa) in enumerate(rows):
        if not anchor(a):
            continue
        scored = sorted(((sum(x * y for x, y in zip(qa, q)), b, lb) for j, (b, lb, q) in enumerate(rows) if j != i and len(q) == len(qa)), key=lambda s: (-s[0], last(s[1])))
        for p, pid, _ in [s for s in scored if s[2] == la][:positives]:
            hard = [s for s in scored if s[2] != la and low * p <= 100 * s[0] <= high * p][:negatives]
            out += [(a, pid, k, n, p, s) for k, (s, n, _) in enumerate(hard, 1)]
    return sorted(out, key=str)


def mine(spark, rows, every=5, **more):
    df = spark.createDataFrame(rows, ROWS)
    got = hard_negatives.mine(df, F.coalesce(F.col("id") % every == 0, F.lit(False)), **more).collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.fixture
def small(monkeypatch):
    for name, v in (("BUCKET", 7), ("BLOCK", 3), ("WAVE", 1)):
        monkeypatch.setattr(hard_negatives, name, v)


@pytest.mark.parametrize("seed", range(3))
def test_against_plain(spark, seed):
    r = random.Random(seed)
    rows = [(k, r.randrange(3), [r.randint(-9, 30) * (1 + k % 4) for _ in range(6)]) for k in range(150)]
    want = plain(rows, lambda a: a % 5 == 0)
    assert len(want) > 40 and mine(spark, rows) == want
    assert mine(spark, rows, positives=2, negatives=1, low=10, high=80) == plain(rows, lambda a: a % 5 == 0, 2, 1, 10, 80)


def test_small_buckets_and_many_waves(spark, small):
    r = random.Random(9)
    rows = [(k, r.randrange(2), [r.randint(0, 5) for _ in range(4)]) for k in range(120)]  # many ties
    assert mine(spark, rows) == plain(rows, lambda a: a % 5 == 0)


def test_pruned_search_is_the_whole_one(spark):
    """A few rows of large norm, many of small norm: whole buckets fall away."""
    r = random.Random(4)
    rows = [(k, k % 2, [r.randint(-4, 4) * (1000 if k % 40 == 0 else 1) for _ in range(5)]) for k in range(400)]
    assert mine(spark, rows, 20) == plain(rows, lambda a: a % 20 == 0)


def test_ties_repeated_rows_and_large_numbers(spark):
    same_ = [(k, k % 2, [3, 4]) for k in range(60)]  # all scores alike: no negative is below 95 %
    assert mine(spark, same_) == plain(same_, lambda a: a % 5 == 0) == []
    r = random.Random(1)
    ties = [(k, k % 3, [1, 1 + (k % 2)]) for k in range(60)] + [(None, 1, [1, 1])]
    assert mine(spark, ties, low=0, high=100) == plain(ties, lambda a: a is not None and a % 5 == 0, low=0, high=100)
    big = [(k, k % 2, [r.randint(-(2**30), 2**30) for _ in range(3)]) for k in range(40)]  # beyond what doubles hold
    assert mine(spark, big) == plain(big, lambda a: a % 5 == 0)
    again = ties[:30] * 2
    got = mine(spark, again, low=0, high=100)
    assert len(got) == len(plain(again, lambda a: a % 5 == 0, low=0, high=100))


def test_lengths_and_empty_tables(spark):
    rows = [(k, k % 2, [k + 1] * (1 + k % 3)) for k in range(60)] + [(100, 0, [])]
    assert mine(spark, rows) == plain(rows, lambda a: a % 5 == 0)
    assert mine(spark, []) == []
    alone = [(0, 1, [1, 2])]
    assert mine(spark, alone) == []


def test_rows_that_take_no_part(spark):
    bad = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, None, [1.0, 2.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 1, [bad[0], 1.0]), (5, 1, [bad[1], 1.0]), (6, 1, [-0.001, 1.0])]
    df = spark.createDataFrame(rows, "id long, label int, v array<float>").filter(hard_negatives.usable(F.col("v"), F.col("label")))
    assert {r.id: r.q for r in df.select("id", hard_negatives.quantised(F.col("v")).alias("q")).collect()} == {0: [256, 512], 6: [-1, 256]}


def test_query_against_its_twin(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert same(queries.op13_hard_negatives(spark, sf), c.sql(queries.ORACLE["op13_hard_negatives"])) > 100
