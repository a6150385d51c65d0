"""Files, word lists, alias maps, SQL functions, paragraphs, and streams that update."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.plans import signals
from tidemark.sources import tables
from tidemark.streaming import pipelines


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_tables_come_back_as_written(spark, tmp_path, fmt):
    df = spark.createDataFrame([("000001", "word", 0.5, "v1", "Main")], "stock_code string, word string, beta double, version string, source string")
    tables.write_table(df, f"{tmp_path}", "sentiment_dict", fmt=fmt)
    got = tables.read_table(spark, f"{tmp_path}", "sentiment_dict", fmt).select(df.columns)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in df.collect()]


def test_word_list(spark, tmp_path):
    (tmp_path / "a.txt").write_text("the # an article\n\n# only a comment\nof\n")
    (tmp_path / "b.txt").write_text("of\nand\n")
    got = tables.word_list(spark, f"{tmp_path}/a.txt", f"{tmp_path}/b.txt", f"{tmp_path}/none.txt")
    assert sorted(r.word for r in got.collect()) == ["and", "of", "the"]
    assert tables.word_list(spark, f"{tmp_path}/none.txt").count() == 0


def test_alias_map(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"000001": ["Acme", "AC"],\n "000002": []}')
    assert sorted(tuple(r) for r in tables.alias_map(spark, f"{tmp_path}/m.json").collect()) == [("000001", "AC"), ("000001", "Acme")]


def test_sql_functions(spark):
    expr.register(spark)
    r = spark.sql("select tm_tokens('A big, BIG dog!') as t, tm_decay(0D) as d").first()
    assert r.t == ["big", "big", "dog"] and r.d == 1.0


def test_paragraphs(spark):
    s = [f"This is sentence {k}." for k in range(8)]
    texts = ["A first part of some length.\n\nshort\n\nA second part of some length.", " ".join(s[:4]), " ".join(s), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.g for r in df.select("k", expr.paragraphs(F.col("t")).alias("g")).collect()}
    assert got == {0: ["A first part of some length.", "A second part of some length."], 1: [texts[1]], 2: [" ".join(s[:3]), " ".join(s[3:6]), " ".join(s[6:])], 3: [], 4: []}


@pytest.mark.parametrize("mode", ["update", "complete"])
def test_state_tables_keep_rows_that_later_batches_do_not_touch(spark, tmp_path, mode):
    for k, rows in enumerate(([("a", 1), ("b", 5)], [("a", 2)], [("c", 1), ("a", 1)])):
        spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = pipelines.arrivals(spark, f"{tmp_path}/in", 1).groupBy("k").agg(F.sum("v").alias("v"))
    got = pipelines.run(s, mode, f"{tmp_path}/out", f"{tmp_path}/state", ["k"])
    assert sorted(tuple(r) for r in got.collect()) == [("a", 4), ("b", 5), ("c", 1)]


def test_dead_letters_are_replayed(spark, tmp_path):
    spark.createDataFrame([(1, True), (2, False), (3, False)], "k int, ok boolean").write.parquet(f"{tmp_path}/in")
    q = pipelines.routed(pipelines.arrivals(spark, f"{tmp_path}/in"), F.col("ok"), F.col("k") == 1, f"{tmp_path}/out", f"{tmp_path}/state")
    assert [r.k for r in pipelines.replay(q["dead"], F.col("k") == 3).collect()] == [3] and q["light"].count() == 1


def test_walk_forward_folds_learn_from_the_days_before(spark, sf):
    from tidemark.fixtures import price
    from tidemark.operators import training

    rows = training.numbered(price(spark, sf), ["excess_return"])
    tests, fits = signals.walk_forward_set(rows, "1995-06-01", "1995-08-15", 120, 2)
    t, f = tests.collect(), {(r.stock_code, r.fold): r for r in fits.collect()}
    assert t and all(f[r.stock_code, r.fold].hi < r.td and (f[r.stock_code, r.fold].hi - f[r.stock_code, r.fold].lo).days == 120 for r in t)
    inside = signals.in_folds(rows, fits).collect()
    assert all(f[tuple([r.stock_code.split("#")[0], int(r.stock_code.split("#")[1])])].lo <= r.date <= f[r.stock_code.split("#")[0], int(r.stock_code.split("#")[1])].hi for r in inside)
    got = signals.walk_forward_scorer(spark, sf).collect()
    assert all(r.is_correct == (r.prediction is not None and (r.prediction == 1) == (r.actual_alpha > 0)) for r in got)
