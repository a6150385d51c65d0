from collections import Counter

import plain
from compare import same
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, queries, workspace


def by_id(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


def test_against_plain(docs, corpus):
    assert by_id(exact_dedup.exact_dedup(docs)) == plain.exact(corpus)


def test_several_micro_batches_give_the_same(docs, corpus):
    assert by_id(exact_dedup.exact_dedup(docs, files_per_batch=1)) == plain.exact(corpus)


def test_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a  b"), (3, "a  b"), (4, None), (None, "")], "doc_id long, text string")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect())
    assert got == {(None, 3, 4, False): 2, (3, 3, 4, True): 2, (4, 4, 2, True): 1, (None, 4, 2, False): 1}


def test_repeated_rows_agree_with_sql(spark, tmp_path, duck):
    spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a  b"), (3, "c"), (3, "d"), (4, "c"), (5, None), (5, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = duck.cursor()
    own.execute(f"create temp view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert same(queries.op9_exact_dedup(spark, str(tmp_path)), own.sql(queries.ORACLE["op9_exact_dedup"])) == 8


def test_kept_rows_say_where_they_were(spark, docs, corpus, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/d")
    got = exact_dedup.exact_dedup(spark.read.parquet(f"{tmp_path}/d")).collect()
    assert all(r.keep_locator.endswith(".parquet") for r in got)


def test_a_hot_group_is_dealt_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(workspace, "HOT_GROUPS", 4)
    rows = [(k, "same text") for k in range(500)] + [(1000 + k, f"t {k // 2}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(exact_dedup.exact_dedup(df)) == plain.exact(rows)


def test_keep_first_keeps_columns_and_one_of_repeated_rows(docs, corpus):
    got = exact_dedup.keep_first(docs.union(docs.filter("doc_id = 5")))
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, v in plain.exact(corpus).items() if v[2])


def test_different_texts_with_one_digest_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("same"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "b")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df).collect()} == {(1, 1, 2), (2, 2, 2), (3, 1, 2), (4, 2, 2)}


def test_main_path_is_native(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_flags_miss_no_key_and_few_others_are_flagged(spark):
    keys = spark.createDataFrame([(None,), *((7 * k,) for k in range(500))], "k long")
    got = workspace.flagged(spark.range(0, 20_000).select("id").union(spark.createDataFrame([(None,)], "id long")), "id", keys, "k").collect()
    wanted = {None, *(7 * k for k in range(500))}
    assert all(r["__maybe"] for r in got if r.id in wanted)
    assert sum(r["__maybe"] for r in got if r.id not in wanted) < 2000


def test_keep_first_leaves_columns_as_they_are(docs):
    want = {r.doc_id: r for r in docs.collect()}
    got = exact_dedup.keep_first(docs)
    assert got.columns == docs.columns and all(r == want[r.doc_id] for r in got.collect())
