import plain
import pytest

from tidemark.llm import components as module
from tidemark.llm import jaccard_join
from tidemark.llm.components import components
from tidemark.llm.workspace import Workspace


def by_id(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_against_plain(docs, corpus):
    want = plain.near(corpus)
    assert sum(v[1] != i for i, v in want.items()) > 15
    assert by_id(jaccard_join.near_duplicates(docs)) == want


@pytest.mark.parametrize("percent", [50, 95])
def test_other_thresholds(docs, corpus, percent):
    assert by_id(jaccard_join.near_duplicates(docs, percent=percent)) == plain.near(corpus, percent)


def test_many_pairs_left_are_all_counted(docs, corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MERGE_WHILE", 1e9)
    assert by_id(jaccard_join.near_duplicates(docs)) == plain.near(corpus)


def test_empty(empty):
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_nulls_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (2, "a b c d e"), (1, "f g h i j"), (1, "a b c d e"), (4, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()), key=str)
    assert got == sorted([(0, 1, None), (2, 1, 1), (1, 1, 1), (1, 1, 1), (4, 0, 4)], key=str)


def test_sizes_of_rows_without_id(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, None), (None, "one"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.n_shingles, r.component_id is None) for r in jaccard_join.near_duplicates(df).collect()) == [(0, True), (1, True), (2, False), (2, True)]


def test_keep_one_leaves_columns_as_they_are(docs):
    want = {r.doc_id: r for r in docs.collect()}
    assert all(r == want[r.doc_id] for r in jaccard_join.keep_one(docs).collect())


def test_keep_one(docs, corpus):
    got = jaccard_join.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, v in plain.near(corpus).items() if v[1] == i)


@pytest.mark.parametrize("few", [0, 1000])
def test_components_of_a_path_and_a_star(spark, few, monkeypatch):
    monkeypatch.setattr(module, "FEW_EDGES", few)
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "t")).collect()}
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 140)} | {200: 200}


def test_sizes_beyond_twenty_bits(spark):
    words = [f"w{k}" for k in range((1 << 20) + 500)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-7])), (3, "a b c d e f")], "doc_id long, text string")
    assert by_id(jaccard_join.near_duplicates(df)) == {1: ((1 << 20) + 496, 1), 2: ((1 << 20) + 489, 1), 3: (2, 3)}


@pytest.mark.parametrize("piece", [2, 16])
def test_hot_tokens_are_dealt_and_lose_no_link(docs, corpus, monkeypatch, piece):
    monkeypatch.setattr(jaccard_join, "PIECE", piece)
    assert by_id(jaccard_join.near_duplicates(docs)) == plain.near(corpus)


def test_a_hot_token_lies_in_several_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PIECE", 2)
    seen = jaccard_join.index(docs.selectExpr("doc_id as id", "text"), spark.sparkContext.broadcast(jaccard_join.sketch(docs.select("text"))), 4, 80)
    hot = jaccard_join.shared_postings(seen).filter("p > 0").groupBy("t").agg({"p": "min", "t": "count"}).collect()
    assert hot and len({r["min(p)"] for r in hot}) > 1
