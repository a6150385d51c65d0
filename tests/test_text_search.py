"""Names by automaton and substrings by index, against plain search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import text_search


@pytest.mark.parametrize("seed", range(30))
def test_automaton_counts_like_str_count(seed, monkeypatch):
    monkeypatch.setattr(text_search, "LANE", 1 + seed * 3)
    r = random.Random(seed)
    word = lambda most: "".join(r.choice("abé"[: 2 + seed % 2]) for _ in range(r.randint(1, most)))
    names = sorted({word(5) for _ in range(12)} | {"aa", "abab"})
    texts = [word(80) if r.random() < 0.9 else "" for _ in range(20)]
    data = [t.encode() for t in texts]
    a = text_search.Automaton([n.encode() for n in names])
    i, j, n = a.counts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert dict(zip(zip(i.tolist(), j.tolist()), n.tolist())) == {(p, q): t.count(x) for p, t in enumerate(texts) for q, x in enumerate(names) if x in t}


def test_mentions_of_odd_rows_and_many_automata(spark, monkeypatch):
    rows = [(1, "aXbXc"), (2, None), (3, ""), (4, "zzz"), (1, "X"), (None, "X y"), (5, "ab" * 5000)]
    df = spark.createDataFrame(rows, "id long, body string")
    names = spark.createDataFrame([("X",), ("X",), ("",), (None,), ("ab",), ("zz",), ("none",)], "n string")
    want = sorted([(1, "X", 2), (1, "X", 1), (0, "X", 1), (5, "ab", 5000), (4, "zz", 1)])
    got = lambda: sorted((r.id or 0, r.name, r.mentions) for r in text_search.mentions(df, "id", "body", names, "n").collect())
    assert got() == want
    monkeypatch.setattr(text_search, "NAMES_BYTES", 3)  # a job for every few names
    assert got() == want
    assert text_search.mentions(df, "id", "body", names.limit(0), "n").count() == 0


def test_index_finds_what_ilike_finds(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"))
    docs = docs.unionByName(spark.createDataFrame([(-1, None, "x"), (-2, "A\nB", None), (-3, "", "")], docs.schema))
    text_search.write_index(docs, "doc_id", ["title", "content"], f"file://{tmp_path}/index", 4)
    for title, content in (("the", "zu und"), ("THE", "qqqq"), ("a\nb", "Ción"), ("t", "la de"), ("never there", "not there either")):
        want = docs.filter(F.col("title").ilike(f"%{title}%") | F.col("content").ilike(f"%{content}%"))
        got = text_search.grounding(spark, docs, "doc_id", f"file://{tmp_path}/index", {"title": title, "content": content})
        assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())
    plan = text_search.candidates(spark, f"file://{tmp_path}/index", "zu und")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan


def test_no_nested_loop_in_the_plans(spark, sf):
    from tidemark import catalogue

    for q in ("name_mentions", "contains_join_names"):
        plan = catalogue.QUERIES[q](spark, sf)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
