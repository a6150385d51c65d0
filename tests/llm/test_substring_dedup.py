import plain

from tidemark.llm import substring_dedup


def by_id(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_against_plain(docs, corpus):
    want = plain.repeats(corpus, 20)
    assert sum(v[1] > 0 for v in want.values()) > 15
    assert by_id(substring_dedup.remove_repeats(docs)) == want


def test_short_windows(docs, corpus):
    assert by_id(substring_dedup.remove_repeats(docs.select("doc_id", "text"), window=5)) == plain.repeats(corpus, 5)


def test_text_is_returned(spark):
    w = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(1, f"{w} x"), (2, f"y  {w}\tz")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in substring_dedup.remove_repeats(df, with_text=True).collect()} == {1: f"{w} x", 2: "y z"}


def test_empty(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_null_and_repeated_ids(spark):
    w = " ".join(f"w{k}" for k in range(25))
    df = spark.createDataFrame([(None, w), (1, w), (1, w), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()))
    assert got == [(False, 25, 0), (False, 25, 25), (True, 0, 0), (True, 25, 25)]
