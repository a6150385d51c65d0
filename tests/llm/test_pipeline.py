"""Every stage against a plain version, on its own input."""

import plain
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = queries.read(spark, SF, "documents"), []
    for _, f in cp.STAGES:
        made = f(spark, docs, SF).persist()
        out.append((docs, made))
        docs = made
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(stages):
    assert all(a.columns == b.columns for a, b in stages[:-1])


def test_language_stage_keeps_texts_with_letters(stages):
    before, after = stages[0]
    assert sorted(i for i, _ in texts(after)) == sorted(i for i, t in texts(before) if any(c.isalpha() for c in t or ""))


def test_exact_stage(stages):
    before, after = stages[1]
    assert sorted(i for i, _ in texts(after)) == sorted(i for i, v in plain.exact(texts(before)).items() if v[2])


def test_near_stage(stages):
    before, after = stages[2]
    assert sorted(i for i, _ in texts(after)) == sorted(i for i, v in plain.near(texts(before)).items() if v[1] == i)


def test_decontamination_stage(stages, spark):
    before, after = stages[3]
    items = [(r.item_id, r.text) for r in queries.read(spark, SF, "benchmark").collect()]
    whole = {d for d, t in texts(before) for _, x in items if f" {' '.join(plain.item_words(x))} " in f" {' '.join(plain.item_words(t))} "}
    gone = {i for i, _ in texts(before)} - {i for i, _ in texts(after)}
    assert whole <= gone
    some = [(i, t) for i, t in texts(before) if i in gone or len(t) < 800]
    assert gone == {d for d, _ in plain.held(some, items)} or len(gone ^ {d for d, _ in plain.held(some, items)}) <= 1


def test_packing_stage(stages):
    before, after = stages[4]
    assert sorted({r.doc_id for r in after.collect()}) == sorted(i for i, _ in texts(before))


def test_run_is_the_stages(spark, stages):
    key = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert key(cp.run(spark, SF)) == key(stages[-1][1])


def test_language_stage_with_clashing_columns(spark):
    docs = queries.read(spark, SF, "documents").withColumns({"score": F.lit(1), "lang_pred": F.lit("x")})
    assert cp.identify_language(spark, docs, SF).columns == docs.columns


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    queries.read(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_run_on_an_empty_table(spark, tmp_path):
    assert cp.run(spark, tables(spark, tmp_path, [])).count() == 0


def test_run_on_nulls_repeated_rows_and_a_very_long_text(spark, tmp_path):
    long = " ".join(f"word{k} of many" for k in range(100_000))
    text = lambda k: " ".join(f"plain{(k * 7 + j) % 997} text" for j in range(30))
    rows = [(k, text(k), "en" if k % 2 else "de", None, None) for k in range(40)] + [(1, text(1), "en", None, None)] * 3 + [(None, text(90), "en", None, None), (None, text(90), None, None, None), (50, None, None, None, None), (51, "", "en", None, None), (52, " ", None, None, None), (53, "12 34", "en", None, None), (54, long, "de", None, None), (55, long, "en", None, None)]
    got = cp.run(spark, tables(spark, tmp_path, rows))
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert ids <= {*range(40), 54, None} and {1, 54, None} <= ids
    assert got.filter("doc_id = 1 and start = 0").count() == 1  # of rows that repeat id and text one stays
