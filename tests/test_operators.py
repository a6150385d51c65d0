"""Hand-computed cases, properties and solver checks."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.operators import features, metrics, models, ordered, scoring, sinks, solvers
from tidemark.streaming import pipelines

D = dt.date


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, D(2024, 1, 1) + dt.timedelta(k), float(v)) for k, v in enumerate(values)], "k string, d date, v double")


def test_rsi_without_losses_is_zero_and_needs_fourteen_changes(spark):
    up = ordered.wilder_rsi(series(spark, range(1, 21)), "k", "d", "v").orderBy("d").collect()
    assert [r.rsi for r in up] == [0.0] * 20
    mixed = [10, 11, 10.5, 11.5, 11, 12, 11.5, 12.5, 12, 13, 12.5, 13.5, 13, 14, 13.5, 14.5]
    got = ordered.wilder_rsi(series(spark, mixed), "k", "d", "v").orderBy("d").collect()
    diffs = np.diff(mixed)
    g, lo = np.maximum(diffs[:14], 0).mean(), np.maximum(-diffs[:14], 0).mean()
    assert got[13].rsi == 0
    assert got[14].rsi == pytest.approx(100 - 100 / (1 + g / lo))
    g, lo = (13 * g + max(diffs[14], 0)) / 14, (13 * lo + max(-diffs[14], 0)) / 14
    assert got[15].rsi == pytest.approx(100 - 100 / (1 + g / lo))


def test_macd_of_a_constant_is_zero(spark):
    for r in ordered.macd(series(spark, [5.0] * 30), "k", "d", "v").collect():
        assert abs(r.macd) < 1e-12 and abs(r.macd_hist) < 1e-12


def test_asof_backward_takes_the_last_row_at_or_before(spark):
    left = spark.createDataFrame([("a", D(2024, 1, d)) for d in (1, 5, 9)] + [("b", D(2024, 1, 5))], "k string, d date")
    right = spark.createDataFrame([("a", D(2024, 1, 5), 1.0), ("a", D(2024, 1, 8), 2.0)], "k string, t date, x double")
    got = {(r.k, r.d.day): r.x for r in ordered.asof_backward(left, right, "k", "d", "t", ["x"]).collect()}
    assert got == {("a", 1): None, ("a", 5): 1.0, ("a", 9): 2.0, ("b", 5): None}


def test_impact_date_rolls_over_weekends_and_past_the_calendar(spark):
    days = ordered.calendar(spark.createDataFrame([(D(2024, 1, d),) for d in (2, 3, 5)], "date date"))
    rows = spark.createDataFrame([(D(2023, 12, 1),), (D(2024, 1, 3),), (D(2024, 1, 4),), (D(2024, 1, 6),), (D(2024, 1, 9),)], "x date")
    got = [r.impact_date for r in ordered.impact_date(rows, days, "x").orderBy("x").collect()]
    assert got == [D(2024, 1, 2), D(2024, 1, 3), D(2024, 1, 5), D(2024, 1, 8), D(2024, 1, 9)]


def test_live_session_leaves_the_morning_out(spark):
    rows = spark.sql("select timestamp '2024-01-02 03:00:00' as t union all select timestamp '2024-01-02 07:00:00'")
    assert [r[0] for r in rows.orderBy("t").select(ordered.session_date("t", "live7_0")).collect()] == [None, D(2024, 1, 3)]


@settings(max_examples=15, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=1))
def test_islands_partition_the_gaps(spark, present):
    df = spark.createDataFrame([("a", D(2024, 1, 1) + dt.timedelta(k)) for k in sorted(present)], "k string, d date")
    gaps = ordered.missing_days(df, "k", "d")
    total = max(present) - min(present) + 1 - len(present)
    runs = ordered.islands(gaps, "k").collect()
    assert sum(r.days for r in runs) == total
    assert all((r.end - r.start).days + 1 == r.days for r in runs)


def test_drift_needs_three_bad_windows(spark):
    bad = spark.createDataFrame([("a", D(2024, 1, 1) + dt.timedelta(k), False) for k in range(10)] + [("b", D(2024, 1, 1) + dt.timedelta(k), True) for k in range(10)] + [("c", D(2024, 1, 1) + dt.timedelta(k), False) for k in range(8)], "k string, d date, ok boolean")
    assert {r.k: r.drifted for r in ordered.drift(bad, "k", "d", "ok").collect()} == {"a": True, "b": False, "c": False}


def test_fista_on_orthonormal_columns_is_soft_thresholding():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.standard_normal((40, 6)))
    x, y = q * np.sqrt(40), rng.standard_normal(40)
    assert np.allclose(solvers.fista(x, y, 0.05, tol=1e-10), solvers.soft(x.T @ y / 40, 0.05), atol=1e-6)


def test_coordinate_descent_meets_the_optimality_conditions():
    rng = np.random.RandomState(42)
    x = rng.standard_normal((100, 50))
    y = x[:, :5] @ np.arange(1, 6) + 0.1 * rng.standard_normal(100) + 3
    w, b = solvers.lasso_cd(x, y, 0.01)
    g = (x - x.mean(0)).T @ (y - x @ w - b) / 100
    assert np.all(np.abs(g) <= 0.01 + 1e-6)
    assert np.allclose(g[w != 0], 0.01 * np.sign(w[w != 0]), atol=1e-6)


def test_stability_selection_finds_the_true_columns():
    rng = np.random.RandomState(1)
    x = rng.standard_normal((80, 20))
    prob, w = solvers.stability_selection(x, x[:, 3] * 2 - x[:, 7], 0.05)
    assert prob[3] == prob[7] == 1 and {3, 7} <= set(np.flatnonzero(np.abs(w) > 0.5))


def test_ridge_without_penalty_is_least_squares():
    rng = np.random.RandomState(2)
    x, y = rng.standard_normal((50, 3)), rng.standard_normal(50)
    w, b = solvers.ridge(x, y, 1e-9)
    assert np.allclose(np.linalg.lstsq(np.c_[x, np.ones(50)], y, rcond=None)[0], [*w, b], atol=1e-6)


def test_grid_scan_skips_done_cells_and_reports_errors(spark):
    rows = models.lagged(series(spark, np.sin(np.arange(60)) / 50), "k", "d", "v", 2)
    done = spark.createDataFrame([("a", 3, 1e-5)], "k string, window_months int, alpha double")
    got = models.grid_scan(rows, "k", "d", [3, 4], [1e-5, 1e-4], done).collect()
    assert len(got) == 3 and all(r.error is None and 0 <= r.hit_rate <= 1 for r in got)
    short = models.grid_scan(rows.limit(1), "k", "d", [3], [1e-5]).collect()
    assert short[0].hit_rate is None and short[0].error


def test_tfidf_rows_have_length_one(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "c"]), (3, []), (4, ["b", "c"])], "r int, t array<string>")
    tf = features.term_counts(rows, "r", "t")
    v = features.vocabulary(tf, None, rows, "r", min_df=2)
    assert {r.word: round(r.idf, 6) for r in v.collect()} == {w: round(float(np.log(5 / 3) + 1), 6) for w in "abc"}
    for r in features.tfidf(tf, v, "r").groupBy("r").agg(F.sum(F.col("value") ** 2).alias("s")).collect():
        assert r.s == pytest.approx(1)


def test_dictionary_scores_add_up(spark):
    tok = spark.createDataFrame([(1, w, 1.0) for w in ("up", "good", "rise", "x")], "k int, word string, weight double")
    lex = spark.createDataFrame([("up", 0.5), ("good", 0.3), ("rise", 0.8)], "word string, beta double")
    r = scoring.contributions(tok, lex, ["k"]).first()
    assert r.net == pytest.approx(1.6) and r.tokens == 4 and r.neg == 0


def test_relevance(spark):
    rows = spark.createDataFrame([(1, "Acme soars", "Acme Acme", "Acme", ["Rival"]), (2, "x", "", "Acme", []), (3, "Rival", "Rival Rival Acme", "Acme", ["Rival"]), (4, "none", "nothing here", "Acme", [])], "k int, t string, c string, n string, rivals array<string>")
    got = {r.k: (r.relevance_score, r.is_relevant) for r in scoring.relevance(rows, None, "k", "t", "c", "n").collect()}
    assert got == {1: (80, True), 2: (0, False), 3: (0, False), 4: (0, False)}  # counts are those of the content


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, x double")
    new = spark.createDataFrame([(2, None, 5.0), (3, "c", 3.0)], "k int, s string, x double")
    key = lambda df: {r.k: (r.s, r.x) for r in df.collect()}
    assert key(sinks.upsert(old, new, ["k"])) == {1: ("a", 1.0), 2: (None, 5.0), 3: ("c", 3.0)}
    assert key(sinks.upsert_keep_known(old, new, ["k"])) == {1: ("a", 1.0), 2: ("b", 5.0), 3: ("c", 3.0)}
    assert key(sinks.insert_absent(old, new, ["k"])) == {1: ("a", 1.0), 2: ("b", 2.0), 3: ("c", 3.0)}
    left, child = sinks.remove(old, new, ["k"], new)
    assert key(left) == {1: ("a", 1.0)} and child.count() == 0


def test_stability_on_a_missing_neighbour(spark):
    g = spark.createDataFrame([(0, 0, 0.5, 0.01), (1, 0, 0.7, 0.03)], "wi int, ai int, hit_rate double, mae double")
    r = {x.wi: x for x in metrics.neighbourhood(g).collect()}
    assert r[0].cells == 2 and r[0].stability == pytest.approx(0.6 * 0.6 + 0.4 * (1 - 0.2) - 0.1)


def test_sentences_and_ngrams(spark):
    df = spark.createDataFrame([("(서울=연합뉴스) Prices rose today. Short. Shares of the firm fell! Why?",)], "t string")
    assert df.select(expr.sentences(F.col("t"))).first()[0] == ["Prices rose today.", "Short.", "Shares of the firm fell!"]
    assert df.select(expr.ngrams(F.array(*[F.lit(x) for x in "abc"]), 3)).first()[0] == ["a", "b", "c", "a;b", "b;c", "a;b;c"]


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    src, out, state = (f"file://{tmp_path}/{x}" for x in ("src", "out", "state"))
    spark.range(5).write.parquet(src)
    pipelines.run(pipelines.first_seen(pipelines.arrivals(spark, src), ["id"]), "append", out, state)
    spark.range(3, 8).write.mode("append").parquet(src)
    got = pipelines.run(pipelines.first_seen(pipelines.arrivals(spark, src), ["id"]), "append", out, state)
    assert sorted(r.id for r in got.collect()) == list(range(8))


def test_relevance_by_aliases(spark):
    rows = spark.createDataFrame([(1, "AC soars", "AC AC AC", "Acme", ["Acme", "Rival"], ["AC"]), (2, "x", "Rival Rival AC", "Acme", ["Rival"], ["AC"])], "k int, t string, c string, n string, rivals array<string>, a array<string>")
    got = {r.k: (r.relevance_score, r.is_relevant) for r in scoring.relevance(rows, None, "k", "t", "c", "n", aliases="a").collect()}
    assert got == {1: (85, True), 2: (0, False)}


def test_walk_forward_is_a_fit_of_each_fold(spark):
    from tidemark.operators import solvers

    values = np.random.RandomState(3).standard_normal(160) / 50
    rows = models.lagged(series(spark, values), "k", "d", "v", 2)
    pdf = rows.orderBy("d").toPandas()
    days = ordered.calendar(rows.select(F.col("d").alias("date")))
    folds = ordered.walk_forward(days, 60, every=20).orderBy("pos").toPandas()
    got = {r.test_date: (r.predicted, r.actual) for r in models.walk_forward(rows, ordered.walk_forward(days, 60, every=20), "k", "d", 1e-5).collect()}
    want = {}
    for f in folds.itertuples():
        m = folds[folds.pos == f.model_pos].iloc[0]
        tr = pdf[(pdf.d >= m.train_start) & (pdf.d <= m.train_end)]
        if len(tr) >= 20:
            w, b = solvers.lasso_cd(np.stack(tr.x.to_numpy()), tr.y.to_numpy(float), 1e-5, steps=200, tol=1e-7)
            te = pdf[pdf.d == f.test_date].iloc[0]
            want[f.test_date] = (pytest.approx(float(np.array(te.x) @ w + b)), pytest.approx(te.y))
    assert got == want and len(got) > 50


def test_scaled_means_without_another_join(spark):
    x = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("b", -4.0), ("b", 2.0), ("c", 0.0)], "word string, value double")
    plain = {r.word: r.mean for r in features.max_abs(x).groupBy("word").agg(F.avg("value").alias("mean")).collect()}
    assert {r.word: r.mean for r in features.mean_max_abs(x).collect()} == plain == {"a": 0.75, "b": -0.25, "c": 0.0}
    from tidemark.plans import textual

    plan = textual.maxabs_scale(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # the number of rows, the vocabulary
