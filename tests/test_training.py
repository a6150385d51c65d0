"""Training on text against a plain version: cells of row and lag, TF-IDF, weights, and the fit's optimality."""

import math
from collections import Counter

import numpy as np
import pytest

from tidemark.operators import scoring, solvers, training
from tidemark.plans import signals


def plain_matrix(cells, y, lags, rate=None):
    """Weighted features {(word, lag): column} and weights from cells[row][lag - 1], lists of words; everything by loops."""
    n = len(cells)
    docs = [Counter(c) for row in cells for c in row]
    df, total = Counter(w for d in docs for w in d), sum(docs, Counter())
    kept = {w for w in df if 3 <= df[w] <= 0.85 * len(docs)}
    assert len(kept) <= training.MAX_FEATURES and total
    idf = {w: math.log((1 + len(docs)) / (1 + df[w])) + 1 for w in kept}
    x = {(w, k): np.zeros(n) for w in kept for k in range(1, lags + 1)}
    for i, row in enumerate(cells):
        for k, c in enumerate(row, 1):
            v = {w: m * idf[w] for w, m in Counter(c).items() if w in kept}
            norm = math.sqrt(sum(a * a for a in v.values()))
            for w, a in v.items():
                x[w, k][i] = a / norm
    x = {f: c / c.max() if c.max() > 0 else c for f, c in x.items()}
    count = {f: int((c > 0).sum()) for f, c in x.items()}
    weight = {f: np.abs(y)[c > 0].mean() if count[f] else 0.0 for f, c in x.items()}
    mean = np.mean([v for v in weight.values() if v > 0])
    stay = {f for f in x if count[f] >= 3 or (count[f] and weight[f] > 2 * mean)}
    scale = np.mean(list(weight.values()))
    decay = training.lag_decay(y, lags, rate)
    weight = {f: v / scale * decay[f[1] - 1] for f, v in weight.items()}
    return {f: x[f] * weight[f] for f in stay}, weight


@pytest.fixture(scope="module")
def trained(spark, sf):
    days, rows, dense = signals.training_set(spark, sf, technical=False)
    fitted = training.train_dictionary(days, rows, dense, signals.LAGS)
    return days.collect(), rows.collect(), dense, fitted.collect()


def cells_of(spark, sf, stock, rows):
    """The words of each row and lag from the articles themselves."""
    from pyspark.sql import functions as F

    from tidemark.fixtures import news, tokens
    from tidemark.functions import expr

    dates = [r.date for r in rows]
    day = [[] for _ in rows]
    for r in news(spark, sf).filter((F.col("stock_code") == stock) & (F.to_date("published_at") <= signals.LAST)).select(F.to_date("published_at").alias("d"), expr.ngrams(tokens(F.col("content")), signals.GRAMS).alias("w")).collect():
        after = [i for i, x in enumerate(dates) if x >= r.d]
        if after:
            day[after[0]] += r.w
    return [[day[i - k] if i >= k else [] for k in range(signals.LAGS)] for i in range(len(rows))]


def test_dictionaries_are_the_plain_ones(spark, sf, trained):
    days, rows, dense, fitted = trained
    tested = 0
    for stock in sorted({r.stock_code for r in days}):
        own = sorted((r for r in rows if r.stock_code == stock), key=lambda r: r.pos)
        y = np.array([r.y for r in own])
        cells = cells_of(spark, sf, stock, own)
        if len(y) < 4 or not any(c for row in cells for c in row):
            continue
        x, weight = plain_matrix(cells, y, signals.LAGS)
        names = sorted(x)
        d = np.array([[r[c] for c in dense] for r in own], float)
        sd = d.std(0)
        z = (d - d.mean(0)) / np.where(sd > 0, sd, 1)
        full = np.column_stack([*(x[f] for f in names), z])
        got = {r.feature: r for r in fitted if r.stock_code == stock}
        w = np.zeros(full.shape[1])
        for j, f in enumerate([*(f"{w_}_L{k}" for w_, k in names), *dense]):
            if f in got:
                w[j] = got[f].beta / (weight[names[j]] if j < len(names) else 1)
        assert set(got) <= {f"{w_}_L{k}" for w_, k in names} | set(dense)
        alpha = next(iter(got.values())).alpha if got else 1e-6
        c = full - full.mean(0)
        loss = lambda w: float(((y - y.mean() - c @ w) ** 2).mean() / 2 + alpha * np.abs(w).sum())  # noqa: B023, E731
        best, _ = solvers.lasso_cd(full, y, alpha, steps=400)
        assert loss(w) <= loss(best) + 2e-6 * loss(np.zeros(len(w)))
        for c_, m, s in zip(dense, d.mean(0), sd):
            if c_ in got:
                assert got[c_].mean == pytest.approx(m) and got[c_].scale == pytest.approx(s or 1.0)
        tested += 1
        if tested == 6:
            break
    assert tested == 6


def test_rare_words_are_rescued_and_critical_ones_weigh_more():
    y = np.array([0.01, -0.01, 0.01, -0.2, 0.01, 0.01])
    pos, word, value = np.array([1, 2, 3, 4, 5, 6, 2]), np.array([0, 0, 0, 1, 0, 0, 2]), np.ones(7)
    *_, weight, kept, _ = training.text_matrix(pos, word, value, 3, np.array([False, False, True]), y, 1, 3, 0.0)
    assert kept.tolist() == [True, True, True]  # frequent, volatile, critical
    *_, again, plain, _ = training.text_matrix(pos, word, value, 3, np.zeros(3, bool), y, 1, 3, 0.0)
    assert plain.tolist() == [True, True, False] and weight[2] / weight[0] > again[2] / again[0]


def test_decay():
    assert training.lag_decay(np.zeros(3), 3, 0.4).tolist() == pytest.approx([1, 1 / 1.4, 1 / 1.8])
    assert training.lag_decay(np.arange(4.0), 3, None).tolist() == pytest.approx([1, 2**-0.5, 3**-0.5])
    y = np.random.RandomState(0).standard_normal(60)
    c = [max(0.01, abs(np.corrcoef(y[:-k], y[k:])[0, 1])) for k in (1, 2, 3)]
    assert training.lag_decay(y, 3, None).tolist() == pytest.approx([v / max(c) for v in c])


def test_a_smaller_penalty_is_tried_where_the_dictionary_is_empty(spark):
    rows = spark.createDataFrame([("a", k, (0.01 if k % 2 else -0.01), float(k % 2)) for k in range(1, 9)], "stock_code string, pos int, y double, f double")
    days = spark.createDataFrame([], "stock_code string, pos int, word string, value double")
    got = training.train_dictionary(days, rows, ["f"], 2, alphas=(1.0, 1e-6)).collect()
    assert [(r.feature, r.alpha) for r in got] == [("f", 1e-6)] and got[0].beta > 0


@pytest.mark.parametrize("alpha", [1e-4, 1e-3])
def test_sparse_solver_agrees_with_the_dense_one(alpha):
    r = np.random.RandomState(2)
    x = (r.rand(80, 200) < 0.1) * r.rand(80, 200)
    x[:, 7] = x[:, 3]
    y = x[:, :4] @ np.array([0.05, -0.04, 0.03, 0.02]) + 0.01 * r.standard_normal(80)
    row, col = np.nonzero(x)
    w, b = solvers.lasso_sparse(row, col, x[row, col], 80, 200, y, alpha, tol=1e-12)
    v, c = solvers.lasso_cd(np.delete(x, 7, 1), y, alpha)
    assert np.delete(w, 7) == pytest.approx(v, abs=1e-6) and w[7] == 0 and b == pytest.approx(c, abs=1e-6)


def test_daily_run_settles_every_stock_with_words(spark, sf):
    got = signals.daily_training_and_prediction(spark, sf).collect()
    assert got and len({r.stock_code for r in got}) == len(got)
    for r in got:
        side = 1 if "Buy" in r.status else -1 if "Sell" in r.status else 0
        assert r.is_correct == (side * r.actual_alpha > 0) and abs(r.expected_alpha) <= 0.15


def test_critical_words_decide_the_status(spark):
    words = spark.createDataFrame([("a", "fire", 1, 1.0), ("b", "fire", 1, 1.0), ("c", "calm", 2, 0.5)], "k string, word string, lag int, weight double")
    d = spark.createDataFrame([("a", "fire_L1", -0.02), ("b", "fire_L1", 0.02), ("c", "calm_L2", 0.02)], "k string, feature string, beta double")
    dense = spark.createDataFrame([], "k string, feature string, value double, mean double, scale double")
    stats = spark.createDataFrame([(k, 10, 10.0, 0.02, 30, 8.0, None) for k in "abc"], "k string, last_volume long, mean_volume double, volatility double, n long, pbr double, mae double")
    got = {r.k: r for r in scoring.predict_advanced(words, d, dense, stats, ["k"], ["fire"]).collect()}
    m = math.log(2)
    assert {k: r.status for k, r in got.items()} == {"a": "Super Sell", "b": "Super Buy", "c": "Wait"}
    assert got["a"].net == pytest.approx(-0.02 * m) and got["b"].net == pytest.approx(0.02 * 0.8 * m) and got["c"].net == pytest.approx(0.01 * 0.8 * m)
    assert got["a"].negative == "fire:-20000" and got["c"].positive == "calm:10000" and got["c"].confidence == 30.0


def test_words_are_split_once(spark):
    """Spark must not push a test of the n-grams' number below the column that splits the text: every n-gram would split it again."""
    counts, _, _ = signals.counted_set(spark, "/root/testdata/sf0.001", technical=False)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    days = spark.createDataFrame([("a", "1995-01-02", ["x", "y", "x", "y"]), ("a", "1995-01-03", None), ("a", "1995-01-03", [])], "stock_code string, date string, words array<string>").selectExpr("stock_code", "cast(date as date) as date", "words")
    rows = spark.createDataFrame([("a", "1995-01-02", 1, 2), ("a", "1995-01-03", 2, 2)], "stock_code string, date string, pos int, n_rows long").selectExpr("stock_code", "cast(date as date) as date", "pos", "n_rows")
    assert {(r.pos, r.word): r.tf for r in training.day_counts(days, rows, 2).collect()} == {(1, "x"): 2, (1, "y"): 2, (1, "x;y"): 2, (1, "y;x"): 1}


def test_descent_on_dependent_columns_needs_few_rounds():
    """Far more columns than rows and a small penalty: coordinate steps alone creep."""
    rng = np.random.RandomState(5)
    x = rng.standard_normal((60, 100)) * 0.05 + rng.standard_normal((60, 1))
    x, y = x - x.mean(0), rng.standard_normal(60)
    y = y - y.mean()
    gram, q, alpha = x.T @ x / 60, x.T @ y / 60, 1e-4
    w = solvers._descend(gram, q, np.zeros(100), alpha, float(y @ y) / 120, 401, 1e-12)
    slope = q - gram @ w
    assert np.abs(slope).max() <= alpha * 1.001 and np.allclose(slope[w != 0], alpha * np.sign(w[w != 0]), atol=alpha * 1e-3)


def test_folds_share_counts_and_models_are_made_once(spark):
    cast = lambda df: df.withColumn("date", df["date"].cast("date"))
    news = cast(spark.createDataFrame([("a", f"1995-01-0{k}", ["x", "y", "x"][: k % 4]) for k in range(1, 8)] + [("b", "1995-01-03", ["z"])], "stock_code string, date string, words array<string>"))
    rows = cast(spark.createDataFrame([(f, f"1995-01-0{k}", i + 1, 2) for f, days in (("a#0", (2, 4)), ("a#1", (4, 7)), ("b#0", (3, 4))) for i, k in enumerate(days)], "stock_code string, date string, pos int, n_rows long"))
    folds = cast(spark.createDataFrame([(f, f[0], f"1995-01-0{k}") for f, lo, hi in (("a#0", 1, 4), ("a#1", 3, 6), ("b#0", 3, 3)) for k in range(lo, hi + 1)], "stock_code string, own string, date string"))
    got = {(r.stock_code, r.pos, r.word): r.tf for r in training.day_counts(news, rows, folds=folds).collect()}
    assert got == {("a#0", 1, "x"): 2, ("a#0", 1, "y"): 1, ("a#0", 2, "x"): 2, ("a#0", 2, "y"): 1, ("a#1", 1, "x"): 2, ("a#1", 1, "y"): 1, ("a#1", 2, "x"): 2, ("a#1", 2, "y"): 1, ("b#0", 1, "z"): 1}
    for query in (signals.walk_forward_scorer, signals.daily_training_and_prediction):
        assert "CoGroupsInPandas" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [40, training.MAX_FEATURES])
def test_frequent_words_are_those_of_the_plan(spark, sf, most):
    """Words counted in one task for each stock: the plan's words and values, ties at the cap too."""
    import pyarrow as pa

    counts, _, _ = signals.counted_set(spark, sf, technical=False)
    want = {(r.stock_code, r.pos, r.word): r.value for r in training.day_tfidf(counts, signals.LAGS, max_features=most).collect()}
    _, n, _ = signals.learned_from(spark, sf, False, signals.FIRST, signals.LAST)
    _, rows, _ = signals.word_set(spark, sf, technical=False)
    articles = n.selectExpr("stock_code", "to_date(published_at) as date", "content")
    from tidemark.fixtures import tokens

    words = training.frequent_words(articles, rows, tokens(articles["content"]), signals.GRAMS, signals.LAGS, max_features=most).toPandas()
    size, got = rows.groupBy("stock_code").count().toPandas().set_index("stock_code")["count"], {}
    schema = pa.schema([("stock_code", pa.string()), ("word", pa.string()), ("pos", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])
    for stock, own in words.groupby("stock_code"):
        assert len(own) <= most and own["word"].is_unique
        c = training.Counts.of(pa.Table.from_pandas(own, schema, preserve_index=False))
        ids, day, word, value = c.tfidf(0, int(size[stock]), signals.LAGS, training.MIN_DF, training.MAX_DF, most)
        got |= {(stock, d + 1, str(c.vocabulary[ids[w]])): v for d, w, v in zip(day.tolist(), word.tolist(), value.tolist(), strict=True)}
    assert len(want) > 1000 and set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())


def test_words_chosen_in_steps_and_by_ranges():
    import pyarrow as pa

    r = np.random.RandomState(1)
    texts = [[f"w{k}" for k in r.zipf(1.3, r.randint(0, 40)) if k < 60] for _ in range(80)] + [None]
    pos = r.randint(1, 13, len(texts))
    ranges = lambda n: [(0, n - 3), (4, n - 3)]
    tf: Counter = Counter()
    for t, p in zip(texts, pos.tolist()):
        for w in [*(t or []), *(f"{a};{b}" for a, b in zip(t or [], (t or [])[1:]))]:
            tf[w, p - 1] += 1
    keep = set()
    for lo, hi in ranges(12):
        df, total = Counter(), Counter()
        for (w, p), c in tf.items():
            if lo <= p < hi:
                df[w] += min(2, hi - p)
                total[w] += c * min(2, hi - p)
        keep |= set(sorted((w for w in df if 3 <= df[w] <= 0.85 * (hi - lo) * 2), key=lambda w: (-total[w], w))[:25])
    for at_once in (1 << 20, 50):
        a = training._Articles("a", 12, 2, 2, 3, 0.85, 25, ranges)
        for lo in range(0, len(texts), 30):
            a.add(pa.array(texts[lo : lo + 30], pa.list_(pa.string())), pa.array(pos[lo : lo + 30], pa.int32()))
        got = {(w, p - 1): c for b in a.chosen(at_once) for x in b.to_pylist() for w, p, c in zip([x["word"]] * len(x["pos"]), x["pos"], x["tf"])}
        assert got == {k: c for k, c in tf.items() if k[0] in keep}


def test_only_words_that_stay_travel(spark):
    """No day's words are dealt, and texts travel before they are split: the articles of a stock meet once."""
    words, _, _ = signals.word_set(spark, "/root/testdata/sf0.001", technical=False)
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Generate explode" not in plan
    assert plan.index("regexp_extract_all") < plan.index("RepartitionByExpression")
