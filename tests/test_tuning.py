"""The window and penalty scan: every cell against a single fit of the trainer, two by loops, resumption, stability."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import lifecycle, solvers, training, tuning
from tidemark.plans import signals

TOL = 1e-12
MONTH = 4  # rows: the table is small
SF = "/root/testdata/sf0.01"
LAGS = signals.LAGS


@pytest.fixture(scope="module")
def given(spark):
    counts, rows, dense = signals.counted_set(spark, SF, technical=False)
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(2) as pool:
        return *pool.map(lambda x: x.toPandas(), (counts, rows)), dense


def cells_of(given, stock, tol=TOL):
    counts, rows, dense = given
    own = rows[rows.stock_code == stock].sort_values("pos")
    judged = len(own) - int(len(own) * 0.8)
    return own, tuning.Cells(tuning.Counts(counts[counts.stock_code == stock]), own.y.to_numpy(float), own[dense].to_numpy(float), judged, training.CRITICAL, LAGS, training.MIN_DF, training.MAX_DF, training.MAX_FEATURES, None, tol, MONTH)


def test_all_cells_are_single_fits(spark, given, tmp_path):
    counts, rows, dense = given
    parts_c, parts_r, mine = [], [], {}
    stocks = sorted(rows.stock_code.unique())[::8]
    for stock in stocks:
        own, cells = cells_of(given, stock)
        for months in tuning.WINDOWS:
            lo = max(0, cells.cut - MONTH * months)
            inside = own[(own.pos > lo) & (own.pos <= cells.cut)]
            words = counts[(counts.stock_code == stock) & (counts.pos > lo) & (counts.pos <= cells.cut)]
            key = f"{stock}#{months}"
            parts_r.append(inside.assign(stock_code=key, pos=inside.pos - lo, n_rows=len(inside)))
            parts_c.append(words.assign(stock_code=key, pos=words.pos - lo, n_rows=len(inside)))
            for alpha, w, _, _, x in cells.run(months, list(tuning.ALPHAS)):
                mine[key, alpha] = ({f: b for f, b, *_ in x.dictionary(w, dense)}, x)
    pd.concat(parts_c).to_parquet(tmp_path / "c.parquet")
    pd.concat(parts_r).to_parquet(tmp_path / "r.parquet")
    c, r = spark.read.parquet(f"{tmp_path}/c.parquet"), spark.read.parquet(f"{tmp_path}/r.parquet")
    days = training.day_tfidf(c, LAGS)
    same = 0
    for alpha in tuning.ALPHAS:
        want: dict = {}
        for x in training.train_dictionary(days, r, dense, LAGS, (alpha,), tol=TOL).collect():
            want.setdefault(x.stock_code, {})[x.feature] = x.beta
        for (key, a), (got, x) in mine.items():
            if a == alpha:
                have = want.get(key, {})
                same += all(got.get(f, 0.0) == pytest.approx(have.get(f, 0.0), abs=1e-8) for f in set(got) | set(have))
                # Where several models have the least loss, what they say of the rows and their size are the same all the same.
                at = {f"{x.vocabulary[c % len(x.vocabulary)]}_L{c // len(x.vocabulary) + 1}": j for j, c in enumerate(x.column.tolist())} | {f: x.words + j for j, f in enumerate(dense)}
                unit = np.concatenate([x.weight[x.column], np.ones(len(dense))])

                def weights(d):
                    w = np.zeros(x.p)
                    for f, v in d.items():
                        w[at[f]] = v / unit[at[f]]
                    return w

                said = [np.bincount(x.row, x.val * weights(d)[x.col], minlength=len(x.y)) for d in (got, have)]
                assert said[0] - said[0].mean() == pytest.approx(said[1] - said[1].mean(), abs=1e-8), (key, a)
                assert np.abs(weights(got)).sum() == pytest.approx(np.abs(weights(have)).sum(), rel=1e-6)
    assert len(mine) == 40 * len(stocks) and same > 0.7 * len(mine)


@pytest.mark.parametrize(("months", "alpha"), [(3, 5e-4), (12, 5e-4)])
def test_a_cell_by_loops(given, months, alpha):
    """TF-IDF, lags, scales and weights by loops over dense columns, the fit by plain coordinate descent."""
    counts, rows, dense = given
    stock = counts.groupby("stock_code").size().idxmax()
    own, cells = cells_of(given, stock)
    lo, cut, n_all = max(0, cells.cut - MONTH * months), cells.cut, len(own)
    day = {p: {} for p in range(n_all)}
    for r in counts[counts.stock_code == stock].itertuples():
        day[r.pos - 1][r.word] = r.tf
    docs = [day[i - k] if i - k >= lo else {} for i in range(lo, cut) for k in range(LAGS)]
    df = Counter(w for d in docs for w in d)
    vocabulary = sorted(w for w in df if 3 <= df[w] <= 0.85 * len(docs))
    idf = {w: math.log((1 + len(docs)) / (1 + df[w])) + 1 for w in vocabulary}

    def vector(p):
        v = {w: t * idf[w] for w, t in day[p].items() if w in idf}
        norm = math.sqrt(sum(a * a for a in v.values()))
        return {w: a / norm for w, a in v.items()}

    at = {(w, k): j for j, (k, w) in enumerate((k, w) for k in range(LAGS) for w in vocabulary)}
    x = np.zeros((n_all - lo, len(at)))
    for i in range(lo, n_all):
        for k in range(LAGS):
            if i - k >= lo:
                for w, a in vector(i - k).items():
                    x[i - lo, at[w, k]] = a
    y = cells.y[lo:cut]
    fit, test = x[: cut - lo], x[cut - lo :]
    top = np.where(fit.max(0) > 0, fit.max(0), 1)
    stands = fit > 0
    weight = np.array([np.abs(y)[stands[:, j]].mean() if stands[:, j].any() else 0.0 for j in range(len(at))])
    mean = weight[weight > 0].mean()
    stay = (stands.sum(0) >= 3) | (stands.any(0) & (weight > 2 * mean))
    decay = training.lag_decay(y, LAGS, None)
    weight = weight / weight.mean() * np.repeat(decay, len(vocabulary))
    z, m, sd = training.standardised(cells.dense[lo:cut])
    full = np.hstack([(fit / top * weight)[:, stay], z])
    w, b = solvers.lasso_cd(full, y, alpha, steps=20_000, tol=1e-13)
    want = np.hstack([(test / top * weight)[:, stay], (cells.dense[cut:] - m) / sd]) @ w + b
    (_, _, _, got, _), = cells.run(months, [alpha])
    assert got == pytest.approx(want, abs=1e-8)


def test_scan_resumes_and_is_whole(spark, given, tmp_path):
    counts, rows, dense = given
    few_stocks = sorted(rows.stock_code.unique())[:5]
    counts, rows = counts[counts.stock_code.isin(few_stocks)], rows[rows.stock_code.isin(few_stocks)]
    counts.to_parquet(tmp_path / "c.parquet")
    rows.to_parquet(tmp_path / "r.parquet")
    c, r = spark.read.parquet(f"{tmp_path}/c.parquet"), spark.read.parquet(f"{tmp_path}/r.parquet")
    few = {"windows": (3, 6), "alphas": (1e-4, 5e-5), "lags": LAGS, "month": MONTH}
    whole = {(x.stock_code, x.window_months, x.alpha): x for x in tuning.scan(c, r, dense, **few).collect()}
    assert len(whole) == 4 * rows.stock_code.nunique() and not any(x.error for x in whole.values())
    stock = counts.groupby("stock_code").size().idxmax()
    own, cells = cells_of(given, stock, 1e-6)
    for months in (3, 6):
        for alpha, _, _, p, _ in cells.run(months, [1e-4, 5e-5]):
            got = whole[stock, months, alpha]
            assert got.hit_rate == pytest.approx((np.sign(p) == np.sign(cells.y[cells.cut :])).mean())
            assert got.mae == pytest.approx(np.abs(p - cells.y[cells.cut :]).mean(), rel=1e-6)
    done = spark.createDataFrame([(*k, -1.0, -1.0, 0, None) for k in list(whole)[:7]], tuning.CELLS)
    rest = {(x.stock_code, x.window_months, x.alpha) for x in tuning.scan(c, r, dense, done=done, **few).collect()}
    assert rest == set(list(whole)[7:])
    path = f"file://{tmp_path}/cells"
    done.write.parquet(path)
    all_ = {(x.stock_code, x.window_months, x.alpha): x.hit_rate for x in tuning.checkpointed(spark, c, r, dense, path, **few).collect()}
    assert set(all_) == set(whole) and all(all_[k] == -1.0 for k in list(whole)[:7])
    before = spark.read.parquet(path).count()
    assert tuning.checkpointed(spark, c, r, dense, path, **few).count() == len(whole)
    assert spark.read.parquet(path).count() == before


def test_cells_that_cannot_be_fitted_say_so(spark):
    c = spark.createDataFrame([("a", 1, 1, "w", 2)], "stock_code string, pos int, n_rows int, word string, tf long")
    r = spark.createDataFrame([("a", 1, 1, 0.5), ("b", 1, 0, None)], "stock_code string, pos int, n_rows int, y double").filter("y is not null")
    got = tuning.scan(c, r, [], windows=(3,), alphas=(1e-4,)).collect()
    assert [(x.stock_code, x.hit_rate is None, bool(x.error)) for x in got] == [("a", True, True)]
    assert tuning.scan(c.limit(0), r.limit(0), []).count() == 0


def test_stability_is_that_of_the_rule(spark):
    r = np.random.default_rng(0)
    grid = {(m, a): (float(r.random()), float(r.random() * 0.2)) for m in (3, 4, 5) for a in (1e-5, 1e-4)}
    df = spark.createDataFrame([("s", m, a, h, e, 1, None) for (m, a), (h, e) in grid.items()], tuning.CELLS)
    ms, al = [3, 4, 5], [1e-5, 1e-4]
    got = {(x.window_months, x.alpha): x for x in tuning.stability(df).collect()}
    for (m, a), (_, e) in grid.items():
        i, j = ms.index(m), al.index(a)
        near = [grid[ms[p], al[q]][0] for p, q in ((i, j), (i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if 0 <= p < 3 and 0 <= q < 2]
        assert got[m, a].neighbours == len(near)
        assert got[m, a].stability == pytest.approx(0.6 * np.mean(near) + 0.4 * (1 - min(e / 0.1, 1)) - np.std(near))
    best = max(got.values(), key=lambda x: x.stability)
    assert lifecycle.promote(tuning.stability(df), "stock_code", "d").first().window_months == best.window_months


def test_scan_of_frequent_words_is_the_scan_of_all(spark):
    sf, few = "/root/testdata/sf0.001", {"windows": (3, 6, 12), "alphas": (1e-4, 5e-5), "lags": LAGS, "month": MONTH, "max_features": 60}
    counts, rows, dense = signals.counted_set(spark, sf, technical=False)
    _, n, _ = signals.learned_from(spark, sf, False, signals.FIRST, signals.LAST)
    from tidemark.fixtures import tokens

    articles = n.selectExpr("stock_code", "to_date(published_at) as date", "content")
    words = training.frequent_words(articles, rows, tokens(articles["content"]), signals.GRAMS, LAGS, max_features=60, ranges=tuning.ranges((3, 6, 12), month=MONTH))
    want, got = ({(x.stock_code, x.window_months, x.alpha): (x.hit_rate, x.used) for x in tuning.scan(c, rows, dense, **few).collect()} for c in (counts, words))
    assert got == want and len(got) == 6 * rows.select("stock_code").distinct().count() and any(u for _, u in got.values())
    query = signals.text_window_scan(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in query and "CoGroupsInPandas" not in query


def test_choice_rests_on_words_that_stay(spark, monkeypatch):
    """The table that every batch of stocks reads has a row for each word that a window keeps, not for each word and day."""
    seen = {}
    monkeypatch.setattr(tuning, "checkpointed", lambda spark, counts, rows, *a, **k: seen.update(counts=counts) or spark.createDataFrame([("a", 3, 1e-4, 0.5, 0.1, 1, None)], tuning.CELLS))
    assert signals.text_scan_choice(spark, "/root/testdata/sf0.001").count() == 1
    c = seen["counts"]
    assert dict(c.dtypes)["pos"] == "array<int>" and c.count() == c.select("stock_code", "word").distinct().count() > 0
