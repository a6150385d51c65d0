"""Queries give a result for every stock and for the whole of each text."""

import datetime
import hashlib

import numpy as np
import pytest

from tidemark import catalogue
from tidemark.operators import solvers
from tidemark.plans import reports


def test_grid_scan_covers_every_stock(spark, sf):
    rows = reports._lagged(spark, sf).toPandas()
    got = {(r.stock_code, r.window_months, r.alpha): r for r in catalogue.QUERIES["grid_scan"](spark, sf).collect()}
    assert len(got) == 40 * rows.stock_code.nunique()
    assert {k[0] for k in got} == set(rows.stock_code)
    for stock, window, alpha in [(min(rows.stock_code), 3, 1e-5), (max(rows.stock_code), 12, 1e-4), (max(rows.stock_code), 3, 5e-4)]:
        one = rows[rows.stock_code == stock].sort_values("date")
        cut = int(len(one) * 0.8)
        x, y = np.stack(one.x.to_numpy()), one.y.to_numpy(float)
        w, b = solvers.lasso_cd(x[max(0, cut - 21 * window) : cut], y[max(0, cut - 21 * window) : cut], alpha, steps=200, tol=1e-7)
        p, r = x[cut:] @ w + b, got[stock, window, alpha]
        assert r.error is None
        assert r.hit_rate == pytest.approx((np.sign(p) == np.sign(y[cut:])).mean())
        assert r.mae == pytest.approx(np.abs(p - y[cut:]).mean())


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_pivot_distribution_has_every_stock_and_day(spark, tmp_path):
    d = documents(spark, tmp_path, [(k, "text", "en", "src1", 4) for k in (0, 3, 24, 24 + 241 * 25, 30, 55, 199)])
    got = {r.day: {k: v for k, v in r.asDict().items() if k != "day"} for r in catalogue.QUERIES["pivot_distribution"](spark, d).collect()}
    want = {}
    for k in (0, 3, 24, 24 + 241 * 25, 30, 55, 199):
        day = str(datetime.date(1995, 1, 2) + datetime.timedelta(k % 241))
        want.setdefault(day, dict.fromkeys([f"s{s}" for s in range(25)], 0))[f"s{k % 25}"] += 1
    assert got == want


def test_sentence_split_reads_the_whole_text(spark, tmp_path):
    said = [f"Sentence number {k} has some words." for k in range(400)]
    d = documents(spark, tmp_path, [(1, " ".join(said), "en", "src1", 0), (2, "\n".join(said[:3]), "en", "src1", 0)])
    got = {r.doc_id: (r.n, r.joined) for r in catalogue.QUERIES["sentence_split"](spark, d).collect()}
    assert got == {1: (400, "|".join(said)), 2: (3, "|".join(said[:3]))}


def test_relevance_score_counts_over_the_whole_content(spark, tmp_path):
    pad = "x" * 5000
    rows = [(1, pad + "7777", "en", "src7", 0), (2, pad + "77772222222", "en", "src7", 0), (3, "7" + pad, "en", "src7", 0), (4, "7" + pad + "444", "en", "src7", 0)]
    got = {r.doc_id: (r.relevance_score, r.is_relevant) for r in catalogue.QUERIES["relevance_score"](spark, documents(spark, tmp_path, rows)).collect()}
    assert got == {1: (20, False), 2: (0, False), 3: (75, True), 4: (65, True)}


def test_ngrams_cover_the_whole_content(spark, tmp_path):
    words = [f"word{k}" for k in range(500)]
    got = {r.doc_id: (r.n, r.digest) for r in catalogue.QUERIES["ngrams_123"](spark, documents(spark, tmp_path, [(1, " ".join(words), "en", "src1", 0), (2, "One two", "en", "src1", 0), (3, "", "en", "src1", 0)])).collect()}
    plain = lambda w: [";".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]
    assert got == {i: (len(plain(w)), hashlib.sha256(" ".join(plain(w)).encode()).hexdigest()) for i, w in ((1, words), (2, ["one", "two"]), (3, []))}
