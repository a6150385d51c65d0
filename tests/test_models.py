"""The model queries against what numpy makes of the same rows."""


import numpy as np
import pytest

from tidemark import catalogue
from tidemark.operators import models, solvers
from tidemark.plans import reports


@pytest.fixture(scope="module")
def rows(spark, sf):
    pdf = reports._lagged(spark, sf).toPandas().sort_values(["stock_code", "date"])
    return {k: (np.stack(g.x.to_numpy()).astype(float), g.y.to_numpy(float)) for k, g in pdf.groupby("stock_code")}


def weights(got, key, p):
    w, b = np.zeros(p), 0.0
    for r in got:
        if r.stock_code == key:
            if r.feature < 0:
                b = r.coefficient
            else:
                w[r.feature] = r.coefficient
    return w, b


def test_lasso_is_optimal(spark, sf, rows):
    got = catalogue.QUERIES["lasso_cd"](spark, sf).collect()
    assert {r.stock_code for r in got} == set(rows)
    for k, (x, y) in rows.items():
        w, b = weights(got, k, x.shape[1])
        r = y - x @ w - b
        slope = (x - x.mean(0)).T @ r / len(y)
        assert abs(r.mean()) < 1e-9 and (np.abs(slope) <= 1e-5 + 1e-8).all()
        assert slope[w != 0] == pytest.approx(1e-5 * np.sign(w[w != 0]), abs=1e-8)


def test_fista_comes_near_the_least_loss(spark, sf, rows):
    got = catalogue.QUERIES["fista_lasso"](spark, sf).collect()
    for k, (x, y) in rows.items():
        loss = lambda w: ((y - x @ w) ** 2).mean() / 2 + 1e-5 * np.abs(w).sum()  # noqa: B023, E731
        w, _ = weights(got, k, x.shape[1])
        assert loss(w) <= loss(solvers.fista(x, y, 1e-5, steps=50_000, tol=1e-12)) + 1e-6


def test_cross_validation_takes_the_penalty_with_the_least_error(spark, sf, rows):
    got = {r.stock_code: r for r in catalogue.QUERIES["lasso_cv"](spark, sf).collect()}
    for k, (x, y) in list(rows.items())[:8]:
        order = np.random.RandomState(42).permutation(len(y))
        errors = []
        for a in models.ALPHAS:
            e = []
            for part in (p for p in np.array_split(order, min(5, len(y))) if len(p)):
                rest = np.array(sorted(set(range(len(y))) - set(part.tolist())))
                e.append(((y[part] - x[part] @ solvers.fista(x[rest], y[rest], a)) ** 2).mean())
            errors.append(round(float(np.mean(e)), 12))
        assert got[k].alpha == max(a for a, e in zip(models.ALPHAS, errors) if e == min(errors))
        assert got[k].used == (np.abs(solvers.fista(x, y, got[k].alpha)) > 1e-12).sum()


def test_stability_is_how_often_a_column_is_used(spark, sf, rows):
    got = catalogue.QUERIES["stability_selection"](spark, sf).collect()
    for k, (x, y) in list(rows.items())[:8]:
        rng, used = np.random.RandomState(42), np.zeros(x.shape[1])
        for _ in range(5):
            at = rng.choice(len(y), max(2, int(0.7 * len(y))), replace=False)
            used += np.abs(solvers.lasso_cd(x[at], y[at], 1e-4)[0]) > 1e-10
        own = sorted((r for r in got if r.stock_code == k), key=lambda r: r.feature)
        assert [r.probability for r in own] == pytest.approx((used / 5).tolist())
        if (used >= 3).any():
            assert all(r.coefficient == 0 for r in own if r.probability < 0.6)


def test_ridge_is_the_closed_form(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    got = {r.stock_code: r for r in catalogue.QUERIES["ridge_embeddings"](spark, sf).collect()}
    for k, g in e.groupby(e.label % 5):
        x, y = np.stack(g.embedding.to_numpy()).astype(float), (g.label % 2).to_numpy(float)
        sd = x.std(0)
        z = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
        a = np.vstack([z, np.eye(z.shape[1])])  # a unit penalty as rows of their own
        w = np.linalg.lstsq(a, np.concatenate([y - y.mean(), np.zeros(z.shape[1])]), rcond=None)[0]
        p = z @ w + y.mean()
        assert got[str(k)].mse == pytest.approx(((y - p) ** 2).mean(), abs=1e-9)


def test_optimal_lag_has_the_best_direction(spark, sf):
    from tidemark.fixtures import price

    got = {r.stock_code: (r.lag, r.hit_rate) for r in catalogue.QUERIES["optimal_lag"](spark, sf).collect()}
    pdf = price(spark, sf).toPandas().sort_values(["stock_code", "date"])
    for k, g in list(pdf.groupby("stock_code"))[:8]:
        v, best = g.return_rate.to_numpy(float), (0, -1.0)
        for lag in range(1, 6):
            x = np.array([[v[i - j] for j in range(1, lag + 1)] for i in range(lag, len(v))])
            y = v[lag:]
            cut = int(len(y) * 0.8)
            hit = 0.0
            if cut >= 2 and cut < len(y):
                w, b = solvers.lasso_cd(x[:cut], y[:cut], 1e-5)
                hit = float((np.sign(x[cut:] @ w + b) == np.sign(y[cut:])).mean())
            if len(y) and hit > best[1]:
                best = (lag, hit)
        assert got.get(k, (0, -1.0)) == (best[0], pytest.approx(best[1]))


def test_walk_forward_covers_every_stock(spark, sf, rows):
    got = catalogue.QUERIES["walk_forward"](spark, sf).collect()
    assert all(np.isfinite([r.predicted, r.actual]).all() for r in got) and len({(r.stock_code, r.test_date) for r in got}) == len(got)


def test_hybrid_is_the_blend_of_words_and_a_ridge_on_vectors(spark, sf):
    from tidemark.fixtures import price
    from tidemark.operators import training
    from tidemark.plans import signals

    rows = training.numbered(price(spark, sf), ["excess_return"])
    v = signals.day_vectors(spark, sf, rows).toPandas()
    got = catalogue.QUERIES["hybrid_prediction"](spark, sf).collect()
    tested = 0
    for r in got:
        own = v[v.stock_code == r.stock_code].sort_values("pos")
        tr = own[(own.date.astype(str) >= signals.FIRST) & (own.date.astype(str) <= signals.LAST)]
        if len(tr) < 2:
            assert r.vectors is None
            continue
        x, y = np.stack(tr.x.to_numpy()).astype(float), tr.y.to_numpy(float)
        sd = np.where(x.std(0) > 0, x.std(0), 1)
        z = (x - x.mean(0)) / sd
        w = np.linalg.lstsq(np.vstack([z, np.eye(z.shape[1])]), np.concatenate([y - y.mean(), np.zeros(z.shape[1])]), rcond=None)[0]
        at = np.array(own[own.date.astype(str) == r.date].x.iloc[0], float)
        want = (at - x.mean(0)) / sd @ w + y.mean()
        assert r.vectors == pytest.approx(want, abs=1e-9) and r.blended == pytest.approx(0.6 * r.expected_alpha + 0.4 * want, abs=1e-9)
        assert r.direction == np.sign(r.blended)
        tested += 1
    assert tested > 5
