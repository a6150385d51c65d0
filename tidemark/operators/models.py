"""Models per stock, window and penalty: one grouped Arrow call for each, over dense lagged return features."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import solvers

ALPHAS = [1e-5, 5e-5, 1e-4, 5e-4, 1e-3, 5e-3]


def lagged(df: DataFrame, key: str, by: str, value: str, lags: int) -> DataFrame:
    """(key, by, y, x array): a value and its last `lags` values; rows without all of them are left out."""
    w = Window.partitionBy(key).orderBy(by)
    cols = [F.lag(value, k).over(w) for k in range(1, lags + 1)]
    return df.select(key, by, F.col(value).alias("y"), F.array(*cols).alias("x")).filter(~F.exists("x", lambda v: v.isNull()) & F.col("y").isNotNull())


def per_group(df: DataFrame, keys: list[str], order: str, schema: str, fit: Callable[[np.ndarray, np.ndarray, tuple], list[tuple]]) -> DataFrame:
    """Calls fit(x, y, key) for each group of (keys, order, x, y); a group is one model's training rows, bounded by its window."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        rows = fit(np.stack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(float), key)
        return pd.DataFrame([(*key, *r) for r in rows], columns=names)

    return df.groupBy(*keys).applyInPandas(run, schema)


def lasso(df: DataFrame, key: str, order: str, alpha: float) -> DataFrame:
    def fit(x, y, _):
        w, b = solvers.lasso_cd(x, y, alpha)
        return [(-1, b), *[(j, float(v)) for j, v in enumerate(w) if abs(v) > 1e-12]]

    return per_group(df, [key], order, f"{key} string, feature int, coefficient double", fit)


def lasso_fista(df: DataFrame, key: str, order: str, alpha: float) -> DataFrame:
    return per_group(df, [key], order, f"{key} string, feature int, coefficient double", lambda x, y, _: [(j, float(v)) for j, v in enumerate(solvers.fista(x, y, alpha)) if v])


def lasso_cv(df: DataFrame, key: str, order: str, alphas: list[float] = ALPHAS, solver: str = "fista") -> DataFrame:
    def fit(x, y, _):
        a, w, _b = solvers.cross_validated(x, y, alphas, solver)
        return [(a, int((np.abs(w) > 1e-12).sum()))]

    return per_group(df, [key], order, f"{key} string, alpha double, used int", fit)


def stable_features(df: DataFrame, key: str, order: str, alpha: float) -> DataFrame:
    def fit(x, y, _):
        prob, w = solvers.stability_selection(x, y, alpha)
        return [(j, float(p), float(v)) for j, (p, v) in enumerate(zip(prob, w, strict=True))]

    return per_group(df, [key], order, f"{key} string, feature int, probability double, coefficient double", fit)


def ridge_fit(df: DataFrame, key: str, order: str, penalty: float = 1.0) -> DataFrame:
    def fit(x, y, _):
        w, b = solvers.ridge(x, y, penalty)
        return [(b, float(np.abs(w).max(initial=0)), float(((y - x @ w - b) ** 2).mean()))]

    return per_group(df, [key], order, f"{key} string, intercept double, largest double, mse double", fit)


def ridge_predict(train: DataFrame, test: DataFrame, key: str, order: str, penalty: float = 1.0) -> DataFrame:
    """(key, order, predicted): what each key's ridge on standardised columns, fitted on its training rows (order, y, x), says of its test rows. Keys
    with fewer than two training rows predict nothing."""
    kind = dict(test.dtypes)[order]

    def run(k: tuple, tr: pd.DataFrame, te: pd.DataFrame) -> pd.DataFrame:
        if len(tr) < 2 or not len(te):
            return pd.DataFrame(columns=[key, order, "predicted"])
        tr = tr.sort_values(order)
        w, b = solvers.ridge(np.stack(tr["x"].to_numpy()).astype(float), tr["y"].to_numpy(float), penalty)
        return pd.DataFrame({key: k[0], order: te[order], "predicted": np.stack(te["x"].to_numpy()).astype(float) @ w + b})

    named = test.select(*[F.col(c).alias(c) for c in (key, order, "x")])  # columns of their own, as both may come from one table
    return train.select(key, order, "y", "x").groupBy(key).cogroup(named.groupBy(key)).applyInPandas(run, f"{key} string, {order} {kind}, predicted double")


def mean_vectors(rows: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """(keys, x): the mean of each key's vectors, element by element."""
    each = rows.select(*keys, F.posexplode(vec).alias("i", "v")).groupBy(*keys, "i").agg(F.avg("v").alias("v"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e.v).alias("x"))


def optimal_lag(df: DataFrame, key: str, by: str, value: str, most: int = 5, alpha: float = 1e-5) -> DataFrame:
    """(key, lag, hit_rate): the lag count with the best direction on the last fifth of rows; of equals the smaller."""
    parts = [lagged(df, key, by, value, k).withColumn("lag", F.lit(k)) for k in range(1, most + 1)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)

    def fit(x, y, _):
        cut = int(len(y) * 0.8)
        if cut < 2 or cut == len(y):
            return [(0.0,)]
        w, b = solvers.lasso_cd(x[:cut], y[:cut], alpha)
        return [(float((np.sign(x[cut:] @ w + b) == np.sign(y[cut:])).mean()),)]

    scored = per_group(rows, [key, "lag"], by, f"{key} string, lag int, hit_rate double", fit)
    return scored.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("hit_rate"), "lag"))).filter("k = 1").drop("k")


def walk_forward(df: DataFrame, folds: DataFrame, key: str, by: str, alpha: float) -> DataFrame:
    """(key, test_date, predicted, actual): each retraining fold's model, from rows with train_start <= date <= train_end (20 at least), predicts
    until the next retraining. Every key's rows are moved and sorted once; a fold is a slice of them. The folds, a row per trading
    day, go along with the function."""
    f = folds.select("model_pos", "test_date", "train_start", "train_end", "retrain").toPandas()
    fits = f[f.retrain].sort_values("model_pos")
    model = dict(zip(f.test_date, f.model_pos, strict=True))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by)
        dates, x, y = pdf[by].to_numpy("datetime64[D]"), np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy(float)
        fold = np.array([model.get(d, -1) for d in pdf[by]])
        out = []
        for pos, lo, hi in zip(fits.model_pos, *(np.searchsorted(dates, fits[c].to_numpy("datetime64[D]"), side) for c, side in (("train_start", "left"), ("train_end", "right"))), strict=True):
            at = np.flatnonzero(fold == pos)
            if hi - lo >= 20 and len(at):
                w, b = solvers.lasso_cd(x[lo:hi], y[lo:hi], alpha, steps=200, tol=1e-7)
                out.append(pd.DataFrame({key: pdf[key].iloc[0], "test_date": pdf[by].iloc[at], "predicted": x[at] @ w + b, "actual": y[at]}))
        return pd.concat(out) if out else pd.DataFrame(columns=[key, "test_date", "predicted", "actual"])

    return df.groupBy(key).applyInPandas(run, f"{key} string, test_date date, predicted double, actual double")


def grid_scan(df: DataFrame, key: str, by: str, windows: list[int], alphas: list[float], done: DataFrame | None = None) -> DataFrame:
    """(key, window_months, alpha, hit_rate, mae, error): every cell on its own; cells of `done` are skipped, a failing cell reports its error.
    A cell's window counts back from the last fifth of rows, on which it is judged. A key's rows are moved once, whatever the number of cells."""
    schema = f"{key} string, window_months int, alpha double, hit_rate double, mae double, error string"
    names = [c.split()[0] for c in schema.split(", ")]

    def cell(x: np.ndarray, y: np.ndarray, window: int, alpha: float) -> tuple:
        try:
            cut = int(len(y) * 0.8)
            lo = max(0, cut - 21 * window)
            if not cut - lo or cut == len(y):
                raise ValueError("a cell needs rows to fit and rows to judge it by")
            w, b = solvers.lasso_cd(x[lo:cut], y[lo:cut], alpha, steps=200, tol=1e-7)
            p = x[cut:] @ w + b
            return float((np.sign(p) == np.sign(y[cut:])).mean()), float(np.abs(p - y[cut:]).mean()), None
        except (ValueError, ZeroDivisionError, np.linalg.LinAlgError) as e:
            return None, None, str(e)[:200]

    def run(k: tuple, pdf: pd.DataFrame, seen: pd.DataFrame | None = None) -> pd.DataFrame:
        skip = set() if seen is None else set(zip(seen.window_months, seen.alpha, strict=True))
        if not len(pdf):
            return pd.DataFrame(columns=names)
        pdf = pdf.sort_values(by)
        x, y = np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy(float)
        with np.errstate(invalid="ignore"):
            return pd.DataFrame([(*k, w, a, *cell(x, y, w, a)) for w in windows for a in alphas if (w, a) not in skip], columns=names)

    if done is None:
        return df.groupBy(key).applyInPandas(lambda k, pdf: run(k, pdf), schema)
    return df.groupBy(key).cogroup(done.select(key, "window_months", "alpha").groupBy(key)).applyInPandas(lambda k, pdf, seen: run(k, pdf, seen), schema)


def blend(tfidf: F.Column, other: F.Column, share: float = 0.6) -> F.Column:
    return share * tfidf + (1 - share) * other
