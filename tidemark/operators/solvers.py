"""Sparse and ridge regression in numpy, run inside grouped Arrow functions; a group is one stock, window and penalty."""

from __future__ import annotations

import numpy as np


def soft(x: np.ndarray | float, t: float):
    return np.sign(x) * np.maximum(np.abs(x) - t, 0)


def lasso_cd(x: np.ndarray, y: np.ndarray, alpha: float, steps: int = 2000, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """Coefficients and intercept that minimise |y - x w - b|^2 / 2n + alpha |w|_1, by coordinate descent over an active set."""
    n, p = x.shape
    mx, my = x.mean(0), y.mean()
    xc, r = x - mx, y - my
    scale = (xc * xc).sum(0) / n
    w = np.zeros(p)
    use = np.flatnonzero(scale > 0)
    for k in range(steps):
        full = k % 10 == 0
        most = 0.0
        for j in use if full else np.flatnonzero(w):
            new = float(soft(w[j] * scale[j] + xc[:, j] @ r / n, alpha)) / scale[j]
            if new != w[j]:
                r -= xc[:, j] * (new - w[j])
                most = max(most, abs(new - w[j]))
                w[j] = new
        if full and most < tol:
            break
    return w, float(my - mx @ w)


class SparsePath:
    """Lassos over one sparse matrix of n rows and p columns in coordinates, for one penalty after the other: what lasso_cd minimises.

    Coordinate descent on the products of a working set, which grows by the columns that most break the optimality conditions and stays from penalty to
    penalty, with its coefficients. Columns that the duality gap shows to be zero at the optimum are left out of the conditions (a safe rule). Of
    equal columns the first stands for all.
    """

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, p: int, y: np.ndarray):
        self.row, self.col, self.val, self.n, self.p = row, col, val, n, p
        self.mean = np.bincount(col, val, minlength=p) / n
        self.scale = np.bincount(col, val * val, minlength=p) / n - self.mean * self.mean
        mark = np.random.RandomState(0).standard_normal((2, n))
        _, first = np.unique(np.round([np.bincount(col, val * m[row], minlength=p) for m in mark], 11), axis=1, return_index=True)
        self.open = np.zeros(p, bool)
        self.open[first] = self.scale[first] > 1e-12
        self.middle = y.mean()
        self.y = y - self.middle
        self.start = float(self.y @ self.y) / (2 * n)
        self.w, self.r, self.used = np.zeros(p), self.y.copy(), np.zeros(0, np.int64)
        self.x, self.gram, self.q = np.zeros((n, 0)), np.zeros((0, 0)), np.zeros(0)

    def _take(self, new: np.ndarray) -> None:
        """Columns into the working set."""
        more = np.zeros((self.n, len(new)))
        place = np.full(self.p, -1)
        place[new] = np.arange(len(new))
        mine = place[self.col] >= 0
        np.add.at(more, (self.row[mine], place[self.col[mine]]), self.val[mine])
        more -= more.mean(0)
        cross = self.x.T @ more / self.n
        self.gram = np.block([[self.gram, cross], [cross.T, more.T @ more / self.n]])
        self.x, self.q = np.hstack([self.x, more]), np.concatenate([self.q, more.T @ self.y / self.n])
        self.used = np.concatenate([self.used, new])

    def begin(self, w: np.ndarray) -> None:
        """Coefficients to start from."""
        new = np.setdiff1d(np.flatnonzero((w != 0) & self.open), self.used)
        if len(new):
            self._take(new)
        self.w = np.where(self.open, w, 0.0)
        self.r = self.y - self.x @ self.w[self.used]

    def solve(self, alpha: float, steps: int = 2000, tol: float = 1e-6) -> tuple[np.ndarray, float]:
        """Coefficients and intercept, to a duality gap of tol times the objective of no coefficients."""
        n, live = self.n, self.open.copy()
        row, col, val = self.row, self.col, self.val
        while self.start > 0:
            slope = np.bincount(col, val * self.r[row], minlength=self.p) / n - self.mean * self.r.sum() / n
            slope[~live] = 0
            most = np.abs(slope).max(initial=0.0)
            shrink = min(1.0, alpha / most) if most else 1.0
            theta = self.r / n * shrink
            gap = float(self.r @ self.r) / (2 * n) + alpha * np.abs(self.w).sum() - float(self.y @ theta - n / 2 * (theta @ theta))
            wrong = np.where(live, np.abs(slope) - alpha, 0.0)
            wrong[self.used] = 0
            new = np.flatnonzero(wrong > 0)
            if gap <= tol * self.start or not len(new):
                if len(self.used) and gap > tol * self.start:
                    before = self.w[self.used].copy()
                    self._descend(alpha, steps, tol)
                    if np.abs(self.w[self.used] - before).max() > 0:
                        continue
                break
            keep = np.abs(slope) * shrink + np.sqrt(np.maximum(self.scale, 0) * 2 * max(gap, 0.0)) * (1 + 1e-9) >= alpha
            keep[self.used] = True
            if (live & keep).sum() < 0.5 * live.sum():
                live &= keep
                inside = live[col]
                row, col, val = row[inside], col[inside], val[inside]
                new = new[live[new]]
            self._take(new[np.argsort(-wrong[new], kind="stable")][: max(20, len(self.used))])
            self._descend(alpha, steps, tol)
        return self.w.copy(), float(self.middle - self.mean @ self.w)

    def _descend(self, alpha: float, steps: int, tol: float) -> None:
        self.w[self.used] = _descend(self.gram, self.q, self.w[self.used], alpha, self.start, steps, tol / 3)
        self.r = self.y - self.x @ self.w[self.used]


def lasso_sparse(row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, p: int, y: np.ndarray, alpha: float, steps: int = 2000, tol: float = 1e-6) -> tuple[np.ndarray, float]:
    """One penalty of a SparsePath."""
    return SparsePath(row, col, val, n, p, y).solve(alpha, steps, tol)


def _descend(gram: np.ndarray, q: np.ndarray, w: np.ndarray, alpha: float, start: float, steps: int, tol: float) -> np.ndarray:
    """Coordinate descent for w gram w / 2 - q w + alpha |w|, over all coordinates now and then and over the nonzero ones between; before all of them
    the nonzero ones are solved for at once."""
    w, slope, scale = w.copy(), q - gram @ w, np.diag(gram).copy()
    for k in range(steps):
        gain = 0.0
        if k and k % 10 == 0:
            w = _solved(gram, q, w, alpha, start)
            slope = q - gram @ w
        for j in range(len(w)) if k % 10 == 0 else np.flatnonzero(w).tolist():
            z = w[j] * scale[j] + slope[j]
            now = (z - alpha if z > alpha else z + alpha if z < -alpha else 0.0) / scale[j]
            if (d := now - w[j]) != 0:
                slope -= gram[j] * d
                w[j] = now
                gain += d * d * scale[j]
        if k % 10 == 0 and gain < tol * tol * start:
            break
    return w


def _solved(gram: np.ndarray, q: np.ndarray, w: np.ndarray, alpha: float, start: float, passes: int = 50) -> np.ndarray:
    """w moved towards the least value with its signs: where a coordinate meets 0 on the way it stays there and the others go on. A pass also weighs how
    far it moves, by so little that only columns that depend on each other feel it. w itself where the value is not lower."""
    value = lambda v: float(v @ gram @ v / 2 - q @ v + alpha * np.abs(v).sum())
    new, small = w.copy(), 1e-9 * float(np.diag(gram).mean()) if len(w) else 0.0
    for _ in range(passes):
        at = np.flatnonzero(new)
        if not len(at):
            break
        own, sign = new[at], np.sign(new[at])
        square = gram[np.ix_(at, at)] + small * np.eye(len(at))
        to = np.linalg.solve(square, q[at] - alpha * sign + small * own)
        out = np.flatnonzero(to * sign < 0)
        if not len(out):
            new[at] = to
            break
        part = own[out] / (own[out] - to[out])
        new[at] = own + part.min() * (to - own)
        new[at[out[part == part.min()]]] = 0.0
    return new if value(new) < value(w) and alpha * np.abs(new).sum() <= start else w


def lipschitz(x: np.ndarray, large: int = 20_000) -> float:
    """An upper bound of the gradient's slope: the trace, or ten power steps where there are very many columns."""
    n, p = x.shape
    if p <= large:
        return float((x * x).sum() / n)
    v = np.ones(p) / np.sqrt(p)
    for _ in range(10):
        v = x.T @ (x @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    return float(1.05 * np.linalg.norm(x @ v) ** 2 / n)


def fista(x: np.ndarray, y: np.ndarray, alpha: float, steps: int = 5000, tol: float = 1e-4) -> np.ndarray:
    """Lasso without intercept by accelerated proximal gradient steps with momentum (t - 1) / (t + 1), until no coefficient moves by tol."""
    n, p = x.shape
    bound = max(lipschitz(x), 1e-12)
    w, v, t = np.zeros(p), np.zeros(p), 1.0
    for _ in range(steps):
        new = soft(v - x.T @ (x @ v - y) / (n * bound), alpha / bound)
        t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / (t + 1) * (new - w)
        moved, w = np.abs(new - w).max(initial=0.0), new
        if moved < tol:
            break
    return w


def folds(n: int, k: int = 5, seed: int = 42) -> list[np.ndarray]:
    order = np.random.RandomState(seed).permutation(n)
    return [part for part in np.array_split(order, min(k, n)) if len(part)]


def cross_validated(x: np.ndarray, y: np.ndarray, alphas: list[float], solver: str = "fista") -> tuple[float, np.ndarray, float]:
    """The penalty with the least mean squared error over five shuffled folds (ties: the larger), refitted on all rows."""

    def fit(a, b, alpha):
        return (fista(a, b, alpha), 0.0) if solver == "fista" else lasso_cd(a, b, alpha)

    errors = []
    for alpha in alphas:
        e = []
        for hold in folds(len(y)):
            rest = np.setdiff1d(np.arange(len(y)), hold)
            w, b = fit(x[rest], y[rest], alpha)
            e.append(((y[hold] - x[hold] @ w - b) ** 2).mean())
        errors.append(float(np.mean(e)))
    best = min(range(len(alphas)), key=lambda i: (round(errors[i], 12), -alphas[i]))
    return (alphas[best], *fit(x, y, alphas[best]))


def stability_selection(x: np.ndarray, y: np.ndarray, alpha: float, critical: np.ndarray | None = None, rounds: int = 5, share: float = 0.7, keep: float = 0.6, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """How often each column is used on subsamples, and coefficients refitted on the columns used often enough or critical (all, if none)."""
    n, p = x.shape
    rng, used = np.random.RandomState(seed), np.zeros(p)
    for _ in range(rounds):
        rows = rng.choice(n, max(2, int(share * n)), replace=False)
        used += np.abs(lasso_cd(x[rows], y[rows], alpha)[0]) > 1e-10
    prob = used / rounds
    chosen = prob >= keep
    if critical is not None:
        chosen |= critical
    if not chosen.any():
        chosen[:] = True
    w = np.zeros(p)
    w[chosen] = lasso_cd(x[:, chosen], y, alpha)[0]
    return prob, w


def ridge(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge on columns scaled to mean 0 and population deviation 1 (0 counts as 1), intercept free."""
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / np.where(sd > 0, sd, 1)
    w = np.linalg.solve(z.T @ z + penalty * np.eye(x.shape[1]), z.T @ (y - y.mean())) / np.where(sd > 0, sd, 1)
    return w, float(y.mean() - mean @ w)
