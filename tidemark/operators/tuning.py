"""Tuning of the text trainer: every stock's models over windows and penalties, judged on the rows that follow, from one matrix of word counts.

The windows of a stock end where its judged rows begin, so each is a suffix of the next larger one: they slice the same sorted counts, and only document
frequencies, weights and scales are made anew. Within a window the penalties fall, and each fit starts from the one before (a SparsePath); a window's
first fit starts from the coefficients that the smaller window had there. Cells that a checkpoint table holds are not fitted again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import training
from .training import Counts

WINDOWS, ALPHAS = tuple(range(3, 13)), (5e-4, 1e-4, 5e-5, 1e-5)
MONTH = 21
CELLS = "stock_code string, window_months int, alpha double, hit_rate double, mae double, used int, error string"


class Cells:
    """One stock's scan. rows: in order of pos, with y and the dense columns; the last `judged` of them are predicted."""

    def __init__(self, counts: Counts, y: np.ndarray, dense: np.ndarray, judged: int, critical: list[str], lags: int, min_df: int, max_df: float, most: int, rate: float | None, tol: float, month: int = MONTH):
        self.month = month
        self.counts, self.y, self.dense, self.cut, self.lags = counts, y, dense, len(y) - judged, lags
        self.set = (lags, min_df, max_df, most)
        self.rest = (critical, lags, min_df, rate)
        self.tol = tol
        self.known: dict[int, float] = {}  # the smaller window's coefficients at its first penalty, in units of the unweighted columns

    def window(self, months: int):
        lo = max(0, self.cut - self.month * months)
        ids, day, word, value = self.counts.tfidf(lo, self.cut, *self.set)
        n = self.cut - lo
        own = day < n
        design = training.Design(self.counts.vocabulary[ids], day[own] + 1, word[own], value[own], self.y[lo : self.cut], self.dense[lo : self.cut], *self.rest)
        return lo, ids, (day, word, value), design

    def names(self, ids: np.ndarray, x: training.Design) -> np.ndarray:
        """A number for each column that is the same in every window."""
        lag, base = np.divmod(x.column, len(ids)) if len(ids) else (x.column, x.column)
        text = ids[base] * self.lags + lag if len(ids) else np.zeros(0, np.int64)
        return np.concatenate([text, -1 - np.arange(self.dense.shape[1])]).astype(np.int64)

    def run(self, months: int, alphas: list[float]):
        """(alpha, coefficients, intercept, predictions of the judged rows) of falling penalties in one window, and its design."""
        lo, ids, (day, word, value), x = self.window(months)
        path, names = x.path(), self.names(ids, x)
        unit = np.concatenate([x.weight[x.column], np.ones(self.dense.shape[1])])
        if self.known:
            path.begin(np.array([self.known.get(k, 0.0) for k in names.tolist()]) / np.where(unit != 0, unit, 1))
        first = None
        for alpha in sorted(alphas, reverse=True):
            w, b = path.solve(alpha, tol=self.tol)
            if first is None:
                first = {int(k): float(v) for k, v in zip(names, w * unit, strict=True) if v}
            yield alpha, w, b, self._predicted(lo, len(ids), day, word, value, x, w) + b, x
        self.known = first or {}

    def _predicted(self, lo: int, n_words: int, day: np.ndarray, word: np.ndarray, value: np.ndarray, x: training.Design, w: np.ndarray) -> np.ndarray:
        n, judged = self.cut - lo, len(self.y) - self.cut
        beta = np.zeros(n_words * self.lags)
        beta[x.column] = w[: x.words] * x.weight[x.column] / x.top[x.column]
        out = (self.dense[self.cut :] - x.mean) / x.sd @ w[x.words :] if self.dense.shape[1] else np.zeros(judged)
        for k in range(self.lags):
            row = day + k - n
            use = (row >= 0) & (row < judged)
            out = out + np.bincount(row[use], value[use] * beta[word[use] + k * n_words], minlength=judged)
        return out


def ranges(windows: tuple[int, ...] = WINDOWS, share: float = 0.2, month: int = MONTH) -> Callable[[int], list[tuple[int, int]]]:
    """The rows that a scan's windows learn from, for training.frequent_words."""

    def of(n: int) -> list[tuple[int, int]]:
        cut = int(n * (1 - share))
        return [(max(0, cut - month * m), cut) for m in windows] if cut else []

    return of


def scan(counts: DataFrame, rows: DataFrame, dense: list[str], windows: tuple[int, ...] = WINDOWS, alphas: tuple[float, ...] = ALPHAS, lags: int = training.LAGS, share: float = 0.2, done: DataFrame | None = None, critical: list[str] | None = None, min_df: int = training.MIN_DF, max_df: float = training.MAX_DF, max_features: int = training.MAX_FEATURES, rate: float | None = None, tol: float = 1e-6, month: int = MONTH) -> DataFrame:
    """(stock_code, window_months, alpha, hit_rate, mae, used, error) of every cell that `done` does not hold.

    counts: as from training.day_counts, or from training.frequent_words by the ranges of the same windows; rows: (stock_code, pos, y, dense columns). The last `share` of a stock's rows are judged, by the model of the
    window_months * month rows before them; used counts its nonzero coefficients. A cell without rows to fit or to judge by, or whose fit fails, says so in
    error. A stock's counts and rows travel once, whatever the number of cells. Where several models have the least loss (more columns than rows), a cell may
    hold another of them than a single fit.
    """
    critical = training.CRITICAL if critical is None else critical
    names = [c.split()[0] for c in CELLS.split(", ")]
    rows = rows.select("stock_code", "pos", "y", *dense)

    def run(stock: str, words: Callable[[], Counts], own: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=names)
        own = own.sort_values("pos")
        had = {(int(m), float(a)) for m, a in own["__cells"].iloc[0]} if "__cells" in own and own["__cells"].iloc[0] is not None else set()
        judged = len(own) - int(len(own) * (1 - share))
        cells = Cells(words(), own["y"].to_numpy(float), own[dense].to_numpy(float), judged, critical, lags, min_df, max_df, max_features, rate, tol, month)
        truth, out, same = cells.y[cells.cut :], [], (None, {})
        for months in sorted(windows):
            todo = [a for a in alphas if (months, a) not in had]
            fitted = set()
            lo = max(0, cells.cut - month * months)
            if same[0] == lo:  # longer than the history: the window before has the same rows
                out += [(stock, months, a, *same[1][a]) for a in todo if a in same[1]]
                todo = [a for a in todo if a not in same[1]]
            else:
                same = (lo, {})
            try:
                if not cells.cut or not judged:
                    raise ValueError("a cell needs rows to fit and rows to judge it by")
                for alpha, w, _, p, _ in cells.run(months, todo) if todo else ():
                    same[1][alpha] = (float((np.sign(p) == np.sign(truth)).mean()), float(np.abs(p - truth).mean()), int((np.abs(w) > 1e-12).sum()), None)
                    out.append((stock, months, alpha, *same[1][alpha]))
                    fitted.add(alpha)
            except (ValueError, np.linalg.LinAlgError) as e:
                out += [(stock, months, a, None, None, None, str(e)[:200]) for a in todo if a not in fitted]
        return pd.DataFrame(out, columns=names)

    if done is not None:
        had = done.filter("error is null").groupBy("stock_code").agg(F.collect_set(F.array(F.col("window_months").cast("double"), "alpha")).alias("__cells"))
        rows = rows.join(had, "stock_code", "left").withColumn("__cells", F.when(F.row_number().over(Window.partitionBy("stock_code").orderBy("pos")) == 1, F.col("__cells")))
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small tables too: the fits take the time, not the rows
    own = rows.repartition(n, "stock_code").groupBy("stock_code")
    if dict(counts.dtypes)["pos"] != "array<int>":
        dealt = counts.select("stock_code", "pos", "word", "tf").repartition(n, "stock_code")
        return dealt.groupBy("stock_code").cogroup(own).applyInPandas(lambda key, words, own: run(key[0], lambda: Counts(words), own), CELLS)
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in CELLS.split(", ")])

    def run_arrow(key: tuple, words: pa.Table, own: pa.Table) -> pa.Table:
        return pa.Table.from_pandas(run(key[0].as_py(), lambda: Counts.of(words), own.to_pandas()), schema, preserve_index=False)

    return counts.repartition(n, "stock_code").groupBy("stock_code").cogroup(own).applyInArrow(run_arrow, CELLS)


def checkpointed(spark: SparkSession, counts: DataFrame, rows: DataFrame, dense: list[str], path: str, batches: int = 4, **more) -> DataFrame:
    """The scan in batches of stocks, each appended to a table when it is complete; what the table holds from an earlier run is not fitted again."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = lambda: spark.read.schema(CELLS).parquet(path) if fs.exists(hadoop) else None
    part = F.pmod(F.hash("stock_code"), F.lit(batches))
    for k in range(batches):
        own = scan(counts.filter(part == k), rows.filter(part == k), dense, done=held(), **more)
        own.write.mode("append").parquet(path)
    last = Window.partitionBy("stock_code", "window_months", "alpha").orderBy(F.col("error").isNotNull())
    return held().withColumn("__k", F.row_number().over(last)).filter("__k = 1").drop("__k")


def stability(cells: DataFrame, penalty: float = 1.0) -> DataFrame:
    """Cells with their neighbours' mean hit rate, its deviation and the stability score: 0.6 of that mean and 0.4 of one less the cell's error over 0.1,
    less the deviation. Neighbours are the cell itself and those one step away in the stock's sorted windows or penalties."""
    step = lambda c: F.dense_rank().over(Window.partitionBy("stock_code").orderBy(c)).cast("int")
    at = cells.filter("error is null").withColumns({"wi": step("window_months"), "ai": step("alpha")})
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))]))
    near = at.select("stock_code", "wi", "ai", "hit_rate", moves.alias("m")).select("stock_code", (F.col("wi") + F.col("m.i")).alias("wi"), (F.col("ai") + F.col("m.j")).alias("ai"), "hit_rate")
    mean = near.groupBy("stock_code", "wi", "ai").agg(F.avg("hit_rate").alias("mean_hr"), F.stddev_pop("hit_rate").alias("std_hr"), F.count("*").cast("int").alias("neighbours"))
    composite = 0.6 * F.col("mean_hr") + 0.4 * (1 - F.least(F.col("mae") / 0.1, F.lit(1.0)))
    return at.join(mean, ["stock_code", "wi", "ai"]).withColumn("stability", composite - penalty * F.col("std_hr"))
