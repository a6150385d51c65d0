"""Training on text: lagged TF-IDF, fundamentals and indicators of each stock, a sparse fit, and the dictionary that it gives.

A day's words stand in the row of the first trading day on or after it (lag 1) and in the rows of the next trading days (lag 2 and so on). Counts,
vocabulary and TF-IDF are DataFrame plans over all stocks; a day travels once, whatever the number of lags, and only the fit is a grouped
function: one stock's days and rows, bounded by its window and by MAX_FEATURES words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from . import ordered, solvers

LAGS, MIN_DF, MAX_DF, MAX_FEATURES = 5, 3, 0.85, 25_000
#: Words that are always kept, however rare.
CRITICAL = "배임 횡령 화재 소송 고발 고소 압수수색 구속 해킹 전쟁 부도 파산 상장폐지 거래정지 분식회계 하한가 유상증자".split()
WORDS = "stock_code string, word string, pos array<int>, tf array<int>"
FITTED = "stock_code string, feature string, beta double, mean double, scale double, alpha double"


def numbered(price: DataFrame, columns: list[str]) -> DataFrame:
    """(stock_code, date, pos, n_rows, columns): a stock's rows in order from 1."""
    w = Window.partitionBy("stock_code")
    return price.select("stock_code", "date", F.row_number().over(w.orderBy("date")).alias("pos"), F.count("*").over(w).alias("n_rows"), *columns)


def day_counts(news: DataFrame, rows: DataFrame, grams: int = 1, folds: DataFrame | None = None) -> DataFrame:
    """(stock_code, pos, n_rows, word, tf) from articles (stock_code, date, words): the words, or their n-grams up to grams words, of each row's own
    day. Articles after a stock's last row belong to none. folds: (stock_code, own, date), the days of stock `own` that a fold of the name stock_code
    has; rows then have the folds' names, and a day's words are counted once for all of them.

    A day's words are counted where its articles are, if these come dealt by stock_code and date, then dealt once by word, as day_tfidf needs them."""
    folds = news.select("stock_code", F.col("stock_code").alias("own"), "date").distinct() if folds is None else folds
    at = ordered.asof_forward(folds, rows, "stock_code", "date", "date", ["pos", "n_rows"]).filter("pos is not null")
    at = at.select(F.col("own").alias("stock_code"), "date", F.col("stock_code").alias("__fold"), "pos", "n_rows")
    # the outer explode: before an inner one Spark tests the array's size in a filter, which it pushes below the column that splits the text, and every n-gram splits it again
    words = news.select("stock_code", "date", F.explode_outer(expr.ngrams(F.col("words"), grams)).alias("word")).filter("word is not null")
    daily = words.groupBy("stock_code", "date", "word").agg(F.count("*").alias("tf")).join(at, ["stock_code", "date"])
    return daily.select(F.col("__fold").alias("stock_code"), "pos", "n_rows", "word", "tf").repartition("stock_code", "word").groupBy("stock_code", "pos", "n_rows", "word").agg(F.sum("tf").alias("tf"))


def day_tfidf(counts: DataFrame, lags: int = LAGS, min_df: int = MIN_DF, max_df: float = MAX_DF, max_features: int = MAX_FEATURES) -> DataFrame:
    """(stock_code, pos, word, value). The corpus of a stock has a document for every row and lag, empty ones too; a day is as many documents as
    rows that it reaches. Of the words in min_df to max_df of them the max_features most frequent stay (ties: by word)."""
    reach = F.least(F.lit(lags), F.col("n_rows") - F.col("pos") + 1)
    words = counts.groupBy("stock_code", "word").agg(F.sum(reach).alias("df"), F.sum(F.col("tf") * reach).alias("total"), F.max("n_rows").alias("n_rows"))
    words = words.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n_rows") * lags))
    words = words.withColumn("k", F.row_number().over(Window.partitionBy("stock_code").orderBy(F.desc("total"), "word"))).filter(F.col("k") <= max_features)  # the feature: a cap on the vocabulary
    idf = words.select("stock_code", "word", (F.log((1 + F.col("n_rows") * lags) / (1 + F.col("df"))) + 1).alias("idf"))
    x = counts.join(idf, ["stock_code", "word"]).select("stock_code", "pos", "word", (F.col("tf") * F.col("idf")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("stock_code", "pos")))
    return x.select("stock_code", "pos", "word", (F.col("x") / norm).alias("value"))


def whole(n: int) -> list[tuple[int, int]]:
    """All rows as the one range that words are chosen by."""
    return [(0, n)]


def frequent_words(articles: DataFrame, rows: DataFrame, words: Column, grams: int = 1, lags: int = LAGS, min_df: int = MIN_DF, max_df: float = MAX_DF, max_features: int = MAX_FEATURES, ranges: Callable[[int], list[tuple[int, int]]] = whole) -> DataFrame:
    """(stock_code, word, pos, tf): the words that day_tfidf keeps of day_counts, each with its rows in order and its counts there.

    articles: (stock_code, date, columns), words: their words as an array, split from the text after that has travelled. ranges: from a stock's number of rows the ranges of rows (from 0, up to an end) that are corpora of their own; a word stays, in all rows, if one of
    them keeps it. A stock's articles meet in one task, which keeps a number for each of their words and counts them a million at a time; only the
    words that stay travel on."""
    if grams > 2:
        raise ValueError("words and pairs of words are counted")
    at = ordered.asof_forward(articles.select("stock_code", "date").distinct(), rows, "stock_code", "date", "date", ["pos", "n_rows"]).filter("pos is not null")
    placed = articles.join(F.broadcast(at.select("stock_code", "date", "pos", "n_rows")), ["stock_code", "date"])  # a row for each stock and day, not for each article
    n = int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.drop("date").repartition(n, "stock_code").sortWithinPartitions("stock_code").select("stock_code", words.alias("words"), "pos", "n_rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stock = None
        for b in batches:
            codes = b["stock_code"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if stock is None or stock.code != codes[lo]:
                    if stock:
                        yield from stock.chosen()
                    stock = _Articles(codes[lo], b["n_rows"][lo].as_py(), grams, lags, min_df, max_df, max_features, ranges)
                stock.add(b["words"].slice(lo, hi - lo), b["pos"].slice(lo, hi - lo))
        if stock:
            yield from stock.chosen()

    return dealt.mapInArrow(run, WORDS)


class _Articles:
    """One stock's articles as numbers of words."""

    def __init__(self, code: str, n_rows: int, grams: int, lags: int, min_df: int, max_df: float, most: int, ranges: Callable[[int], list[tuple[int, int]]]):
        self.code, self.n_rows, self.grams, self.lags, self.min_df, self.max_df, self.most = code, n_rows, grams, lags, min_df, max_df, most
        self.ranges = sorted(set(ranges(n_rows)))
        self.number: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, words: pa.Array, pos: pa.Array) -> None:
        found = words.flatten().dictionary_encode()
        own = np.array([self.number.setdefault(w, len(self.number)) for w in found.dictionary.to_pylist()], np.int32)
        length = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        last = np.zeros(len(found), bool)
        last[np.cumsum(length)[length > 0] - 1] = True
        day = np.repeat(pos.to_numpy(zero_copy_only=False).astype(np.int32) - 1, length)
        self.parts.append((own[found.indices.to_numpy(zero_copy_only=False)] if len(found) else np.zeros(0, np.int32), day, last))

    def named(self, code: np.ndarray, pair: np.ndarray) -> list[str]:
        v, all_ = max(len(self.number), 1), list(self.number)
        return [f"{all_[c // v]};{all_[c % v]}" if p else all_[c] for c, p in zip(code.tolist(), pair.tolist(), strict=True)]

    def counted(self, at_once: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
        """(whether pairs, word, row, count) in order of words and rows, all rows of a word together."""
        ids, day, last = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []  # held once
        v, n = len(self.number), self.n_rows
        for pair in range(self.grams):
            steps = len(ids) // at_once + 1
            for step in range(steps):
                mine = ids % np.int32(steps) == step
                if pair:
                    mine &= ~last
                first = np.flatnonzero(mine)
                key = ids[first].astype(np.int64)
                if pair:
                    key = key * v + ids[first + 1]
                key = key * n + day[first]
                del mine, first
                key.sort()
                start = np.flatnonzero(np.diff(key, prepend=-1))
                key, tf = key[start], np.diff(start, append=len(key))
                code = key // n
                yield bool(pair), code, key - code * n, tf

    def chosen(self, at_once: int = 1 << 20) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held: list[tuple] = []
        best = [none for _ in self.ranges]  # the largest totals so far
        for pair, code, day, tf in self.counted(at_once):
            start = np.flatnonzero(np.diff(code, prepend=-1))
            if not len(start):
                continue
            total, stays = np.zeros((len(self.ranges), len(start)), np.int64), np.zeros(len(start), bool)
            for k, (lo, hi) in enumerate(self.ranges):
                reach = np.where((day >= lo) & (day < hi), np.minimum(self.lags, hi - day), 0)
                df = np.add.reduceat(reach, start)
                sums = np.add.reduceat(tf * reach, start)
                total[k] = np.where((df >= self.min_df) & (df <= self.max_df * (hi - lo) * self.lags), sums, 0)
                best[k] = np.concatenate([best[k], total[k][total[k] > 0]])
                if len(best[k]) > self.most:
                    best[k] = np.partition(best[k], len(best[k]) - self.most)[-self.most :]
                stays |= total[k] >= (best[k].min() if len(best[k]) == self.most else 1)
            rows = np.repeat(stays, np.diff(start, append=len(code)))
            held.append((np.full(int(stays.sum()), pair), code[start[stays]], total[:, stays], np.diff(start, append=len(code))[stays], day[rows], tf[rows]))
        if not held:
            return
        pair, code, total, length, day, tf = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
        stays = np.zeros(len(code), bool)
        for sums in total:
            stays |= self.first(sums, code, pair)
        rows = np.repeat(stays, length)
        code, pair, length, day, tf = code[stays], pair[stays], length[stays], day[rows], tf[rows]
        end = np.concatenate([[0], np.cumsum(length)])
        for lo in range(0, len(code), 4096):
            hi = min(lo + 4096, len(code))
            offsets = pa.array(end[lo : hi + 1] - end[lo], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[end[lo] : end[hi]].astype(np.int32))) for x in (day + 1, tf)]
            yield pa.RecordBatch.from_arrays([pa.array([self.code] * (hi - lo)), pa.array(self.named(code[lo:hi], pair[lo:hi])), *lists], ["stock_code", "word", "pos", "tf"])

    def first(self, sums: np.ndarray, code: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Which words are the most frequent ones (ties: by word); those of 0 are none."""
        if (sums > 0).sum() <= self.most:
            return sums > 0
        least = np.partition(sums, len(sums) - self.most)[len(sums) - self.most]
        out, tied = sums > least, np.flatnonzero(sums == least)
        names = np.array(self.named(code[tied], pair[tied]), object)
        out[tied[np.argsort(names, kind="stable")[: self.most - int(out.sum())]]] = True
        return out


class Counts:
    """One stock's words: sorted days (from 0) with their words and counts."""

    def __init__(self, words: pd.DataFrame):
        words = words.sort_values(["pos", "word"])
        self.vocabulary, self.word = np.unique(words["word"].to_numpy(str), return_inverse=True) if len(words) else (np.zeros(0, str), np.zeros(0, np.int64))
        self.word = self.word.reshape(-1)
        self.day, self.tf = words["pos"].to_numpy(np.int64) - 1, words["tf"].to_numpy(float)

    @classmethod
    def of(cls, words: pa.Table) -> Counts:
        """From rows of frequent_words."""
        out = cls.__new__(cls)
        names = np.array(words["word"].to_pylist(), str) if len(words) else np.zeros(0, str)
        order = np.argsort(names, kind="stable")
        number = np.empty(len(names), np.int32)
        number[order] = np.arange(len(names), dtype=np.int32)
        pos, tf = (words[c].combine_chunks() for c in ("pos", "tf"))
        word = np.repeat(number, pos.value_lengths().to_numpy(zero_copy_only=False))
        day = pos.flatten().to_numpy(zero_copy_only=False).astype(np.int32) - 1
        by = np.lexsort((word, day))
        out.vocabulary, out.word, out.day, out.tf = names[order], word[by], day[by], tf.flatten().to_numpy(zero_copy_only=False)[by].astype(float)
        return out

    def tfidf(self, lo: int, cut: int, lags: int, min_df: int, max_df: float, most: int):
        """(vocabulary, day, word, value) of all days from lo on, by the corpus of the rows lo to cut - 1 (as day_tfidf has it); days count
        from lo."""
        at = np.searchsorted(self.day, [lo, cut])
        day, word, tf = self.day[at[0] :] - lo, self.word[at[0] :], self.tf[at[0] :]
        n, own = cut - lo, at[1] - at[0]
        reach = np.minimum(lags, n - day[:own])
        df = np.bincount(word[:own], reach, minlength=len(self.vocabulary))
        total = np.bincount(word[:own], tf[:own] * reach, minlength=len(self.vocabulary))
        ids = np.flatnonzero((df >= min_df) & (df <= max_df * n * lags))
        ids = np.sort(ids[np.lexsort((ids, -total[ids]))][:most])
        number = np.full(len(self.vocabulary), -1, np.int32)
        number[ids] = np.arange(len(ids))
        use = number[word] >= 0
        day, word, tf = day[use], word[use], tf[use]
        x = tf * (np.log((1 + n * lags) / (1 + df[word])) + 1)
        norm = np.sqrt(np.bincount(day, x * x, minlength=int(day.max(initial=0)) + 1))
        return ids, day, number[word], x / norm[day]


def lag_decay(y: np.ndarray, lags: int, rate: float | None) -> np.ndarray:
    """The weight of each lag: 1 / (1 + rate (lag - 1)); without a rate the autocorrelation of y relative to the largest one, where there are more
    than twice as many rows as lags, else one over the root of the lag."""
    k = np.arange(1, lags + 1)
    if rate is not None:
        return 1 / (1 + rate * (k - 1))
    if len(y) <= 2 * lags:
        return 1 / np.sqrt(k)
    found = {}
    for lag in k.tolist():
        a, b = y[:-lag], y[lag:]
        if a.std() > 0 and b.std() > 0:
            found[lag] = max(abs(float(np.corrcoef(a, b)[0, 1])), 0.01)
    top = max(found.values(), default=1.0)
    return np.array([found[lag] / top if lag in found else (1 / lag if found else 1 / np.sqrt(lag)) for lag in k.tolist()])


def text_matrix(pos: np.ndarray, word: np.ndarray, value: np.ndarray, n_words: int, critical: np.ndarray, y: np.ndarray, lags: int, min_df: int, rate: float | None):
    """(row, column, value, weights, kept, top): the lagged matrix in coordinates (column (lag - 1) * n_words + word), scaled by each column's largest
    value, the columns' weights, which columns stay, and their largest values (1 for none).

    A column's weight is the mean size of y over the rows where it stands, over the mean of all columns, times its lag's decay. A column in fewer
    than min_df rows stays if its volatility is more than twice the mean, or if it is critical, which then weighs that much at least."""
    n, p = len(y), n_words * lags
    row = np.concatenate([pos - 1 + k for k in range(lags)]) if len(pos) else np.zeros(0, np.int64)
    col, val = np.concatenate([word + k * n_words for k in range(lags)]), np.tile(value, lags)
    inside = row < n
    row, col, val = row[inside], col[inside], val[inside]
    top = np.zeros(p)
    np.maximum.at(top, col, np.abs(val))
    top = np.where(top > 0, top, 1)
    val = val / top[col]
    count = np.bincount(col, minlength=p)
    weight = np.bincount(col, np.abs(y)[row], minlength=p) / np.maximum(count, 1)
    mean = weight[weight > 0].mean() if (weight > 0).any() else 0.0
    critical = np.tile(critical, lags)
    rare = count < min_df
    kept = ~rare | ((count > 0) & ((weight > 2 * mean) | critical))
    weight = np.where(kept & rare & critical, np.maximum(weight, 2 * mean), weight)
    weight = weight / weight.mean() if p and weight.mean() > 0 else np.ones(p)
    return row, col, val, weight * np.repeat(lag_decay(y, lags, rate), n_words), kept, top


def standardised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns less their means over their population deviations (1 where that is 0)."""
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 0, sd, 1.0)
    return (x - mean) / sd, mean, sd


class Design:
    """One stock's training matrix in coordinates: the columns of `text_matrix` that stay, then the standardised dense ones."""

    def __init__(self, vocabulary: np.ndarray, pos: np.ndarray, word: np.ndarray, value: np.ndarray, y: np.ndarray, dense: np.ndarray, critical: list[str], lags: int, min_df: int, rate: float | None):
        self.vocabulary, self.y, self.lags = vocabulary, y, lags
        row, col, val, self.weight, self.kept, self.top = text_matrix(pos, word, value, len(vocabulary), np.isin(vocabulary, critical), y, lags, min_df, rate)
        number = (np.cumsum(self.kept) - 1).astype(np.int32)
        use = self.kept[col]
        row, val, col = row[use], (val * self.weight[col])[use], number[col[use]]
        self.words = int(self.kept.sum())
        self.column = np.flatnonzero(self.kept)
        scaled, self.mean, self.sd = standardised(dense) if dense.shape[1] else (dense, np.zeros(0), np.zeros(0))
        at, k = np.nonzero(scaled)
        at, k = at.astype(row.dtype), (self.words + k).astype(np.int32)
        self.row, self.col, self.val = np.concatenate([row, at]), np.concatenate([col, k]), np.concatenate([val, scaled[at, k - self.words]])
        self.p = self.words + dense.shape[1]

    def path(self) -> solvers.SparsePath:
        return solvers.SparsePath(self.row, self.col, self.val, len(self.y), self.p, self.y)

    def dictionary(self, w: np.ndarray, names: list[str]) -> list[tuple]:
        """(feature, beta, mean, scale) of the nonzero coefficients, in units of the unweighted columns."""
        out: list[tuple] = []
        for j in np.flatnonzero(np.abs(w) > 1e-12):
            if j < self.words:
                lag, base = divmod(int(self.column[j]), len(self.vocabulary))
                out.append((f"{self.vocabulary[base]}_L{lag + 1}", float(w[j] * self.weight[self.column[j]]), None, None))
            else:
                out.append((names[j - self.words], float(w[j]), float(self.mean[j - self.words]), float(self.sd[j - self.words])))
        return out


def train_dictionary(days: DataFrame, rows: DataFrame, dense: list[str], lags: int = LAGS, alphas: tuple[float, ...] = (1e-5, 1e-6), min_df: int = MIN_DF, rate: float | None = None, critical: list[str] | None = None, tol: float = 1e-6) -> DataFrame:
    """The dictionary of each stock: nonzero coefficients in units of the unweighted columns, as (stock_code, feature, beta, mean, scale, alpha).

    days: as from day_tfidf; rows: (stock_code, pos, y, dense columns). Features are word_L1 and so on for words, and the names in dense, which come
    with the mean and scale that they were standardised by. Penalties are tried in order until the dictionary is not empty. A stock without rows
    gives nothing, one without words is fitted on its dense columns.
    """
    critical = CRITICAL if critical is None else critical

    def fit(key: tuple, words: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=[c.split()[0] for c in FITTED.split(", ")])
        vocabulary, word = np.unique(words["word"].to_numpy(str), return_inverse=True) if len(words) else (np.zeros(0, str), np.zeros(0, np.int64))
        return _fitted(key[0], vocabulary, words["pos"].to_numpy(np.int64), word.reshape(-1), words["value"].to_numpy(float), own, dense, critical, lags, alphas, min_df, rate, tol)

    return days.groupBy("stock_code").cogroup(rows.groupBy("stock_code")).applyInPandas(fit, FITTED)


def _fitted(stock: str, vocabulary: np.ndarray, pos: np.ndarray, word: np.ndarray, value: np.ndarray, own: pd.DataFrame, dense: list[str], critical: list[str], lags: int, alphas: tuple[float, ...], min_df: int, rate: float | None, tol: float) -> pd.DataFrame:
    own = own.sort_values("pos")
    x = Design(vocabulary, pos, word, value, own["y"].to_numpy(float), own[dense].to_numpy(float), critical, lags, min_df, rate)
    out: list[tuple] = []
    for alpha in alphas:
        if out := x.dictionary(x.path().solve(alpha, tol=tol)[0], dense):
            break
    return pd.DataFrame([(stock, *r, alpha) for r in out], columns=[c.split()[0] for c in FITTED.split(", ")])


def train_words(words: DataFrame, rows: DataFrame, dense: list[str], lags: int = LAGS, alphas: tuple[float, ...] = (1e-5, 1e-6), min_df: int = MIN_DF, max_df: float = MAX_DF, max_features: int = MAX_FEATURES, rate: float | None = None, critical: list[str] | None = None, tol: float = 1e-6) -> DataFrame:
    """The same from rows of frequent_words, whose TF-IDF is made where a stock is fitted: no day's words are sorted or joined on the way."""
    critical = CRITICAL if critical is None else critical
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.float64()) for c in FITTED.split(", ")])

    def fit(key: tuple, words: pa.Table, own: pa.Table) -> pa.Table:
        if not len(own):
            return schema.empty_table()
        counts = Counts.of(words)
        ids, day, word, value = counts.tfidf(0, len(own), lags, min_df, max_df, max_features)
        got = _fitted(key[0].as_py(), counts.vocabulary[ids], day + 1, word, value, own.to_pandas(), dense, critical, lags, alphas, min_df, rate, tol)
        return pa.Table.from_pandas(got, schema, preserve_index=False)

    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the fits take the time, not the rows
    own = rows.select("stock_code", "pos", "y", *dense).repartition(n, "stock_code")
    return words.repartition(n, "stock_code").groupBy("stock_code").cogroup(own.groupBy("stock_code")).applyInArrow(fit, FITTED)
