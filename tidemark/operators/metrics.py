"""Aggregate measures of predictions and of return series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(a: Column, b: Column, default: float = 0.0) -> Column:
    """A quotient, or a default where the divisor is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def same_sign(a: str, b: str) -> Column:
    """Strict agreement: a zero agrees with nothing."""
    return ((F.col(a) > 0) & (F.col(b) > 0)) | ((F.col(a) < 0) & (F.col(b) < 0))


def accuracy(df: DataFrame, keys: list[str], predicted: str, actual: str) -> DataFrame:
    """Hit rate, mean absolute and root mean square error, and the information coefficient (0 with one row or no variance)."""
    p, a = F.col(predicted), F.col(actual)
    ok = (F.count("*") > 1) & (F.stddev_pop(p) > 0) & (F.stddev_pop(a) > 0)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(same_sign(predicted, actual).cast("double")).alias("hit_rate"), F.avg(F.abs(p - a)).alias("mae"), F.sqrt(F.avg((p - a) * (p - a))).alias("rmse"), F.when(ok, F.corr(p, a)).otherwise(0.0).alias("ic"))


def strategy_return(signal: str, actual: str) -> Column:
    """Long above 0, short below, else cash."""
    return F.signum(signal) * F.col(actual)


def risk(df: DataFrame, keys: list[str], ret: str, bench: str, days: int = 252) -> DataFrame:
    """Sharpe, Sortino (deviation of negative returns only), volatility and information ratio, annualised, with population deviations."""
    r, b, y = F.col(ret), F.col(bench), F.sqrt(F.lit(float(days)))
    return df.groupBy(*keys).agg(over(F.avg(r) * y, F.stddev_pop(r)).alias("sharpe"), over(F.avg(r) * y, F.stddev_pop(F.when(r < 0, r))).alias("sortino"), (F.stddev_pop(r) * y).alias("volatility"), over(F.avg(r - b) * y, F.stddev_pop(r - b)).alias("info_ratio"))


def beta(df: DataFrame, keys: list[str], ret: str, bench: str) -> DataFrame:
    """Sample covariance over population variance; 1 where the market does not move."""
    return df.groupBy(*keys).agg(over(F.covar_samp(ret, bench), F.var_pop(bench), 1.0).alias("beta"))


def profit_factor(df: DataFrame, keys: list[str], ret: str) -> DataFrame:
    """Gains over losses; 1 with gains and no losses, 0 without either."""
    up, down = F.coalesce(F.sum(F.when(F.col(ret) > 0, F.col(ret))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col(ret) < 0, -F.col(ret))), F.lit(0.0))
    return df.groupBy(*keys).agg(up.alias("gains"), down.alias("losses")).withColumn("profit_factor", F.when(F.col("losses") > 0, F.try_divide("gains", "losses")).when(F.col("gains") > 0, 1.0).otherwise(0.0))


def equal_bins(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, lo, mid, n) over equal widths from least to largest; the last bin is closed."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    rows = df.select(value).crossJoin(F.broadcast(span)).withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    k = F.least(F.floor(over(F.col(value) - F.col("lo"), F.col("w"))), F.lit(bins - 1)).cast("int")
    return rows.groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("l"), F.first("w").alias("w")).select("bin", (F.col("l") + F.col("bin") * F.col("w")).alias("lo"), (F.col("l") + (F.col("bin") + 0.5) * F.col("w")).alias("mid"), "n")


def lag_autocorrelation(df: DataFrame, key: str, by: str, ret: str, lags: int = 5) -> DataFrame:
    """(key, lag, weight): absolute correlation of a series with itself lag rows earlier, at least 0.01, over the largest of the key; 1 / sqrt(lag)
    where the series is no longer than twice the lags."""
    w = Window.partitionBy(key).orderBy(by)
    rows = df.select(key, by, F.col(ret).alias("r"), *[F.lag(ret, k).over(w).alias(f"r{k}") for k in range(1, lags + 1)])
    wide = rows.groupBy(key).agg(F.count("*").alias("n"), *[F.greatest(F.lit(0.01), F.abs(F.coalesce(F.nanvl(F.corr("r", f"r{k}"), F.lit(0.0)), F.lit(0.0)))).alias(f"c{k}") for k in range(1, lags + 1)])
    top = F.greatest(*[F.col(f"c{k}") for k in range(1, lags + 1)])
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.when(F.col("n") > 2 * lags, F.col(f"c{k}") / top).otherwise(1 / k**0.5).alias("weight")) for k in range(1, lags + 1)]))
    return wide.select(key, long.alias("x")).select(key, "x.lag", "x.weight")


def neighbourhood(grid: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Stability of each grid cell over the cross of up to five cells: 0.6 mean hit rate + 0.4 (1 - min(mean error / 0.1, 1)) - gamma times the
    deviation of hit rates. A cell that is not there is left out."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dw"), F.lit(b).alias("da")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]))
    near = grid.select("wi", "ai", steps.alias("s")).select("wi", "ai", (F.col("wi") + F.col("s.dw")).alias("nw"), (F.col("ai") + F.col("s.da")).alias("na"))
    other = grid.select(F.col("wi").alias("nw"), F.col("ai").alias("na"), "hit_rate", "mae")
    score = 0.6 * F.avg("hit_rate") + 0.4 * (1 - F.least(F.avg("mae") / 0.1, F.lit(1.0))) - gamma * F.stddev_pop("hit_rate")
    return near.join(other, ["nw", "na"]).groupBy("wi", "ai").agg(F.count("*").alias("cells"), score.alias("stability"))


def best_cell(scored: DataFrame) -> DataFrame:
    """The most stable cell; of equals the one with the shorter window, then the smaller penalty."""
    return scored.orderBy(F.desc(F.round("stability", 9)), "wi", "ai").limit(1)
