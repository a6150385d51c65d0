"""Ordered-series operators: first rows, fills, as-of and session joins, gaps and islands, smoothing, curves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order (give a tie-break): what DISTINCT ON does."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rnk") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def lag_or_zero(c: str, key: str, by: str) -> Column:
    return F.coalesce(F.lag(c).over(Window.partitionBy(key).orderBy(by)), F.lit(0.0))


def forward_fill(c: str, key: str, by: str, default: float = 0.0) -> Column:
    w = Window.partitionBy(key).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(default))


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """Left rows with the columns of the last right row at or before them (right times are unique in a key).

    One union and one window instead of a range join: every key is sorted once."""
    tag = right.select(key, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*[F.col(c) for c in [right_time, *columns]]).alias("__r"))
    rows = left.select(key, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct("*").alias("__l"))
    w = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(tag, allowMissingColumns=True).withColumn("__m", F.last("__r", ignorenulls=True).over(w))
    return both.filter("__side = 1").select("__l.*", *[F.col(f"__m.{c}").alias(c if c not in left.columns else f"{c}_right") for c in [right_time, *columns]])


def asof_forward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """Left rows with the columns of the first right row at or after them (right times are unique in a key)."""
    tag = right.select(key, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(*columns).alias("__r"))
    rows = left.select(key, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct("*").alias("__l"))
    w = Window.partitionBy(key).orderBy(F.desc("__t"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(tag, allowMissingColumns=True).withColumn("__m", F.last("__r", ignorenulls=True).over(w))
    return both.filter("__side = 1").select("__l.*", *[F.col(f"__m.{c}").alias(c if c not in left.columns else f"{c}_right") for c in columns])


def calendar(price: DataFrame) -> DataFrame:
    """Trading days: the distinct price dates, with the day before (else seven days earlier) and the position. A row per trading day."""
    w = Window.orderBy("td")
    days = price.select(F.col("date").alias("td")).distinct()
    return days.select("td", F.coalesce(F.lag("td").over(w), F.date_sub("td", 7)).alias("prev_td"), F.row_number().over(w).alias("pos"))


def next_weekday(d: str) -> Column:
    return F.date_add(d, F.when(F.weekday(d) == 5, 2).when(F.weekday(d) == 6, 1).otherwise(0))


def impact_date(rows: DataFrame, days: DataFrame, date: str) -> DataFrame:
    """Adds impact_date: the first trading day on or after a date; after the last one the next weekday. The join is by
    date: each day of the calendar's span is mapped once, and a calendar has a row per day."""
    bounds = days.agg(F.min("td").alias("lo"), F.max("td").alias("hi"))
    spine = bounds.select(F.explode(F.sequence("lo", "hi")).alias("__d"))
    w = Window.orderBy("__d").rowsBetween(0, Window.unboundedFollowing)
    known = spine.join(days.select(F.col("td").alias("__d"), F.col("td").alias("__td")), "__d", "left").select("__d", F.first("__td", ignorenulls=True).over(w).alias("__to"))
    before = rows.join(known, F.col(date) == F.col("__d"), "left").crossJoin(F.broadcast(bounds))
    return before.withColumn("impact_date", F.when(F.col(date) < F.col("lo"), F.col("lo")).otherwise(F.coalesce("__to", next_weekday(date)))).drop("__d", "__to", "lo", "hi")


def session_date(ts: str, rule: str) -> Column:
    """The date from which an article counts. `cutoff16`: from 16:00 it counts for the next day. `live7_0`: times are UTC, from 07:00 (16:00 in
    Seoul) it counts for the next day, and between 00:00 and 07:00 for none. `date`: its own day."""
    d, h = F.to_date(ts), F.hour(ts)
    if rule == "cutoff16":
        return F.when(h >= 16, F.date_add(d, 1)).otherwise(d)
    if rule == "live7_0":
        return F.when(h >= 7, F.date_add(d, 1))
    if rule == "date":
        return d
    raise ValueError(f"no session rule {rule}")


def day_spine(df: DataFrame, key: str, date: str) -> DataFrame:
    """Every day from a key's first to its last."""
    return df.groupBy(key).agg(F.min(date).alias("lo"), F.max(date).alias("hi")).select(key, F.explode(F.sequence("lo", "hi")).alias("day"))


def missing_days(df: DataFrame, key: str, date: str) -> DataFrame:
    have = df.select(key, F.col(date).alias("day")).distinct()
    return day_spine(df, key, date).join(have, [key, "day"], "left_anti")


def islands(days: DataFrame, key: str, date: str = "day") -> DataFrame:
    """Runs of consecutive days: (key, start, end, days)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(date))
    return days.withColumn("__g", F.date_sub(F.col(date), n)).groupBy(key, "__g").agg(F.min(date).alias("start"), F.max(date).alias("end"), F.count("*").alias("days")).drop("__g")


def by_series(df: DataFrame, key: str, by: str, value: str, columns: list[str], state: dict[str, float], step: Callable[[Column, Column, Column], dict[str, Column]], made: Callable[[Column, Column], list[Column]]) -> DataFrame:
    """(key, by, columns): what a recursion makes of each key's values in order; a key is one stock's history (thousands of days at most).

    step: from the state, a value and its number (from 0) to the next state; made: the columns, from the state after a value and its number. The fold is
    one aggregate over the sorted array; it keeps each state as the next step finds it, so no state is computed twice.
    """
    series = df.select(key, F.struct(F.col(by).alias("__by"), F.col(value).cast("double").alias("v")).alias("__x")).groupBy(key).agg(F.array_sort(F.collect_list("__x")).alias("__s"))
    kind = "struct<" + ",".join(f"{n}:double" for n in state) + ">"

    def merge(a: Column, x: Column) -> Column:
        new = step(a["now"], x["v"], F.size(a["out"]))
        return F.struct(F.struct(*[new[n].cast("double").alias(n) for n in state]).alias("now"), F.array_append(a["out"], a["now"]).alias("out"))

    zero = F.struct(F.struct(*[F.lit(float(v)).alias(n) for n, v in state.items()]).alias("now"), F.array().cast(f"array<{kind}>").alias("out"))
    states = F.aggregate("__s", zero, merge, lambda a: F.array_append(a["out"], a["now"]))  # the first is the state before all values
    rows = series.select(key, "__s", states.alias("__a")).select(key, F.posexplode(F.arrays_zip("__s", F.expr("slice(__a, 2, size(__s))").alias("__a"))).alias("__k", "__r"))
    out = made(F.col("__r.__a"), F.col("__k"))
    return rows.select(key, F.col("__r.__s.__by").alias(by), *[c.alias(n) for n, c in zip(columns, out, strict=True)])


def wilder_rsi(df: DataFrame, key: str, by: str, value: str, n: int = 14) -> DataFrame:
    """(key, by, rsi): seeded with the mean of the first n changes, then smoothed by (n - 1) / n. 0 before n changes, and 0
    where there has been no loss (the published formula's choice)."""

    def step(a: Column, v: Column, k: Column) -> dict[str, Column]:
        change = F.when(k > 0, v - a["last"]).otherwise(0.0)
        keep = F.when(k <= n, 1.0).otherwise((n - 1) / n)
        return {"last": v, "up": a["up"] * keep + F.greatest(change, F.lit(0.0)) / n, "down": a["down"] * keep + F.greatest(-change, F.lit(0.0)) / n}

    def made(a: Column, k: Column) -> list[Column]:
        return [F.when((k < n) | (a["down"] == 0), 0.0).otherwise(100 - 100 / (1 + a["up"] / a["down"]))]

    return by_series(df, key, by, value, ["rsi"], {"last": 0, "up": 0, "down": 0}, step, made)


def macd(df: DataFrame, key: str, by: str, value: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """(key, by, macd, macd_signal, macd_hist): exponential means with weight 2 / (n + 1), seeded with the first value."""

    def step(a: Column, v: Column, k: Column) -> dict[str, Column]:
        follow = lambda c, x, n: F.when(k == 0, x).otherwise(x * (2 / (n + 1)) + a[c] * (1 - 2 / (n + 1)))
        quick, slack = follow("fast", v, fast), follow("slow", v, slow)
        return {"fast": quick, "slow": slack, "signal": follow("signal", quick - slack, signal)}

    def made(a: Column, k: Column) -> list[Column]:
        line = a["fast"] - a["slow"]
        return [line, a["signal"], line - a["signal"]]

    return by_series(df, key, by, value, ["macd", "macd_signal", "macd_hist"], {"fast": 0, "slow": 0, "signal": 0}, step, made)


def compounded(ret: Column, key: str, by: str) -> Column:
    """Growth of 1 by returns above -1, as a running product."""
    return F.exp(F.sum(F.log1p(ret)).over(Window.partitionBy(key).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))


def drawdown(df: DataFrame, key: str, by: str, curve: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(curve).over(w)
    return df.withColumns({"peak": peak, "drawdown": (F.col(curve) - peak) / peak})


def longest_run(df: DataFrame, key: str, by: str, condition: Column) -> DataFrame:
    """(key, longest): the most consecutive rows that fulfil a condition."""
    w = Window.partitionBy(key).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("__on", F.coalesce(condition, F.lit(False))).withColumn("__g", F.sum(F.when(F.col("__on"), 0).otherwise(1)).over(w))
    return marked.groupBy(key, "__g").agg(F.sum(F.col("__on").cast("int")).alias("n")).groupBy(key).agg(F.max("n").alias("longest"))


def drift(df: DataFrame, key: str, by: str, correct: str, recent: int = 10, width: int = 7, runs: int = 3, floor: float = 0.45) -> DataFrame:
    """(key, rows, drifted): whether the last `runs` windows of `width` rows, among the last `recent`, all have a hit rate
    below floor; false with fewer than width + runs - 1 rows."""
    last = df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by)))).filter(F.col("__k") <= recent)
    hit = F.avg(F.coalesce(F.col(correct).cast("double"), F.lit(0.0))).over(Window.partitionBy(key).orderBy("__k").rowsBetween(0, width - 1))
    rated = last.withColumn("__hit", hit)
    return rated.groupBy(key).agg(F.count("*").alias("rows"), F.sum(F.when((F.col("__k") <= runs) & (F.col("__hit") < floor), 1).otherwise(0)).alias("__low")).select(key, "rows", ((F.col("__low") == runs) & (F.col("rows") >= width + runs - 1)).alias("drifted"))


def walk_forward(days: DataFrame, window_days: int, every: int = 5, buffer_days: int = 7) -> DataFrame:
    """Folds by trading day: training [d - 1 - window_days, d - 1], buffer [d - buffer_days, d - 1]; the model is retrained every so many days and carried on."""
    return days.select("pos", F.col("td").alias("test_date"), F.date_sub("td", 1 + window_days).alias("train_start"), F.date_sub("td", 1).alias("train_end"), F.date_sub("td", buffer_days).alias("buffer_start"), ((F.col("pos") - 1) % every == 0).alias("retrain"), (F.floor((F.col("pos") - 1) / every) * every + 1).alias("model_pos"))
