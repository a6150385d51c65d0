"""Training on text, prediction with whole dictionaries, and the daily run over all stocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import code, fundamentals, news, price, sentiment_dict, settled, sql, table, tokens
from ..functions import expr
from ..operators import lifecycle, models, ordered, scoring, training, tuning
from ..sources import tables
from ..streaming import pipelines
from .registry import Registry
from .relational import day, with_views
from .reports import RSI, SERIES

R = Registry()
FIRST, LAST, AS_OF = "1995-01-02", "1995-08-15", "1995-08-15"
FUNDAMENTAL = ["per", "pbr", "roe", "log_market_cap"]
TECHNICAL = ["rsi_14", "macd_line", "macd_sig", "macd_hist"]
LAGS, GRAMS = 3, 2


def fundamental_columns(spark: SparkSession, d: str) -> DataFrame:
    f = fundamentals(spark, d)
    return f.select("stock_code", "base_date", "per", "pbr", expr.return_on_equity("per", "pbr", "eps", "bps").alias("roe"), F.log(F.greatest(F.col("market_cap").cast("double"), F.lit(1.0))).alias("log_market_cap"))


def dense_rows(spark: SparkSession, d: str, technical: bool) -> DataFrame:
    """Every price row with its fundamentals (the last known ones, else 0), and with technical with its indicators."""
    p = price(spark, d)
    rows = ordered.asof_backward(p, fundamental_columns(spark, d), "stock_code", "date", "base_date", FUNDAMENTAL).fillna(0.0, FUNDAMENTAL)
    if not technical:
        return rows
    rsi = ordered.wilder_rsi(p, "stock_code", "date", "close_price").withColumnRenamed("rsi", "rsi_14")
    m = ordered.macd(p, "stock_code", "date", "close_price").withColumnsRenamed({"macd": "macd_line", "macd_signal": "macd_sig"})
    return rows.join(rsi, ["stock_code", "date"]).join(m, ["stock_code", "date"])


def named(c: str) -> str:
    return f"__T_{c}__" if c in TECHNICAL else f"__F_{c}__"


def by_day(n: DataFrame) -> DataFrame:
    """Articles as (stock_code, date, content), dealt by both: texts travel, not their words."""
    return n.select("stock_code", F.to_date("published_at").alias("date"), "content").repartition("stock_code", "date")


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The rows from a table in the shared folder: what several parts of a plan read is made once."""
    df.write.parquet(to := pipelines.folder(spark, name))
    return spark.read.parquet(to)


def training_set(spark: SparkSession, d: str, technical: bool = True, first: str = FIRST, last: str = LAST) -> tuple[DataFrame, DataFrame, list[str]]:
    """The days (as from training.day_tfidf) and rows of every stock in a range of dates, and the names of the dense columns."""
    counts, rows, names = counted_set(spark, d, technical, first, last)
    return training.day_tfidf(counts, LAGS), rows, names


def counted_set(spark: SparkSession, d: str, technical: bool = True, first: str = FIRST, last: str = LAST) -> tuple[DataFrame, DataFrame, list[str]]:
    """The same with the counts of days (as from training.day_counts)."""
    kept, n, names = learned_from(spark, d, technical, first, last)
    t = by_day(n).select("stock_code", "date", tokens(F.col("content")).alias("words"))
    return training.day_counts(t, kept, GRAMS), kept, names


def word_set(spark: SparkSession, d: str, technical: bool = True, ranges=training.whole) -> tuple[DataFrame, DataFrame, list[str]]:
    """The words that a model may use (as from training.frequent_words), rows and names of the dense columns."""
    kept, n, names = learned_from(spark, d, technical, FIRST, LAST)
    articles = n.select("stock_code", F.to_date("published_at").alias("date"), "content")
    return training.frequent_words(articles, kept, tokens(F.col("content")), GRAMS, LAGS, ranges=ranges), kept, names


def learned_from(spark: SparkSession, d: str, technical: bool, first: str, last: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows and articles of a range of dates, and the names of the dense columns."""
    dense = FUNDAMENTAL + (TECHNICAL if technical else [])
    kept = dense_rows(spark, d, technical).filter(F.col("date").between(first, last)).withColumn("y", F.col("excess_return"))
    rows = training.numbered(kept, ["y", *[F.col(c).alias(named(c)) for c in dense]])
    n = news(spark, d).filter((F.col("published_at") >= F.date_sub(F.lit(first).cast("date"), LAGS + 2)) & (F.to_date("published_at") <= last))
    return rows, n, [named(c) for c in dense]


def own_names(spark: SparkSession, d: str) -> DataFrame:
    """The names that a stock's dictionary must not hold."""
    return lifecycle.aliases(table(spark, d, "nation").select(code("n_nationkey").alias("stock_code"), "n_name"), "stock_code", "n_name")


def trained(spark: SparkSession, d: str, technical: bool = True) -> DataFrame:
    words, rows, dense = word_set(spark, d, technical)
    fitted = training.train_words(words, rows, dense, LAGS)
    base = F.regexp_replace("feature", r"_L\d+$", "")
    own = own_names(spark, d).select("stock_code", F.lower("alias").alias("__base")).distinct()
    return fitted.withColumn("__base", base).join(own, ["stock_code", "__base"], "left_anti").drop("__base")


@R.add()
def train_text_dictionary(spark, d):
    return trained(spark, d).withColumn("version", F.lit("1995-08-15"))


def words_by_lag(spark: SparkSession, d: str, rows: DataFrame, at: DataFrame, lags: int, keys: tuple[str, ...] | list[str] = ("stock_code",)) -> DataFrame:
    """(keys, word, lag, weight) of the articles of the last sessions before each row of at (stock_code, td, tpos): those from 16:00 on count for the
    next trading day, and an article decays by the hours to the opening of td at nine."""
    n = news(spark, d).withColumn("date", ordered.session_date("published_at", "cutoff16"))
    days = ordered.asof_forward(n.select("stock_code", "date").distinct(), rows, "stock_code", "date", "date", ["pos"]).filter("pos is not null")  # days, not articles
    wanted = days.select("stock_code", "date", "pos").join(at, "stock_code").withColumn("lag", F.col("tpos") - F.col("pos") + 1).filter(F.col("lag").between(1, lags))
    near = n.select("stock_code", "date", "published_at", "content").join(F.broadcast(wanted), ["stock_code", "date"])  # texts of other days do not travel
    weight = expr.time_decay(expr.hours_since(F.col("published_at"), F.col("td").cast("timestamp") + F.expr("INTERVAL 9 HOURS")))
    return near.select(*keys, "lag", weight.alias("weight"), F.explode(tokens(F.col("content"))).alias("word"))


def market_stats(rows: DataFrame, at: DataFrame) -> DataFrame:
    """(stock_code, last_volume, mean_volume, volatility, n) of the rows up to each stock's day: 5 rows of volume, 30 of returns."""
    k = F.row_number().over(Window.partitionBy("stock_code").orderBy(F.desc("date")))
    last = rows.join(at, "stock_code").filter(F.col("date") <= F.col("td")).withColumn("k", k).filter("k <= 30")
    return last.groupBy("stock_code").agg(F.max(F.when(F.col("k") == 1, F.col("volume"))).alias("last_volume"), F.avg(F.when(F.col("k") <= 5, F.col("volume"))).alias("mean_volume"), F.stddev_samp("return_rate").alias("volatility"), F.count("return_rate").alias("n"))


def last_day(rows: DataFrame, until: str) -> DataFrame:
    return rows.filter(F.col("date") <= until).groupBy("stock_code").agg(F.max("date").alias("td"), F.max("pos").alias("tpos"))


def long_form(wide: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(named(c)).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]))
    return wide.select("stock_code", pairs.alias("x")).select("stock_code", "x.*")


_DICT = "dictionary as (select word || '_L' || lag as feature, round(sum(beta), 12) as beta from (select word, lag, beta * 0.0005 / lag as beta from dict, (select unnest([1, 2, 3, 4, 5]) as lag) where version = 'src0' union all select word, 1, beta * 0.00025 from dict where version = 'src1') group by 1), coef as (select unnest(['__F_per__', '__F_pbr__', '__F_roe__', '__T_rsi_14__']) as feature, unnest([0.002, -0.003, 0.001, -0.002]) as beta)"
_PREDICT = """rows as (select *, row_number() over (partition by stock_code order by date) as pos from price),
t as (select stock_code, max(date) as td, max(pos) as tpos from rows where date <= date '1995-08-15' group by 1),
art as (select stock_code, content, published_at, (select min(pos) from rows p where p.stock_code = n.stock_code and p.date >= cast(published_at as date) + case when hour(published_at) >= 16 then 1 else 0 end) as pos from news n),
near as (select stock_code, content, tpos - pos + 1 as lag, exp(-0.02 * case when hour(published_at) = 0 and minute(published_at) = 0 then 24 else greatest(date_diff('second', published_at, td + interval 9 hour) / 3600.0, 0) end) as weight from art join t using (stock_code) where tpos - pos + 1 between 1 and 5),
words as (select stock_code, lag, least(weight, 1) as weight, unnest(list_filter(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+'), lambda w: length(w) > 1)) as word from near),
fd as (select stock_code, base_date, per, pbr, case when bps > 0 then eps / bps * 100 when per > 0 then pbr / per * 100 else 0 end as roe from fund),
fx as (select stock_code, '__F_per__' as feature, per as value, base_date from fd union all select stock_code, '__F_pbr__', pbr, base_date from fd union all select stock_code, '__F_roe__', roe, base_date from fd),
now as (select stock_code, feature, arg_max(value, base_date) as value from fx join t using (stock_code) where base_date <= td group by 1, 2),
scaler as (select stock_code, feature, avg(value) as mean, stddev_pop(value) as scale from fx group by 1, 2),
dense as (select stock_code, feature, value, mean, scale from now join scaler using (stock_code, feature) union all select r.stock_code, '__T_rsi_14__', case when k < 14 or l = 0 then 0 else 100 - 100 / (1 + g / l) end, 50, 10 from r join t on r.stock_code = t.stock_code and r.date = t.td),
hit as (select stock_code, word, round(beta * weight, 12) as c, count(*) as times, true as text from words join dictionary on feature = word || '_L' || lag group by stock_code, word, lag, weight, beta),
con as (select stock_code, word, c, cast(sum(times) as bigint) as times from hit where abs(c) > 1e-5 group by 1, 2, 3 union all select stock_code, feature, round(case when scale <> 0 then (value - mean) / scale * beta else 0 end, 12), 1 from dense join coef using (feature)),
ranked as (select *, row_number() over (partition by stock_code order by c desc, word) as up, row_number() over (partition by stock_code order by c, word) as down from con),
sums as (select stock_code, coalesce(sum(c * times) filter (where c > 0), 0) as pos, coalesce(sum(c * times) filter (where c < 0), 0) as neg, coalesce(bool_or(c < 0 and word in ('gratis', 'idiot')), false) as bad, coalesce(bool_or(c > 0 and word in ('gratis', 'idiot')), false) as good, coalesce(string_agg(word || ':' || cast(round(c * 1e6) as bigint), ',' order by up) filter (where c > 0 and up <= 3), '') as positive, coalesce(string_agg(word || ':' || cast(round(c * 1e6) as bigint), ',' order by down) filter (where c < 0 and down <= 3), '') as negative from ranked group by 1),
lately as (select *, row_number() over (partition by stock_code order by date desc) as q from rows join t using (stock_code) where date <= td),
stats as (select stock_code, max(volume) filter (where q = 1) as last_volume, avg(volume) filter (where q <= 5) as mean_volume, stddev_samp(return_rate) filter (where q <= 30) as volatility, count(*) filter (where q <= 30) as n from lately group by 1),
mae as (select stock_code, avg(abs(expected_alpha - actual_alpha)) as mae from settled group by 1),
x as (select w.stock_code, coalesce(pos, 0) * (1 - case when coalesce(pbr, 1) > 6 then least((coalesce(pbr, 1) - 6) / 10, 0.3) else 0 end) as pos, coalesce(neg, 0) as neg, bad, good, coalesce(positive, '') as positive, coalesce(negative, '') as negative, case when mean_volume > 0 then least(greatest(ln(1 + last_volume / mean_volume), 0.5), 2.0) else 1 end as m, least(greatest(case when n >= 20 then coalesce(volatility, 0.02) else 0.02 end / 0.02, 0.5), 3.0) as v, coalesce(mae, 0.05) as mae, (select count(*) from words o where o.stock_code = w.stock_code and lag = 1) as tokens
from (select distinct stock_code from words) w join stats using (stock_code) left join sums using (stock_code) left join mae using (stock_code) left join (select stock_code, value as pbr from now where feature = '__F_pbr__') b using (stock_code)),
y as (select *, (pos + neg) * m as net, (pos - neg) * m as i from x)"""


@R.add(with_views("price news dict fund settled", SERIES + ", " + RSI + ", " + _DICT + ", " + _PREDICT, "select stock_code, round(least(greatest(net, -0.15), 0.15), 8) as expected_alpha, round(net, 8) as net, round(i, 8) as intensity, case when bad then 'Super Sell' when good then 'Super Buy' when i < 0.01 * v then 'Wait' when i > 0.02 * v and abs(net) < 0.0025 * v then 'Restricted' when net > 0.005 * v then 'Super Buy' when net > 0 then 'Buy' when net < -0.005 * v then 'Super Sell' else 'Sell' end as status, round((40 * least(1.0, tokens / 150.0) + 60 * greatest(0.0, 1 - 10 * mae)) * case when abs(net) > 0.05 then 0.7 else 1 end, 1) as confidence, positive, negative from y").replace("with ", "with recursive ", 1))
def predict_advanced(spark, d):
    """Every stock's prediction for its last day: a main and a buffer dictionary, fundamentals and an indicator, volume and volatility."""
    p = price(spark, d)
    rows = training.numbered(p, ["volume", "return_rate"])
    at = last_day(rows, AS_OF)
    v = sentiment_dict(spark, d)
    main = v.filter("version = 'src0'").select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("lag"), "word", "beta").select(F.concat("word", F.lit("_L"), F.col("lag").cast("string")).alias("feature"), (F.col("beta") * 0.0005 / F.col("lag")).alias("beta"))
    buffer = v.filter("version = 'src1'").select(F.concat("word", F.lit("_L1")).alias("feature"), (F.col("beta") * 0.00025).alias("beta"))
    coef = spark.createDataFrame([("__F_per__", 0.002), ("__F_pbr__", -0.003), ("__F_roe__", 0.001), ("__T_rsi_14__", -0.002)], "feature string, beta double")
    both = scoring.combined(main, buffer, []).select("feature", F.round("beta", 12).alias("beta")).unionByName(coef)
    f = fundamental_columns(spark, d).drop("log_market_cap")
    latest = ordered.asof_backward(at, f, "stock_code", "td", "base_date", ["per", "pbr", "roe"])
    scaler = long_form(f, ["per", "pbr", "roe"]).groupBy("stock_code", "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("scale"))
    dense = long_form(latest, ["per", "pbr", "roe"]).filter("value is not null").join(scaler, ["stock_code", "feature"])
    rsi = ordered.wilder_rsi(p, "stock_code", "date", "close_price").join(at, "stock_code").filter("date = td").select("stock_code", F.lit("__T_rsi_14__").alias("feature"), F.col("rsi").alias("value"), F.lit(50.0).alias("mean"), F.lit(10.0).alias("scale"))
    mae = settled(spark, d).groupBy("stock_code").agg(F.avg(F.abs(F.col("expected_alpha") - F.col("actual_alpha"))).alias("mae"))
    stats = market_stats(rows, at).join(latest.select("stock_code", F.coalesce("pbr", F.lit(1.0)).alias("pbr")), "stock_code").join(mae, "stock_code", "left")
    out = scoring.predict_advanced(words_by_lag(spark, d, rows, at, 5), both, dense.unionByName(rsi), stats, ["stock_code"], ["gratis", "idiot"])
    return out.select("stock_code", *[F.round(c, 8).alias(c) for c in ("expected_alpha", "net", "intensity")], "status", "confidence", "positive", "negative")


@R.add()
def daily_training_and_prediction(spark, d):
    """A whole run over all stocks: dictionaries trained on text, fundamentals and indicators, the prediction of each stock's first day after the
    training range from the sessions before it, and its settlement."""
    rows = training.numbered(price(spark, d), ["volume", "return_rate", "excess_return"])
    nxt = rows.filter(F.col("date") > LAST).groupBy("stock_code").agg(F.min("date").alias("td"), F.min("pos").alias("tpos"))
    fitted = stored(spark, trained(spark, d), "trained")
    before = rows.join(nxt, "stock_code").filter(F.col("pos") == F.col("tpos") - 1).select("stock_code", "date")
    wide = dense_rows(spark, d, True).join(before, ["stock_code", "date"])
    dense = long_form(wide, FUNDAMENTAL + TECHNICAL).join(fitted.filter("mean is not null").select("stock_code", "feature", "mean", "scale"), ["stock_code", "feature"])
    stats = market_stats(rows, nxt.withColumn("td", F.date_sub("td", 1))).join(wide.select("stock_code", "pbr"), "stock_code").withColumn("mae", F.lit(None).cast("double"))
    out = scoring.predict_advanced(words_by_lag(spark, d, rows, nxt, LAGS), fitted, dense, stats, ["stock_code"], training.CRITICAL)
    actual = rows.join(nxt, "stock_code").filter("pos = tpos").select("stock_code", day("td").alias("date"), F.col("excess_return").alias("actual_alpha"))
    return out.join(actual, "stock_code").withColumn("is_correct", F.when(F.col("status").contains("Buy"), F.col("actual_alpha") > 0).when(F.col("status").contains("Sell"), F.col("actual_alpha") < 0).otherwise(F.lit(False)))


@R.add()
def text_window_scan(spark, d):
    """The text trainer over ten windows and four penalties for every stock, each judged on the stock's last fifth of rows."""
    words, rows, dense = word_set(spark, d, technical=False, ranges=tuning.ranges())
    return tuning.scan(words, rows, dense, lags=LAGS)


@R.add()
def text_scan_choice(spark, d):
    """The scan kept in a checkpoint table, its most stable cell for each stock, and whether that is promoted."""
    words, rows, dense = word_set(spark, d, technical=False, ranges=tuning.ranges())
    to = pipelines.folder(spark, "scan")
    for name, df in (("counts", words), ("rows", rows)):  # every batch of stocks reads them
        df.write.parquet(f"{to}/{name}")
    cells = tuning.checkpointed(spark, spark.read.parquet(f"{to}/counts"), spark.read.parquet(f"{to}/rows"), dense, f"{to}/cells", lags=LAGS)
    return lifecycle.promote(tuning.stability(cells), "stock_code", LAST).select("stock_code", "window_months", "alpha", "hit_rate", "mae", "mean_hr", "std_hr", "neighbours", "stability", "version", "promotion_status")


WF_FIRST, WF_LAST, WF_WINDOW, WF_EVERY = "1995-06-01", "1995-08-15", 120, 20


def walk_forward_set(rows: DataFrame, first: str, last: str, window_days: int, every: int) -> tuple[DataFrame, DataFrame]:
    """(tests, fits): test rows (stock_code, fold, td, tpos), whose fold is retrained every so many of a stock's rows, and the range of days that each
    fold learns from (fold, stock_code, lo, hi): window_days up to the day before its first test."""
    w = Window.partitionBy("stock_code")
    test = rows.filter(F.col("date").between(first, last)).withColumn("fold", F.floor((F.col("pos") - F.min("pos").over(w)) / every).cast("int"))
    tests = test.select("stock_code", "fold", F.col("date").alias("td"), F.col("pos").alias("tpos"))
    start = tests.groupBy("stock_code", "fold").agg(F.min("td").alias("from"))
    return tests, start.select("stock_code", "fold", F.date_sub("from", 1 + window_days).alias("lo"), F.date_sub("from", 1).alias("hi"))


def in_folds(df: DataFrame, fits: DataFrame) -> DataFrame:
    """Rows once for each fold that learns from their date, under the fold's name as stock_code."""
    own = fits.select(F.col("stock_code").alias("__stock"), "fold", "lo", "hi")
    joined = df.join(own, F.col("stock_code") == F.col("__stock")).filter(F.col("date").between(F.col("lo"), F.col("hi")))
    return joined.withColumn("stock_code", F.concat("__stock", F.lit("#"), F.col("fold").cast("string"))).drop("__stock", "fold", "lo", "hi")


@R.add()
def walk_forward_scorer(spark, d):
    """Every stock's test days scored by dictionaries retrained on the days before: Buy stands for 1, Sell for 0, any other status for no prediction,
    which counts as wrong."""
    rows = training.numbered(price(spark, d), ["volume", "return_rate", "excess_return"])
    tests, fits = walk_forward_set(rows, WF_FIRST, WF_LAST, WF_WINDOW, WF_EVERY)
    dense = [named(c) for c in FUNDAMENTAL]
    wide = dense_rows(spark, d, False)
    kept = training.numbered(in_folds(wide.withColumn("y", F.col("excess_return")), fits), ["y", *[F.col(c).alias(named(c)) for c in FUNDAMENTAL]])
    n = news(spark, d).filter(F.to_date("published_at").between(F.date_sub(F.lit(WF_FIRST).cast("date"), 1 + WF_WINDOW), F.lit(WF_LAST).cast("date")))
    days = in_folds(n.select("stock_code", F.col("stock_code").alias("own"), F.to_date("published_at").alias("date")).distinct(), fits)
    counts = training.day_counts(by_day(n).select("stock_code", "date", tokens(F.col("content")).alias("words")), kept, folds=days)
    fitted = stored(spark, training.train_dictionary(training.day_tfidf(counts, LAGS), kept, dense, LAGS), "folds")
    key = F.concat("stock_code", F.lit("#"), F.col("fold").cast("string"))
    placed = tests.select("stock_code", "td", "tpos", key.alias("key"))
    words = words_by_lag(spark, d, rows, placed, LAGS, ["key", "td"])
    before = placed.join(wide.select("stock_code", F.col("date").alias("td"), *FUNDAMENTAL), ["stock_code", "td"])
    values = before.select("key", "td", F.explode(F.array(*[F.struct(F.lit(named(c)).alias("feature"), F.col(c).cast("double").alias("value")) for c in FUNDAMENTAL])).alias("x")).select("key", "td", "x.*")
    fitted = fitted.withColumnRenamed("stock_code", "key")
    scaled = values.join(fitted.filter("mean is not null").select("key", "feature", "mean", "scale"), ["key", "feature"])
    day_stats = rows.withColumns({"last_volume": F.col("volume"), "mean_volume": F.avg("volume").over(_back(5)), "volatility": F.stddev_samp("return_rate").over(_back(30)), "n": F.count("return_rate").over(_back(30))})
    stats = placed.withColumn("pos", F.col("tpos") - 1).join(day_stats.select("stock_code", "pos", "last_volume", "mean_volume", "volatility", "n"), ["stock_code", "pos"]).join(before.select("key", "td", "pbr"), ["key", "td"]).select("key", "td", "last_volume", "mean_volume", "volatility", "n", "pbr", F.lit(None).cast("double").alias("mae"))
    out = scoring.predict_advanced(words, fitted, scaled, stats, ["key", "td"], training.CRITICAL)
    actual = placed.join(rows.select("stock_code", F.col("pos").alias("tpos"), F.col("excess_return").alias("actual_alpha")), ["stock_code", "tpos"]).select("key", "td", "stock_code", "actual_alpha")
    predicted = F.when(F.col("status").contains("Buy"), 1).when(F.col("status").contains("Sell"), 0)
    return out.join(actual, ["key", "td"]).select("stock_code", day("td").alias("date"), "status", "expected_alpha", "actual_alpha", predicted.alias("prediction")).withColumn("is_correct", F.coalesce((F.col("prediction") == 1) == (F.col("actual_alpha") > 0), F.lit(False)))


def _back(n: int):
    return Window.partitionBy("stock_code").orderBy("pos").rowsBetween(1 - n, 0)


@R.add(with_views("news price", "p as (select stock_code, min(date) as lo, max(date) as hi from price where date between date '1995-01-02' and date '1995-08-31' group by 1), n as (select stock_code, count(distinct cast(published_at as date)) as news_days from news group by 1)", "select stock_code, date_diff('day', lo, hi) as span_days, coalesce(news_days, 0) as news_days, date_diff('day', lo, hi) >= 50 and coalesce(news_days, 0) >= 30 as enough from p left join n using (stock_code)"))
def data_availability(spark, d):
    """Whether a stock has enough days of prices and of news to learn from a window of 60 days."""
    p = price(spark, d).filter(F.col("date").between("1995-01-02", "1995-08-31")).groupBy("stock_code").agg(F.datediff(F.max("date"), F.min("date")).cast("long").alias("span_days"))
    n = news(spark, d).groupBy("stock_code").agg(F.countDistinct(F.to_date("published_at")).alias("news_days"))
    x = p.join(n, "stock_code", "left").fillna(0, ["news_days"])
    return x.withColumn("enough", lifecycle.enough_data(F.col("span_days"), F.col("news_days"), 60))


@R.add("select l.doc_id, quality from labels l where doc_id not in (select doc_id from documents where n_chars >= 500)")
def stale_label_rows(spark, d):
    return lifecycle.stale_labels(table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents").filter("n_chars >= 500"), ["doc_id"])


@R.add("select event_id, case when event_type = 'click' then 'verification_light' else 'verification_heavy' end as queue, cast(floor(least(value, 100) * (event_id % 30) / 100) as int) as resume_day from events")
def job_queue_and_resume(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", "DAILY_UPDATE").otherwise("SCAN").alias("kind"), F.least("value", F.lit(100)).alias("progress"), (F.col("event_id") % 30).alias("days"))
    return e.select("event_id", lifecycle.routed_queue("kind").alias("queue"), lifecycle.resume_at("progress", "days").alias("resume_day"))


def day_vectors(spark: SparkSession, d: str, rows: DataFrame, dims: int = 16) -> DataFrame:
    """(stock_code, date, pos, y, x): every row with the mean vector of its day's articles, zeros without articles."""
    n = news(spark, d)
    vectors = tables.hashed_embeddings(n.select("doc_id", tokens(F.col("content")).alias("words")), "doc_id", "words", dims)
    at = ordered.asof_forward(n.select("stock_code", "doc_id", F.to_date("published_at").alias("date")), rows, "stock_code", "date", "date", ["pos"]).filter("pos is not null")
    x = models.mean_vectors(at.join(vectors, "doc_id"), ["stock_code", "pos"], "embedding")
    zero = F.array_repeat(F.lit(0.0), dims)
    return rows.join(x, ["stock_code", "pos"], "left").select("stock_code", "date", "pos", F.col("excess_return").alias("y"), F.coalesce("x", zero).alias("x"))


@R.add()
def hybrid_prediction(spark, d):
    """The daily run's prediction blended with a ridge on the day's article vectors: 0.6 of the words and 0.4 of the vectors, and the direction of both."""
    rows = training.numbered(price(spark, d), ["excess_return"])
    v = day_vectors(spark, d, rows).withColumn("pos", F.col("pos").cast("long"))
    words = daily_training_and_prediction(spark, d).select("stock_code", "date", "expected_alpha", "actual_alpha")
    test = v.withColumn("date", day("date")).join(words.select("stock_code", "date"), ["stock_code", "date"])
    ridge = models.ridge_predict(v.filter(F.col("date").between(FIRST, LAST)), test, "stock_code", "pos").select("stock_code", F.col("predicted").alias("vectors"))
    out = words.join(ridge, "stock_code", "left").withColumn("blended", models.blend(F.col("expected_alpha"), F.coalesce("vectors", F.lit(0.0))))
    return out.select("stock_code", "date", "expected_alpha", "vectors", "blended", F.signum("blended").cast("int").alias("direction"), (F.signum("blended") * F.col("actual_alpha") > 0).alias("is_correct"))
