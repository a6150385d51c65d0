"""Reference-shaped views of the driver's tables, and the same views as DuckDB text for the oracle.

Money is in whole cents until the last step, so that both engines compute the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(c: str | F.Column) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lpad(c.cast("string"), 6, "0")


def is_weekday(c: str) -> F.Column:
    return F.weekday(c) < 5


def price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily_price: a row per nation and weekday with orders; returns against the previous row and against the equal-weight index."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    day = o.select("o_custkey", F.to_date("o_orderdate").alias("date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")).filter(is_weekday("date"))
    d = day.join(c.select("c_custkey", "c_nationkey"), day.o_custkey == c.c_custkey).groupBy(code("c_nationkey").alias("stock_code"), "date").agg(F.sum("cents").alias("s"), F.count("*").alias("volume"))
    d = d.select("stock_code", "date", (F.lit(1000000) + F.expr("s div (volume * 1000)")).alias("close_cents"), "volume")
    i = d.groupBy("date").agg(F.expr("sum(close_cents) div count(*)").alias("idx"))
    ret = lambda c, w: F.col(c).cast("double") / F.lag(c).over(w) - 1
    ir = i.select("date", ret("idx", Window.orderBy("date")).alias("idx_ret"))  # a row per trading day
    r = d.withColumn("ret", ret("close_cents", Window.partitionBy("stock_code").orderBy("date")))
    return r.join(ir, "date").filter("ret is not null and idx_ret is not null").select("stock_code", "date", (F.col("close_cents").cast("double") / 100).alias("close_price"), "volume", F.round("ret", 8).alias("return_rate"), F.round(F.col("ret") - F.col("idx_ret"), 8).alias("excess_return"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestamp_ntz '1995-01-02 00:00:00' + make_dt_interval(cast(doc_id % 241 as int), cast(doc_id * 7 % 24 as int), cast(doc_id * 13 % 60 as int))")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("url_hash"), code(F.col("doc_id") % 25).alias("stock_code"), at.alias("published_at"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"), "source", "lang")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    rows = li.select("l_suppkey", F.to_date("l_shipdate").alias("prediction_date"), "l_discount", "l_tax").filter(is_weekday("prediction_date"))
    return rows.join(s.select("s_suppkey", "s_nationkey"), rows.l_suppkey == s.s_suppkey).groupBy(code("s_nationkey").alias("stock_code"), "prediction_date").agg((F.round(F.avg("l_discount") - 0.05, 6) + 0.0).alias("expected_alpha"), F.round(F.avg("l_tax"), 6).alias("intensity"), F.count("*").alias("n"))


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with the excess return of their day."""
    p = price(spark, sf_dir).select("stock_code", F.col("date").alias("prediction_date"), F.col("excess_return").alias("actual_alpha"))
    return predictions(spark, sf_dir).join(p, ["stock_code", "prediction_date"])


def tokens(text: F.Column) -> F.Column:
    """Lower-case runs of letters and digits, longer than one."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) > 1)


def word_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and distinct word: (doc_id, stock_code, published_at, source, word)."""
    n = news(spark, sf_dir)
    return n.select("doc_id", "stock_code", "published_at", "source", F.explode(F.array_distinct(tokens(F.col("content")))).alias("word"))


def sentiment_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of labelled documents, a version per source: beta is the mean quality with the word less the mean of all."""
    q = table(spark, sf_dir, "labels").select("doc_id", "quality")
    mean = q.agg((F.sum("quality") / F.count("quality")).alias("mean"))
    return (
        news(spark, sf_dir).join(q, "doc_id").select("source", "quality", "published_at", F.explode(F.array_distinct(tokens(F.col("content")))).alias("word")).groupBy("word", F.col("source").alias("version")).agg(F.sum("quality").alias("s"), F.count("quality").alias("n"), F.max("published_at").alias("updated_at")).filter("n >= 2")
        .crossJoin(F.broadcast(mean)).select("word", "version", F.round(F.col("s") / F.col("n") - F.col("mean"), 6).alias("beta"), "n", "updated_at")
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse on purpose: a row per nation and quarter's first month with orders."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    m = o.select("o_custkey", F.to_date(F.trunc(F.to_date("o_orderdate"), "month")).alias("base_date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")).filter(F.month("base_date") % 3 == 1)
    g = m.join(c.select("c_custkey", "c_nationkey"), m.o_custkey == c.c_custkey).groupBy(code("c_nationkey").alias("stock_code"), "base_date").agg(F.sum("cents").alias("s"), F.count("*").alias("n"))
    return g.select("stock_code", "base_date", (F.expr("s div (n * 10000)") / 100.0).alias("per"), (F.expr("s % 900") / 100.0).alias("pbr"), F.col("s").alias("market_cap"), (F.expr("s % 7000") / 10.0 - 100).alias("eps"), (F.expr("s % 11000") / 10.0 - 100).alias("bps"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window by penalty grid with hit rates and errors made from order quantities: (wi, ai, window_months, alpha, hit_rate, mae)."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 10).cast("int").alias("wi"), (F.col("l_suppkey") % 4).cast("int").alias("ai"), F.col("l_quantity").cast("long").alias("q"))
    g = li.groupBy("wi", "ai").agg(F.sum("q").alias("s"), F.count("*").alias("n"))
    alpha = F.element_at(F.array(F.lit(1e-5), F.lit(5e-5), F.lit(1e-4), F.lit(5e-4)), F.col("ai") + 1)
    return g.select("wi", "ai", (F.col("wi") + 3).alias("window_months"), alpha.alias("alpha"), (F.expr("s % 1000") / 1000.0).alias("hit_rate"), (F.expr("(s * 7 + n) % 1500") / 10000.0).alias("mae"))


#: DuckDB text of the views above, by name; each needs those it names.
_SQL = {
    "px_d": "select lpad(cast(c_nationkey as varchar), 6, '0') as stock_code, cast(o_orderdate as date) as date, 1000000 + cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) // (count(*) * 1000) as close_cents, count(*) as volume from orders join customer on o_custkey = c_custkey where isodow(cast(o_orderdate as date)) < 6 group by 1, 2",
    "px_i": "select date, cast(sum(close_cents) as bigint) // count(*) as idx from px_d group by 1",
    "px_ir": "select date, cast(idx as double) / lag(idx) over (order by date) - 1 as idx_ret from px_i",
    "px_r": "select *, cast(close_cents as double) / lag(close_cents) over (partition by stock_code order by date) - 1 as ret from px_d",
    "price": "select stock_code, px_r.date, cast(close_cents as double) / 100 as close_price, volume, round(ret, 8) as return_rate, round(ret - idx_ret, 8) as excess_return from px_r join px_ir on px_r.date = px_ir.date where ret is not null and idx_ret is not null",
    "news": "select doc_id, sha256(cast(doc_id as varchar)) as url_hash, lpad(cast(doc_id % 25 as varchar), 6, '0') as stock_code, timestamp '1995-01-02 00:00:00' + to_days(cast(doc_id % 241 as integer)) + to_hours(doc_id * 7 % 24) + to_minutes(doc_id * 13 % 60) as published_at, substring(text, 1, 60) as title, text as content, source, lang from documents",
    "pred": "select lpad(cast(s_nationkey as varchar), 6, '0') as stock_code, cast(l_shipdate as date) as prediction_date, round(avg(l_discount) - 0.05, 6) + 0.0::double as expected_alpha, round(avg(l_tax), 6) as intensity, count(*) as n from lineitem join supplier on l_suppkey = s_suppkey where isodow(cast(l_shipdate as date)) < 6 group by 1, 2",
    "settled": "select pred.*, excess_return as actual_alpha from pred join price on pred.stock_code = price.stock_code and prediction_date = date",
    "words_all": "select doc_id, stock_code, published_at, source, unnest(list_filter(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+'), lambda w: length(w) > 1)) as word from news",
    "word_days": "select distinct * from words_all",
    "dict": "select word, source as version, round(sum(quality) / count(quality) - (select sum(quality) / count(quality) from labels), 6) as beta, count(quality) as n, max(published_at) as updated_at from word_days join labels using (doc_id) group by 1, 2 having count(quality) >= 2",
    "fund": "select stock_code, base_date, s // (n * 10000) / 100.0::double as per, s % 900 / 100.0::double as pbr, s as market_cap, s % 7000 / 10.0::double - 100 as eps, s % 11000 / 10.0::double - 100 as bps from (select lpad(cast(c_nationkey as varchar), 6, '0') as stock_code, cast(date_trunc('month', o_orderdate) as date) as base_date, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as s, count(*) as n from orders join customer on o_custkey = c_custkey where month(o_orderdate) % 3 = 1 group by 1, 2)",
    "grid": "select wi, ai, wi + 3 as window_months, [1e-5, 5e-5, 1e-4, 5e-4][ai + 1] as alpha, s % 1000 / 1000.0::double as hit_rate, (s * 7 + n) % 1500 / 10000.0::double as mae from (select cast(l_partkey % 10 as int) as wi, cast(l_suppkey % 4 as int) as ai, cast(sum(cast(l_quantity as bigint)) as bigint) as s, count(*) as n from lineitem group by 1, 2)",
}


def sql(names: str, body: str) -> str:
    """DuckDB text of `body` over the named views and those that they need."""
    need, todo = set(), names.split()
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += [m for m in _SQL if m != n and f" {m} " in f" {_SQL[n].replace('.', ' ').replace(')', ' ')} "]
    return "with " + ",\n".join(f"{n} as ({_SQL[n]})" for n in _SQL if n in need) + "\n" + body
