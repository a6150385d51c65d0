"""Reports that put several operators together, numeric series, models and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import code, fundamentals, grid, news, predictions, price, sentiment_dict, settled, sql, table
from ..operators import metrics, models, ordered, text_search
from ..streaming import heartbeats, meters, pipelines
from .registry import Registry
from .relational import _SPINE, day, with_views

R = Registry()


def stock_stats(articles: DataFrame, key: str, date: str) -> DataFrame:
    """Articles, first and last day, days with news, missing days and the longest gap of each stock."""
    days = articles.groupBy(key, F.col(date).alias("day")).agg(F.count("*").alias("n"))
    totals = days.groupBy(key).agg(F.sum("n").alias("articles"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("news_days"))
    gaps = ordered.islands(ordered.missing_days(days, key, "day"), key).groupBy(key).agg(F.sum("days").alias("missing_days"), F.count("*").alias("gaps"), F.max("days").alias("longest_gap"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return totals.join(gaps, key, "left").select(key, "articles", day("first_day").alias("first_day"), day("last_day").alias("last_day"), "news_days", zero("missing_days"), zero("gaps"), zero("longest_gap"))


@R.add(with_views("news", _SPINE + ", isl as (select stock_code, g, count(*) as days from (select *, day - cast(row_number() over (partition by stock_code order by day) as integer) as g from gaps) group by 1, 2), gs as (select stock_code, cast(sum(days) as bigint) as missing_days, count(*) as gaps, max(days) as longest_gap from isl group by 1)", "select stock_code, count(*) as articles, strftime(min(cast(published_at as date)), '%Y-%m-%d') as first_day, strftime(max(cast(published_at as date)), '%Y-%m-%d') as last_day, count(distinct cast(published_at as date)) as news_days, coalesce(any_value(missing_days), 0) as missing_days, coalesce(any_value(gs.gaps), 0) as gaps, coalesce(any_value(longest_gap), 0) as longest_gap from news left join gs using (stock_code) group by 1"))
def stock_stats_dashboard(spark, d):
    return stock_stats(news(spark, d).select("stock_code", F.to_date("published_at").alias("date")), "stock_code", "date")


@R.add(sql("settled", "select stock_code, count(*) as n, round(avg(case when (expected_alpha > 0 and actual_alpha > 0) or (expected_alpha < 0 and actual_alpha < 0) then 1.0 else 0.0 end), 6) as hit_rate, round(avg(abs(expected_alpha - actual_alpha)), 6) as mae, round(sqrt(avg((expected_alpha - actual_alpha) * (expected_alpha - actual_alpha))), 6) as rmse, case when count(*) > 1 and stddev_pop(expected_alpha) > 0 and stddev_pop(actual_alpha) > 0 then round(corr(expected_alpha, actual_alpha), 6) else 0 end as ic from settled group by 1"))
def metrics_accuracy(spark, d):
    m = metrics.accuracy(settled(spark, d), ["stock_code"], "expected_alpha", "actual_alpha")
    return m.select("stock_code", "n", *[F.round(c, 6).alias(c) for c in ("hit_rate", "mae", "rmse", "ic")])


_RET = "ret as (select stock_code, prediction_date, sign(expected_alpha) * actual_alpha as r, actual_alpha as b from settled)"


def _returns(spark, d):
    return settled(spark, d).select("stock_code", "prediction_date", metrics.strategy_return("expected_alpha", "actual_alpha").alias("r"), F.col("actual_alpha").alias("b"))


@R.add(with_views("settled", _RET, "select stock_code, round(case when stddev_pop(r) > 0 then avg(r) * sqrt(252) / stddev_pop(r) else 0 end, 5) as sharpe, round(coalesce(case when stddev_pop(r) filter (where r < 0) > 0 then avg(r) * sqrt(252) / stddev_pop(r) filter (where r < 0) end, 0), 5) as sortino, round(stddev_pop(r) * sqrt(252), 6) as volatility, round(case when stddev_pop(r - b) > 0 then avg(r - b) * sqrt(252) / stddev_pop(r - b) else 0 end, 5) as info_ratio from ret group by 1"))
def metrics_risk(spark, d):
    m = metrics.risk(_returns(spark, d), ["stock_code"], "r", "b")
    return m.select("stock_code", *[F.round(c, 6 if c == "volatility" else 5).alias(c) for c in ("sharpe", "sortino", "volatility", "info_ratio")])


@R.add(with_views("settled", _RET, "select stock_code, round(coalesce(covar_samp(r, b) / nullif(var_pop(b), 0), 1), 6) as beta from ret group by 1"))
def metrics_beta(spark, d):
    return metrics.beta(_returns(spark, d), ["stock_code"], "r", "b").withColumn("beta", F.round("beta", 6))


@R.add(with_views("settled", _RET, "select stock_code, round(g, 6) as gains, round(l, 6) as losses, round(case when l > 0 then g / l when g > 0 then 1 else 0 end, 5) as profit_factor from (select stock_code, coalesce(sum(case when r > 0 then r end), 0) as g, coalesce(sum(case when r < 0 then -r end), 0) as l from ret group by 1)"))
def metrics_profit_factor(spark, d):
    m = metrics.profit_factor(_returns(spark, d), ["stock_code"], "r")
    return m.select("stock_code", F.round("gains", 6).alias("gains"), F.round("losses", 6).alias("losses"), F.round("profit_factor", 5).alias("profit_factor"))


@R.add(sql("price", "select cast(least(floor((excess_return - lo) / w), 9) as int) as bin, round(lo + least(floor((excess_return - lo) / w), 9) * w, 6) as lo, round(lo + (least(floor((excess_return - lo) / w), 9) + 0.5) * w, 6) as mid, count(*) as n from price, (select min(excess_return) as lo, (max(excess_return) - min(excess_return)) / 10 as w from price) group by 1, 2, 3"))
def metrics_histogram(spark, d):
    return metrics.equal_bins(price(spark, d), "excess_return").select("bin", F.round("lo", 6).alias("lo"), F.round("mid", 6).alias("mid"), "n")


_CURVE = "curve as (select stock_code, prediction_date, exp(sum(ln(1 + r)) over w) as c, exp(sum(ln(1 + b)) over w) as bench from ret window w as (partition by stock_code order by prediction_date)), dd as (select *, max(c) over (partition by stock_code order by prediction_date) as peak from curve)"


def _curve(spark, d):
    return _returns(spark, d).withColumns({"c": ordered.compounded(F.col("r"), "stock_code", "prediction_date"), "bench": ordered.compounded(F.col("b"), "stock_code", "prediction_date")})


@R.add(with_views("settled", _RET + ", " + _CURVE, "select stock_code, strftime(prediction_date, '%Y-%m-%d') as date, round(c, 5) as strategy, round(bench, 5) as benchmark from curve"))
def equity_curve(spark, d):
    return _curve(spark, d).select("stock_code", day("prediction_date").alias("date"), F.round("c", 5).alias("strategy"), F.round("bench", 5).alias("benchmark"))


@R.add(with_views("settled", _RET + ", " + _CURVE, "select stock_code, round(min((c - peak) / peak), 5) as mdd, round(max(peak), 5) as peak from dd group by 1"))
def drawdown(spark, d):
    return ordered.drawdown(_curve(spark, d), "stock_code", "prediction_date", "c").groupBy("stock_code").agg(F.round(F.min("drawdown"), 5).alias("mdd"), F.round(F.max("peak"), 5).alias("peak"))


@R.add(with_views("settled", _RET + ", " + _CURVE, "select stock_code, cast(max(n) as bigint) as longest from (select stock_code, g, sum(case when c < peak then 1 else 0 end) as n from (select *, sum(case when c < peak then 0 else 1 end) over (partition by stock_code order by prediction_date) as g from dd) group by 1, 2) group by 1"))
def underwater_run(spark, d):
    x = ordered.drawdown(_curve(spark, d), "stock_code", "prediction_date", "c")
    return ordered.longest_run(x, "stock_code", "prediction_date", F.col("c") < F.col("peak"))


@R.add(sql("settled", "select stock_code, count(*) as rows, count(*) >= 9 and count(*) filter (where k <= 3 and h < 0.45) = 3 as drifted from (select stock_code, k, avg(ok) over (partition by stock_code order by k rows between current row and 6 following) as h from (select stock_code, case when (expected_alpha > 0 and actual_alpha > 0) or (expected_alpha < 0 and actual_alpha < 0) then 1.0 else 0.0 end as ok, row_number() over (partition by stock_code order by prediction_date desc) as k from settled) where k <= 10) group by 1"))
def drift_windows(spark, d):
    s = settled(spark, d).withColumn("ok", metrics.same_sign("expected_alpha", "actual_alpha"))
    return ordered.drift(s, "stock_code", "prediction_date", "ok")


SERIES = "s as (select stock_code, date, close_price as v, row_number() over (partition by stock_code order by date) - 1 as k from price)"


RSI = """r as (select stock_code, date, k, v, cast(0 as double) as g, cast(0 as double) as l from s where k = 0 union all
select s.stock_code, s.date, s.k, s.v, case when s.k <= 14 then r.g + greatest(s.v - r.v, 0) / 14 else (r.g * 13 + greatest(s.v - r.v, 0)) / 14 end, case when s.k <= 14 then r.l + greatest(r.v - s.v, 0) / 14 else (r.l * 13 + greatest(r.v - s.v, 0)) / 14 end from r join s on s.stock_code = r.stock_code and s.k = r.k + 1)"""


@R.add(with_views("price", SERIES + ", " + RSI, "select stock_code, strftime(date, '%Y-%m-%d') as date, round(case when k < 14 or l = 0 then 0 else 100 - 100 / (1 + g / l) end, 5) as rsi from r").replace("with ", "with recursive ", 1))
def rsi_wilder(spark, d):
    return ordered.wilder_rsi(price(spark, d), "stock_code", "date", "close_price").select("stock_code", day("date").alias("date"), F.round("rsi", 5).alias("rsi"))


@R.add(with_views("price", SERIES + """, r as (select stock_code, date, k, v as f, v as w, cast(0 as double) as g from s where k = 0 union all
select stock_code, date, k, f, w, (f - w) * 0.2 + g * 0.8 from (select s.stock_code, s.date, s.k, cast(s.v * 2 / 13 + r.f * 11 / 13 as double) as f, cast(s.v * 2 / 27 + r.w * 25 / 27 as double) as w, r.g from r join s on s.stock_code = r.stock_code and s.k = r.k + 1))""", "select stock_code, strftime(date, '%Y-%m-%d') as date, round(f - w, 4) as macd, round(g, 4) as macd_signal from r").replace("with ", "with recursive ", 1))
def macd(spark, d):
    return ordered.macd(price(spark, d), "stock_code", "date", "close_price").select("stock_code", day("date").alias("date"), F.round("macd", 4).alias("macd"), F.round("macd_signal", 4).alias("macd_signal"))


@R.add(with_views("price", "l as (select stock_code, return_rate as r, " + ", ".join(f"lag(return_rate, {k}) over w as r{k}" for k in range(1, 6)) + " from price window w as (partition by stock_code order by date)), c as (select stock_code, count(*) as n, [" + ", ".join(f"greatest(0.01, abs(coalesce(corr(r, r{k}), 0)))" for k in range(1, 6)) + "] as c from l group by 1)", "select stock_code, lag, round(c[lag] / list_max(c), 6) as weight from c, (select unnest([1, 2, 3, 4, 5]) as lag)"))
def lag_autocorr_decay(spark, d):
    m = metrics.lag_autocorrelation(price(spark, d), "stock_code", "date", "return_rate")
    return m.select("stock_code", "lag", F.round("weight", 6).alias("weight"))


@R.add(sql("pred price", "select strftime(prediction_date, '%Y-%m-%d') as date, pred.stock_code, round((intensity + expected_alpha) / 2, 8) as pos, excess_return as actual from pred left join price on pred.stock_code = price.stock_code and prediction_date = date where pred.stock_code = '000003' order by prediction_date desc limit 60"))
def performance_chart(spark, d):
    p = predictions(spark, d).filter("stock_code = '000003'").orderBy(F.desc("prediction_date")).limit(60)
    return p.join(price(spark, d).withColumnRenamed("date", "prediction_date"), ["stock_code", "prediction_date"], "left").select(day("prediction_date").alias("date"), "stock_code", F.round((F.col("intensity") + F.col("expected_alpha")) / 2, 8).alias("pos"), F.col("excess_return").alias("actual"))


@R.add(sql("settled", "select stock_code, strftime(date_trunc('week', prediction_date), '%Y-%m-%d') as week, count(*) as days, count(*) filter (where (expected_alpha > 0 and actual_alpha > 0) or (expected_alpha < 0 and actual_alpha < 0)) as correct, round(avg(abs(expected_alpha)), 10) as strength from settled group by 1, 2"))
def weekly_summary(spark, d):
    s = settled(spark, d).groupBy("stock_code", F.date_format(F.date_trunc("week", "prediction_date"), "yyyy-MM-dd").alias("week"))
    return s.agg(F.count("*").alias("days"), F.count_if(metrics.same_sign("expected_alpha", "actual_alpha")).alias("correct"), F.round(F.avg(F.abs("expected_alpha")), 10).alias("strength"))


@R.add(sql("settled", "select distinct on (stock_code) stock_code, case when expected_alpha > 0.005 then 'Super Buy' when expected_alpha > 0 then 'Buy' when expected_alpha < -0.005 then 'Super Sell' else 'Sell' end as status, case when expected_alpha > 0.005 then 1 when expected_alpha < -0.005 then 2 when expected_alpha > 0 then 3 else 4 end as priority from settled order by stock_code, prediction_date desc"))
def top_signals(spark, d):
    a = F.col("expected_alpha")
    s = ordered.first_per_key(settled(spark, d), ["stock_code"], [F.desc("prediction_date")])
    return s.select("stock_code", F.when(a > 0.005, "Super Buy").when(a > 0, "Buy").when(a < -0.005, "Super Sell").otherwise("Sell").alias("status"), F.when(a > 0.005, 1).when(a < -0.005, 2).when(a > 0, 3).otherwise(4).alias("priority"))


@R.add(sql("news", "select stock_code, doc_id, title from (select *, row_number() over (partition by stock_code order by published_at desc, doc_id) as k from news where title ilike '%the%' or content ilike '%zu und%') where k <= 5"))
def grounding_search(spark, d):
    """Each stock's latest articles with a word in the title or a phrase in the content, by the trigram index of both."""
    n, index = news(spark, d), pipelines.folder(spark, "trigrams")
    text_search.write_index(n, "doc_id", ["title", "content"], index)
    n = text_search.grounding(spark, n, "doc_id", index, {"title": "the", "content": "zu und"})
    return ordered.top_per_key(n, ["stock_code"], [F.desc("published_at"), F.col("doc_id")], 5).select("stock_code", "doc_id", "title")


@R.add("select c_custkey, c_name from customer where (c_name like '%7%' or cast(c_custkey as varchar) like '%12%') and c_acctbal between 100 and 5000 and c_nationkey in (1, 2, 3) and c_mktsegment is not null")
def stock_search(spark, d):
    c = table(spark, d, "customer")
    wanted = [F.contains("c_name", F.lit("7")) | F.contains(F.col("c_custkey").cast("string"), F.lit("12")), F.col("c_acctbal").between(100, 5000), F.col("c_nationkey").isin(1, 2, 3), F.col("c_mktsegment").isNotNull()]
    for w in wanted:  # optional predicates are added one by one
        c = c.filter(w)
    return c.select("c_custkey", "c_name")


@R.add("with w as (select user_id, max(ts) as last_seen, arg_max(event_type, ts) as status from events group by 1) select user_id, status, date_diff('second', last_seen, timestamp '2024-01-30 00:00:00') > 3600 as stale, coalesce(q.consumers, 0) as consumers, case when date_diff('second', last_seen, timestamp '2024-01-30 00:00:00') > 3600 and coalesce(q.consumers, 0) = 0 then 'zombie' when date_diff('second', last_seen, timestamp '2024-01-30 00:00:00') > 3600 then 'slow' else 'ok' end as health from w left join (select user_id, count(*) as consumers from events where event_type = 'signup' group by 1 having count(*) > 12) q using (user_id)")
def worker_health(spark, d):
    e = table(spark, d, "events")
    last = pipelines.latest_state(e, "user_id", "ts")
    q = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.count("*").alias("consumers")).filter("consumers > 12")
    silent = F.unix_timestamp(F.lit("2024-01-30 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("last_seen").cast("timestamp")) > 3600
    x = last.join(q, "user_id", "left").withColumn("consumers", F.coalesce("consumers", F.lit(0)))
    return x.select("user_id", "status", silent.alias("stale"), "consumers", F.when(silent & (F.col("consumers") == 0), "zombie").when(silent, "slow").otherwise("ok").alias("health"))


@R.add("select event_id, greatest(1, least(12, cast(floor(value) as bigint) % 20)) as val_months, case when event_type = 'click' then 'daily' else 'scan' end as kind, date_diff('day', least(cast(ts as date), date '2024-01-10'), greatest(cast(ts as date), date '2024-01-10')) as days, greatest(date_diff('day', greatest(cast(ts as date), date '2024-01-10'), date '2024-01-20'), 0) as back from events")
def job_parameters(spark, d):
    e = table(spark, d, "events")
    dt, pin = F.to_date("ts"), F.lit("2024-01-10").cast("date")
    return e.select("event_id", F.greatest(F.lit(1), F.least(F.lit(12), F.floor("value").cast("long") % 20)).alias("val_months"), F.when(F.col("event_type") == "click", "daily").otherwise("scan").alias("kind"), F.datediff(F.greatest(dt, pin), F.least(dt, pin)).cast("long").alias("days"), F.greatest(F.datediff(F.lit("2024-01-20").cast("date"), F.greatest(dt, pin)), F.lit(0)).cast("long").alias("back"))


@R.add("select user_id, cast(max(round(value)) as bigint) as progress, round(avg(value), 6) as mean from events group by 1")
def monotone_progress(spark, d):
    from ..operators import sinks

    e = table(spark, d, "events").select("user_id", "event_id", F.round("value").alias("progress"), "value")
    top = sinks.progress(e.filter("event_id % 2 = 0").select("user_id", "progress"), e.filter("event_id % 2 = 1").select("user_id", "progress"), "user_id")
    return top.join(e.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean")), "user_id").select("user_id", F.col("progress").cast("long").alias("progress"), "mean")


@R.add("select vec_id, label, round(list_sum(list_transform(embedding, lambda x: x * x)), 4) as norm2 from embeddings")
def embedding_norms(spark, d):
    n = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", "label", F.round(n, 4).alias("norm2"))


def centroid_ranking(vectors: DataFrame, key: str, pos: str, vec: str, dims: int, k: int) -> DataFrame:
    """Of each key's vectors the k nearest to their mean by cosine, in their own order: an extractive summary's sentences."""
    e = vectors.select(key, pos, *[F.col(vec)[i].cast("double").alias(f"e{i}") for i in range(dims)])
    mean = e.groupBy(key).agg(*[F.avg(f"e{i}").alias(f"m{i}") for i in range(dims)])
    dot = lambda a, b: sum((F.col(f"{a}{i}") * F.col(f"{b}{i}") for i in range(dims)), F.lit(0.0))
    sim = metrics.over(dot("e", "m"), F.sqrt(dot("e", "e")) * F.sqrt(dot("m", "m")))
    s = e.join(mean, key).select(key, pos, F.round(sim, 5).alias("similarity"))
    return ordered.top_per_key(s, [key], [F.desc("similarity"), F.col(pos)], k).drop("rnk")


@R.add("""with l as (select vec_id, label, unnest(range(1, 65)) as i, unnest(embedding)::double as x from embeddings), m as (select label, i, avg(x) as m from l group by 1, 2),
s as (select vec_id, label, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 5) as similarity from l join m using (label, i) group by 1, 2)
select label, vec_id, similarity from (select *, row_number() over (partition by label order by similarity desc, vec_id) as k from s) where k <= 3""")
def centroid_summary(spark, d):
    return centroid_ranking(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 64, 3)


def _lagged(spark, d, lags: int = 5) -> DataFrame:
    return models.lagged(price(spark, d), "stock_code", "date", "return_rate", lags)


@R.add()
def lasso_cd(spark, d):
    return models.lasso(_lagged(spark, d), "stock_code", "date", 1e-5)


@R.add()
def fista_lasso(spark, d):
    return models.lasso_fista(_lagged(spark, d), "stock_code", "date", 1e-5)


@R.add()
def lasso_cv(spark, d):
    return models.lasso_cv(_lagged(spark, d), "stock_code", "date")


@R.add()
def stability_selection(spark, d):
    return models.stable_features(_lagged(spark, d), "stock_code", "date", 1e-4)


@R.add()
def ridge_embeddings(spark, d):
    e = table(spark, d, "embeddings").select((F.col("label") % 5).cast("string").alias("stock_code"), "vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 2).cast("double").alias("y"))
    return models.ridge_fit(e, "stock_code", "vec_id")


@R.add()
def optimal_lag(spark, d):
    return models.optimal_lag(price(spark, d), "stock_code", "date", "return_rate")


@R.add()
def walk_forward(spark, d):
    p = price(spark, d)
    return models.walk_forward(_lagged(spark, d), ordered.walk_forward(ordered.calendar(p), 90, every=20), "stock_code", "date", 1e-5)


@R.add()
def grid_scan(spark, d):
    return models.grid_scan(_lagged(spark, d), "stock_code", "date", list(range(3, 13)), [1e-5, 5e-5, 1e-4, 5e-4])


@R.add()
def hybrid_blend(spark, d):
    s = settled(spark, d)
    return s.select("stock_code", day("prediction_date").alias("date"), (F.round(models.blend(F.col("expected_alpha"), F.col("intensity")), 9) + 0.0).alias("blended"))


R.oracle["hybrid_blend"] = sql("settled", "select stock_code, strftime(prediction_date, '%Y-%m-%d') as date, round(0.6 * expected_alpha + 0.4 * intensity, 9) + 0.0::double as blended from settled")


@R.add("select strftime(cast(ts as date), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_daily_counts(spark, d):
    s = pipelines.daily_counts(pipelines.arrivals(spark, f"{d}/events.parquet"), "ts", "event_type")
    out = pipelines.run(s, "complete", pipelines.folder(spark, "daily"), pipelines.folder(spark, "state"))
    return out.withColumn("total", F.round("total", 4))


@R.add("select distinct user_id, event_type from events")
def stream_dedup(spark, d):
    s = pipelines.first_seen(pipelines.arrivals(spark, f"{d}/events.parquet"), ["user_id", "event_type"])
    return pipelines.run(s, "append", pipelines.folder(spark, "seen"), pipelines.folder(spark, "state"))


@R.add("""with e as (select user_id, ts, lead(ts) over (partition by user_id order by ts) as nxt from events where user_id is not null and ts is not null),
x as (select user_id, ts + k * interval 36 hour as due from e, (select unnest(range(1, 100)) as k) where ts + k * interval 36 hour < coalesce(nxt, (select date_trunc('millisecond', max(ts)) from events))),
r as (select *, row_number() over (partition by user_id order by due) as k from x)
select user_id, strftime(due, '%Y-%m-%d %H:%M:%S') as at, case when k <= 2 then 'retry' else 'fail' end as action, least(k, 2) as retry_count from r where k <= 3""")
def stream_stale_jobs(spark, d):
    """Workers silent for more than 36 hours: two retries, then the third silence fails them. Every event is a heartbeat."""
    session = spark.newSession()  # the state's settings stay out of the caller's session
    session.conf.set("spark.sql.streaming.stateStore.providerClass", heartbeats.ROCKSDB)
    s = heartbeats.watched(pipelines.arrivals(session, f"{d}/events.parquet"), "user_id", "ts", 36 * 3600, most=2)
    out = pipelines.run(s, "append", pipelines.folder(spark, "stale"), pipelines.folder(spark, "state"))
    return out.select(F.col("job").alias("user_id"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "action", "retry_count")


@R.add("""select 'rows_total' as name, null::double as bound, count(*)::double as value from events
union all select 'errors_total', null, count(*) filter (event_type = 'error') from events
union all select 'event_value', b, count(*) filter (value <= b) from events, (select unnest([1.0, 10.0, 100.0, 1e6]) as b) group by b
union all select 'stream_rows_total', null, count(*) from events""")
def collection_metrics(spark, d):
    """What a batch plan and a stream over the events count on their way, as a table of metrics."""
    meter, to = meters.Meter(), pipelines.folder(spark, "metrics")
    e = table(spark, d, "events")
    meter.watch(e, "events", {"errors_total": F.col("event_type") == "error"}, {"event_value": (F.col("value"), (1.0, 10.0, 100.0, 1e6))}).write.format("noop").mode("overwrite").save()
    listener = meters.StreamMeter(meter)
    spark.streams.addListener(listener)
    try:
        pipelines.run(pipelines.daily_counts(pipelines.arrivals(spark, f"{d}/events.parquet"), "ts", "event_type"), "complete", pipelines.folder(spark, "daily"), pipelines.folder(spark, "state"))
        listener.settled()
    finally:
        spark.streams.removeListener(listener)
    meter.write(spark, to)
    return spark.read.schema(meters.SERIES).parquet(to).filter(F.col("name").isin("rows_total", "errors_total", "event_value", "stream_rows_total")).groupBy("name", "bound").agg(F.sum("value").alias("value"))


@R.add("""with j as (select user_id as job, arg_max(event_type, ts) as queue, max(ts) as last_seen from events group by 1), c as (select event_type as queue, count(*) filter (ts > timestamp '2024-01-30 23:00:00') as consumers, count(*) as ready from events group by 1)
select job, queue, 'zombie' as issue from j where last_seen < timestamp '2024-01-30 21:58:00' and queue not in (select queue from c where consumers > 5)
union all select null, queue, 'backlog' from c where ready > (select avg(ready) from c)""")
def stream_zombies_and_backlogs(spark, d):
    """Workers without a sign of life for two minutes on queues that nobody consumes, and queues with more waiting than usual."""
    e = pipelines.arrivals(spark, f"{d}/events.parquet")
    jobs = pipelines.run(e.groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.max_by("event_type", "ts").alias("queue")), "complete", pipelines.folder(spark, "jobs"), pipelines.folder(spark, "state"))
    late = F.count(F.when(F.col("ts") > F.lit("2024-01-30 23:00:00").cast("timestamp_ntz"), 1)).alias("late")
    queues = pipelines.run(e.groupBy(F.col("event_type").alias("queue")).agg(late, F.count("*").alias("ready")), "complete", pipelines.folder(spark, "queues"), pipelines.folder(spark, "state"))
    running = jobs.select(F.col("user_id").alias("job"), "queue", "last_seen")
    usual = queues.agg(F.avg("ready")).first()[0] or 0
    z = heartbeats.zombies(running, queues.select("queue", F.when(F.col("late") > 5, F.col("late")).otherwise(0).alias("consumers")), F.lit("2024-01-30 22:00:00"))
    return z.select("job", "queue", F.lit("zombie").alias("issue")).unionByName(heartbeats.backlog(queues, usual).select(F.lit(None).cast("long").alias("job"), "queue", F.lit("backlog").alias("issue")))


@R.add("select queue, count(*) as n, cast(sum(event_id) as bigint) as ids from (select event_id, case when event_type = 'error' then 'dead' when event_type = 'view' then 'light' else 'heavy' end as queue from events) group by 1")
def stream_routing_dlq(spark, d):
    q = pipelines.routed(pipelines.arrivals(spark, f"{d}/events.parquet"), F.col("event_type") != "error", F.col("event_type") == "view", pipelines.folder(spark, "routed"), pipelines.folder(spark, "state"))
    all_ = None
    for name, df in q.items():
        part = df.select(F.lit(name).alias("queue"), "event_id")
        all_ = part if all_ is None else all_.unionByName(part)
    return all_.groupBy("queue").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
