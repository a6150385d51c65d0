"""Joins, aggregates, windows, sorts and set operations over the reference-shaped views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import code, fundamentals, grid, news, predictions, price, sentiment_dict, settled, sql, table, word_days
from ..operators import metrics, ordered
from .registry import Registry

R = Registry()
day = lambda c: F.date_format(c, "yyyy-MM-dd")
SINCE, UNTIL, AS_OF = "1995-03-01", "1995-06-30", "1995-08-01"


@R.add(sql("news price", "select stock_code, count(*) as n, cast(sum(volume) as bigint) as volume from news join price using (stock_code) where cast(published_at as date) = date and published_at >= timestamp '1995-03-01' group by 1"))
def join_inner_news_price(spark, d):
    n = news(spark, d).filter(F.col("published_at") >= SINCE).select("stock_code", F.to_date("published_at").alias("date"))
    return n.join(price(spark, d).select("stock_code", "date", "volume"), ["stock_code", "date"]).groupBy("stock_code").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@R.add("select n_name, o_orderpriority, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2")
def join_three_way(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"))


@R.add(sql("news price", "select doc_id, strftime(date, '%Y-%m-%d') as date, excess_return from news join price on news.stock_code = price.stock_code and cast(published_at as date) = date"))
def join_composite_cast_key(spark, d):
    n = news(spark, d).select("doc_id", "stock_code", F.to_date("published_at").alias("date"))
    return n.join(price(spark, d), ["stock_code", "date"]).select("doc_id", day("date").alias("date"), "excess_return")


@R.add(sql("news price", "select news.stock_code, count(*) as n, count(*) filter (where excess_return > 0) as up_days, round(avg(excess_return), 6) as mean from news join price on news.stock_code = price.stock_code and cast(published_at as date) + 1 = date group by 1"))
def join_date_plus_lag(spark, d):
    n = news(spark, d).select("stock_code", F.date_add(F.to_date("published_at"), 1).alias("date"))
    return n.join(price(spark, d), ["stock_code", "date"]).groupBy("stock_code").agg(F.count("*").alias("n"), F.count_if(F.col("excess_return") > 0).alias("up_days"), F.round(F.avg("excess_return"), 6).alias("mean"))


@R.add(sql("pred price", "select pred.stock_code, strftime(prediction_date, '%Y-%m-%d') as date, expected_alpha, coalesce(round(return_rate - coalesce(excess_return, 0), 6), 0) as index_return, close_price is not null as priced from pred left join price on pred.stock_code = price.stock_code and prediction_date = date"))
def join_left_pred_price(spark, d):
    p = price(spark, d).withColumnRenamed("date", "prediction_date")
    return predictions(spark, d).join(p, ["stock_code", "prediction_date"], "left").select("stock_code", day("prediction_date").alias("date"), "expected_alpha", F.coalesce(F.round(F.col("return_rate") - F.coalesce("excess_return", F.lit(0)), 6), F.lit(0.0)).alias("index_return"), F.col("close_price").isNotNull().alias("priced"))


_IMPACT = "td as (select distinct date as td from price), imp as (select doc_id, news.stock_code, published_at, (select min(td) from td where td >= cast(published_at as date)) as impact from news)"


def with_views(names: str, more: str, body: str) -> str:
    return sql(names, "").rstrip() + ",\n" + more + "\n" + body


@R.add(with_views("news price", _IMPACT, "select doc_id, strftime(impact, '%Y-%m-%d') as impact_date from imp"))
def asof_forward_impact_date(spark, d):
    n = news(spark, d).select("doc_id", F.to_date("published_at").alias("date"))
    return ordered.impact_date(n, ordered.calendar(price(spark, d)), "date").select("doc_id", day("impact_date").alias("impact_date"))


@R.add(with_views("news price", _IMPACT + ", cal as (select td, lead(td, 2) over (order by td) as target from td)", "select strftime(target, '%Y-%m-%d') as date, count(*) as n from imp join cal on impact = td where target is not null group by 1"))
def join_trading_day_lag(spark, d):
    days = ordered.calendar(price(spark, d))
    n = ordered.impact_date(news(spark, d).select(F.to_date("published_at").alias("date")), days, "date")
    lag3 = days.select(F.col("td").alias("impact_date"), F.lead("td", 2).over(Window.orderBy("td")).alias("target")).filter("target is not null")
    return n.join(lag3, "impact_date").groupBy(day("target").alias("date")).agg(F.count("*").alias("n"))


_SPINE = "have as (select distinct stock_code, cast(published_at as date) as day from news), spine as (select stock_code, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from have group by 1), gaps as (select * from spine anti join have using (stock_code, day))"


@R.add(with_views("news", _SPINE, "select stock_code, strftime(day, '%Y-%m-%d') as day from gaps"))
def join_anti_missing_days(spark, d):
    n = news(spark, d).select("stock_code", F.to_date("published_at").alias("date"))
    return ordered.missing_days(n, "stock_code", "date").select("stock_code", day("day").alias("day"))


@R.add(with_views("news", _SPINE, """select stock_code, strftime(min(day), '%Y-%m-%d') as start, strftime(max(day), '%Y-%m-%d') as "end", count(*) as days
from (select *, day - cast(row_number() over (partition by stock_code order by day) as integer) as g from gaps) group by stock_code, g"""))
def date_islands(spark, d):
    n = news(spark, d).select("stock_code", F.to_date("published_at").alias("date"))
    return ordered.islands(ordered.missing_days(n, "stock_code", "date"), "stock_code").select("stock_code", day("start").alias("start"), day("end").alias("end"), "days")


@R.add(sql("dict", "select distinct word from dict where version = 'src0' and word not in (select word from dict where version = 'src1')"))
def join_not_in(spark, d):
    v = sentiment_dict(spark, d)
    return v.filter("version = 'src0'").select("word").distinct().join(v.filter("version = 'src1'").select("word"), "word", "left_anti")


@R.add(sql("dict", "select word, version, beta from dict where word in (select word from dict where version = 'src0') and n >= 5"))
def join_semi_in(spark, d):
    v = sentiment_dict(spark, d)
    return v.filter("n >= 5").join(v.filter("version = 'src0'").select("word"), "word", "left_semi").select("word", "version", "beta")


@R.add(sql("dict", "select dict.word, version, beta from dict join (select word, max(updated_at) as m from dict group by 1) x on dict.word = x.word and updated_at = m"))
def join_groupwise_max(spark, d):
    w = Window.partitionBy("word").orderBy(F.desc("updated_at"))
    return sentiment_dict(spark, d).withColumn("r", F.rank().over(w)).filter("r = 1").select("word", "version", "beta")


@R.add(sql("dict", "select word, version, beta from dict join (select word from dict group by 1 order by round(avg(abs(beta)), 6) desc, word limit 20) using (word)"))
def join_topn_then_history(spark, d):
    v = sentiment_dict(spark, d)
    top = v.groupBy("word").agg(F.round(F.avg(F.abs("beta")), 6).alias("m")).orderBy(F.desc("m"), "word").limit(20)  # the feature: the 20 strongest words
    return v.join(top.select("word"), "word").select("word", "version", "beta")


@R.add(sql("price fund", "select price.stock_code, strftime(date, '%Y-%m-%d') as date, strftime(base_date, '%Y-%m-%d') as base_date, per, market_cap from price asof left join fund on price.stock_code = fund.stock_code and date >= base_date"))
def asof_backward_fundamentals(spark, d):
    out = ordered.asof_backward(price(spark, d).select("stock_code", "date"), fundamentals(spark, d), "stock_code", "date", "base_date", ["per", "market_cap"])
    return out.select("stock_code", day("date").alias("date"), day("base_date").alias("base_date"), "per", "market_cap")


@R.add(with_views("news price", "cal as (select td, coalesce(lag(td) over (order by td), td - 7) as prev from (select distinct date as td from price))", "select doc_id, strftime(td, '%Y-%m-%d') as session from news join cal on published_at >= prev + interval 16 hour and published_at < td + interval 16 hour"))
def range_join_session_window(spark, d):
    days = ordered.calendar(price(spark, d))
    n = ordered.impact_date(news(spark, d).withColumn("date", ordered.session_date("published_at", "cutoff16")), days, "date")
    first = days.filter("pos = 1").select(F.col("td").alias("first_td"), F.col("prev_td").alias("first_prev"))
    n = n.crossJoin(F.broadcast(first)).filter(F.expr("cast(published_at as timestamp) >= cast(first_prev as timestamp) + interval 16 hours"))
    return n.join(days.select(F.col("td").alias("impact_date")), "impact_date", "left_semi").select("doc_id", day("impact_date").alias("session"))


@R.add(sql("price", "select price.stock_code, strftime(date, '%Y-%m-%d') as date, excess_return from price join (select stock_code, avg(excess_return) as mu, stddev_samp(excess_return) as sd from price group by 1 having count(*) > 200) s on price.stock_code = s.stock_code and abs(excess_return - mu) > 2 * sd"))
def theta_tail_events(spark, d):
    p = price(spark, d)
    s = p.groupBy("stock_code").agg(F.avg("excess_return").alias("mu"), F.stddev_samp("excess_return").alias("sd"), F.count("*").alias("k")).filter("k > 200")
    return p.join(s, "stock_code").filter(F.abs(F.col("excess_return") - F.col("mu")) > 2 * F.col("sd")).select("stock_code", day("date").alias("date"), "excess_return")


_HINT = "h as (select doc_id, stock_code, case when doc_id % 7 > 0 then published_at end as ts, cast(published_at as date) + 1 as hint from news)"


@R.add(with_views("news price", _HINT, "select doc_id, strftime(date, '%Y-%m-%d') as date from h join price on h.stock_code = price.stock_code and ((ts is not null and ((hour(ts) < 16 and cast(ts as date) = date) or (hour(ts) >= 16 and cast(ts as date) + 1 = date))) or (ts is null and hint = date))"))
def join_disjunctive_hint(spark, d):
    n = news(spark, d).select("doc_id", "stock_code", F.when(F.col("doc_id") % 7 > 0, F.col("published_at")).alias("ts"), F.date_add(F.to_date("published_at"), 1).alias("hint"))
    n = n.withColumn("date", F.coalesce(ordered.session_date("ts", "cutoff16"), "hint"))
    return n.join(price(spark, d), ["stock_code", "date"]).select("doc_id", day("date").alias("date"))


@R.add(sql("price", """select stock_code, max(case when k = 1 then volume end) as last_volume, round(avg(case when k <= 5 then volume end), 6) as volume_5,
round(stddev_samp(case when k <= 30 then return_rate end), 6) as sd_30, count(case when k <= 30 then 1 end) as n_30,
round(least(greatest(ln(1 + max(case when k = 1 then volume end) / avg(case when k <= 5 then volume end)) / ln(2), 0.5), 2.0), 6) as multiplier
from (select *, row_number() over (partition by stock_code order by date desc) as k from price) group by 1"""))
def scalar_subq_volume_stats(spark, d):
    p = price(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("stock_code").orderBy(F.desc("date")))).filter("k <= 30")
    five = F.avg(F.when(F.col("k") <= 5, F.col("volume")))
    last = F.max(F.when(F.col("k") == 1, F.col("volume")))
    return p.groupBy("stock_code").agg(last.alias("last_volume"), F.round(five, 6).alias("volume_5"), F.round(F.stddev_samp("return_rate"), 6).alias("sd_30"), F.count("*").alias("n_30"), F.round(F.least(F.greatest(F.log1p(last / five) / F.log1p(F.lit(1.0)), F.lit(0.5)), F.lit(2.0)), 6).alias("multiplier"))


@R.add(sql("news", "select strftime(day, '%Y-%m-%d') as day, n, string_agg(title, '|' order by k) as headlines from (select cast(published_at as date) as day, title, count(*) over (partition by cast(published_at as date)) as n, row_number() over (partition by cast(published_at as date) order by length(content) desc, doc_id) as k from news) where k <= 3 group by day, n"))
def corr_subq_top3_headlines(spark, d):
    n = news(spark, d).select("doc_id", F.to_date("published_at").alias("day"), "title", F.length("content").alias("len"))
    w = Window.partitionBy("day").orderBy(F.desc("len"), "doc_id")
    top = n.withColumn("k", F.row_number().over(w)).filter("k <= 3").groupBy("day").agg(F.array_sort(F.collect_list(F.struct("k", "title"))).alias("t"))
    return top.join(n.groupBy("day").agg(F.count("*").alias("n")), "day").select(day("day").alias("day"), "n", F.array_join(F.transform("t", lambda x: x.title), "|").alias("headlines"))


@R.add(sql("word_days dict", "select doc_id, count(*) as words, round(sum(coalesce(beta, 0)), 6) as score from word_days left join (select word, beta from dict where version = 'src0') using (word) group by 1"))
def dict_lookup_score(spark, d):
    v = sentiment_dict(spark, d).filter("version = 'src0'").select("word", "beta")
    return word_days(spark, d).join(v, "word", "left").groupBy("doc_id").agg(F.count("*").alias("words"), F.round(F.sum(F.coalesce("beta", F.lit(0.0))), 6).alias("score"))


@R.add(sql("dict", "select word, round(sum(beta), 6) as beta, count(*) as parts from dict where version in ('src0', 'src1') group by 1"))
def dict_merge_main_buffer(spark, d):
    v = sentiment_dict(spark, d)
    return v.filter("version = 'src0'").unionByName(v.filter("version = 'src1'")).groupBy("word").agg(F.round(F.sum("beta"), 6).alias("beta"), F.count("*").alias("parts"))


@R.add(sql("pred settled", "select stock_code, strftime(prediction_date, '%Y-%m-%d') as date, src, alpha from (select *, row_number() over (partition by stock_code, prediction_date order by pri) as k, dense_rank() over (partition by stock_code order by prediction_date desc) as dd from (select stock_code, prediction_date, 'production' as src, expected_alpha as alpha, 0 as pri from pred where n > 1 union all select stock_code, prediction_date, 'verification', actual_alpha, 1 from settled)) where k = 1 and dd <= 60"))
def precedence_merge(spark, d):
    a = predictions(spark, d).filter("n > 1").select("stock_code", "prediction_date", F.lit("production").alias("src"), F.col("expected_alpha").alias("alpha"), F.lit(0).alias("pri"))
    b = settled(spark, d).select("stock_code", "prediction_date", F.lit("verification").alias("src"), F.col("actual_alpha").alias("alpha"), F.lit(1).alias("pri"))
    one = ordered.first_per_key(a.unionByName(b), ["stock_code", "prediction_date"], [F.col("pri")])
    return ordered.top_per_key(one, ["stock_code"], [F.desc("prediction_date")], 60).select("stock_code", day("prediction_date").alias("date"), "src", "alpha")


@R.add(sql("grid", "select a.wi, a.ai, count(*) as cells, round(0.6 * avg(b.hit_rate) + 0.4 * (1 - least(avg(b.mae) / 0.1, 1)) - stddev_pop(b.hit_rate), 6) as stability from grid a join grid b on abs(a.wi - b.wi) + abs(a.ai - b.ai) <= 1 group by 1, 2"))
def grid_neighbour_stability(spark, d):
    return metrics.neighbourhood(grid(spark, d)).withColumn("stability", F.round("stability", 6))


@R.add(sql("grid", "select wi, ai, round(s, 6) as stability from (select a.wi, a.ai, 0.6 * avg(b.hit_rate) + 0.4 * (1 - least(avg(b.mae) / 0.1, 1)) - stddev_pop(b.hit_rate) as s from grid a join grid b on abs(a.wi - b.wi) + abs(a.ai - b.ai) <= 1 group by 1, 2) order by round(s, 9) desc, wi, ai limit 1"))
def grid_best_cell(spark, d):
    return metrics.best_cell(metrics.neighbourhood(grid(spark, d))).select("wi", "ai", F.round("stability", 6).alias("stability"))


@R.add("select event_type as status, user_id % 4 as worker, count(*) as n, round(avg(abs(value)), 6) as magnitude from events group by 1, 2")
def agg_status_counts(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("status"), (F.col("user_id") % 4).alias("worker")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs("value")), 6).alias("magnitude"))


@R.add(sql("settled", "select count(*) as n, count(distinct stock_code) as stocks, round(avg(case when sign(expected_alpha) = sign(actual_alpha) and actual_alpha <> 0 then 1.0 else 0.0 end), 6) as hit_rate, round(avg(abs(expected_alpha - actual_alpha)), 6) as mae, strftime(min(prediction_date), '%Y-%m-%d') as first_day, strftime(max(prediction_date), '%Y-%m-%d') as last_day from settled"))
def agg_global_summary(spark, d):
    return settled(spark, d).agg(F.count("*").alias("n"), F.countDistinct("stock_code").alias("stocks"), F.round(F.avg(metrics.same_sign("expected_alpha", "actual_alpha").cast("double")), 6).alias("hit_rate"), F.round(F.avg(F.abs(F.col("expected_alpha") - F.col("actual_alpha"))), 6).alias("mae"), day(F.min("prediction_date")).alias("first_day"), day(F.max("prediction_date")).alias("last_day"))


@R.add(sql("news price", "select news.stock_code, count(distinct cast(published_at as date)) as news_days, (select count(distinct date) from price) as trading_days from news group by 1"))
def agg_distinct_days(spark, d):
    t = price(spark, d).select("date").distinct().agg(F.count("*").alias("trading_days"))
    return news(spark, d).groupBy("stock_code").agg(F.countDistinct(F.to_date("published_at")).alias("news_days")).crossJoin(F.broadcast(t))


@R.add(sql("price", "select stock_code, strftime(min(date), '%Y-%m-%d') as lo, strftime(max(date), '%Y-%m-%d') as hi, max(date) - min(date) as span, count(*) >= 0.5 * (max(date) - min(date) - 10) as enough from price group by 1"))
def agg_minmax_span(spark, d):
    span = F.datediff(F.max("date"), F.min("date"))
    return price(spark, d).groupBy("stock_code").agg(day(F.min("date")).alias("lo"), day(F.max("date")).alias("hi"), span.cast("long").alias("span"), (F.count("*") >= 0.5 * (span - 10)).alias("enough"))


@R.add(sql("price", "select stock_code, count(*) filter (where excess_return > 0) as pos, count(*) filter (where excess_return < 0) as neg, round(sum(case when excess_return > 0 then excess_return else 0 end), 6) as gains from price group by 1"))
def agg_conditional(spark, d):
    up = F.when(F.col("excess_return") > 0, F.col("excess_return")).otherwise(0.0)
    return price(spark, d).groupBy("stock_code").agg(F.count_if(F.col("excess_return") > 0).alias("pos"), F.count_if(F.col("excess_return") < 0).alias("neg"), F.round(F.sum(up), 6).alias("gains"))


@R.add(sql("price", "select stock_code, round(avg(excess_return), 6) as mu, round(stddev_samp(excess_return), 6) as sigma, count(*) as n from price group by 1 having count(*) > 200"))
def agg_stddev_having(spark, d):
    return price(spark, d).groupBy("stock_code").agg(F.round(F.avg("excess_return"), 6).alias("mu"), F.round(F.stddev_samp("excess_return"), 6).alias("sigma"), F.count("*").alias("n")).filter("n > 200")


@R.add(sql("news", "select stock_code, string_agg(strftime(day, '%Y-%m-%d') || ':' || n, ',' order by day) as sparkline from (select stock_code, cast(published_at as date) as day, count(*) as n from news where published_at >= timestamp '1995-03-01' group by 1, 2) group by 1"))
def agg_ordered_collect(spark, d):
    c = news(spark, d).filter(F.col("published_at") >= SINCE).groupBy("stock_code", F.to_date("published_at").alias("day")).agg(F.count("*").alias("n"))
    return c.groupBy("stock_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda x: F.concat(day(x.day), F.lit(":"), x.n.cast("string"))), ",").alias("sparkline"))


@R.add(with_views("news price words_all", _IMPACT, "select strftime(impact, '%Y-%m-%d') as day, count(*) as tokens, count(distinct word) as words from words_all join imp using (doc_id) group by 1"))
def agg_token_flatten(spark, d):
    from ..fixtures import tokens

    n = ordered.impact_date(news(spark, d).withColumn("date", F.to_date("published_at")), ordered.calendar(price(spark, d)), "date")
    return n.select("impact_date", F.explode(tokens(F.col("content"))).alias("word")).groupBy(day("impact_date").alias("day")).agg(F.count("*").alias("tokens"), F.countDistinct("word").alias("words"))


@R.add(sql("word_days price", "select word, round(avg(abs(excess_return)), 12) as volatility, count(*) as n from word_days join price on word_days.stock_code = price.stock_code and cast(published_at as date) = date group by 1 having count(*) >= 5"))
def agg_token_volatility(spark, d):
    w = word_days(spark, d).withColumn("date", F.to_date("published_at"))
    return w.join(price(spark, d), ["stock_code", "date"]).groupBy("word").agg(F.round(F.avg(F.abs("excess_return")), 12).alias("volatility"), F.count("*").alias("n")).filter("n >= 5")


@R.add(sql("word_days", "select word, count(distinct stock_code) as owners from word_days group by 1 having count(distinct stock_code) < 5 and count(*) > 1"))
def agg_owner_count(spark, d):
    return word_days(spark, d).groupBy("word").agg(F.countDistinct("stock_code").alias("owners"), F.count("*").alias("k")).filter("owners < 5 and k > 1").select("word", "owners")


@R.add("select user_id, count(*) as jobs, round(avg(case when event_type = 'purchase' then 1.0 else 0.0 end), 6) as hit_rate from events group by 1")
def agg_hit_rate_per_job(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("jobs"), F.round(F.avg((F.col("event_type") == "purchase").cast("double")), 6).alias("hit_rate"))


@R.add("select round(100.0 * count(*) filter (where event_type = 'purchase') / count(*), 4) as success_rate, count(*) as total from events where ts >= timestamp '2024-01-15' and ts < timestamp '2024-01-16'")
def agg_success_rate_24h(spark, d):
    e = table(spark, d, "events").filter((F.col("ts") >= "2024-01-15") & (F.col("ts") < "2024-01-16"))
    return e.agg(F.round(F.coalesce(F.try_divide(100.0 * F.count_if(F.col("event_type") == "purchase"), F.count("*")), F.lit(100.0)), 4).alias("success_rate"), F.count("*").alias("total"))


@R.add("select count(*) filter (where event_type = 'error') > 0 as any_error, (select count(*) from documents) as documents, (select count(*) from pages) as pages, (select count(*) from orders) as orders from events")
def agg_existence_and_totals(spark, d):
    one = lambda t: table(spark, d, t).agg(F.count("*").alias(t))
    e = table(spark, d, "events").agg((F.count_if(F.col("event_type") == "error") > 0).alias("any_error"))
    return e.crossJoin(one("documents")).crossJoin(one("pages")).crossJoin(one("orders"))


@R.add(sql("news", "select strftime(cast(published_at as date), '%Y-%m-%d') as day, " + ", ".join(f"count(*) filter (where stock_code = '{k:06d}') as s{k}" for k in range(25)) + " from news group by 1"))
def pivot_distribution(spark, d):
    n = news(spark, d).groupBy(day("published_at").alias("day")).pivot("stock_code", [f"{k:06d}" for k in range(25)]).count().fillna(0)
    return n.withColumnsRenamed({f"{k:06d}": f"s{k}" for k in range(25)})


@R.add(sql("dict", "select word, round(sum(beta), 6) as total, count(*) as n, round(max(abs(beta)), 6) as peak from dict where not regexp_matches(word, '^[0-9]+$') group by 1 having count(*) >= 2"))
def driver_words(spark, d):
    v = sentiment_dict(spark, d).filter(~F.col("word").rlike("^[0-9]+$"))
    return v.groupBy("word").agg(F.round(F.sum("beta"), 6).alias("total"), F.count("*").alias("n"), F.round(F.abs(F.max_by("beta", F.abs("beta"))), 6).alias("peak")).filter("n >= 2")


_FEATURES = "f as (select word || case when right(version, 1) in ('1', '2', '3') then '_L' || right(version, 1) else '' end as feature, beta from dict)"


@R.add(with_views("dict", _FEATURES, "select base, string_agg(lag || ':' || cast(round(beta * 1e6) as bigint), ',' order by lag, beta) as profile, count(*) as n from (select case when regexp_matches(feature, '_L[0-9]+$') then regexp_replace(feature, '_L[0-9]+$', '') else feature end as base, case when regexp_matches(feature, '_L[0-9]+$') then cast(regexp_extract(feature, '_L([0-9]+)$', 1) as int) else 1 end as lag, beta from f) group by 1 having count(*) > 1"))
def lag_profile(spark, d):
    from ..functions.expr import base_and_lag

    v = sentiment_dict(spark, d)
    suffix = F.when(F.substring("version", -1, 1).isin("1", "2", "3"), F.concat(F.lit("_L"), F.substring("version", -1, 1))).otherwise("")
    base, lag = base_and_lag(F.col("feature"))
    f = v.select(F.concat("word", suffix).alias("feature"), "beta").select(base.alias("base"), lag.alias("lag"), "beta")
    text = F.transform(F.array_sort(F.collect_list(F.struct("lag", "beta"))), lambda x: F.concat(x.lag.cast("string"), F.lit(":"), F.round(x.beta * 1e6).cast("long").cast("string")))
    return f.groupBy("base").agg(F.array_join(text, ",").alias("profile"), F.count("*").alias("n")).filter("n > 1")


@R.add(sql("settled", "select distinct on (stock_code) stock_code, strftime(prediction_date, '%Y-%m-%d') as date, expected_alpha, actual_alpha from settled order by stock_code, prediction_date desc"))
def distinct_on_latest(spark, d):
    return ordered.first_per_key(settled(spark, d), ["stock_code"], [F.desc("prediction_date")]).select("stock_code", day("prediction_date").alias("date"), "expected_alpha", "actual_alpha")


@R.add(sql("settled", "select distinct on (prediction_date) strftime(prediction_date, '%Y-%m-%d') as date, stock_code, expected_alpha from settled where isodow(prediction_date) < 6 order by prediction_date, abs(expected_alpha) desc, stock_code"))
def distinct_on_strongest_per_day(spark, d):
    return ordered.first_per_key(settled(spark, d), ["prediction_date"], [F.desc(F.abs("expected_alpha")), F.col("stock_code")]).select(day("prediction_date").alias("date"), "stock_code", "expected_alpha")


@R.add(sql("dict", "select distinct on (word) word, version, beta from dict order by word, updated_at desc, version desc"))
def distinct_on_latest_version(spark, d):
    return ordered.first_per_key(sentiment_dict(spark, d), ["word"], [F.desc("updated_at"), F.desc("version")]).select("word", "version", "beta")


@R.add(sql("price", "select stock_code, strftime(date, '%Y-%m-%d') as date, coalesce(lag(close_price) over (partition by stock_code order by date), 0) as known from price"))
def lag_zero_fill(spark, d):
    return price(spark, d).select("stock_code", day("date").alias("date"), ordered.lag_or_zero("close_price", "stock_code", "date").alias("known"))


@R.add(sql("price fund", "select stock_code, strftime(date, '%Y-%m-%d') as date, coalesce(last_value(per ignore nulls) over (partition by stock_code order by date rows between unbounded preceding and current row), 0) as per, round(ln(greatest(coalesce(last_value(market_cap ignore nulls) over (partition by stock_code order by date rows between unbounded preceding and current row), 0), 1)), 6) as log_cap from (select price.stock_code, date, per, market_cap from price left join fund on price.stock_code = fund.stock_code and date = base_date)"))
def forward_fill(spark, d):
    f = fundamentals(spark, d).select("stock_code", F.col("base_date").alias("date"), "per", "market_cap")
    p = price(spark, d).select("stock_code", "date").join(f, ["stock_code", "date"], "left")
    fill = lambda c: ordered.forward_fill(c, "stock_code", "date")
    return p.select("stock_code", day("date").alias("date"), fill("per").alias("per"), F.round(F.log(F.greatest(fill("market_cap"), F.lit(1.0))), 6).alias("log_cap"))


@R.add(sql("price", "select stock_code, strftime(date, '%Y-%m-%d') as date, round(close_price / lag(close_price, 5) over (partition by stock_code order by date) - 1, 6) as five_day from price"))
def period_return(spark, d):
    w = Window.partitionBy("stock_code").orderBy("date")
    return price(spark, d).select("stock_code", day("date").alias("date"), F.round(F.col("close_price") / F.lag("close_price", 5).over(w) - 1, 6).alias("five_day"))


@R.add(sql("price", "select stock_code, strftime(date, '%Y-%m-%d') as date, nxt as actual_alpha from (select *, lead(excess_return) over (partition by stock_code order by date) as nxt from price) where nxt is not null"))
def next_row_alpha(spark, d):
    w = Window.partitionBy("stock_code").orderBy("date")
    return price(spark, d).withColumn("actual_alpha", F.lead("excess_return").over(w)).filter("actual_alpha is not null").select("stock_code", day("date").alias("date"), "actual_alpha")


@R.add("""with w as (select distinct cast(date_trunc('week', o_orderdate) as date) as monday from orders)
select strftime(monday + k, '%Y-%m-%d') as day, isoyear(monday + k) || '-W' || lpad(cast(weekofyear(monday + k) as varchar), 2, '0') as week, dayname(monday + k) as name from w, (select unnest([0, 1, 2, 3, 4]) as k)""")
def week_spine(spark, d):
    w = table(spark, d, "orders").select(F.to_date(F.date_trunc("week", "o_orderdate")).alias("monday")).distinct()
    days = w.select(F.explode(F.sequence("monday", F.date_add("monday", 4))).alias("d"))
    label = F.concat(F.expr("extract(yearofweek from d)").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("d").cast("string"), 2, "0"))
    return days.select(day("d").alias("day"), label.alias("week"), F.date_format("d", "EEEE").alias("name"))


@R.add(sql("price", "select stock_code, strftime(date, '%Y-%m-%d') as date, k <= floor(n * 0.8) as train, cast(ceil(k / 5.0) as bigint) as batch from (select *, row_number() over (partition by stock_code order by date) as k, count(*) over (partition by stock_code) as n from price)"))
def holdout_split(spark, d):
    w = Window.partitionBy("stock_code")
    p = price(spark, d).withColumns({"k": F.row_number().over(w.orderBy("date")), "n": F.count("*").over(w)})
    return p.select("stock_code", day("date").alias("date"), (F.col("k") <= F.floor(F.col("n") * 0.8)).alias("train"), F.ceil(F.col("k") / 5.0).cast("long").alias("batch"))


@R.add(with_views("price", "td as (select date as td, row_number() over (order by date) as pos from (select distinct date from price))", "select pos, strftime(td, '%Y-%m-%d') as test_date, strftime(td - 91, '%Y-%m-%d') as train_start, strftime(td - 1, '%Y-%m-%d') as train_end, strftime(td - 7, '%Y-%m-%d') as buffer_start, (pos - 1) % 5 = 0 as retrain, (pos - 1) // 5 * 5 + 1 as model_pos from td"))
def walkforward_folds(spark, d):
    f = ordered.walk_forward(ordered.calendar(price(spark, d)), 90)
    return f.select(F.col("pos").cast("long").alias("pos"), *[day(c).alias(c) for c in ("test_date", "train_start", "train_end", "buffer_start")], "retrain", F.col("model_pos").cast("long").alias("model_pos"))


@R.add(sql("grid", "select wi, ai, hit_rate, row_number() over (order by case when hit_rate < 0.9 then hit_rate end desc nulls last, wi, ai) as pos from grid"))
def sort_nulls_last_topk(spark, d):
    w = Window.orderBy(F.when(F.col("hit_rate") < 0.9, F.col("hit_rate")).desc_nulls_last(), "wi", "ai")  # 40 cells
    return grid(spark, d).select("wi", "ai", "hit_rate", F.row_number().over(w).cast("long").alias("pos"))


@R.add(sql("dict", "select word, beta from dict where version = 'src2' order by abs(beta) desc, word limit 25"))
def sort_abs(spark, d):
    return sentiment_dict(spark, d).filter("version = 'src2'").orderBy(F.desc(F.abs("beta")), "word").limit(25).select("word", "beta")


@R.add("select o_orderkey, o_orderpriority from orders order by o_orderkey limit 20 offset 40")
def paginate(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority").orderBy("o_orderkey").offset(40).limit(20)


@R.add(sql("dict", "select version, side, k, word, beta from (select version, word, beta, case when beta > 0 then 'positive' else 'negative' end as side, row_number() over (partition by version, beta > 0 order by abs(beta) desc, word) as k from dict where beta <> 0) where k <= 3"))
def topk_contributions(spark, d):
    v = sentiment_dict(spark, d).filter("beta <> 0").withColumn("side", F.when(F.col("beta") > 0, "positive").otherwise("negative"))
    return ordered.top_per_key(v, ["version", "side"], [F.desc(F.abs("beta")), F.col("word")], 3, "k").select("version", "side", F.col("k").cast("long").alias("k"), "word", "beta")


@R.add("select event_id, event_type from events order by coalesce(case event_type when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 end, 99), event_id limit 5")
def priority_sort(spark, d):
    rank = F.create_map(*[F.lit(x) for p in (("error", 1), ("purchase", 2), ("signup", 3)) for x in p])
    return table(spark, d, "events").orderBy(F.coalesce(rank[F.col("event_type")], F.lit(99)), "event_id").limit(5).select("event_id", "event_type")


@R.add(sql("dict", "select 'vanguard' as kind, word from dict where version = 'src3' and word not in (select word from dict where version = 'src4') union all select 'derelict', word from dict where version = 'src4' and word not in (select word from dict where version = 'src3')"))
def union_tagged_vanguard_derelict(spark, d):
    v = sentiment_dict(spark, d).select("word", "version")
    new, old = v.filter("version = 'src3'").select("word"), v.filter("version = 'src4'").select("word")
    return new.join(old, "word", "left_anti").select(F.lit("vanguard").alias("kind"), "word").unionByName(old.join(new, "word", "left_anti").select(F.lit("derelict").alias("kind"), "word"))


@R.add(sql("news price", "select strftime(d, '%Y-%m-%d') as day from (select distinct cast(published_at as date) as d from news except select date from price)"))
def set_difference_days(spark, d):
    return news(spark, d).select(F.to_date("published_at").alias("d")).subtract(price(spark, d).select(F.col("date").alias("d"))).select(day("d").alias("day"))


@R.add("select distinct lang, source from documents union select distinct 'xx', source from documents")
def distinct_rows(spark, d):
    x = table(spark, d, "documents").select("lang", "source")
    return x.union(x.select(F.lit("xx"), "source")).distinct()


@R.add("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem where l_shipdate <= timestamp '2000-09-02' group by 1, 2")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
