"""Sources, aliases, versions, jobs and whole training and scoring runs."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import fundamentals, grid, news, predictions, price, sentiment_dict, settled, sql, table, tokens, word_days
from ..functions import expr
from ..operators import features, lifecycle, metrics, models, ordered, scoring, sinks
from ..sources import site, tables
from ..streaming import pipelines
from .registry import Registry
from .relational import day, with_views

R = Registry()


@R.add(sql("price", "select stock_code, strftime(date, '%Y-%m-%d') as date, close_price from price where date > date '1998-06-10' - 5 and date <= date '1998-06-10'"))
def source_price_lookback(spark, d):
    return tables.lookback(price(spark, d), "date", F.lit("1998-06-10").cast("date"), 5).select("stock_code", day("date").alias("date"), "close_price")


@R.add()
def source_index_change(spark, d):
    p = price(spark, d)
    i = p.select("date", F.round(F.col("return_rate") - F.col("excess_return"), 8).alias("c")).filter(F.dayofmonth("date") % 2 == 0).groupBy("date").agg(F.max("c").alias("change"))
    return tables.with_index_change(p.select("stock_code", "date"), i).select("stock_code", day("date").alias("date"), "change")


R.oracle["source_index_change"] = sql("price", "select stock_code, strftime(price.date, '%Y-%m-%d') as date, coalesce(change, 0) as change from price left join (select date, max(round(return_rate - excess_return, 8)) as change from price where day(date) % 2 = 0 group by 1) i on price.date = i.date")


@R.add(sql("price", "select stock_code, strftime(p.date, '%Y-%m-%d') as date, round(coalesce(r, 0), 6) as sector_return from (select distinct stock_code, cast(stock_code as int) % 5 as sector from price) m join (select sector, date, c / lag(c) over (partition by sector order by date) - 1 as r from (select cast(stock_code as int) % 5 as sector, date, max(close_price) as c from price group by 1, 2)) p using (sector)"))
def source_sector_return(spark, d):
    p = price(spark, d).withColumn("sector", F.col("stock_code").cast("int") % 5)
    out = tables.sector_return(p.select("stock_code", "sector").distinct(), p.groupBy("sector", "date").agg(F.max("close_price").alias("close")))
    return out.select("stock_code", day("date").alias("date"), F.round("sector_return", 6).alias("sector_return"))


@R.add("select event_id, case when isodow(ts) < 6 and hour(ts) * 60 + minute(ts) between 540 and 929 then 'OPEN' else 'CLOSED' end as status from events")
def source_market_status(spark, d):
    return table(spark, d, "events").select("event_id", tables.market_status(F.col("ts"), F.weekday("ts") < 5).alias("status"))


@R.add("select lang as query, doc_id, cast(ceil(k / 10.0) as int) as page from (select lang, doc_id, row_number() over (partition by lang order by n_chars desc, doc_id) as k from documents) where k <= 100")
def source_paged_search(spark, d):
    hits = table(spark, d, "documents").select(F.col("lang").alias("query"), "doc_id", "n_chars")
    return tables.search_pages(hits, [F.desc("n_chars"), F.col("doc_id")]).select("query", "doc_id", "page")


@R.add(sql("news", "select stock_code as query, cast(ceil(k / 10.0) as int) as page, cast((k - 1) % 10 + 1 as int) as rank, 'https://news.example/' || doc_id as url from (select stock_code, doc_id, row_number() over (partition by stock_code order by published_at desc, doc_id) as k from news) where k <= 100"))
def source_listing(spark, d):
    """The links on each stock's listing pages, ten a page, latest first, ten pages at most; the pages are made from the articles."""
    k = F.row_number().over(Window.partitionBy("stock_code").orderBy(F.desc("published_at"), "doc_id"))
    n = news(spark, d).select("stock_code", "doc_id", k.alias("k")).withColumn("page", F.ceil(F.col("k") / 10).cast("int"))
    link = F.concat(F.lit('<li><a class="news" href="https://news.example/'), F.col("doc_id").cast("string"), F.lit('">'), F.col("doc_id").cast("string"), F.lit("</a></li>"))
    pages = n.groupBy(F.col("stock_code").alias("query"), "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", link.alias("a")))), lambda x: x.a), "\n").alias("html"))
    root = pipelines.folder(spark, "listing")
    pages.write.partitionBy("query", "page").text(root)
    site.register(spark)
    stocks = [r[0] for r in pages.select("query").distinct().sort("query").collect()]  # the request's queries
    return spark.read.format("paged_listing").option("path", root).option("queries", json.dumps(stocks)).load()


@R.add("select event_type as queue, count(*) as n, min(event_id) as first, max(event_id) as last from events group by 1")
def source_queue(spark, d):
    """Events as messages in a segment a day, consumed as a stream into their queues."""
    e = table(spark, d, "events").select((F.datediff("ts", F.lit("2024-01-01")) + 1).alias("segment"), F.to_json(F.struct("event_id", "event_type")).alias("body"))
    root = pipelines.folder(spark, "queue")
    e.repartition("segment").write.partitionBy("segment").text(root)
    site.register(spark)
    messages = spark.readStream.format("message_queue").option("path", root).load()
    read = F.from_json("body", "event_id long, event_type string")
    out = pipelines.run(messages.select(read.alias("m")).select("m.*"), "append", pipelines.folder(spark, "consumed"), pipelines.folder(spark, "state"))
    return out.groupBy(F.col("event_type").alias("queue")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@R.add("select page_id, substring(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')), 1, 5000) as body from pages where regexp_matches(url, 'blog|news|shop')")
def source_disclosures(spark, d):
    return tables.disclosures(table(spark, d, "pages"), "url", "html", ["blog", "news", "shop"]).select("page_id", "body")


@R.add("select doc_id, lang from documents where lang in ('en', 'de') and doc_id not in (select doc_id from documents where doc_id % 3 = 0)")
def bulk_delete_and_select(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang").filter(F.col("lang").isin("en", "de"))
    return sinks.remove(x, x.filter("doc_id % 3 = 0"), ["doc_id"])[0]


@R.add(sql("news", "select doc_id, strftime(coalesce(case when doc_id % 4 > 0 then cast(published_at as date) end, cast(published_at as date)), '%Y-%m-%d') as hint from news"))
def update_from_join(spark, d):
    n = news(spark, d)
    url = n.select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.to_date("published_at")).alias("hint"))
    return url.join(n.select("doc_id", F.to_date("published_at").alias("content_date")), "doc_id", "left").select("doc_id", day(F.coalesce("hint", "content_date")).alias("hint"))


@R.add("select user_id, round(avg(least(value, 100)), 2) as progress, bool_and(value >= 100) as completed from events group by 1")
def job_progress(spark, d):
    return lifecycle.job_progress(table(spark, d, "events").select("user_id", F.least("value", F.lit(100.0)).alias("progress")), "user_id")


@R.add("select event_id, case when event_type = 'click' and k < 3 and date_diff('second', ts, timestamp '2024-01-20 00:00:00') > 3600 then 'pending' when event_type = 'click' and date_diff('second', ts, timestamp '2024-01-20 00:00:00') > 3600 then 'failed' when event_type = 'click' then 'running' else event_type end as status from (select *, user_id % 5 as k from events)")
def job_recovery(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", "running").otherwise(F.col("event_type")).alias("status"), F.col("ts").alias("updated_at"), (F.col("user_id") % 5).cast("int").alias("retry_count"))
    return lifecycle.recover(e, F.lit("2024-01-20 00:00:00")).select("event_id", "status")


@R.add("select event_id, task, o as \"offset\", days from (select event_id, 'recent' as task, 0 as o, n // 2 as days from (select event_id, event_id % 30 as n from events) union all select event_id, 'historical', n // 2, n - n // 2 from (select event_id, event_id % 30 as n from events)) where days > 0")
def job_backfill_split(spark, d):
    return lifecycle.split_backfill(table(spark, d, "events").select("event_id", (F.col("event_id") % 30).alias("n")), "n")


@R.add("select event_id, user_id not in (select user_id from events where event_type = 'error' and event_id % 50 = 0) as may_start from events where event_type = 'signup'")
def job_mutual_exclusion(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("stock_code"), F.lit("heavy").alias("category"), "event_type")
    running = e.filter("event_type = 'error' and event_id % 50 = 0").withColumn("status", F.lit("running"))
    return lifecycle.exclusive_start(running, e.filter("event_type = 'signup'")).select("event_id", "may_start")


@R.add("select event_id, case when user_id % 2 = 0 and event_type <> 'view' then 'pending' else event_type end as status, case when event_type = 'click' and user_id % 3 = 0 then 'active' else event_type end as target from events")
def job_restart_and_activate(spark, d):
    e = table(spark, d, "events")
    jobs = e.select("event_id", F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type")).alias("status"), F.lit(0.0).alias("progress"), F.lit(0).alias("retry_count"), "user_id")
    r = lifecycle.restart(jobs, F.col("user_id") % 2 == 0).select("event_id", F.when(F.col("status") == "running", "view").otherwise(F.col("status")).alias("status"))
    t = lifecycle.activate_requested(e.select("event_id", F.when(F.col("event_type") == "click", "paused").otherwise(F.col("event_type")).alias("status"), (F.col("user_id") % 3 == 0).alias("auto_activate_daily")))
    return r.join(t.select("event_id", F.when(F.col("status") == "paused", "click").otherwise(F.col("status")).alias("target")), "event_id")


@R.add(with_views("grid", "s as (select a.wi, a.ai, 0.6 * avg(b.hit_rate) + 0.4 * (1 - least(avg(b.mae) / 0.1, 1)) - stddev_pop(b.hit_rate) as s from grid a join grid b on abs(a.wi - b.wi) + abs(a.ai - b.ai) <= 1 group by 1, 2)", "select 'x' as stock_code, window_months, hit_rate, case when hit_rate > 0.5 then 'promoted' else 'rejected' end as promotion_status from grid join s using (wi, ai) order by round(s, 9) desc, wi, ai limit 1"))
def promotion(spark, d):
    g = grid(spark, d)
    s = metrics.neighbourhood(g).join(g, ["wi", "ai"]).withColumn("stock_code", F.lit("x"))
    return lifecycle.promote(s, "stock_code", "20240101").select("stock_code", "window_months", "hit_rate", "promotion_status")


@R.add("select s_suppkey, case when s_nationkey % 3 = 0 then s_suppkey % 4 = 1 else s_suppkey % 4 = 0 end as is_active from supplier where s_suppkey % 4 < 2")
def drift_rollback(spark, d):
    s = table(spark, d, "supplier").filter("s_suppkey % 4 < 2").select("s_suppkey", F.expr("s_suppkey div 4").alias("k"), (F.col("s_suppkey") % 4).cast("string").alias("version"), "s_nationkey")
    meta = s.select("s_suppkey", F.col("s_nationkey").alias("k"), "version", (F.col("version") == "0").alias("is_active"), F.when(F.col("version") == "0", "1").alias("parent_version"))
    drifted = meta.select("k").distinct().withColumn("drifted", F.col("k") % 3 == 0)
    keyed = meta.dropDuplicates(["k", "version"]).select("k", "version", "is_active", "parent_version")
    now = lifecycle.roll_back(keyed.filter("version = '0'").unionByName(keyed.filter("version = '1'")), drifted, "k").select("k", "version", F.col("is_active").alias("now"))
    first = keyed.filter("version = '0'").select("k")
    return meta.join(now, ["k", "version"]).join(first, "k", "left").select("s_suppkey", "now").withColumnRenamed("now", "is_active")


R.oracle["drift_rollback"] = "select s_suppkey, case when s_nationkey % 3 = 0 and s_nationkey in (select s_nationkey from supplier where s_suppkey % 4 = 0) then s_suppkey % 4 = 1 else s_suppkey % 4 = 0 end as is_active from supplier where s_suppkey % 4 < 2"


@R.add("with w as (select distinct c_custkey as k, unnest(list_filter(list_distinct([c_name] || string_split_regex(c_name, '[\\s_#]+')), lambda a: length(a) >= 2)) as a from customer), v as (select distinct k, unnest(case when regexp_matches(a, '[A-Za-z]') then [a, lower(a), upper(a), upper(a[1]) || lower(a[2:])] else [a] end) as alias from w) select k as c_custkey, alias from v where alias in (select alias from v group by 1 having count(distinct k) < 5)")
def alias_generation(spark, d):
    return lifecycle.aliases(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", "c_name")


@R.add("select distinct w as word, 'NNP' as tag from (select unnest([p_name] || string_split_regex(p_name, '\\s+')) as w from part) where length(w) >= 2")
def user_dictionary(spark, d):
    return lifecycle.user_dictionary(table(spark, d, "part"), "p_name")


@R.add(sql("dict", "select word, beta as coefficient from dict where version = 'src0' and beta <> 0 and word not in (select lower(n_name) from nation) and word not in ('the', 'der')"))
def coefficient_export(spark, d):
    c = sentiment_dict(spark, d).filter("version = 'src0'").select(F.lit("x").alias("k"), "word", F.col("beta").alias("coefficient"))
    own = spark.createDataFrame([("x", "The"), ("x", "DER")], "k string, alias string").unionByName(table(spark, d, "nation").select(F.lit("x").alias("k"), F.col("n_name").alias("alias")))
    return lifecycle.masked(c, own, "k").select("word", "coefficient")


@R.add(sql("word_days dict", "select distinct word from word_days where source = 'src0' and word not in (select word from dict where abs(beta) >= 1e-6)"))
def neutral_words(spark, d):
    v = sentiment_dict(spark, d).select("word", F.col("beta").alias("coefficient"))
    return lifecycle.neutral_words(word_days(spark, d).filter("source = 'src0'"), v)


@R.add(sql("pred price", "select stock_code, strftime(prediction_date, '%Y-%m-%d') as date, round(a, 8) as actual, sign(expected_alpha) = sign(a) or (abs(expected_alpha) < 0.005 and abs(a) < 0.005) as is_correct from pred join (select stock_code, date, lead(close_price) over (partition by stock_code order by date) / close_price - 1 as a from price) x using (stock_code) where prediction_date = date and a is not null"))
def historical_rescoring(spark, d):
    return lifecycle.rescored(predictions(spark, d), price(spark, d), "stock_code", "prediction_date").select("stock_code", day("prediction_date").alias("date"), F.round("actual", 8).alias("actual"), "is_correct")


@R.add(sql("fund", "select stock_code, strftime(base_date, '%Y-%m-%d') as base_date, round((per - 15) / 5 * 0.01 + (pbr - 4) / 2 * -0.02, 8) as contribution from fund"))
def fundamentals_contribution(spark, d):
    scaler = spark.createDataFrame([("per", 15.0, 5.0, 0.01), ("pbr", 4.0, 2.0, -0.02)], "c string, mean double, scale double, beta double")
    long = fundamentals(spark, d).select("stock_code", "base_date", F.explode(F.create_map(F.lit("per"), F.col("per"), F.lit("pbr"), F.col("pbr"))).alias("c", "x"))
    return long.join(F.broadcast(scaler), "c").groupBy("stock_code", "base_date").agg(F.round(F.sum((F.col("x") - F.col("mean")) / F.col("scale") * F.col("beta")), 8).alias("contribution")).select("stock_code", day("base_date").alias("base_date"), "contribution")


@R.add(sql("settled", "select stock_code, strftime(prediction_date, '%Y-%m-%d') as date, round(least(greatest(0.1 * (intensity - expected_alpha), -0.05), 0.05), 8) as adjustment, case when expected_alpha > 0 then '+' when expected_alpha < 0 then '-' else '0' end || ' ' || stock_code as narrative from settled"))
def adjustment_and_narrative(spark, d):
    a = F.col("expected_alpha")
    return settled(spark, d).select("stock_code", day("prediction_date").alias("date"), (F.round(scoring.bert_adjustment("intensity", "expected_alpha"), 8) + 0.0).alias("adjustment"), F.format_string("%s %s", F.when(a > 0, "+").when(a < 0, "-").otherwise("0"), F.col("stock_code")).alias("narrative"))


@R.add(with_views("news price word_days dict", "td as (select distinct date as td from price), cal as (select td, lead(td) over (order by td) as next_td from td), imp as (select doc_id, (select min(td) from td where td >= cast(published_at as date)) as impact from news), x as (select stock_code, impact as target, word, 1 as lag from word_days join imp using (doc_id) union all select stock_code, next_td, word, 2 from word_days join imp using (doc_id) join cal on impact = td where next_td is not null)", "select stock_code, strftime(target, '%Y-%m-%d') as date, round(sum(beta / sqrt(lag)), 6) as score, count(*) as hits from x join (select word, beta from dict where version = 'src0') v using (word) group by 1, 2"))
def lagged_daily_scores(spark, d):
    days = ordered.calendar(price(spark, d))
    n = ordered.impact_date(word_days(spark, d).withColumn("date", F.to_date("published_at")), days, "date").select("stock_code", F.col("impact_date").alias("td"), "word")
    nxt = days.select("td", F.lead("td").over(Window.orderBy("td")).alias("next_td"))
    cal = nxt.select("td", F.explode(F.array(F.struct(F.lit(1).alias("lag"), F.col("td").alias("target")), F.struct(F.lit(2).alias("lag"), F.col("next_td").alias("target")))).alias("l")).select("td", "l.*").filter("target is not null")
    v = sentiment_dict(spark, d).filter("version = 'src0'").select("word", "beta")
    return n.join(cal, "td").join(v, "word").groupBy("stock_code", day("target").alias("date")).agg(F.round(F.sum(F.col("beta") / F.sqrt("lag")), 6).alias("score"), F.count("*").alias("hits"))


@R.add()
def hashed_embeddings(spark, d):
    return tables.hashed_embeddings(table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("words")), "doc_id", "words")
