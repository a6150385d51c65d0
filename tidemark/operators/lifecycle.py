"""Versions, promotions, jobs and targets: decisions that turn one state of a table into the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import first_per_key


def promote(scored: DataFrame, stock: str, date: str, floor: float = 0.5) -> DataFrame:
    """Each stock's most stable cell, promoted where its hit rate is above the floor, with the version it gets."""
    best = first_per_key(scored, [stock], [F.desc(F.round("stability", 9)), F.col("wi"), F.col("ai")])
    version = F.concat(F.lit("prod_"), F.col("window_months").cast("string"), F.lit("m_a"), F.col("alpha").cast("string"), F.lit("_"), F.lit(date))
    return best.withColumn("version", version).withColumn("promotion_status", F.when(F.col("hit_rate") > floor, "promoted").otherwise("rejected"))


def roll_back(meta: DataFrame, drifted: DataFrame, key: str) -> DataFrame:
    """Where a key has drifted, its active version's parent becomes the active one; without a parent nothing changes."""
    to = meta.filter("is_active and parent_version is not null").join(drifted.filter("drifted").select(key), key).select(key, F.col("parent_version").alias("__to"))
    return meta.join(to, key, "left").withColumn("is_active", F.when(F.col("__to").isNotNull(), F.col("version") == F.col("__to")).otherwise(F.col("is_active"))).drop("__to")


def enough_data(span_days: Column, news_days: Column, needed: int) -> Column:
    return (span_days >= needed - 10) & (news_days >= 0.5 * needed)


def exclusive_start(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with may_start: no running job of their stock in their category (heavy or light)."""
    busy = jobs.filter("status = 'running'").select("stock_code", "category").distinct().withColumn("__busy", F.lit(True))
    return requests.join(busy, ["stock_code", "category"], "left").withColumn("may_start", F.col("__busy").isNull()).drop("__busy")


def stop(jobs: DataFrame, ids: Column) -> DataFrame:
    return jobs.withColumn("status", F.when(ids & F.col("status").isin("running", "pending"), "stop_requested").otherwise(F.col("status")))


def restart(jobs: DataFrame, ids: Column) -> DataFrame:
    done = ids & ~F.col("status").isin("running")
    return jobs.withColumns({"status": F.when(done, "pending").otherwise(F.col("status")), "progress": F.when(done, 0.0).otherwise(F.col("progress")), "retry_count": F.when(done, 0).otherwise(F.col("retry_count"))})


def recover(jobs: DataFrame, as_of: Column, minutes: int = 60, most: int = 3) -> DataFrame:
    """Running jobs that have been silent go back to pending with one more retry, or fail after `most`."""
    silent = (F.col("status") == "running") & (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("updated_at").cast("timestamp")) > minutes * 60)
    again = silent & (F.col("retry_count") < most)
    return jobs.withColumns({"status": F.when(again, "pending").when(silent, "failed").otherwise(F.col("status")), "retry_count": F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count"))})


def split_backfill(jobs: DataFrame, days: str) -> DataFrame:
    """Two tasks for a backfill of so many days: the recent half, then the historical rest; no task without days."""
    half = F.expr(f"{days} div 2")
    tasks = F.array(F.struct(F.lit("recent").alias("task"), F.lit(0).cast("long").alias("offset"), half.cast("long").alias("days")), F.struct(F.lit("historical").alias("task"), half.cast("long").alias("offset"), (F.col(days) - half).cast("long").alias("days")))
    return jobs.select("*", F.explode(tasks).alias("t")).select(*[c for c in jobs.columns if c != days], "t.*").filter("days > 0")


def resume_at(progress: str, days: str) -> Column:
    return F.floor(F.col(progress) * F.col(days) / 100).cast("int")


def job_progress(tasks: DataFrame, job: str) -> DataFrame:
    """A job's progress is the mean of its tasks'; it is done when all are."""
    return tasks.groupBy(job).agg(F.round(F.avg("progress"), 2).alias("progress"), F.bool_and(F.col("progress") >= 100).alias("completed"))


def activate_requested(targets: DataFrame) -> DataFrame:
    return targets.withColumn("status", F.when((F.col("status") == "paused") & F.col("auto_activate_daily"), "active").otherwise(F.col("status")))


def stale_labels(labels: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    return labels.join(table.select(keys), keys, "left_anti")


def routed_queue(kind: str) -> Column:
    return F.when(F.col(kind) == "DAILY_UPDATE", "verification_light").otherwise("verification_heavy")


def aliases(names: DataFrame, key: str, name: str, most_owners: int = 5) -> DataFrame:
    """(key, alias): a name, its parts and its form without a company suffix, with English case variants; shared by fewer than so many keys."""
    short = F.regexp_replace(F.col(name), r"(?i)(\s+(inc|corp|holdings|group|co)\.?|홀딩스|그룹|전자)$", "")
    parts = F.filter(F.array_distinct(F.concat(F.array(F.col(name), short), F.split(F.col(name), r"[\s_#]+"))), lambda a: F.length(a) >= 2)
    variants = F.array_distinct(F.flatten(F.transform(parts, lambda a: F.when(a.rlike("[A-Za-z]"), F.array(a, F.lower(a), F.upper(a), F.initcap(a))).otherwise(F.array(a)))))
    all_ = names.select(key, F.explode(variants).alias("alias"))
    owners = all_.groupBy("alias").agg(F.countDistinct(key).alias("owners")).filter(F.col("owners") < most_owners)
    return all_.join(owners.select("alias"), "alias").select(key, "alias")


def user_dictionary(names: DataFrame, name: str) -> DataFrame:
    """(word, tag): names and their parts of at least two characters, each once."""
    return names.select(F.explode(F.concat(F.array(F.col(name)), F.split(name, r"\s+"))).alias("word")).filter(F.length("word") >= 2).distinct().select("word", F.lit("NNP").alias("tag"))


def masked(coefficients: DataFrame, alias: DataFrame, key: str) -> DataFrame:
    """Nonzero coefficients of words that are not aliases of the key itself."""
    return coefficients.filter("coefficient <> 0").join(alias.select(key, F.lower("alias").alias("word")).distinct(), [key, "word"], "left_anti")


def neutral_words(features: DataFrame, coefficients: DataFrame) -> DataFrame:
    return features.select("word").distinct().join(coefficients.filter(F.abs("coefficient") >= 1e-6).select("word"), "word", "left_anti")


def rescored(predictions: DataFrame, prices: DataFrame, key: str, date: str) -> DataFrame:
    """Predictions with the next day's change of close; correct with one sign, or where both stay below 0.005."""
    w = Window.partitionBy(key).orderBy("date")
    nxt = prices.select(key, F.col("date").alias(date), (F.lead("close_price").over(w) / F.col("close_price") - 1).alias("actual"))
    p, a = F.col("expected_alpha"), F.col("actual")
    ok = (F.signum(p) == F.signum(a)) | ((F.abs(p) < 0.005) & (F.abs(a) < 0.005))
    return predictions.join(nxt.filter("actual is not null"), [key, date]).withColumn("is_correct", ok)
