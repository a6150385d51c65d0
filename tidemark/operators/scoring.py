"""Dictionary scoring: contributions, valuation, status ladder, confidence, relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clamp, occurrences, squeezed


def contributions(tokens: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, neg, net, intensity) of tokens (word, weight) with a lexicon (word, beta); unknown words count 0."""
    c = F.col("weight") * F.coalesce("beta", F.lit(0.0))
    hit = tokens.join(lexicon.groupBy("word").agg(F.sum("beta").alias("beta")), "word", "left").withColumn("c", c)
    pos, neg = F.sum(F.when(F.col("c") > 0, F.col("c")).otherwise(0.0)), F.sum(F.when(F.col("c") < 0, F.col("c")).otherwise(0.0))
    return hit.groupBy(*keys).agg(pos.alias("pos"), neg.alias("neg"), (pos + neg).alias("net"), (pos - neg).alias("intensity"), F.count("*").alias("tokens"))


def valuation_penalty(pos: str, pbr: str) -> Column:
    """Positive weight after a price-to-book above 6 has taken 10 % a point, up to 30 %."""
    return F.col(pos) * (1 - F.when(F.col(pbr) > 6, F.least((F.col(pbr) - 6) / 10, F.lit(0.3))).otherwise(0.0))


def volume_multiplier(last: Column, mean: Column) -> Column:
    """The logarithm of one and the last volume over the mean of the last days, 0.5 to 2; 1 without a mean."""
    return F.when(mean > 0, clamp(F.log1p(last / mean), 0.5, 2.0)).otherwise(1.0)


def status(net: str, intensity: str, volatility: str, n: str, critical: str) -> Column:
    """The six-state ladder; thresholds scale with volatility over 0.02 (0.5 to 3; 0.02 with fewer than 20 rows)."""
    v = clamp(F.when(F.col(n) >= 20, F.coalesce(F.col(volatility), F.lit(0.02))).otherwise(0.02) / 0.02, 0.5, 3.0)
    s, i, c = F.col(net), F.col(intensity), F.col(critical)
    return (
        F.when(c < 0, "Super Sell").when(c > 0, "Super Buy").when(i < 0.01 * v, "Wait").when((i > 0.02 * v) & (F.abs(s) < 0.0025 * v), "Restricted")
        .when(s > 0.005 * v, "Super Buy").when(s > 0, "Buy").when(s < -0.005 * v, "Super Sell").otherwise("Sell")
    )


def combined(main: DataFrame, buffer: DataFrame, keys: list[str]) -> DataFrame:
    """The two dictionaries as one: betas of a feature in both add up."""
    return main.select(*keys, "feature", "beta").unionByName(buffer.select(*keys, "feature", "beta")).groupBy(*keys, "feature").agg(F.sum("beta").alias("beta"))


def predict_advanced(words: DataFrame, dictionary: DataFrame, dense: DataFrame, stats: DataFrame, keys: list[str], critical: list[str], least: float = 1e-5, top: int = 3) -> DataFrame:
    """One row per key: expected_alpha, net, intensity, status, confidence, positive and negative (its `top` strongest words and their weights).

    words: (keys, word, lag, weight), a row per token with the time weight of its article. dictionary: (keys, feature, beta), features word_L1 and so
    on, and the names of dense columns (a dictionary may have some of the keys only, or none: then it serves all rows of those it has). dense: (keys, feature, value, mean, scale), fundamentals and indicators alike. stats: (keys, last_volume,
    mean_volume, volatility, n, pbr, mae). Token contributions of at most `least` do not count. Keys of stats without words are left out.
    """
    feature = F.concat("word", F.lit("_L"), F.col("lag").cast("string"))
    tokens = words.groupBy(*keys, "word", "lag", "weight").agg(F.count("*").alias("times")).withColumn("feature", feature)
    latest = words.filter("lag = 1").groupBy(*keys).agg(F.count("*").alias("tokens"))
    on = [*(k for k in keys if k in dictionary.columns), "feature"]
    dictionary = dictionary.select(*on, "beta")
    hit = tokens.join(dictionary, on).select(*keys, "word", F.round(F.col("beta") * F.col("weight"), 12).alias("c"), "times").filter(F.abs("c") > least)
    more = dense.join(dictionary, on).select(*keys, F.col("feature").alias("word"), F.round(F.when(F.col("scale") != 0, (F.col("value") - F.col("mean")) / F.col("scale") * F.col("beta")).otherwise(0.0), 12).alias("c"), F.lit(1).cast("long").alias("times"))
    all_ = hit.unionByName(more).groupBy(*keys, "word", "c").agg(F.sum("times").alias("times"))
    rank = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(order, "word"))
    ranked = all_.withColumns({"up": rank(F.desc("c")), "down": rank(F.asc("c"))})
    side = lambda on, k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(on & (F.col(k) <= top), F.struct(k, "word", "c")))), lambda x: F.concat(x.word, F.lit(":"), F.round(x.c * 1e6).cast("long").cast("string"))), ",")
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.when(F.col("c") > 0, F.col("c") * F.col("times")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("c") < 0, F.col("c") * F.col("times")).otherwise(0.0)).alias("neg"),
        F.max(F.col("word").isin(critical) & (F.col("c") < 0)).alias("bad"), F.max(F.col("word").isin(critical) & (F.col("c") > 0)).alias("good"),
        side(F.col("c") > 0, "up").alias("positive"), side(F.col("c") < 0, "down").alias("negative"),
    )
    x = words.select(*keys).distinct().join(stats, keys).join(sums, keys, "left").join(latest, keys, "left").fillna(0.0, ["pos", "neg"]).fillna(0, ["tokens"]).fillna("", ["positive", "negative"])
    multiplier = F.coalesce(volume_multiplier(F.col("last_volume"), F.col("mean_volume")), F.lit(1.0))
    x = x.withColumn("pos", valuation_penalty("pos", "pbr")).withColumns({"net": (F.col("pos") + F.col("neg")) * multiplier, "intensity": (F.col("pos") - F.col("neg")) * multiplier, "critical": F.when(F.coalesce("bad", F.lit(False)), -1).when(F.coalesce("good", F.lit(False)), 1).otherwise(0)})
    return x.select(*keys, clamp(F.col("net"), -0.15, 0.15).alias("expected_alpha"), "net", "intensity", status("net", "intensity", "volatility", "n", "critical").alias("status"), confidence("tokens", "mae", "net").alias("confidence"), "positive", "negative")


def confidence(tokens: str, mae: str, net: str) -> Column:
    """Percent: 40 for up to 150 tokens, 60 for a small error (0.05 where unknown); a net score beyond 0.05 costs 30 % of it."""
    c = 40 * F.least(F.lit(1.0), F.col(tokens) / 150) + 60 * F.greatest(F.lit(0.0), 1 - 10 * F.coalesce(F.col(mae), F.lit(0.05)))
    return F.round(c * F.when(F.abs(F.col(net)) > 0.05, 0.7).otherwise(1.0), 1)


def relevance(articles: DataFrame, names: DataFrame | None, key: str, title: str, content: str, name: str, rivals: str = "rivals", aliases: str | None = None) -> DataFrame:
    """Adds relevance_score and is_relevant (30 or more). The name or an alias in the title 50, in the first 200 characters of the content 20, 5 for
    each mention of the most mentioned of them in the content, up to 20; nowhere 0. A rival that the content mentions more often costs 30
    (10 with the name itself in the title), not below 0.

    names: (name, rivals and aliases arrays), one row per article key, else columns of articles. Spaces do not count. A rival of the
    name itself is none. Empty content is irrelevant.
    """
    body, head, who = squeezed(F.coalesce(F.col(content), F.lit(""))), squeezed(F.coalesce(F.col(title), F.lit(""))), squeezed(F.col(name))
    own = F.array_distinct(F.concat(F.array(who), F.transform(F.coalesce(F.col(aliases), F.array().cast("array<string>")), squeezed))) if aliases else F.array(who)
    others = F.filter(F.transform(rivals, squeezed), lambda r: r != F.col("__who"))
    joined = articles.join(names, key) if names is not None else articles
    cut = joined.withColumns({"__body": body, "__head": head, "__who": who, "__own": own})
    counted = cut.withColumns({
        "__c": F.array_max(F.transform("__own", lambda a: occurrences(F.col("__body"), a))),
        "__m": F.coalesce(F.array_max(F.transform(others, lambda r: occurrences(F.col("__body"), r))), F.lit(0)),
        "__b": F.when(F.exists("__own", lambda a: F.contains("__head", a)), 50).otherwise(0) + F.when(F.exists("__own", lambda a: F.contains(F.substring("__body", 1, 200), a)), 20).otherwise(0),
    })
    penalty = F.when(F.col("__m") > F.col("__c"), F.when(F.contains("__head", F.col("__who")), 10).otherwise(30)).otherwise(0)
    nothing = (F.col("__body") == "") | ((F.col("__c") == 0) & (F.col("__b") == 0))
    score = F.when(nothing, 0).otherwise(F.greatest(F.lit(0), F.col("__b") + F.least(F.col("__c") * 5, F.lit(20)) - penalty))
    return counted.withColumn("relevance_score", score).withColumn("is_relevant", F.col("relevance_score") >= 30).drop("__body", "__head", "__who", "__own", "__c", "__m", "__b")


def bert_adjustment(pos: str, neg: str) -> Column:
    return clamp(0.1 * (F.col(pos) - F.col(neg)), -0.05, 0.05)
