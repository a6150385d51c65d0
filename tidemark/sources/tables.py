"""Where rows come from: stored tables, word lists, alias maps, calendars, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import TABLES


def read_table(spark: SparkSession, location: str, name: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A stored table with its declared schema (any file format), or a database table over JDBC."""
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(url=location, dbtable=name, **options).load()
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(TABLES[name]) if name in TABLES and fmt in ("csv", "json") else reader).load(f"{location}/{name}.{fmt}")


def write_table(df: DataFrame, location: str, name: str, partitions: list[str] | None = None, fmt: str = "parquet") -> None:
    w = df.write.mode("overwrite").format(fmt)
    (w.partitionBy(*partitions) if partitions else w).save(f"{location}/{name}.{fmt}")


def word_list(spark: SparkSession, *paths: str) -> DataFrame:
    """Words of line files; `#` opens a comment; files that are not there count as empty."""
    have = [p for p in paths if spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    if not have:
        return spark.createDataFrame([], "word string")
    w = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(have).select(w.alias("word")).filter("word <> ''").distinct()


def alias_map(spark: SparkSession, path: str) -> DataFrame:
    """(stock_code, alias) of a JSON object of lists."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return text.select(F.explode("m").alias("stock_code", "aliases")).select("stock_code", F.explode("aliases").alias("alias"))


def lookback(prices: DataFrame, date: str, as_of: Column, days: int) -> DataFrame:
    return prices.filter((F.col(date) > F.date_sub(as_of, days)) & (F.col(date) <= as_of))


def with_index_change(history: DataFrame, index: DataFrame, key: str = "date") -> DataFrame:
    """History with the index's change of the day, 0 where the index has none."""
    return history.join(index.select(key, "change"), key, "left").withColumn("change", F.coalesce("change", F.lit(0.0)))


def sector_return(members: DataFrame, closes: DataFrame) -> DataFrame:
    """(stock_code, date, sector_return): the change of a stock's sector index, 0.0 on its first day and without a sector."""
    w = Window.partitionBy("sector").orderBy("date")
    r = closes.select("sector", "date", F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0)).alias("sector_return"))
    return members.join(r, ["sector"], "left").select("stock_code", "date", F.coalesce("sector_return", F.lit(0.0)).alias("sector_return"))


def market_status(ts: Column, is_session: Column, opens: int = 9 * 60, closes: int = 15 * 60 + 30) -> Column:
    minute = F.hour(ts) * 60 + F.minute(ts)
    return F.when(is_session & minute.between(opens, closes - 1), "OPEN").otherwise("CLOSED")


def search_pages(hits: DataFrame, order: list[Column], per_page: int = 10, most: int = 10) -> DataFrame:
    """Results as a paged search returns them: up to `most` pages; what lies beyond is not asked for."""
    k = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return hits.withColumn("page", F.ceil(k / per_page).cast("int")).filter(F.col("page") <= most)


def disclosures(filings: DataFrame, title: str, html: str, keywords: list[str], most: int = 5000) -> DataFrame:
    """Filings whose title holds a keyword, their text cut to a length."""
    from ..functions.expr import visible_text

    return filings.filter(F.col(title).rlike("|".join(keywords))).withColumn("body", F.substring(visible_text(F.col(html)), 1, most))


def hashed_embeddings(rows: DataFrame, key: str, words: str, dims: int = 16) -> DataFrame:
    """(key, embedding): a stand-in for a language model's vectors, signed counts of hashed words scaled to length one. Rows without words have none."""
    w = rows.select(key, F.explode(words).alias("w"))
    sign = F.when(F.pmod(F.xxhash64("w"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    slots = w.groupBy(key, F.pmod(F.hash("w"), F.lit(dims)).alias("slot")).agg(F.sum(sign).alias("v"))
    one = slots.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return one.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.when(F.col("norm") > 0, F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.col("norm")).otherwise(0.0)).alias("embedding"))
