"""Writes as set operations: the new state of a table from its old state and a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import first_per_key


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """The batch's row wins; of several in the batch the first by `order`."""
    batch = first_per_key(new, keys, [order]) if order is not None else new.dropDuplicates(keys)
    return old.join(batch.select(keys), keys, "left_anti").unionByName(batch.select(old.columns))


def upsert_keep_known(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """As upsert, but a null in the batch leaves the old value."""
    n = new.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in new.columns if c not in keys])
    return old.join(n, keys, "full").select(*keys, *[F.coalesce(f"__n_{c}", c).alias(c) if f"__n_{c}" in n.columns else F.col(c) for c in old.columns if c not in keys])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(keys), keys, "left_anti").select(old.columns))


def replace_version(old: DataFrame, new: DataFrame, version: list[str]) -> DataFrame:
    """All rows of the versions that the batch names give way to it."""
    return old.join(new.select(version).distinct(), version, "left_anti").unionByName(new.select(old.columns))


def activate(meta: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """Exactly the rows of one version are active in each key that has it; other keys stay as they are."""
    named = meta.filter(version).select(keys).distinct().withColumn("__has", F.lit(True))
    return meta.join(named, keys, "left").withColumn("is_active", F.when(F.col("__has"), version).otherwise(F.col("is_active"))).drop("__has")


def settle(predictions: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Fills actual_alpha and is_correct where a price is known; a zero is never correct."""
    from .metrics import same_sign

    p = prices.select(*keys, F.col("excess_return").alias("__alpha"))
    out = predictions.drop("actual_alpha", "is_correct").join(p, keys, "left").withColumnRenamed("__alpha", "actual_alpha")
    return out.withColumn("is_correct", F.when(F.col("actual_alpha").isNotNull(), same_sign("expected_alpha", "actual_alpha")))


def progress(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Progress never falls."""
    return old.unionByName(new).groupBy(key).agg(F.max("progress").alias("progress"))


def transitions(log: DataFrame, key: str, by: list[str], status: str) -> DataFrame:
    """Rows whose status differs from the row before; a key's first row counts."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*by)
    return log.withColumn("__before", F.lag(status).over(w)).filter(~F.col(status).eqNullSafe(F.col("__before"))).drop("__before")


def remove(old: DataFrame, gone: DataFrame, keys: list[str], *children: DataFrame) -> tuple[DataFrame, ...]:
    """The table and its child tables without the named keys."""
    return tuple(t.join(gone.select(keys).distinct(), keys, "left_anti") for t in (old, *children))
