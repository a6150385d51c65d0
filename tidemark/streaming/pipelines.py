"""Queue-like pipelines as structured streams that run over what has arrived and stop."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-stream-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def arrivals(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """A stream over a table's files. The path goes in as a pattern, which may name a single file as well as a folder."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def run(stream: DataFrame, mode: str, to: str, state: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream to the end of what is there. Append goes to files; other modes write each batch to a folder of its own, so a batch that runs
    again overwrites itself alone: of complete batches the last one counts, of update batches the last row of each of `keys`."""
    spark = stream.sparkSession
    w = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        w.outputMode("append").format("parquet").option("path", to).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(to)
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of the table")
    w.outputMode(mode).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{to}/batch={k}")).start().awaitTermination()
    folder_ = spark._jvm.org.apache.hadoop.fs.Path(to)
    if not folder_.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder_):  # nothing has arrived
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("basePath", to).parquet(to)
    if mode == "complete":
        return rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")
    last = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("__k", F.row_number().over(last)).filter("__k = 1").drop("__k", "batch")


def daily_counts(events: DataFrame, ts: str, kind: str, late: str = "1 day") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, "1 day").alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), kind, "n", "total")


def first_seen(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first arrival of each key; state is kept, as keys can come back at any time."""
    return events.dropDuplicates(keys).select(keys)


def latest_state(jobs: DataFrame, key: str, ts: str) -> DataFrame:
    """The last heartbeat and number of reports of each worker."""
    return jobs.groupBy(key).agg(F.max(ts).alias("last_seen"), F.max_by("event_type", F.struct(ts, "event_id")).alias("status"), F.count("*").alias("reports"))


def routed(stream: DataFrame, ok: F.Column, light: F.Column, to: str, state: str, handle: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """Sends each row to the light, the heavy or the dead-letter table. A batch that runs again overwrites its own folder, so a row lands once."""
    spark = stream.sparkSession
    good = F.coalesce(ok, F.lit(False))

    def batch(df: DataFrame, k: int) -> None:
        kept = handle(df)
        kept.withColumn("queue", F.when(~good, "dead").when(light, "light").otherwise("heavy")).write.mode("overwrite").partitionBy("queue").parquet(f"{to}/batch={k}")

    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    all_ = spark.read.option("basePath", to).parquet(to).drop("batch")
    return {q: all_.filter(F.col("queue") == q).drop("queue") for q in ("light", "heavy", "dead")}


def replay(dead: DataFrame, repaired: F.Column) -> DataFrame:
    """Dead letters that may be tried again."""
    return dead.filter(repaired)
