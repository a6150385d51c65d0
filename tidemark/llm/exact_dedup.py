"""Exact deduplication by a keyed stream state that never expires.

Every document becomes an entry of digest, stable identifier and content locator. A structured stream folds the entries
into a disk-backed (RocksDB) state: for each digest the smallest identifier, its locator and the number of documents. Entries of one
digest are only dropped after the full bytes of all of them have been compared.
All of it is DataFrame operations; Python runs on the driver only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import NO_MARK, Workspace, flagged, join_groups, salted_semi, shards

STATE_SHARE = 4  # a state row is a small part of a document, and so are its partitions
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: F.Column) -> F.Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _first(c: str) -> F.Column:
    """The entry that stays: the smallest identifier, null after all others."""
    return F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("locator"))).alias(c)


def fold(spark: SparkSession, inbox: str, schema, out: str, state: str, files_per_batch: int | None = None) -> None:
    """Runs the stream over what the inbox holds beyond what the state has seen. Each micro-batch writes the changed keys."""
    session = spark.newSession()  # the state's settings stay out of the caller's session
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "64")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # many small stores: no disk held in advance
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    session.conf.set("spark.sql.streaming.checkpointFileManagerClass", "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager")  # works on all stores
    session.conf.set("spark.sql.shuffle.partitions", -(-shards(spark) // STATE_SHARE))
    reader = session.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    state_of = reader.parquet(inbox).groupBy("digest").agg(_first("first"), F.count("*").alias("n"))
    query = (
        state_of.writeStream.outputMode("update")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .foreachBatch(lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("overwrite").option(*NO_MARK).parquet(f"{out}/batch_{k:09d}"))
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, keep_locator.

    Texts are equal when identical after `normalised`; null equals empty. group_size counts rows, so rows that repeat an id and a text
    count each, and each is kept if its id is the smallest. A null id sorts after all others and stays only where a group has
    no other. keep_locator is the file that held the kept row when its entry was made (empty for rows that come from no file). Other
    columns, whatever their names, are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "exact-dedup")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    inbox = ws.table(rows.select("id", F.sha2(normalised(F.col("text")), 256).alias("digest"), F.input_file_name().alias("locator")), "inbox")
    fold(spark, ws.path("inbox"), inbox.schema, ws.path("groups"), ws.path("state"), files_per_batch)
    groups = (
        spark.read.option("recursiveFileLookup", "true").schema("digest string, first struct<no_id:boolean,id:" + dict(inbox.dtypes)["id"] + ",locator:string>, n long, batch int").parquet(ws.path("groups"))
        .groupBy("digest")
        .agg(F.max_by(F.struct("first", "n"), "batch").alias("g"))
        .select("digest", F.col("g.first.id").alias("keep_id"), F.col("g.first.locator").alias("keep_locator"), F.col("g.n").alias("group_size"))
    )
    groups = ws.table(groups, "keys")
    found = ws.table(join_groups(inbox.drop("locator"), groups, "digest", "group_size"), "found")
    ws.drop("inbox", "groups", "state")

    # Full bytes on hits: all texts of a digest are equal if the least and the greatest are.
    copied = ws.table(found.filter("group_size > 1").select("id"), "copied")
    texts = flagged(rows, "id", copied, "id").filter("__maybe").select("id", normalised(F.col("text")).alias("norm")).withColumn("digest", F.sha2("norm", 256))
    hits = salted_semi(texts.select("digest", "norm"), groups.filter("group_size > 1"), "digest", "group_size")
    differ = ws.table(hits.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).filter("lo <> hi").select("digest"), "differ")
    out = found.select("id", "keep_id", "group_size", "digest", "keep_locator")
    if not differ.isEmpty():  # texts with one digest but other bytes: each text is a group of its own
        apart = texts.join(differ, "digest")
        own = apart.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        out = out.join(differ, "digest", "left_anti").unionByName(apart.join(own, ["digest", "norm"]).select("id", "keep_id", "group_size", "digest", F.lit("").alias("keep_locator")))
    ws.drop("keys")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"), "keep_locator")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat id and text one stays. Only rows whose id goes or is repeated are joined."""
    copies = exact_dedup(docs, id_col, text_col).filter("group_size > 1")
    ws = Workspace(docs.sparkSession, "keep-first")
    copies = ws.table(copies.groupBy(F.col(id_col).alias("kept_id"), F.col("text_sha256").alias("kept_digest")).agg(F.first("kept").alias("kept"), F.count("*").alias("kept_rows")), "copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("own_id"))  # names of any kind stay inside the row
    parted = flagged(rows, "own_id", copies.filter("not kept or kept_rows > 1"), "kept_id")
    marked = parted.filter("__maybe").withColumn("own_digest", F.sha2(normalised(F.col("row")[text_col]), 256))
    marked = marked.join(copies, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_digest") == F.col("kept_digest")), "left")
    one = marked.filter("kept_rows is null or (kept and kept_rows = 1)").select("row.*")
    again = marked.filter("kept and kept_rows > 1").groupBy("kept_id", "kept_digest").agg(F.first("row").alias("row")).select("row.*")
    return parted.filter("not __maybe").select("row.*").unionByName(one).unionByName(again)
