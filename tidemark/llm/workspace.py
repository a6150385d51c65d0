"""Intermediate tables in the folder that the whole cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; only where that is unset (tests, one machine) a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of an address in the shared folder, for Python on executors."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


NO_MARK = ("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")  # nobody waits for an intermediate table's _SUCCESS


def release(spark: SparkSession) -> None:
    """The driver's JVM frees the shuffle files and broadcasts of finished steps, and returns free memory of its own to the machine, where it has
    that command."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    jvm.System.gc()
    of = jvm.java.lang.Class.forName

    def call(name: str, *given) -> object:
        """A method of the management interface; the class behind it is not open to calls."""
        kinds, values = gateway.new_array(jvm.java.lang.Class, len(given)), gateway.new_array(jvm.java.lang.Object, len(given))
        for k, (kind, value) in enumerate(given):
            kinds[k], values[k] = of(kind), value
        return of("javax.management.MBeanServer").getMethod(name, kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)

    bean = ("javax.management.ObjectName", jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"))
    if any(x.getName() == "systemTrimNativeHeap" for x in call("getMBeanInfo", bean).getOperations()):
        call("invoke", bean, ("java.lang.String", "systemTrimNativeHeap"), ("[Ljava.lang.Object;", None), ("[Ljava.lang.String;", None))


class Workspace:
    """Names tables below the shared folder, writes them and removes them.

    A written table cuts the lineage: a lost executor costs only the tasks that it was running, since every executor
    can read the table again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, *parts: str) -> DataFrame:
        """Written, by the folders of `parts` if there are any, and read again."""
        out = df.write.mode("overwrite").option(*NO_MARK)
        (out.partitionBy(*parts) if parts else out).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, key: str | list[str], n: int) -> DataFrame:
        """A table in n buckets of a key: later groupings and joins by it need no shuffle of these rows. Only its files outlive this call, not
        its name in the catalogue."""
        known = f"tidemark_{uuid.uuid4().hex}"
        df.write.option(*NO_MARK).bucketBy(n, key).sortBy(key).format("parquet").option("path", self.path(name)).saveAsTable(known)
        table = self.spark.table(known)
        self.spark.sql(f"DROP TABLE {known}")
        return table

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads, and lets the driver's JVM free the shuffle files of finished steps."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        release(self.spark)


ARROW_BYTES = 4 << 20


def bound_arrow_batches(spark: SparkSession) -> None:
    """Batches that Spark hands to Python take about ARROW_BYTES, unless the session has a bound of its own: texts of any length stream in
    bounded pieces on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, ARROW_BYTES)


def shards(spark: SparkSession) -> int:
    """How many shards a hash space is cut into: the session's shuffle partitions, which follow the input's size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def labels(spark: SparkSession, n: int) -> list[int]:
    """n numbers that Spark's hash deals to n partitions, one to each."""
    rows = spark.range(32 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    return [r["id"] for r in sorted(rows, key=lambda r: r["p"])]


def dealt(rows: DataFrame) -> GroupedData:
    """Rows grouped by their shard, a partition for each shard."""
    known = F.array(*[F.lit(x).cast("long") for x in labels(rows.sparkSession, shards(rows.sparkSession))])
    return rows.withColumn("__deal", known[F.col("shard")]).groupBy("__deal")


MOST_BITS = 1 << 25


def flagged(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows with __maybe: false where the column's value is certainly none of the keys.

    The keys are bits of a table that is broadcast: 16 bits a key, at most MOST_BITS in words of 64 (16 MB with their numbers). Rows of other keys
    share bits now and then (very often where the keys are far more than the bits); whoever asks joins the rows that may match, few as a
    rule, and spares the others the shuffle.
    """
    bits = min(MOST_BITS, max(1 << 12, 1 << (16 * keys.count() + 1).bit_length()))
    spot = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(bits))
    word = lambda c: F.shiftright(spot(c), 6)
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (spot(c) % 64).cast("int"))
    made = keys.select(word(key).alias("__word"), one(key).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    joined = rows.join(F.broadcast(made), word(column) == F.col("__word"), "left")
    return joined.withColumn("__maybe", F.coalesce(F.col("__bits").bitwiseAND(one(column)) != 0, F.lit(False))).drop("__word", "__bits")


HOT_GROUPS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Rows with their group's columns, where a group can hold a large part of all rows.

    Groups that hold more than one in HOT_GROUPS of all rows, of which there are fewer than HOT_GROUPS, are broadcast; the others meet their
    rows in a shuffle. groups: a written table, one row per key, with its number of rows in `size`.
    """
    bound = (groups.agg(F.sum(size)).first()[0] or 0) / HOT_GROUPS
    hot = F.broadcast(groups.filter(F.col(size) > bound))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(groups.filter(F.col(size) <= bound), key))


def salted_semi(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Rows whose key is in groups, where a group can hold a large part of all rows: a group of more than one in as many rows as there are
    partitions (HOT_GROUPS at least) is dealt in as many pieces as it is larger than that. The rows are read and shuffled once."""
    most = max(HOT_GROUPS, shards(rows.sparkSession))
    bound = max(1.0, (groups.agg(F.sum(size)).first()[0] or 0) / most)
    pieces = groups.select(key, F.ceil(F.col(size) / bound).alias("__pieces"))
    hot = F.broadcast(pieces.filter("__pieces > 1"))  # fewer than `most` rows
    dealt_rows = rows.join(hot, key, "left").withColumn("__piece", F.coalesce(F.floor(F.rand(7) * F.col("__pieces")), F.lit(0).cast("long"))).drop("__pieces")
    wanted = pieces.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__pieces") - 1)).alias("__piece"))  # at most `most` more than groups
    return dealt_rows.join(wanted.hint("merge"), [key, "__piece"], "left_semi").drop("__piece")
