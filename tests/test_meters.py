"""Metrics equal counted rows; heartbeats by their rule."""

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import heartbeats, meters, pipelines


BASE = 1_000_000  # minutes: a watermark starts at the epoch, where rows would be late


def rows(meter, spark):
    return {(r.name, r.kind, r.label, r.bound): r.value for r in meter.table(spark).collect()}


def test_batch_plans_are_counted_as_they_run(spark, tmp_path):
    meter = meters.Meter()
    df = spark.range(100).withColumn("x", F.when(F.col("id") % 10 > 0, F.col("id")))
    watched = meter.watch(df, "ids", {"even_total": F.col("id") % 2 == 0}, {"x": (F.col("x"), (10, 50, float("inf")))})
    assert watched.filter("id < 5").count() == 5  # the count is of all rows
    meter.add("other_total")
    meter.set("depth", 3.5, "q")
    meter.set("depth", 2.5, "q")
    for v in (0.2, 0.7, 90):
        meter.put("wait", v)
    got = rows(meter, spark)
    assert got["rows_total", "counter", "ids", None] == 100 and got["even_total", "counter", "ids", None] == 50
    assert [got["x", "histogram", "ids", b] for b in (10.0, 50.0, float("inf"))] == [9, 45, 90]
    assert got["depth", "gauge", "q", None] == 2.5 and got["other_total", "counter", "", None] == 1
    assert [got["wait", "histogram", "", b] for b in meters.SECONDS] == [0, 1, 2, 2, 2, 3] and got["wait_sum", "counter", "", None] == pytest.approx(90.9)
    assert rows(meter, spark) == got  # nothing counts twice
    meter.write(spark, f"file://{tmp_path}/m")
    assert spark.read.parquet(f"file://{tmp_path}/m").count() == len(got)


def test_streams_report_rows_and_failures(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    meter = meters.Meter()
    listener = meters.StreamMeter(meter)
    spark.streams.addListener(listener)
    s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    s.writeStream.queryName("copy").format("noop").option("checkpointLocation", f"file://{tmp_path}/a").trigger(availableNow=True).start().awaitTermination()
    bad = s.select(F.raise_error(F.lit("no"))).writeStream.queryName("bad").format("noop").option("checkpointLocation", f"file://{tmp_path}/b").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="no"):
        bad.awaitTermination()
    assert listener.settled()
    spark.streams.removeListener(listener)
    got = rows(meter, spark)
    assert got["stream_rows_total", "counter", "copy", None] == 30 and got["stream_batches_total", "counter", "copy", None] == 3
    assert got["stream_batch_seconds", "histogram", "copy", float("inf")] == 3 and got["stream_failures_total", "counter", "bad", None] == 1


def beats(spark, path, *parts):
    for k, part in enumerate(parts):
        df = spark.createDataFrame([(j, m) for j, m in part], "job string, m long").select("job", F.timestamp_seconds((F.col("m") + BASE) * 60).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(path)


def actions(spark, path, state, most=2, per_batch=None):
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", heartbeats.ROCKSDB)
    s = heartbeats.watched(pipelines.arrivals(session, path, per_batch), "job", "ts", 3600, most)
    out = pipelines.run(s, "append", f"{state}/out", f"{state}/state")
    return sorted((r.job, int(r.at.timestamp()) // 60 - BASE, r.action, r.retry_count) for r in out.collect())


def test_a_silent_job_is_retried_and_then_fails(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    beats(spark, path, [("a", 0), ("a", 50), ("a", 110), ("b", 0), ("c", 0), ("c", 400), ("d", 1000), ("e", None), (None, 5)])
    got = actions(spark, path, f"file://{tmp_path}/w")
    fail = lambda job, last: [(job, last + 60, "retry", 1), (job, last + 120, "retry", 2), (job, last + 180, "fail", 2)]
    assert got == sorted(fail("a", 110) + fail("b", 0) + fail("c", 0))  # c's heartbeat after its failure changes nothing; d is alive
    assert [x for x in actions(spark, path, f"file://{tmp_path}/three", most=3) if x[0] == "b"] == [("b", 60, "retry", 1), ("b", 120, "retry", 2), ("b", 180, "retry", 3), ("b", 240, "fail", 3)]


def test_a_late_heartbeat_cancels_the_timer_and_restarts_keep_the_state(spark, tmp_path):
    path, state = f"file://{tmp_path}/in", f"file://{tmp_path}/w"
    beats(spark, path, [("a", 0), ("b", 0)])
    assert actions(spark, path, state) == []
    beats(spark, path, [("a", 59)])
    assert actions(spark, path, state) == []
    beats(spark, path, [("x", 100)])  # b's deadline passes, a's has moved
    assert actions(spark, path, state) == [("b", 60, "retry", 1)]
    beats(spark, path, [("b", 110), ("x", 159), ("x", 165)])
    assert actions(spark, path, state) == [("a", 119, "retry", 1), ("b", 60, "retry", 1)]


def test_zombies_need_known_queues(spark):
    t = lambda m: f"2024-01-01 00:{m:02d}:00"
    jobs = spark.createDataFrame([("a", "q", t(1)), ("b", "q", t(9)), ("c", "r", t(1)), ("d", "q", None)], "job string, queue string, last_seen string").withColumn("last_seen", F.col("last_seen").cast("timestamp"))
    queues = spark.createDataFrame([("q", 0), ("r", 1)], "queue string, consumers int")
    found = lambda c: sorted(r.job for r in heartbeats.zombies(jobs, c, F.lit(t(10))).collect())
    assert found(queues) == ["a", "d"] and found(queues.limit(0)) == []
    assert [r.queue for r in heartbeats.backlog(spark.createDataFrame([("q", 5001), ("r", 5000)], "queue string, ready long")).collect()] == ["q"]
