"""Jobs that fall silent: a keyed state with a timer for each job's next deadline and the number of its retries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACTIONS = "job {kind}, at timestamp, action string, retry_count int"


class Watch(StatefulProcessor):
    """A running job whose last heartbeat is more than `seconds` ago goes back to the queue with one more retry, which counts as a sign of life; after
    `most` retries it fails, and nothing that it sends later changes that. A heartbeat before the deadline moves it, also one that arrives late but
    still after the last known one.

    Heartbeats of a batch are taken in order of time, so the result does not depend on how the stream is cut into batches.
    """

    def __init__(self, kind: str, seconds: int, most: int):
        self.kind, self.span, self.most = kind, seconds * 1_000_000, most

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "last_us long, retries int, failed boolean")

    def _expired(self, key, last: int, retries: int, failed: bool, until: int):
        """The state after all deadlines before `until`, and the actions that they caused."""
        out = []
        while not failed and last + self.span < until:
            last += self.span
            failed = retries >= self.most
            retries += not failed
            out.append((key[0], pd.Timestamp(last, unit="us"), "fail" if failed else "retry", retries))
        return last, retries, failed, out

    def _keep(self, last: int, retries: int, failed: bool) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.state.update((last, retries, failed))
        if not failed:
            self.handle.registerTimer((last + self.span) // 1000 + 1)

    def _frame(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=["job", "at", "action", "retry_count"]).astype({"retry_count": "int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        beats = sorted(int(x) for pdf in rows for x in pdf["us"])
        last, retries, failed = self.state.get() if self.state.exists() else (beats[0], 0, False)
        actions = []
        for beat in beats:
            last, retries, failed, out = self._expired(key, last, retries, failed, beat)
            actions += out
            last = last if failed else max(last, beat)
        self._keep(last, retries, failed)
        yield from self._frame(actions)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, retries, failed = self.state.get()
        last, retries, failed, out = self._expired(key, last, retries, failed, timerValues.getCurrentWatermarkInMs() * 1000)
        self._keep(last, retries, failed)
        yield from self._frame(out)

    def close(self) -> None:
        pass


def watched(beats: DataFrame, job: str, ts: str, seconds: int, most: int = 3, late: str = "0 seconds") -> DataFrame:
    """(job, at, action, retry_count): every retry and failure of a stream of heartbeats, as soon as the watermark has passed the deadline. Rows
    without a job or a time are left out."""
    kind = dict(beats.dtypes)[job]
    at = F.col(ts).cast("timestamp")
    rows = beats.select(F.col(job).alias("job"), at.alias("ts"), F.unix_micros(at).alias("us")).filter("job is not null and ts is not null").withWatermark("ts", late)
    return rows.groupBy("job").transformWithStateInPandas(Watch(kind, seconds, most), outputStructType=ACTIONS.format(kind=kind), outputMode="append", timeMode="EventTime")


def zombies(running: DataFrame, consumers: DataFrame, as_of: F.Column, seconds: int = 120) -> DataFrame:
    """Running jobs (job, queue, last_seen) whose last sign of life is missing or more than `seconds` old while nobody consumes their queue. Without
    any row of consumers nothing is known, and no job is called one."""
    silent = F.col("last_seen").isNull() | (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("last_seen").cast("timestamp")) > seconds)
    idle = running.filter(silent).join(consumers.filter("consumers > 0").select("queue"), "queue", "left_anti")
    known = consumers.agg((F.count("*") > 0).alias("known"))  # one row
    return idle.join(F.broadcast(known), F.col("known")).drop("known")


def backlog(ready: DataFrame, most: int = 5000) -> DataFrame:
    """Queues with more messages waiting than `most`."""
    return ready.filter(F.col("ready") > most).select("queue", "ready")
