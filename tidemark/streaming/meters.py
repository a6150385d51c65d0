"""Counters, gauges and histograms of what plans and streams process, kept as a table.

A batch plan is observed while it runs: the counts come with its own job, not from another pass. Streams report through a listener. `Meter.table` has a row
for each series, and for each bucket of a histogram with the number of values up to its bound.
"""

from __future__ import annotations

import threading
import time
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SERIES = "name string, kind string, label string, bound double, value double"
SECONDS = (0.1, 0.5, 1.0, 5.0, 30.0, float("inf"))


class Meter:
    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._value: dict[tuple[str, str, str, float | None], float] = defaultdict(float)
        self._observed: list[tuple[Observation, dict[str, tuple[str, str, str, float | None]]]] = []

    def add(self, name: str, label: str = "", by: float = 1.0) -> None:
        with self._lock:
            self._value[name, "counter", label, None] += by

    def set(self, name: str, value: float, label: str = "") -> None:
        with self._lock:
            self._value[name, "gauge", label, None] = value

    def put(self, name: str, value: float, bounds: tuple[float, ...] = SECONDS, label: str = "") -> None:
        """A value of a histogram."""
        with self._lock:
            for b in bounds:
                self._value[name, "histogram", label, b] += value <= b
            self._value[f"{name}_sum", "counter", label, None] += value

    def watch(self, df: DataFrame, label: str, counters: dict[str, Column], histograms: dict[str, tuple[Column, tuple[float, ...]]] | None = None) -> DataFrame:
        """The same rows; whoever runs the plan to its end adds to the counters (rows that fulfil a condition) and histograms (values; null is
        none). A plan that runs again counts the first time."""
        seen, aggregates, names = Observation(), [F.count(F.lit(1)).alias("c0")], {"c0": ("rows_total", "counter", label, None)}
        for name, condition in counters.items():
            names[f"c{len(names)}"] = (name, "counter", label, None)
            aggregates.append(F.count(F.when(condition, 1)).alias(f"c{len(names) - 1}"))
        for name, (value, bounds) in (histograms or {}).items():
            for b in bounds:
                names[f"c{len(names)}"] = (name, "histogram", label, b)
                aggregates.append(F.count(F.when(value <= b, 1)).alias(f"c{len(names) - 1}"))
        self._observed.append((seen, names))
        return df.observe(seen, *aggregates)

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, kind, label, bound, value); the observed plans must have run."""
        waiting, self._observed = self._observed, []
        for seen, names in waiting:
            for c, v in seen.get.items():
                with self._lock:
                    self._value[names[c]] += v
        with self._lock:
            rows = [(n, k, lab, None if b is None else float(b), float(v)) for (n, k, lab, b), v in sorted(self._value.items(), key=str)]
        return spark.createDataFrame(rows, SERIES)

    def write(self, spark: SparkSession, to: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(to)


class StreamMeter(StreamingQueryListener):
    """Adds every stream's rows, batches, batch seconds and failures to a meter, under the query's name."""

    def __init__(self, meter: Meter):
        self.meter, self._names, self._open = meter, {}, set()

    def onQueryStarted(self, event) -> None:
        self._names[str(event.id)] = event.name or str(event.id)
        self._open.add(str(event.id))
        self.meter.add("streams_started_total", self._names[str(event.id)])

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        self.meter.add("stream_rows_total", name, p.numInputRows)
        if p.numInputRows:
            self.meter.add("stream_batches_total", name)
            self.meter.put("stream_batch_seconds", p.batchDuration / 1000, label=name)
        self.meter.set("stream_rows_per_second", p.processedRowsPerSecond or 0.0, name)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.meter.add("stream_failures_total", self._names.get(str(event.id), str(event.id)))
        self._open.discard(str(event.id))

    def settled(self, seconds: float = 30.0) -> bool:
        """Waits until all streams that have started have reported their end."""
        until = time.monotonic() + seconds
        while self._open and time.monotonic() < until:
            time.sleep(0.05)
        return not self._open
