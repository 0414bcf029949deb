"""Operational metrics: counters, gauges, percentiles, observed queries, and reporting to a sink."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siltstone.operators.mvcc import DELETE

Sink = Callable[[dict], None]


def op_counters(log: DataFrame) -> DataFrame:
    """(metric, n): a delete counts as a write and as a delete."""
    counts = log.agg(F.count("*").alias("writes"), F.count_if(F.col("op") == DELETE).alias("deletes"))
    return counts.selectExpr("stack(2, 'writes.total', writes, 'deletes.total', deletes) AS (metric, n)")


def value_percentiles(values: DataFrame, column: str = "value") -> DataFrame:
    """(n, p50, p95, p99, mx), exact."""
    p = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return values.agg(F.count(column).alias("n"), p.alias("p"), F.max(column).alias("mx")).select("n", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "mx")


class Metrics:
    """Counters, gauges and histograms of one table; a snapshot empties the histograms."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self.counters: dict[str, int] = {}
        self.gauges: dict[str, Callable[[], float]] = {}
        self._samples: dict[str, list[float]] = {}

    def count(self, name: str, n: int = 1) -> None:
        with self._lock:
            self.counters[name] = self.counters.get(name, 0) + n

    def gauge(self, name: str, read: Callable[[], float]) -> None:
        self.gauges[name] = read

    def record(self, name: str, value: float) -> None:
        with self._lock:
            self._samples.setdefault(name, []).append(max(0.0, value))

    def snapshot(self) -> dict:
        with self._lock:
            taken, self._samples = self._samples, {}
            counters = dict(self.counters)
        histograms = {}
        for name, values in taken.items():
            values.sort()
            at = lambda q, v=values: v[min(len(v) - 1, int(q * len(v)))]
            histograms[name] = {"count": len(values), "p50": at(0.5), "p95": at(0.95), "p99": at(0.99), "max": values[-1]}
        return {"counters": counters, "gauges": {k: f() for k, f in self.gauges.items()}, "histograms": histograms}

    def observed(self, df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
        """``df`` with its row and tombstone counts gathered while it runs, at no extra pass."""
        seen = Observation(name)
        return df.observe(seen, F.count("*").alias("rows"), F.count_if(F.col("op") == DELETE).alias("deletes")), seen


def log_sink(snapshot: dict) -> None:
    logging.getLogger("siltstone.metrics").info("%s", snapshot)


def no_sink(snapshot: dict) -> None:
    """Drops the snapshot."""


class Reporter:
    """Publishes snapshots to a sink every so often; a sink that fails stops nothing."""

    def __init__(self, metrics: Metrics, sink: Sink = no_sink, every_s: float = 10.0):
        self.metrics, self.sink, self.every_s = metrics, sink, every_s
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._loop, daemon=True)

    def start(self) -> Reporter:
        self._thread.start()
        return self

    def publish(self) -> None:
        try:
            self.sink(self.metrics.snapshot())
        except Exception:
            logging.getLogger("siltstone.metrics").exception("the metrics sink failed")

    def _loop(self) -> None:
        while not self._stop.wait(self.every_s):
            self.publish()

    def stop(self) -> None:
        self._stop.set()
        if self._thread.is_alive():
            self._thread.join()
