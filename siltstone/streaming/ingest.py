"""Streams of mutations into a table: each micro-batch becomes one commit. Compaction in the background."""

from __future__ import annotations

import logging
import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.sources.table import Table


def stream_into(table: Table, mutations: DataFrame, checkpoint: str, app: str = "stream", order: str | None = None, compact: bool = False, **trigger) -> StreamingQuery:
    """Start writing a stream of (key, op, value[, order]) into ``table``.

    Commits carry the stream's name and batch number, so a batch that is repeated after a failure
    is applied once. Late rows need no watermark: versions are resolved by seq when read. Batches
    wait for compactions while level 0 is too full (``Table.relieve``); limit the source too (such as
    maxFilesPerTrigger). ``compact`` runs a due compaction behind each batch; ``trigger`` goes to
    writeStream.trigger.
    """

    def flush(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table.relieve()
            table.apply_batch(batch, order, app=app, batch=number)
            if compact:
                table.compact()

    writer = mutations.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


class CompactionScheduler:
    """Runs due compactions of a table every compaction_interval_ms; one that fails is logged and tried again."""

    def __init__(self, table: Table):
        self.table = table
        self._stop, self._busy = threading.Event(), threading.Lock()
        self._thread = threading.Thread(target=self._loop, daemon=True)

    def start(self) -> CompactionScheduler:
        self._thread.start()
        return self

    def trigger(self, wait: bool = True) -> int:
        """Compact until nothing is due; the number of compactions. Without ``wait`` nothing happens while one runs."""
        if not self._busy.acquire(blocking=wait):
            return 0
        try:
            done = 0
            while self.table.compact():
                done += 1
            return done
        finally:
            self._busy.release()

    def _loop(self) -> None:
        while not self._stop.wait(self.table.config.compaction_interval_ms / 1000):
            try:
                self.trigger(wait=False)
            except Exception:
                logging.getLogger("siltstone.compaction").exception("a compaction failed")

    def stop(self) -> None:
        self._stop.set()
        if self._thread.is_alive():
            self._thread.join()


def latest_per_key(mutations: DataFrame) -> DataFrame:
    """A streaming aggregate (key, seq, op, value) of the newest mutation per key, for update or complete output."""
    newest = mutations.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("m"))
    return newest.select("key", "m.seq", "m.op", "m.value")
