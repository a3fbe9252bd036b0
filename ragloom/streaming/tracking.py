"""U2, U3 with state of each document's own: changed states in update mode, alarms and forgetting by timers.

A document's held state is one row in the state store. A batch writes the documents that changed and no others, so the
work of a batch grows with its events and not with all documents. Timers run in event time: they expire once the watermark
has passed them, whether or not the document gets another event.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ragloom.durable import materialize

from .streams import BUCKETS, Batch, read_derived

#: The state store that timers and value states need.
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATES, ALARMS = "states", "alarms"
SCHEMAS = {STATES: "doc_id long, state string, at_ms long, event_id long", ALARMS: "doc_id long, state string, at_ms long, event_id long"}
OUTPUT = "doc_id long, kind string, state string, at_ms long, event_id long"


class Tracker(StatefulProcessor):
    """Holds each document's newest event. A newer one is passed on as a state and sets the timers anew; older ones change nothing."""

    def __init__(self, stale_ms: int, forget_ms: int, in_progress: tuple[str, ...]):
        self.stale_ms, self.forget_ms, self.in_progress = stale_ms, forget_ms, in_progress

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string, at_ms long, event_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else None
        best = held
        for pdf in rows:
            last = pdf.sort_values(["at_ms", "event_id"]).iloc[-1]
            if best is None or (int(last.at_ms), int(last.event_id)) > (best[1], best[2]):
                best = (last.state, int(last.at_ms), int(last.event_id))
        if best is not None and best != held:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.held.update(best)
            self.handle.registerTimer(best[1] + self.forget_ms)
            if best[0] in self.in_progress:
                self.handle.registerTimer(best[1] + self.stale_ms)
            yield self._row(key, "state", best)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.held.exists():
            return
        held = self.held.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= held[1] + self.forget_ms:
            self.held.clear()
        elif held[0] in self.in_progress:
            yield self._row(key, "alarm", held)

    @staticmethod
    def _row(key: Any, kind: str, held: tuple) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [key[0]], "kind": [kind], "state": [held[0]], "at_ms": [held[1]], "event_id": [held[2]]})

    def close(self) -> None:
        pass


def tracked(events: DataFrame, minutes: int, in_progress: tuple[str, ...], late: str = "1 hour", forget_days: int = 365) -> DataFrame:
    """``(doc_id, state, ts, event_id)`` as a stream -> changed states and alarms (``kind``).

    A document whose newest event is in progress becomes an alarm ``minutes`` later, if none newer has come; its state is
    dropped from the store ``forget_days`` after its newest event (a later event starts anew). Events behind the watermark are left out.
    """
    x = events.withWatermark("ts", late).select("doc_id", "state", F.unix_millis("ts").alias("at_ms"), "event_id", "ts")
    tracker = Tracker(minutes * 60_000, forget_days * 86_400_000, in_progress)
    return x.groupBy("doc_id").transformWithStateInPandas(tracker, OUTPUT, "Update", "EventTime")


def keep_tracked(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Runs over what is there. Changed states replace a document's row in the table ``states``, alarms are added to ``alarms``, both
    in one snapshot a batch (see ``streams.Batch``); a repeated batch gives the same tables."""
    spark = stream.sparkSession

    def write(rows: DataFrame, batch_id: int) -> None:
        rows = materialize(rows, "tracked")
        batch = Batch(rows.sparkSession, path, batch_id, buckets)
        new = rows.where("kind = 'state'").drop("kind")
        # a batch may pass on a state and, as the watermark moves, an alarm of the same document
        touched = batch.touched(new, "doc_id")
        before = batch.read(STATES, SCHEMAS[STATES], touched).join(new.select("doc_id"), "doc_id", "left_anti")
        batch.write(STATES, SCHEMAS[STATES], before.unionByName(new), "doc_id", touched)
        batch.write(ALARMS, SCHEMAS[ALARMS], rows.where("kind = 'alarm'").drop("kind"), "doc_id", None)
        batch.commit(keep=2)

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # read when a query starts
    try:
        w = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
        query = w.trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    query.awaitTermination()


def read_tracked(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The table ``states`` or ``alarms`` of the newest snapshot."""
    return read_derived(spark, f"{path}/{name}", SCHEMAS[name])
