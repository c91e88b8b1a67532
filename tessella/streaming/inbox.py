"""The inbox of messages as keyed state: what operators/messaging.inbox_state() folds in one go, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "first long, ack long, last long, claimed boolean, retries long"
OUT = "consumer_name string, event_id string, result string, retries long, cause string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Inbox(StatefulProcessor):
    """State of one (consumer_name, event_id): the times of the first receive, of the last acknowledgement and of the last
    receive or retry (with which it was), and the number of retries. Each is a minimum, maximum or count, so the rows of a key
    may come in any order and in any cut into batches.

    claim_ms: a claim that is not acknowledged within that time is given up (cause "timeout"), so that the event can be
    delivered again. remember_ms: state is dropped that long after a key's last row, and with it the memory of what is
    consumed. Both are timers of event time; None for neither.
    """

    def __init__(self, claim_ms: int | None = None, remember_ms: int | None = None):
        self.claim_ms, self.remember_ms = claim_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("inbox", STATE)

    def _result(self, first, ack, claimed) -> str | None:
        return "consumed" if first is not None and ack is not None and ack > first else "processing" if claimed else None

    def _row(self, key, found, cause):
        import pandas as pd

        first, ack, _, claimed, retries = found
        return pd.DataFrame({"consumer_name": [key[0]], "event_id": [key[1]], "result": pd.Series([self._result(first, ack, claimed)], dtype=object), "retries": [retries], "cause": [cause]})

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        first, ack, last, claimed, retries = self.state.get() if self.state.exists() else (None, None, None, False, 0)
        latest = None
        for pdf in rows:
            for at, action in zip(pdf["at"].astype("datetime64[ms]").astype("int64"), pdf["action"], strict=True):
                at = int(at)
                latest = at if latest is None else max(latest, at)
                if action == "ack":
                    ack = at if ack is None else max(ack, at)
                    continue
                if action == "receive":
                    first = at if first is None else min(first, at)
                else:
                    retries += 1
                if last is None or at >= last:
                    last, claimed = at, action == "receive"
        found = (first, ack, last, claimed, int(retries))
        self.state.update(found)
        if self.claim_ms and self._result(first, ack, claimed) == "processing":
            self.handle.registerTimer(last + self.claim_ms)
        if self.remember_ms and latest is not None:
            self.handle.registerTimer(latest + self.remember_ms)
        yield self._row(key, found, "actions")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if not self.state.exists():
            return
        at = expiredTimerInfo.getExpiryTimeInMs()
        first, ack, last, claimed, retries = self.state.get()
        newest = max(x for x in (first, ack, last) if x is not None)
        if self.claim_ms and last is not None and at == last + self.claim_ms and self._result(first, ack, claimed) == "processing":
            found = (first, ack, last, False, retries)
            self.state.update(found)
            yield self._row(key, found, "timeout")
        elif self.remember_ms and at >= newest + self.remember_ms:
            self.state.clear()

    def close(self) -> None:
        pass


def inbox_stream(log: DataFrame, time: str = "at", late: str = "10 seconds", claim_seconds: int | None = None, remember_seconds: int | None = None) -> DataFrame:
    """Changes of the inbox (OUT) from a stream of log rows (consumer_name, event_id, at, action): of each key the last row holds.

    The state store must be RocksDB (spark.sql.streaming.stateStore.providerClass = PROVIDER). The watermark bounds only the
    timers: rows that are late still count, as their key has its state.
    """
    ms = lambda s: None if s is None else s * 1000
    timed = claim_seconds is not None or remember_seconds is not None
    rows = log.withColumnRenamed(time, "at")
    keyed = (rows.withWatermark("at", late) if timed else rows).groupBy("consumer_name", "event_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Inbox(ms(claim_seconds), ms(remember_seconds)), outputStructType=OUT, outputMode="Update", timeMode="EventTime" if timed else "None")
