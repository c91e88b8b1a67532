"""Streaming forms: consumers that take each event once, the outbox, and leases.

A stream remembers events for a limited time: what comes again later than the watermark is taken as new. The
batch forms remember for good.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import messaging, scheduler


def consume_once(deliveries: DataFrame, time: str = "at", remember: str = "1 hour") -> DataFrame:
    """The first delivery of each (consumer_name, event_id) within the watermark."""
    return deliveries.withWatermark(time, remember).dropDuplicatesWithinWatermark(["consumer_name", "event_id"])


def routed(envelopes: DataFrame) -> DataFrame:
    """Envelopes that are in order, with topic, tag and key."""
    return messaging.route(envelopes.where(messaging.envelope_error().isNull()))


def event_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type in windows of event time."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), "event_type", "events")


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _delete(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dispatch(outbox_stream: DataFrame, state_path: str, publish: Callable[[DataFrame], DataFrame], checkpoint: str, every: str | None = None, clock: Callable[[], Column] = F.current_timestamp):
    """Publishes outbox rows when they are due, again after a failure, until they are published or failed for good.

    Each micro-batch takes the rows that its predecessor left pending and the new ones. Those that are due go to publish,
    which returns them with error (null: published); what is over is written to done/batch=N, all others, due later or to be
    tried again, to pending/batch=N, which the next batch reads. A batch that runs again reads the same predecessor and
    writes its own folders again, so nothing is lost or recorded twice (rows may be published twice; consumers take each
    event once). With `every`, an interval such as "1 second", a clock stream makes a batch even when no new rows come.
    """
    spark = outbox_stream.sparkSession
    fields = outbox_stream.schema
    if every is not None:
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        outbox_stream = outbox_stream.unionByName(ticks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]))

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows, before = batch.where("event_id is not null and status = 'pending'"), f"{state_path}/pending/batch={number - 1}"
        if _exists(session, before):
            rows = session.read.schema(fields).parquet(before).unionByName(rows)
        now = F.lit(session.range(1).select(clock()).first()[0])
        held = rows.persist()
        due = messaging.due(held, now, None)
        after = messaging.after_dispatch(publish(due), now).persist()
        later = held.join(due.select("event_id"), "event_id", "left_anti").select(*fields.names)
        later.unionByName(after.where("status = 'pending'").select(*fields.names)).write.mode("overwrite").parquet(f"{state_path}/pending/batch={number}")
        after.where("status <> 'pending'").write.mode("overwrite").parquet(f"{state_path}/done/batch={number}")
        after.unpersist()
        held.unpersist()
        _delete(session, f"{state_path}/pending/batch={number - 2}")

    writer = outbox_stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer).start()


def mailbox(messages: DataFrame, subscriptions: DataFrame, remember: str = "1 hour", time: str = "created_at") -> DataFrame:
    """Routed messages of a stream as deliveries to a table of subscriptions, each once per consumer within the watermark."""
    got = messaging.receive(messages, subscriptions)
    return got.withWatermark(time, remember).dropDuplicatesWithinWatermark(["consumer_name", "event_id"])


def permission_decisions(requests: DataFrame, decisions: DataFrame, seconds: int = messaging.PERMISSION_SECONDS, late: str = "10 seconds") -> DataFrame:
    """(request_id, created_at, decision, reason) from two streams: requests (request_id, created_at) with the first decision
    (request_id, decision, reason, decided_at) that comes in time; without one they come out as rejected for timeout once
    both watermarks have passed the time, so neither side is kept for longer."""
    asked = requests.select("request_id", "created_at").withWatermark("created_at", late)
    told = decisions.select(F.col("request_id").alias("__of"), "decision", "reason", "decided_at").withWatermark("decided_at", late).dropDuplicatesWithinWatermark(["__of"])
    in_time = F.expr(f"request_id = __of AND decided_at >= created_at AND decided_at <= created_at + INTERVAL {seconds} SECONDS")
    met = asked.join(told, in_time, "left_outer")
    return met.select("request_id", "created_at", F.coalesce("decision", F.lit("rejected")).alias("decision"), F.when(F.col("decision").isNull(), "timeout").otherwise(F.col("reason")).alias("reason"))


LEASE_OUT = "execution_id string, attempt int, event_type string, at timestamp"


def lease_watch(signs: DataFrame, time: str = "at", lease_seconds: int = scheduler.LEASE_SECONDS, late: str = "10 seconds") -> DataFrame:
    """signs (execution_id, attempt, kind: claimed, heartbeat, ended, at) to execution.expired events once a lease is over."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, rows: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        columns = ["execution_id", "attempt", "event_type", "at"]
        if state.hasTimedOut:
            (until,) = state.get
            state.remove()
            yield pd.DataFrame([(key[0], key[1], "execution.expired", pd.Timestamp(until, unit="ms"))], columns=columns)
            return
        (until,) = state.get if state.exists else (0,)
        ended = False
        for pdf in rows:
            ended = ended or bool((pdf["kind"] == "ended").any())
            until = max(until, int(pdf["at"].max().timestamp() * 1000) + lease_seconds * 1000)
        if ended:
            state.remove()
        elif until <= state.getCurrentWatermarkMs():
            state.remove()
            yield pd.DataFrame([(key[0], key[1], "execution.expired", pd.Timestamp(until, unit="ms"))], columns=columns)
        else:
            state.update((until,))
            state.setTimeoutTimestamp(until)

    keyed = signs.withColumnRenamed(time, "at").withWatermark("at", late).groupBy("execution_id", "attempt")
    return keyed.applyInPandasWithState(step, LEASE_OUT, "until long", "append", GroupStateTimeout.EventTimeTimeout)
