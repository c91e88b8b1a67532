"""The streaming forms on files."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import messaging
from tessella.streaming import inbox, pipelines


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_each_event_once(spark, tmp_path):
    schema = "consumer_name string, event_id string, at timestamp"
    t = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, 0, s)
    stream = feed(spark, f"{tmp_path}/in", [("w", "e1", t(1)), ("w", "e1", t(2)), ("v", "e1", t(3))], schema)
    assert sorted(map(tuple, drain(pipelines.consume_once(stream), "once").select("consumer_name", "event_id").collect())) == [("v", "e1"), ("w", "e1")]


def test_leases_run_out(spark, tmp_path):
    schema = "execution_id string, attempt int, kind string, at timestamp"
    d = __import__("datetime")
    t = lambda s: d.datetime(2024, 1, 1) + d.timedelta(seconds=s)
    path = f"{tmp_path}/signs"
    feed(spark, path, [("x", 1, "claimed", t(0)), ("y", 1, "claimed", t(0)), ("y", 1, "ended", t(5))], schema)
    feed(spark, path, [("z", 1, "claimed", t(500))], schema)
    stream = feed(spark, path, [("z", 1, "heartbeat", t(510))], schema)
    out = drain(pipelines.lease_watch(stream), "leases").collect()
    assert [(r.execution_id, r.event_type) for r in out] == [("x", "execution.expired")]


def test_dispatch_keeps_what_is_not_over(spark, tmp_path):
    """A row that is due later, one that fails and then succeeds, one that fails for good: none is lost."""
    d = __import__("datetime")
    schema = "event_id string, status string, retry_count int, next_retry_at timestamp, created_at timestamp"
    t = lambda s: d.datetime(2024, 1, 1) + d.timedelta(seconds=s)
    path, turn = f"{tmp_path}/box", []
    feed(spark, path, [("ok", "pending", 0, None, t(0)), ("later", "pending", 0, t(3600), t(0)), ("flaky", "pending", 0, None, t(0)), ("bad", "pending", 10, None, t(0)), ("old", "published", 0, None, t(0))], schema)

    def publish(due):
        bad = F.col("event_id").isin("bad", *(["flaky"] if len(turn) == 1 else []))
        return due.withColumn("error", F.when(bad, F.lit("down")))

    def clock():
        turn.append(1)
        return F.lit(t(10_000 * len(turn) - 8_000))

    q = None
    for k in range(3):  # each new file makes a batch
        stream = feed(spark, path, [(f"new{k}", "pending", 0, None, t(0))], schema) if k else spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        q = pipelines.dispatch(stream, f"{tmp_path}/state", publish, f"{tmp_path}/cp", clock=clock)
        q.processAllAvailable()
        q.stop()
    done = {r.event_id: (r.status, r.retry_count) for r in spark.read.parquet(f"{tmp_path}/state/done").collect()}
    assert done == {"ok": ("published", 0), "flaky": ("published", 1), "bad": ("failed", 12), "later": ("published", 0), "new1": ("published", 0), "new2": ("published", 0)}
    assert spark.read.schema(schema).parquet(f"{tmp_path}/state/pending/batch=2").count() == 0


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, inbox.PROVIDER)
    yield
    spark.conf.unset(name)


LOG = "consumer_name string, event_id string, at timestamp, action string"


def at(s):
    d = __import__("datetime")
    return d.datetime(2024, 1, 1) + d.timedelta(seconds=s)


def last_changes(rows):
    """The state after the last change of each key, in the order of the batches."""
    out = {}
    for r in rows:
        out[r.consumer_name, r.event_id] = (r.result, r.retries)
    return out


def changes(stream):
    got = []
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: got.extend(df.collect())).start()
    q.processAllAvailable()
    q.stop()
    return got


def test_inbox_as_state_equals_the_batch_fold(spark, tmp_path, rocksdb):
    random.seed(6)
    log = [(f"c{random.randrange(2)}", f"e{random.randrange(8)}", at(k), random.choice(["receive", "receive", "ack", "retry"])) for k in range(60)]
    want = {(r.consumer_name, r.event_id): (r.result, r.retries) for r in messaging.inbox_state(spark.createDataFrame(log, LOG)).collect()}
    random.shuffle(log)
    for k in range(0, 60, 20):
        stream = feed(spark, f"{tmp_path}/log", log[k : k + 20], LOG)
    assert last_changes(changes(inbox.inbox_stream(stream))) == want


def test_claims_run_out_and_memory_ends(spark, tmp_path, rocksdb):
    path = f"{tmp_path}/log"
    feed(spark, path, [("w", "slow", at(0), "receive"), ("w", "quick", at(0), "receive"), ("w", "quick", at(1), "ack")], LOG)
    feed(spark, path, [("w", "other", at(500), "receive")], LOG)
    stream = feed(spark, path, [("w", "other", at(501), "ack")], LOG)
    got = changes(inbox.inbox_stream(stream, claim_seconds=60, remember_seconds=3600))
    assert [(r.event_id, r.result, r.cause) for r in got if r.cause == "timeout"] == [("slow", None, "timeout")]
    assert last_changes(got) == {("w", "slow"): (None, 0), ("w", "quick"): ("consumed", 0), ("w", "other"): ("consumed", 0)}


def test_permissions_from_two_streams(spark, tmp_path):
    """A decision in time, one that comes too late, none at all: as permissions() says of the same rows at the end."""
    asked, told = [(r, at(0)) for r in ("yes", "late", "none")], [("yes", "approved", "ok", at(10)), ("late", "approved", "ok", at(400))]
    more = [(f"push{k}", at(2000 + k)) for k in range(2)]
    a, b = "request_id string, created_at timestamp", "request_id string, decision string, reason string, decided_at timestamp"
    feed(spark, f"{tmp_path}/asked", asked, a)
    feed(spark, f"{tmp_path}/told", told, b)
    for k, m in enumerate(more):
        requests = feed(spark, f"{tmp_path}/asked", [m], a)
        decisions = feed(spark, f"{tmp_path}/told", [(f"other{k}", "approved", "ok", at(2000 + k))], b)
    got = {r.request_id: (r.decision, r.reason) for r in drain(pipelines.permission_decisions(requests, decisions), "permits").collect()}
    assert got == {"yes": ("approved", "ok"), "late": ("rejected", "timeout"), "none": ("rejected", "timeout")}
    early = spark.createDataFrame([x for x in told if x[0] != "late"], b).withColumn("decided_by", F.lit("lead"))
    batch = messaging.permissions(spark.createDataFrame(asked, a), early, F.lit(at(2000)))
    assert got == {r.request_id: (r.decision, r.reason) for r in batch.collect()}


def test_mailbox_and_routes(spark, tmp_path):
    """Deliveries of a stream to a table of subscriptions, each once."""
    schema = "event_id string, topic string, tag string, target string, created_at timestamp"
    rows = [("a", "t", "x", "r1", at(0)), ("a", "t", "x", "r1", at(1)), ("b", "t", "y", None, at(2)), ("c", "t", "x", None, at(3)), ("d", "u", "x", "r1", at(4))]
    stream = feed(spark, f"{tmp_path}/in", rows, schema)
    subscriptions = spark.createDataFrame([("one", "t", "x || z", "r1", False), ("all", "t", "*", None, True), ("own", "t", "* || x", "r1", True)], "consumer_name string, topic string, tags string, target string, broadcast boolean")
    got = sorted((r.consumer_name, r.event_id) for r in drain(pipelines.mailbox(stream, subscriptions), "mail").collect())
    assert got == [("all", "b"), ("all", "c"), ("one", "a"), ("own", "a"), ("own", "b"), ("own", "c")]
