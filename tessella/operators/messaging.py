"""Messages: envelopes, routing, the outbox with its backoff, idempotent consumers, permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.values import after_seconds, backoff_seconds

TOPICS = {"command": "agent-command", "message": "agent-message", "permission": "permission-event", "task": "task-event"}
DIRECTED = ("permission_response", "execution_cancel", "runtime_wakeup")
BATCH, MOST_RETRIES, PERMISSION_SECONDS = 50, 12, 300


def envelope_error() -> Column:
    """What is wrong with an envelope; null if nothing."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    payload = F.col("payload")
    shard = payload["work_shard"].try_cast("int")
    return (
        F.when(blank("sender"), "sender is missing")
        .when(blank("event_type"), "event_type is missing")
        .when(payload.isNull(), "payload is not an object")
        .when(F.col("execution_id").isNull() != F.col("attempt").isNull(), "execution_id and attempt belong together")
        .when(F.col("attempt") < 1, "attempt starts at 1")
        .when(F.col("event_type").isin(*DIRECTED) & blank("target"), "a directed message needs a target")
        .when((F.col("event_type") == "task_available") & (blank(payload["task_type"]) | shard.isNull() | (shard < 0)), "task_available needs a task type and a shard")
    )


def topic(event_type: Column) -> Column:
    starts = lambda *p: F.array_contains(F.transform(F.array(*map(F.lit, p)), lambda x: event_type.startswith(x)), True)
    return (
        F.when(event_type.isin("task_available", *DIRECTED), TOPICS["command"])
        .when(starts("permission."), TOPICS["permission"])
        .when(starts("task.", "execution.", "card."), TOPICS["task"])
        .otherwise(TOPICS["message"])
    )


def message_key(event_type: Column) -> Column:
    """The target of a directed message, else the first id that is there."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.when(event_type.isin(*DIRECTED), F.col("target")).otherwise(F.coalesce(given("task_id"), given("execution_id"), given("request_id"), given("target"), F.col("event_id")))


def route(envelopes: DataFrame) -> DataFrame:
    """envelopes with topic, tag and message_key."""
    kind = F.col("event_type")
    return envelopes.withColumn("topic", topic(kind)).withColumn("tag", kind).withColumn("message_key", message_key(kind))


def due(outbox: DataFrame, as_of: Column, batch: int | None = BATCH) -> DataFrame:
    """Pending rows whose time has come, oldest first."""
    rows = outbox.where((F.col("status") == "pending") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= as_of)))
    return rows if batch is None else rows.orderBy("created_at", "event_id").limit(batch)


def after_dispatch(tried: DataFrame, as_of: Column, base: float = 1.0, most: int = MOST_RETRIES) -> DataFrame:
    """tried outbox rows with error (null: published) as they are afterwards."""
    failed = F.col("error").isNotNull()
    out = tried.withColumn("retry_count", F.when(failed, F.col("retry_count") + 1).otherwise(F.col("retry_count")))
    over = failed & (F.col("retry_count") >= most)
    delay = backoff_seconds(F.col("retry_count"), base)
    return out.withColumns({
        "status": F.when(over, "failed").when(failed, "pending").otherwise("published"),
        "next_retry_at": F.when(failed & ~over, after_seconds(as_of, delay)).otherwise(F.lit(None).cast("timestamp")),
        "published_at": F.when(~failed, as_of), "last_error": F.substring(F.col("error"), 1, 4000),
    }).drop("error")


def delivery_audit(tried: DataFrame, as_of: Column, most: int = MOST_RETRIES) -> DataFrame:
    """One audit row for each attempt to publish; a failed attempt counts."""
    failed = F.col("error").isNotNull()
    count = F.when(failed, F.col("retry_count") + 1).otherwise(F.col("retry_count"))
    status = F.when(~failed, "published").when(count >= most, "failed").otherwise("retry_scheduled")
    return tried.select("event_id", status.alias("delivery_status"), count.alias("retry_count"), F.substring("error", 1, 4000).alias("error_message"), as_of.alias("delivered_at"))


def first_deliveries(deliveries: DataFrame, inbox: DataFrame | None = None) -> DataFrame:
    """One delivery of each (consumer_name, event_id), none that the inbox has already."""
    rest = [c for c in deliveries.columns if c not in ("consumer_name", "event_id")]
    once = deliveries.groupBy("consumer_name", "event_id").agg(F.min(F.struct(*rest)).alias("r")).select("consumer_name", "event_id", "r.*")
    return once if inbox is None else once.join(inbox.select("consumer_name", "event_id"), ["consumer_name", "event_id"], "left_anti")


def inbox_state(log: DataFrame) -> DataFrame:
    """log (consumer_name, event_id, at, action: receive, ack, retry) as state (result, retries).

    The first receive claims an event; an acknowledgement after it consumes the event for good; a retry frees it for
    redelivery as long as it is not consumed. What was never received is not in the inbox (null). retries counts the requests.
    One partial aggregation, in any order of the rows; streaming/inbox.py folds the same as state.
    """
    at = lambda *actions: F.when(F.col("action").isin(*actions), F.col("at"))
    last = F.max_by("action", at("receive", "retry"))
    by = log.groupBy("consumer_name", "event_id").agg(F.min(at("receive")).alias("first"), F.max(at("ack")).alias("ack"), last.alias("last"), F.count(at("retry")).alias("retries"))
    result = F.when(F.col("ack") > F.col("first"), "consumed").when(F.col("last") == "receive", "processing")
    return by.select("consumer_name", "event_id", "retries", result.alias("result"))


def accepts(tags: str) -> Column:
    """Whether a subscription with this tag expression ("a || b", "*") takes a message."""
    names = [t.strip() for t in tags.split("||")]
    return F.lit(True) if "*" in names else F.col("tag").isin(*names)


def receive(messages: DataFrame, subscriptions: DataFrame, inbox: DataFrame | None = None) -> DataFrame:
    """Deliveries (consumer_name and the message) to subscriptions (consumer_name, topic, tags, target, broadcast).

    A message goes to the subscriptions of its topic whose tags take it and which it is addressed to (a null target: to
    those with broadcast), but not where the inbox (inbox_state()) has it consumed or in work.
    """
    tags = F.split("tags", r"\s*\|\|\s*")
    keys = F.when(F.array_contains(tags, "*"), F.array(F.lit("*"))).otherwise(F.array_distinct(tags))
    s = subscriptions.select("consumer_name", F.col("topic").alias("__topic"), F.explode(keys).alias("__tag"), F.col("target").alias("__target"), F.coalesce("broadcast", F.lit(False)).alias("__all"))
    # A message is looked up by its tag and by "*", a directed one by its target too, the others among the subscriptions
    # with broadcast: every pair that a join makes is a delivery.
    rows = messages.withColumn("__key", F.explode(F.array_distinct(F.array(F.col("tag"), F.lit("*")))))
    on = (F.col("topic") == F.col("__topic")) & (F.col("__key") == F.col("__tag"))
    directed = rows.join(s, on & (F.col("target") == F.col("__target")))
    others = rows.where("target is null").join(s.where("__all"), on)
    out = directed.unionByName(others).select("consumer_name", *messages.columns)
    if inbox is None:
        return out
    return out.join(inbox.where("result is not null").select("consumer_name", "event_id"), ["consumer_name", "event_id"], "left_anti").select("consumer_name", *messages.columns)


def outbox_status(outbox: DataFrame) -> DataFrame:
    """Outbox rows by status."""
    return outbox.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


def undelivered(outbox: DataFrame, inbox: DataFrame) -> DataFrame:
    """Published events that no consumer has in its inbox."""
    return outbox.where("status = 'published'").join(inbox.select("event_id").distinct(), "event_id", "left_anti")


def addressed_to(target: str, broadcast: bool = False) -> Column:
    return (F.col("target") == target) | (F.lit(broadcast) & F.col("target").isNull())


def parse_messages(raw: DataFrame, schema) -> tuple[DataFrame, DataFrame]:
    """(well-formed envelopes, others) of raw rows with a JSON column value; the others are acknowledged and dropped."""
    parsed = raw.withColumn("e", F.from_json("value", schema))
    good = F.col("e").isNotNull() & F.col("e.event_id").isNotNull() & F.col("e.event_type").isNotNull()
    return parsed.where(good).select("e.*"), parsed.where(~good).drop("e")


def permissions(requests: DataFrame, decisions: DataFrame, as_of: Column, seconds: int = PERMISSION_SECONDS) -> DataFrame:
    """requests with their first decision; without one they are pending, and rejected once the time is over."""
    first = decisions.groupBy("request_id").agg(F.min_by(F.struct("decision", "reason", "decided_by", "decided_at"), "decided_at").alias("d")).select("request_id", "d.*")
    over = after_seconds(F.col("created_at"), F.lit(seconds)) < as_of
    state = F.coalesce(F.col("decision"), F.when(over, "rejected").otherwise("pending"))
    return requests.join(first, "request_id", "left").withColumn("decision", state).withColumn("reason", F.coalesce("reason", F.when(over & F.col("decided_at").isNull(), "timeout")))
