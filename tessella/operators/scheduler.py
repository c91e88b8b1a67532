"""Task scheduling as functions from tables to tables, at a given time (as_of): no locks and no wall clock.

State is the fold of an append-only log; every transition is fenced by (task, execution, attempt, runtime).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.hashing import work_shard
from tessella.functions.values import after_seconds, json_merge
from tessella.operators.ranking import numbered
from tessella.storage import discard, materialize

LEASE_SECONDS, MOST_ATTEMPTS, DEFAULT_PRIORITY = 60, 2, 5
ACTIVE = ("claimed", "running")
#: The events of a run that goes well, in order.
GOOD_RUN = ("execution.claimed", "card.resolved", "card.load_started", "card.loaded", "execution.started", "execution.heartbeat", "execution.completed", "card.unload_started", "card.unloaded")
#: For each operation on the current attempt: the statuses it may start from, the status it leads to (None: stays), and
#: what is recorded, in order. A failure that leaves a further attempt records RETRIED as well.
TRANSITIONS = {
    "load_card": (ACTIVE, None, ("card.load_started",)),
    "start": (("claimed",), "running", ("card.loaded", "execution.started")),
    "heartbeat": (ACTIVE, None, ("execution.heartbeat",)),
    "complete": (ACTIVE, "completed", ("execution.completed", "card.unload_started")),
    "fail": (ACTIVE, "failed", ("execution.failed", "card.unload_started")),
    "fail_card": (ACTIVE, "failed", ("card.load_failed", "execution.failed", "card.unload_started")),
    "cancel": (ACTIVE, "cancelled", ("execution.cancelled", "card.unload_started")),
}
RETRIED = ("execution.retried", "task_available")
STALE = "execution.stale_update_rejected"
#: The statuses of an attempt that is over.
OVER = ("completed", "failed", "expired", "cancelled")
NOT_PUBLISHED = ("execution.heartbeat", "execution.stale_update_rejected")


def publish_dag(dags: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """tasks, dependencies, events and messages of parsed DAG documents (thread_id, owner, dag struct)."""
    rows = dags.select("thread_id", "owner", F.explode("dag.tasks").alias("t"))
    kind = F.coalesce(F.col("t.task_type"), F.lit("general"))
    shard = F.coalesce(F.col("t.work_shard"), work_shard(kind, F.col("t.id")))
    tasks = rows.select(
        F.col("t.id").alias("id"), F.col("t.subject").alias("subject"), F.col("t.description").alias("description"), "thread_id", "owner", F.lit("pending").alias("status"),
        F.size(F.coalesce(F.col("t.blockedBy"), F.array().cast("array<string>"))).alias("blocked_by_count"), F.to_json(F.col("t.metadata")).alias("metadata"), as_of.alias("updated_at"), kind.alias("task_type"), shard.alias("work_shard"),
    )
    links = rows.select(F.col("t.id").alias("task_id"), F.explode("t.blockedBy").alias("blocker_id")).distinct()
    events = tasks.select("id", "thread_id", F.lit("task.published").alias("event_type"))
    messages = tasks.where("blocked_by_count = 0").select("id", "thread_id", "task_type", "work_shard", F.lit("task_available").alias("event_type"))
    return {"tasks": tasks, "dependencies": links, "events": events, "messages": messages}


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; aggregates before it shuffles, so a key with many rows is no burden."""
    rest = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return last.select(*key, "r.*")


def ready(tasks: DataFrame) -> DataFrame:
    return tasks.where("status = 'pending' and blocked_by_count = 0")


def priority(metadata: Column) -> Column:
    """The number in metadata; 5 where there is none or it is no number."""
    return F.coalesce(F.get_json_object(metadata, "$.priority").try_cast("int"), F.lit(DEFAULT_PRIORITY))


def claim_order(tasks: DataFrame, per: tuple[str, ...] = ("thread_id", "task_type", "work_shard")) -> DataFrame:
    """Ready tasks with their place in line within a shard; a line is cut in ranges, however long it is (ranking.numbered())."""
    return numbered(ready(tasks), list(per), [priority(F.col("metadata")), "updated_at", "id"])


def first_in_line(tasks: DataFrame, most: int, per: tuple[str, ...] = ("thread_id", "task_type", "work_shard")) -> DataFrame:
    """The first most rows of each line of claim_order(): the limit goes below the exchange of the window, so a long line does not move."""
    w = Window.partitionBy(*per).orderBy(priority(F.col("metadata")), "updated_at", "id")
    return ready(tasks).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def claim(tasks: DataFrame, runtimes: DataFrame, as_of: Column, lease: int = LEASE_SECONDS) -> DataFrame:
    """One task for each idle runtime (runtime_id, status, thread_id, task_type, work_shard): the n-th in line for the n-th runtime."""
    per = ["thread_id", "task_type", "work_shard"]
    idle = runtimes.where("status = 'idle'").withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy("runtime_id")))
    won = first_in_line(tasks, idle.agg(F.max("place")).first()[0] or 0).join(idle.select(*per, "place", "runtime_id"), [*per, "place"])
    attempt = F.coalesce(F.col("current_attempt"), F.lit(0)) + 1
    execution = F.coalesce(F.col("current_execution_id"), F.sha2(F.concat_ws(":", F.col("id"), as_of.cast("string")), 256))
    return won.select("id", "runtime_id", execution.alias("execution_id"), attempt.alias("attempt"), F.lit("claimed").alias("status"), as_of.alias("claimed_at"), after_seconds(as_of, F.lit(lease)).alias("lease_expires_at"), "place")


def fence(updates: DataFrame, executions: DataFrame, tasks: DataFrame) -> DataFrame:
    """updates (task_id, execution_id, attempt, runtime_id, operation) with accepted, the status that results, and event_type.

    What does not come from the current attempt while that is active is stale; an operation that the current attempt's
    status does not allow (a second start) does nothing and has no event.
    """
    current = executions.select("task_id", "execution_id", "attempt", "runtime_id", F.col("status").alias("was")).join(
        tasks.select(F.col("id").alias("task_id"), F.col("current_execution_id").alias("execution_id"), F.col("current_attempt").alias("attempt")), ["task_id", "execution_id", "attempt"]
    )
    met = updates.join(current, ["task_id", "execution_id", "attempt", "runtime_id"], "left")
    is_op = lambda op: F.col("operation") == op
    allowed = F.coalesce(*[F.when(is_op(op) & F.col("was").isin(*states), F.lit(True)) for op, (states, _, _) in TRANSITIONS.items()], F.lit(False))
    to = F.coalesce(*[F.when(is_op(op), F.lit(new)) for op, (_, new, _) in TRANSITIONS.items() if new], F.col("was"))
    main = F.coalesce(*[F.when(is_op(op), F.lit(next((e for e in events if e.startswith("execution.")), events[0]))) for op, (_, _, events) in TRANSITIONS.items()])
    active = F.coalesce(F.col("was").isin(*ACTIVE), F.lit(False))
    event = F.when(F.col("accepted"), main).when(~active, F.lit(STALE))
    return met.withColumn("accepted", allowed).withColumn("status", F.when(F.col("accepted"), to)).withColumn("event_type", event).drop("was")


def transition_events(fenced: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """All that the updates of fence() record: place (from 0) and event_type for each, in order."""
    texts = lambda names: F.array(*map(F.lit, names))
    kinds = F.coalesce(*[F.when(F.col("operation") == op, texts(events)) for op, (_, _, events) in TRANSITIONS.items()])
    again = (F.col("status") == "failed") & retry(F.col("attempt"), most)
    every = F.when(F.col("accepted"), F.when(again, F.concat(kinds, texts(RETRIED))).otherwise(kinds)).when(F.col("event_type") == STALE, texts((STALE,)))
    return fenced.select("task_id", "execution_id", "attempt", "runtime_id", "operation", F.posexplode(every).alias("place", "event_type"))


def task_after_end(tasks: DataFrame, ended: DataFrame, as_of: Column) -> DataFrame:
    """tasks whose current attempt was completed or cancelled: ended (task_id, execution_id, attempt, status, summary, result_path, reason)."""
    over = ended.select(F.col("task_id").alias("id"), F.col("execution_id").alias("current_execution_id"), F.col("attempt").alias("current_attempt"), F.col("status").alias("__to"), "summary", "result_path", "reason")
    met = tasks.join(over, ["id", "current_execution_id", "current_attempt"])
    none = F.lit(None)
    done = json_merge(F.col("metadata"), {"summary": F.substring("summary", 1, 1000), "result_path": F.col("result_path")})
    stopped = json_merge(F.col("metadata"), {"cancel_reason": F.substring("reason", 1, 4000)})
    changed = {"status": F.col("__to"), "owner": none.cast("string"), "claimed_at": none.cast("timestamp"), "lease_expires_at": none.cast("timestamp"), "updated_at": as_of, "metadata": F.when(F.col("__to") == "completed", done).otherwise(stopped)}
    return met.withColumns(changed).select(*tasks.columns)


def unload_events(requests: DataFrame, executions: DataFrame, runtimes: DataFrame) -> DataFrame:
    """requests (task_id, execution_id, attempt, runtime_id, error) of runtimes that have discarded a card, with event_type.

    Null while the attempt is not over, or if its runtime does not unload it; with an error the runtime stays as it is.
    """
    over = executions.where(F.col("status").isin(*OVER)).select("task_id", "execution_id", "attempt", "runtime_id", F.lit(True).alias("__over"))
    held = runtimes.where("status = 'unloading'").select("runtime_id", F.col("current_execution_id").alias("execution_id"), F.col("current_attempt").alias("attempt"), F.lit(True).alias("__held"))
    met = requests.join(over, ["task_id", "execution_id", "attempt", "runtime_id"], "left").join(held, ["runtime_id", "execution_id", "attempt"], "left")
    event = F.when(F.col("__over"), F.when(F.col("error").isNotNull(), "card.unload_failed").when(F.col("__held"), "card.unloaded"))
    return met.select(*requests.columns, event.alias("event_type"))


def retry(attempt: Column, most: int = MOST_ATTEMPTS) -> Column:
    return attempt < most


def task_after_failure(tasks: DataFrame, failed: DataFrame, reason: Column, as_of: Column, most: int = MOST_ATTEMPTS) -> DataFrame:
    """tasks whose current attempt (task_id, execution_id, attempt) failed: pending again or failed, with the reason in metadata."""
    hit = tasks.join(failed.select(F.col("task_id").alias("id"), F.col("execution_id").alias("current_execution_id"), F.col("attempt").alias("current_attempt")), ["id", "current_execution_id", "current_attempt"], "left_semi")
    none = F.lit(None)
    return hit.withColumns({"status": F.when(retry(F.col("current_attempt"), most), "pending").otherwise("failed"), "owner": none.cast("string"), "claimed_at": none.cast("timestamp"), "lease_expires_at": none.cast("timestamp"), "updated_at": as_of, "metadata": json_merge(F.col("metadata"), {"last_error": reason})})


def expired(executions: DataFrame, tasks: DataFrame, as_of: Column, most: int = MOST_ATTEMPTS) -> DataFrame:
    """Current attempts whose lease is over, with retry_scheduled."""
    over = executions.where(F.col("status").isin(*ACTIVE) & (F.col("lease_expires_at") < as_of))
    current = tasks.select(F.col("id").alias("task_id"), F.col("current_execution_id").alias("execution_id"), F.col("current_attempt").alias("attempt"), "task_type", "work_shard")
    return over.join(current, ["task_id", "execution_id", "attempt"]).withColumn("retry_scheduled", retry(F.col("attempt"), most))


def expiry_events(over: DataFrame) -> DataFrame:
    """What is recorded for each expired attempt, in order."""
    kinds = F.when(F.col("retry_scheduled"), F.array(*map(F.lit, ("execution.expired", "card.unload_started", "card.unloaded", "task_available")))).otherwise(F.array(*map(F.lit, ("execution.expired", "card.unload_started", "card.unloaded"))))
    return over.select("task_id", "execution_id", "attempt", "runtime_id", F.posexplode(kinds).alias("place", "event_type"))


def renewed_leases(heartbeats: DataFrame, seconds: int = LEASE_SECONDS) -> DataFrame:
    return heartbeats.groupBy("execution_id", "attempt").agg(F.max("at").alias("last_heartbeat_at")).withColumn("lease_expires_at", after_seconds(F.col("last_heartbeat_at"), F.lit(seconds)))


def remaining_blockers(dependencies: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, remaining): blockers that exist and are not completed; one aggregation for all tasks."""
    met = dependencies.join(tasks.select(F.col("id").alias("blocker_id"), "status"), "blocker_id", "left")
    return met.groupBy("task_id").agg(F.count(F.when(F.col("status") != "completed", 1)).alias("remaining"))


def unblocked_by(done: DataFrame, dependencies: DataFrame, tasks: DataFrame) -> DataFrame:
    """Dependents of done (id) that nothing blocks any more."""
    touched = dependencies.join(done.select(F.col("id").alias("blocker_id")), "blocker_id", "left_semi").select("task_id").distinct()
    return remaining_blockers(dependencies.join(touched, "task_id", "left_semi"), tasks).where("remaining = 0").select("task_id")


def ready_shards(tasks: DataFrame, thread_id: str | None = None, limit: int = 256) -> DataFrame:
    rows = ready(tasks) if thread_id is None else ready(tasks).where(F.col("thread_id") == thread_id)
    return rows.select("thread_id", "task_type", "work_shard").distinct().orderBy("thread_id", "task_type", "work_shard").limit(limit)


def board(tasks: DataFrame, thread_id: str | None = None) -> DataFrame:
    rows = tasks if thread_id is None else tasks.where(F.col("thread_id") == thread_id)
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("tasks"))


def runtime_state(log: DataFrame, as_of: Column, lease: int = LEASE_SECONDS) -> DataFrame:
    """log (runtime_id, at, action: register, heartbeat, stop) as state: status, last_heartbeat, lease_expires_at, alive.

    The last registration counts. A stop ends the lease at its time; a heartbeat of a stopped or unknown runtime does
    nothing. alive tells whether the lease still holds.
    """
    at = lambda a: F.when(F.col("action") == a, F.col("at"))
    begun = materialize(log.groupBy("runtime_id").agg(F.max(at("register")).alias("registered")).where("registered is not null"), "registered")
    since = log.join(begun, "runtime_id").where(F.col("at") >= F.col("registered"))  # the written side lets a busy runtime be split
    ends = materialize(since.groupBy("runtime_id", "registered").agg(F.min(at("stop")).alias("stopped"), F.max(at("stop")).alias("last_stop")), "stopped")
    beats = since.where("action = 'heartbeat'").select("runtime_id", "at").join(ends.select("runtime_id", "stopped"), "runtime_id").where("stopped is null or at < stopped")
    beat = beats.groupBy("runtime_id").agg(F.max("at").alias("beat"))
    sign = F.greatest("registered", "beat")
    out = ends.join(beat, "runtime_id", "left").select(
        "runtime_id", F.when(F.col("stopped").isNotNull(), "stopped").otherwise("idle").alias("status"), sign.alias("last_heartbeat"), F.coalesce("last_stop", after_seconds(sign, F.lit(lease))).alias("lease_expires_at")
    )
    return out.withColumn("alive", (F.col("status") != "stopped") & (F.col("lease_expires_at") >= as_of))


def finish_unload(runtimes: DataFrame, executions: DataFrame) -> DataFrame:
    """Runtimes that unload an attempt which is over become idle."""
    over = executions.where(~F.col("status").isin(*ACTIVE)).select(F.col("execution_id").alias("current_execution_id"), F.col("attempt").alias("current_attempt"), F.lit(True).alias("__over"))
    met = runtimes.join(over, ["current_execution_id", "current_attempt"], "left")
    free = (F.col("status") == "unloading") & F.coalesce("__over", F.lit(False))
    return met.withColumns({"status": F.when(free, "idle").otherwise(F.col("status")), "current_execution_id": F.when(~free, F.col("current_execution_id")), "current_attempt": F.when(~free, F.col("current_attempt"))}).drop("__over")


def runtime_executions(runtimes: DataFrame, executions: DataFrame) -> DataFrame:
    return runtimes.join(executions.select(F.col("execution_id").alias("current_execution_id"), F.col("attempt").alias("current_attempt"), "task_id", F.col("status").alias("execution_status")), ["current_execution_id", "current_attempt"], "left")


def resolve_cards(tasks: DataFrame, cards: DataFrame) -> DataFrame:
    """tasks with agent_card_id and version: the pinned active card, else the active card of the type if there is just one."""
    pin = F.from_json("card_selector", "struct<agent_card_id:string,version:string>")
    rows = tasks.withColumn("p_id", pin["agent_card_id"]).withColumn("p_version", pin["version"])
    active = cards.where("status = 'active'")
    pinned = active.select(F.col("agent_card_id").alias("p_id"), F.col("version").alias("p_version"), F.lit(True).alias("found"))
    by_type = active.select(F.explode(F.array_distinct("task_types")).alias("task_type"), "agent_card_id", "version").groupBy("task_type").agg(F.count(F.lit(1)).alias("n"), F.max("agent_card_id").alias("t_id"), F.max("version").alias("t_version")).where("n = 1").drop("n")
    met = rows.join(pinned, ["p_id", "p_version"], "left").join(by_type, "task_type", "left")
    has_pin = F.col("p_id").isNotNull() & F.col("p_version").isNotNull()
    return met.select(*tasks.columns, F.when(has_pin, F.when(F.col("found"), F.col("p_id"))).otherwise(F.col("t_id")).alias("agent_card_id"), F.when(has_pin, F.when(F.col("found"), F.col("p_version"))).otherwise(F.col("t_version")).alias("version"))


def frozen_cards(executions: DataFrame, cards: DataFrame) -> DataFrame:
    """executions with intact: whether the card is active and still has the digests of the claim."""
    c = cards.select("agent_card_id", F.col("version").alias("agent_card_version"), F.col("bundle_digest").alias("c_digest"), F.col("config_hash").alias("c_hash"), F.col("status").alias("c_status"))
    same = (F.col("c_status") == "active") & (F.col("c_digest") == F.col("agent_card_digest")) & (F.col("c_hash") == F.col("agent_card_config_hash"))
    return executions.join(c, ["agent_card_id", "agent_card_version"], "left").withColumn("intact", F.coalesce(same, F.lit(False))).drop("c_digest", "c_hash", "c_status")


def claim_with_cards(tasks: DataFrame, runtimes: DataFrame, cards: DataFrame, executions: DataFrame, as_of: Column, lease: int = LEASE_SECONDS) -> dict[str, DataFrame]:
    """What idle runtimes claim until none of them finds a task any more: executions, failed tasks, runtimes and events.

    A runtime takes the next task of its line. The first attempt of a task gets its card (resolve_cards()), a further one the
    card that its last attempt has frozen, if that is intact (frozen_cards()). A task without a card fails, and its runtime
    goes on to the next one. So the runtimes of a line are a queue: with n of them, the runtime of the j-th task that fails
    meets the task at place n + j. These links are followed back to the first n places by doubling, for all lines at once, in
    rounds that are the logarithm of the tasks that one runtime meets.
    """
    per = ["thread_id", "task_type", "work_shard"]
    frozen = frozen_cards(executions, cards).where("intact").select(F.col("execution_id").alias("current_execution_id"), F.col("attempt").alias("current_attempt"), "agent_card_id", "agent_card_version")
    placed, wanted = claim_order(tasks), ["id", *per, "place", "current_execution_id", "current_attempt", "agent_card_id", "agent_card_version"]
    # Apart, so that first attempts, which have no execution, do not meet in one task of the join.
    first = resolve_cards(placed.where("current_execution_id is null"), cards).withColumnRenamed("version", "agent_card_version")
    further = placed.where("current_execution_id is not null").join(frozen, ["current_execution_id", "current_attempt"], "left")
    digests = cards.select("agent_card_id", F.col("version").alias("agent_card_version"), F.col("bundle_digest").alias("agent_card_digest"), F.col("config_hash").alias("agent_card_config_hash"))
    line = first.select(*wanted).unionByName(further.select(*wanted)).join(digests, ["agent_card_id", "agent_card_version"], "left")
    line = materialize(line.select("id", *per, "place", "current_execution_id", "current_attempt", *digests.columns, F.col("agent_card_digest").isNotNull().alias("ok")), "line")
    free = runtimes.where("status = 'idle'").select(*per, "runtime_id")
    many = materialize(free.groupBy(*per).agg(F.count(F.lit(1)).alias("n")), "many")
    # As many tasks with a card as there are runtimes are claimed, in order; what has none and comes before the last of them
    # fails, or all of it where runtimes are left over.
    ranked = numbered(line.select(*per, "ok", "place").join(many, per), [*per, "ok"], ["place"], "nth")
    last = materialize(ranked.where("ok and nth <= n").groupBy(*per, "n").agg(F.max("place").alias("last"), F.count(F.lit(1)).alias("got")), "last")
    ends = many.join(last.select(*per, "last", "got"), per, "left")
    lost = line.where("not ok").join(ends, per).where((F.coalesce("got", F.lit(0)) < F.col("n")) | (F.col("place") < F.col("last")))
    back = ranked.where("not ok").join(last.select(*per, "last"), per).where("nth + n <= last").select(*per, (F.col("nth") + F.col("n")).alias("place"), F.col("place").alias("at"), "n")
    links = materialize(back, "links")
    while not links.where("at > n").isEmpty():
        step = links.select(*per, F.col("place").alias("at"), F.col("at").alias("__before"))
        nearer = materialize(links.join(step, [*per, "at"], "left").select(*per, "place", F.coalesce("__before", "at").alias("at"), "n"), "links")
        discard(links)
        links = nearer
    queue = numbered(free.join(last.select(*per), per), per, ["runtime_id"], "turn")
    claimed = line.where("ok").join(last.select(*per, "last"), per).where("place <= last").join(links.select(*per, "place", "at"), [*per, "place"], "left")
    every = materialize(claimed.withColumn("turn", F.coalesce("at", "place")).join(queue, [*per, "turn"]).select(*line.columns, "runtime_id"), "claimed")
    attempt = (F.coalesce("current_attempt", F.lit(0)) + 1).alias("attempt")
    execution = F.coalesce(F.col("current_execution_id"), F.sha2(F.concat_ws(":", F.col("id"), as_of.cast("string")), 256)).alias("execution_id")
    until = after_seconds(as_of, F.lit(lease)).alias("lease_expires_at")
    won = every.select(execution, attempt, F.col("id").alias("task_id"), "thread_id", "runtime_id", *digests.columns, F.lit("claimed").alias("status"), as_of.alias("claimed_at"), until)
    failed = lost.select("id", F.lit("failed").alias("status"), F.lit("card_resolution_failed").alias("last_error"))
    kinds = F.array(F.lit("execution.claimed"), F.lit("card.resolved"))
    return {
        "executions": won, "failed": failed, "runtimes": won.select("runtime_id", F.lit("loading").alias("status"), F.col("execution_id").alias("current_execution_id"), F.col("attempt").alias("current_attempt"), "lease_expires_at"),
        "events": won.select("task_id", "execution_id", "attempt", "runtime_id", F.posexplode(kinds).alias("place", "event_type")),
    }


def history(executions: DataFrame, task_id: str) -> DataFrame:
    return executions.where(F.col("task_id") == task_id).orderBy("claimed_at", "attempt")


def event_order(events: DataFrame) -> DataFrame:
    """Place of each event in its execution, and the event before it. Neither needs an execution to be one task's work: the
    event before is found by its place."""
    line = ["execution_id", "attempt"]
    placed = materialize(numbered(events, line, ["sequence_no"]), "placed")
    before = placed.select(*[F.col(c).alias(f"__{c}") for c in line], (F.col("place") + 1).alias("__place"), F.col("event_type").alias("after"))
    same = (F.col("place") == F.col("__place")) & F.col("execution_id").eqNullSafe(F.col("__execution_id")) & F.col("attempt").eqNullSafe(F.col("__attempt"))
    return placed.join(before, same, "left").drop("__execution_id", "__attempt", "__place")


def published(events: DataFrame) -> DataFrame:
    return events.where(~F.col("event_type").isin(*NOT_PUBLISHED))
