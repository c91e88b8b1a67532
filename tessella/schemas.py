"""Row types of the engine's tables, and checks that return the rows that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 3

_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()), "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType()),
}


def _rows(columns: str) -> T.StructType:
    """A row type from "name kind, name kind"; needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split(" ", 1) for c in columns.split(", "))])


FILES = _rows("path string, language string, size long, mtime_ns long, content_hash string")
NODES = _rows("file_path string, kind string, name string, qualified_name string, parent_qualified string, line_start int, line_end int, is_test boolean")
EDGES = _rows("file_path string, kind string, source_qualified string, target_name string, target_qualified string, line int")
EMBEDDINGS = _rows("qualified_name string, provider_identity string, text_hash string, vector array<float>, dimension int, provider string, model string")
TASKS = _rows(
    "id string, subject string, description string, thread_id string, owner string, status string, blocked_by_count int, claimed_at timestamp, lease_expires_at timestamp, "
    "last_heartbeat timestamp, metadata string, updated_at timestamp, task_type string, work_shard int, card_selector string, current_execution_id string, current_attempt int"
)
DEPENDENCIES = _rows("task_id string, blocker_id string")
EXECUTIONS = _rows(
    "execution_id string, attempt int, task_id string, thread_id string, runtime_id string, agent_card_id string, agent_card_version string, agent_card_digest string, agent_card_config_hash string, "
    "status string, claimed_at timestamp, started_at timestamp, ended_at timestamp, lease_expires_at timestamp, last_heartbeat_at timestamp, result_summary string, result_path string, failure_reason string"
)
ENVELOPE = _rows(
    "event_id string, event_type string, sender string, target string, payload map<string,string>, thread_id string, task_id string, execution_id string, attempt int, request_id string, correlation_id string, created_at string"
)
MEMORY = _rows("id string, type string, scope string, description string, content string, source string, created_at string, updated_at string")
DAG_TASK = _rows("id string, subject string, description string, blockedBy array<string>, metadata map<string,string>, task_type string, work_shard int")
DAG = T.StructType([T.StructField("plan_summary", T.StringType()), T.StructField("tasks", T.ArrayType(DAG_TASK))])

#: Values that a column may have.
TASK_STATUS = ("pending", "in_progress", "completed", "failed", "cancelled")
RUNTIME_STATUS = ("starting", "idle", "loading", "running", "unloading", "stopped")
EXECUTION_STATUS = ("claimed", "running", "completed", "failed", "expired", "cancelled")
OUTBOX_STATUS = ("pending", "published", "failed")
CARD_STATUS = ("active", "deprecated", "revoked")


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows for which a check is false, once for each, with the check's name in rule. Null counts as kept, as in SQL."""
    broken = F.filter(F.array(*[F.when(F.coalesce(~c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return df.withColumn("rule", F.explode(broken))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that several rows have, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def dangling(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """Rows whose column refers to no key of other."""
    return df.where(F.col(column).isNotNull()).join(other.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def both_or_neither(*columns: str) -> Column:
    """All of these columns are null, or none is."""
    nulls = [F.col(c).isNull() for c in columns]
    return reduce(lambda a, b: a & b, nulls) | ~reduce(lambda a, b: a | b, nulls)


def task_checks() -> dict[str, Column]:
    return {"status": F.col("status").isin(*TASK_STATUS), "attempt": F.col("current_attempt") >= 1, "shard": F.col("work_shard") >= 0, "current": both_or_neither("current_execution_id", "current_attempt")}


def execution_checks() -> dict[str, Column]:
    return {"status": F.col("status").isin(*EXECUTION_STATUS), "attempt": F.col("attempt") >= 1}


def changed_cards(old: DataFrame, new: DataFrame) -> DataFrame:
    """Agent cards (agent_card_id, version) whose content differs; only status may change."""
    keys = ["agent_card_id", "version"]
    rest = [c for c in old.columns if c not in (*keys, "status")]
    differs = reduce(lambda a, b: a | b, [~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in rest])
    return old.alias("o").join(new.alias("n"), keys).where(differs).select(*keys)
