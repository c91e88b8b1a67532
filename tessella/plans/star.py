"""The driver's star schema seen as a code graph, as tasks, as messages and as memory: views, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.hashing import work_shard

#: The instant at which time-dependent queries look.
AS_OF = "2024-01-16 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def _padded(prefix: str, column: str):
    """format_string would write a null as text."""
    return F.when(F.col(column).isNotNull(), F.format_string(prefix + "%010d", column))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as files, customers and suppliers as classes, parts and orders as functions."""
    t = lambda n: table(spark, sf_dir, n)
    none = F.lit("")
    parts = [
        t("region").select(F.lit("file").alias("kind"), F.col("r_name").alias("name"), _id("R", "r_regionkey").alias("qualified_name"), _id("R", "r_regionkey").alias("file_path"), none.alias("parent_qualified"), F.lit(False).alias("is_test")),
        t("nation").select(F.lit("file"), "n_name", _id("N", "n_nationkey"), _id("R", "n_regionkey"), _id("R", "n_regionkey"), F.lit(False)),
        t("customer").select(F.lit("class"), "c_name", _id("C", "c_custkey"), _id("N", "c_nationkey"), _id("N", "c_nationkey"), F.coalesce(F.col("c_acctbal") < 0, F.lit(False))),
        t("supplier").select(F.lit("class"), "s_name", _id("S", "s_suppkey"), _id("N", "s_nationkey"), _id("N", "s_nationkey"), F.coalesce(F.col("s_acctbal") < 0, F.lit(False))),
        t("part").select(F.lit("function"), "p_name", _id("P", "p_partkey"), _id("B", "p_brand"), none, F.coalesce(F.col("p_size") < 10, F.lit(False))),
        t("orders").select(F.lit("function"), F.concat(F.lit("order"), F.col("o_orderkey").cast("string")), _id("O", "o_orderkey"), _id("C", "o_custkey"), _id("C", "o_custkey"), F.coalesce(F.col("o_orderstatus") == "P", F.lit(False))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


NODES_SQL = """nodes AS (
SELECT 'file' AS kind, r_name AS name, 'R:' || r_regionkey AS qualified_name, 'R:' || r_regionkey AS file_path, '' AS parent_qualified, false AS is_test FROM region
UNION ALL SELECT 'file', n_name, 'N:' || n_nationkey, 'R:' || n_regionkey, 'R:' || n_regionkey, false FROM nation
UNION ALL SELECT 'class', c_name, 'C:' || c_custkey, 'N:' || c_nationkey, 'N:' || c_nationkey, coalesce(c_acctbal < 0, false) FROM customer
UNION ALL SELECT 'class', s_name, 'S:' || s_suppkey, 'N:' || s_nationkey, 'N:' || s_nationkey, coalesce(s_acctbal < 0, false) FROM supplier
UNION ALL SELECT 'function', p_name, 'P:' || p_partkey, 'B:' || p_brand, '', coalesce(p_size < 10, false) FROM part
UNION ALL SELECT 'function', 'order' || o_orderkey, 'O:' || o_orderkey, 'C:' || o_custkey, 'C:' || o_custkey, coalesce(o_orderstatus = 'P', false) FROM orders)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys: nation INHERITS region, customer and supplier IMPORT nation, order CALLS customer and part, REFERENCES supplier; customers CONTAIN orders."""
    t = lambda n: table(spark, sf_dir, n)
    parts = [
        t("nation").select(F.lit("INHERITS").alias("kind"), _id("N", "n_nationkey").alias("source_qualified"), _id("R", "n_regionkey").alias("target_qualified")),
        t("customer").select(F.lit("IMPORTS"), _id("C", "c_custkey"), _id("N", "c_nationkey")),
        t("supplier").select(F.lit("IMPORTS"), _id("S", "s_suppkey"), _id("N", "s_nationkey")),
        t("orders").select(F.lit("CALLS"), _id("O", "o_orderkey"), _id("C", "o_custkey")),
        t("orders").select(F.lit("CONTAINS"), _id("C", "o_custkey"), _id("O", "o_orderkey")),
        t("lineitem").select(F.lit("CALLS"), _id("O", "l_orderkey"), _id("P", "l_partkey")),
        t("lineitem").select(F.lit("REFERENCES"), _id("O", "l_orderkey"), _id("S", "l_suppkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


EDGES_SQL = """edges AS (
SELECT 'INHERITS' AS kind, 'N:' || n_nationkey AS source_qualified, 'R:' || n_regionkey AS target_qualified FROM nation
UNION ALL SELECT 'IMPORTS', 'C:' || c_custkey, 'N:' || c_nationkey FROM customer
UNION ALL SELECT 'IMPORTS', 'S:' || s_suppkey, 'N:' || s_nationkey FROM supplier
UNION ALL SELECT 'CALLS', 'O:' || o_orderkey, 'C:' || o_custkey FROM orders
UNION ALL SELECT 'CONTAINS', 'C:' || o_custkey, 'O:' || o_orderkey FROM orders
UNION ALL SELECT 'CALLS', 'O:' || l_orderkey, 'P:' || l_partkey FROM lineitem
UNION ALL SELECT 'REFERENCES', 'O:' || l_orderkey, 'S:' || l_suppkey FROM lineitem)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks: status from the order's, priority from the digit, shard from the id, three kinds of type."""
    o = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(F.lit("fetch"), F.lit("merge"), F.lit("report")), (F.pmod(F.col("o_orderkey"), F.lit(3)) + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("pending")
    ident = F.concat(F.lit("task-"), F.col("o_orderkey").cast("string"))
    return o.select(
        ident.alias("id"), _id("thread", "o_custkey").alias("thread_id"), status.alias("status"), F.lit(0).alias("blocked_by_count"),
        F.concat(F.lit('{"priority":"'), F.substring("o_orderpriority", 1, 1), F.lit('"}')).alias("metadata"), F.col("o_orderdate").alias("updated_at"), kind.alias("task_type"), work_shard(kind, ident).alias("work_shard"),
    )


TASKS_SQL = """tasks AS (SELECT *, CAST(CAST('0x' || substr(sha256(task_type || ':' || id), 1, 16) AS UBIGINT) % 64 AS INTEGER) AS work_shard FROM (
SELECT 'task-' || o_orderkey AS id, 'thread:' || o_custkey AS thread_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'in_progress' ELSE 'pending' END AS status,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_orderdate AS updated_at, (['fetch', 'merge', 'report'])[o_orderkey % 3 + 1] AS task_type FROM orders))"""


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share a supplier are no dependency; an order depends on the order before each of its line items' parts: orderkey minus linenumber."""
    li = table(spark, sf_dir, "lineitem")
    return li.where(F.col("l_orderkey") > F.col("l_linenumber")).select(F.concat(F.lit("task-"), F.col("l_orderkey").cast("string")).alias("task_id"), F.concat(F.lit("task-"), (F.col("l_orderkey") - F.col("l_linenumber")).cast("string")).alias("blocker_id")).distinct()


DEPENDENCIES_SQL = "dependencies AS (SELECT DISTINCT 'task-' || l_orderkey AS task_id, 'task-' || (l_orderkey - l_linenumber) AS blocker_id FROM lineitem WHERE l_orderkey > l_linenumber)"


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages; the kind of event decides the kind of message, props.k the retries."""
    e = table(spark, sf_dir, "events")
    kinds = {"signup": "task_available", "click": "task.published", "view": "note", "purchase": "permission.requested", "error": "execution_cancel"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")]
    user = F.col("user_id").cast("string")
    return e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"), kind.alias("event_type"), F.lit("scheduler").alias("sender"),
        F.when(F.pmod(F.col("user_id"), F.lit(2)) == 0, F.concat(F.lit("runtime-"), user)).alias("target"), F.create_map(F.lit("task_type"), F.lit("general"), F.lit("work_shard"), user).alias("payload"),
        F.when(F.pmod(F.col("event_id"), F.lit(3)) == 0, F.concat(F.lit("task-"), user)).alias("task_id"), F.lit(None).cast("string").alias("execution_id"), F.lit(None).cast("int").alias("attempt"),
        F.when(F.pmod(F.col("event_id"), F.lit(5)) == 0, F.concat(F.lit("req-"), user)).alias("request_id"), F.get_json_object("props", "$.k").cast("int").alias("retry_count"), F.col("ts").alias("created_at"),
    )


ENVELOPES_SQL = """envelopes AS (SELECT 'e' || event_id AS event_id,
CASE event_type WHEN 'signup' THEN 'task_available' WHEN 'click' THEN 'task.published' WHEN 'view' THEN 'note' WHEN 'purchase' THEN 'permission.requested' WHEN 'error' THEN 'execution_cancel' END AS event_type,
CASE WHEN user_id % 2 = 0 THEN 'runtime-' || user_id END AS target, CASE WHEN event_id % 3 = 0 THEN 'task-' || user_id END AS task_id, CASE WHEN event_id % 5 = 0 THEN 'req-' || user_id END AS request_id,
user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS retry_count, ts AS created_at FROM events)"""


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts: each user is a task, each event an attempt that is claimed at its time with a lease of 60 seconds."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("task-"), F.col("user_id").cast("string")).alias("task_id"), F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("execution_id"), (F.pmod(F.col("event_id"), F.lit(3)) + 1).cast("int").alias("attempt"),
        F.concat(F.lit("runtime-"), F.pmod(F.col("event_id"), F.lit(7)).cast("string")).alias("runtime_id"), F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running").alias("status"),
        F.col("ts").alias("claimed_at"), (F.col("ts") + F.expr("INTERVAL 60 SECONDS")).alias("lease_expires_at"), F.col("event_id").alias("sequence_no"), "event_type",
    )


EXECUTIONS_SQL = """executions AS (SELECT 'task-' || user_id AS task_id, 'x' || event_id AS execution_id, CAST(event_id % 3 + 1 AS INTEGER) AS attempt, 'runtime-' || (event_id % 7) AS runtime_id,
CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, ts AS claimed_at, ts + INTERVAL 60 SECONDS AS lease_expires_at, event_id AS sequence_no, event_type FROM events)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memory records: English ones personal, others of the project; the newest has the largest id."""
    d = table(spark, sf_dir, "documents")
    user = F.col("lang") == "en"
    return d.select(
        _padded("m", "doc_id").alias("id"), F.when(user, "semantic").otherwise("project").alias("type"), F.when(user, "user").otherwise("project").alias("scope"), F.substring("text", 1, 80).alias("description"),
        F.col("text").alias("content"), "source", F.lit("2024-01-01").alias("created_at"), _padded("2024-", "n_chars").alias("updated_at"),
    )


RECORDS_SQL = """records AS (SELECT printf('m%010d', doc_id) AS id, CASE WHEN lang = 'en' THEN 'semantic' ELSE 'project' END AS type, CASE WHEN lang = 'en' THEN 'user' ELSE 'project' END AS scope,
substr(text, 1, 80) AS description, text AS content, source, printf('2024-%010d', n_chars) AS updated_at FROM documents)"""


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as skills: named by their first word; those of even sources belong to the user."""
    d = table(spark, sf_dir, "documents")
    even = F.pmod(F.regexp_extract("source", "([0-9]+)$", 1).cast("int"), F.lit(2)) == 0
    return d.select(F.when(even, "user").otherwise("project").alias("source"), F.lower(F.regexp_extract("text", "^[A-Za-z]+", 0)).alias("name"), F.col("lang").alias("category"), F.col("doc_id").cast("string").alias("description"), F.lit("true").alias("enabled"))


SKILLS_SQL = """skills AS (SELECT CASE WHEN CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 2 = 0 THEN 'user' ELSE 'project' END AS source, lower(regexp_extract(text, '^[A-Za-z]+')) AS name, lang AS category, CAST(doc_id AS VARCHAR) AS description FROM documents)"""


def as_of():
    return F.lit(AS_OF).cast("timestamp")
