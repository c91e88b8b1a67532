"""Records in files: JSON objects, Markdown with a YAML header, replies with a task graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import schemas
from tessella.functions.text import strip_fences

#: Folders beside a skill whose files are no skills.
SUPPORT = ("references", "templates", "scripts", "assets")


def json_records(spark: SparkSession, path: str, scope: str, kinds: tuple[str, ...]) -> DataFrame:
    """One record per file; files that are no JSON, or whose id, scope or type is not what their place says, are left out."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.from_json("value", schemas.MEMORY).alias("r"), F.input_file_name().alias("file"))
    stem = F.regexp_extract("file", r"([^/]+)\.json$", 1)
    return raw.where(F.col("r").isNotNull() & (F.col("r.id") == stem) & (F.col("r.scope") == scope) & F.col("r.type").isin(*kinds)).select("r.*")


def header(text: Column) -> Column:
    """(meta map, body, valid) of Markdown with a YAML header of plain "key: value" lines and lists.

    YAML beyond that (nested mappings, anchors, block texts) is outside the scope of the parser. A header that is
    not closed makes the row invalid.
    """
    return F.pandas_udf(_parse_headers, "struct<meta:map<string,string>,body:string,valid:boolean>")(text)


def _parse_headers(texts: pd.Series) -> pd.DataFrame:
    out = [parse_header(t or "") for t in texts]
    return pd.DataFrame({"meta": [o[0] for o in out], "body": [o[1] for o in out], "valid": [o[2] for o in out]})


def parse_header(text: str) -> tuple[dict[str, str], str, bool]:
    import json

    lines = text.lstrip("﻿").splitlines()
    if not lines or lines[0].strip() != "---":
        return {}, text, True
    end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)
    if end is None:
        return {}, "", False
    meta: dict[str, str] = {}
    items: list[str] | None = None
    for raw in lines[1:end]:
        x = raw.split(" #")[0].rstrip() if not raw.lstrip().startswith("#") else ""
        if not x.strip():
            continue
        if x.lstrip().startswith("- ") and items is not None:
            items.append(x.strip()[2:].strip().strip("'\""))
            meta[last] = json.dumps(items)
            continue
        key, colon, value = x.partition(":")
        if not colon or key != key.strip():
            return {}, "", False
        last, value = key, value.strip()
        items = [] if not value else None
        quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
        meta[key] = value[1:-1] if quoted else value
    return meta, "\n".join(lines[end + 1 :]).strip(), True


def skill_files(spark: SparkSession, root: str, source: str) -> DataFrame:
    """SKILL.md files below root as rows of the skill catalog."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="SKILL.md").select("value", F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("file"))
    inside = F.expr(f"substring(file, {len(root.replace('file:', '').rstrip('/')) + 2})")
    parts = F.slice(F.split(inside, "/"), F.lit(1), F.size(F.split(inside, "/")) - 1)
    rows = raw.withColumn("parts", parts).where(~F.arrays_overlap("parts", F.array(*map(F.lit, SUPPORT)))).withColumn("h", header(F.col("value"))).where("h.valid")
    meta = lambda *keys: F.coalesce(*[F.col("h.meta")[k] for k in keys])
    return rows.select(
        F.lit(source).alias("source"), F.coalesce(meta("name"), F.element_at("parts", -1)).alias("name"),
        F.when(F.size("parts") > 1, F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), "/")).alias("category"),
        F.substring(F.coalesce(meta("description"), F.lit("")), 1, 1024).alias("description"), meta("when_to_use", "when-to-use").alias("when_to_use"), meta("allowed_tools", "allowed-tools").alias("raw_tools"),
        F.coalesce(meta("enabled"), F.lit("true")).alias("enabled"), (F.lower(F.coalesce(meta("user_invocable", "user-invocable"), F.lit("true"))) != "false").alias("user_invocable"),
        F.when(meta("context") == "fork", "fork").otherwise("inline").alias("context"), meta("created_by", "created-by").alias("created_by"), F.col("h.body").alias("content"), "file",
    )


def parse_dags(replies: DataFrame, column: str = "reply") -> DataFrame:
    """replies with dag (struct) and errors (array): replies may be fenced; required fields are checked."""
    text = strip_fences(F.col(column))
    rows = replies.withColumn("__raw", text).withColumn("dag", F.from_json("__raw", schemas.DAG))
    keys = F.json_object_keys("__raw")
    missing = F.filter(F.array(F.lit("plan_summary"), F.lit("tasks")), lambda k: ~F.array_contains(F.coalesce(keys, F.array().cast("array<string>")), k))
    tasks = F.coalesce(F.col("dag.tasks"), F.array().cast("array<struct<id:string,subject:string,description:string,blockedBy:array<string>,metadata:map<string,string>,task_type:string,work_shard:int>>"))
    fields = F.filter(
        F.flatten(F.transform(tasks, lambda t, i: F.array(*[F.when(t[f].isNull(), F.concat(F.lit("task "), i.cast("string"), F.lit(f" lacks {f}"))) for f in ("id", "subject", "description", "blockedBy")]))), lambda e: e.isNotNull()
    )
    ids = F.transform(tasks, lambda t: t["id"])
    twice = F.transform(F.filter(F.array_distinct(ids), lambda i: F.size(F.filter(ids, lambda j: j == i)) > 1), lambda i: F.concat(F.lit("duplicate task id "), i))
    errors = F.when(F.col("dag").isNull() | keys.isNull(), F.array(F.lit("not a JSON object"))).when(F.size(missing) > 0, F.transform(missing, lambda k: F.concat(F.lit("missing field "), k))).otherwise(F.concat(fields, twice))
    return rows.withColumn("errors", errors).drop("__raw")
