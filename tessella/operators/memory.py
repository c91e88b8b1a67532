"""Memory records: (id, type, scope, description, content, source, created_at, updated_at), and user_id or project of their scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES, SCOPES = ("semantic", "procedural", "project", "episodic"), ("user", "project")
CANDIDATES, RECALLED, EXTRACTED = 100, 5, 20
#: Characters of each text at most.
LONGEST = {"description": 500, "content": 16_000, "source": 2_000}


def valid_id(ident: Column) -> Column:
    """Whether an id is a UUID of versions 1 to 8, in lower case."""
    return F.coalesce(ident.rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"), F.lit(False))


def get(records: DataFrame, scope: str, ident: str) -> DataFrame:
    """The record of an id in a scope; a LookupError if that scope has none."""
    if scope not in SCOPES:
        raise ValueError(f"unknown scope: {scope}")
    hit = records.where((F.col("scope") == scope) & (F.col("id") == ident))
    if not hit.limit(1).count():
        raise LookupError("no such memory in this scope")
    return hit


def listed(records: DataFrame, scope: str | None = None, kind: str | None = None) -> DataFrame:
    rows = records if scope is None else records.where(F.col("scope") == scope)
    return rows if kind is None else rows.where(F.col("type") == kind)


def page(records: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first; limit 1 to 100."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be between 1 and 100, offset 0 or more")
    return records.orderBy(F.desc("updated_at"), F.desc("id")).offset(offset).limit(limit)


def candidates(records: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The newest of each scope, with key 1, 2, ...: user records before project records."""
    newest = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("updated_at"), F.desc("id")))
    few = records.withColumn("__n", newest).where(F.col("__n") <= most)
    order = Window.orderBy(F.when(F.col("scope") == "user", 0).otherwise(1), "scope", "__n")  # most rows per scope
    return few.withColumn("key", F.row_number().over(order)).drop("__n")


def save_error(previous_type: Column | None = None, texts: tuple[str, ...] = tuple(LONGEST), filled: bool = True) -> Column:
    """Why a record can't be saved; null if it can. Of the given texts none may be too long nor, if filled, null or blank."""
    out = (
        F.when(~F.col("type").isin(*TYPES) | ~F.col("scope").isin(*SCOPES) | F.col("type").isNull() | F.col("scope").isNull(), "unknown type or scope")
        .when((F.col("type") == "semantic") & (F.col("scope") != "user"), "type does not allow this scope")
        .when(F.col("type").isin("project", "episodic") & (F.col("scope") != "project"), "type does not allow this scope")
    )
    for c in texts:
        long = F.length(c) > LONGEST[c]
        out = out.when(F.col(c).isNull() | (F.trim(c) == "") | long if filled else long, f"{c} is empty or too long")
    return out.when(previous_type.isNotNull() & (previous_type != F.col("type")), "type cannot change") if previous_type is not None else out


def saved(records: DataFrame, writes: DataFrame) -> DataFrame:
    """records after the valid writes (same columns): the last write of an id wins, created_at stays."""
    old = records.select("id", "scope", F.col("type").alias("__type"), F.col("created_at").alias("__created"))
    good = writes.join(old, ["id", "scope"], "left").where(save_error(F.col("__type")).isNull())
    new = good.withColumns({"created_at": F.coalesce("__created", "updated_at"), "description": F.trim("description"), "content": F.trim("content")}).drop("__type", "__created")
    rest = [c for c in records.columns if c not in ("id", "scope")]
    new = new.groupBy("id", "scope").agg(F.max_by(F.struct(*rest), F.col("updated_at")).alias("r")).select("id", "scope", "r.*")
    return records.join(new, ["id", "scope"], "left_anti").unionByName(new.select(*records.columns))


def deleted(records: DataFrame, tombstones: DataFrame) -> DataFrame:
    return records.join(tombstones, ["id", "scope"], "left_anti")


def extracted(items: DataFrame, known: DataFrame) -> DataFrame:
    """items (kind, place, scope, id, description, ...) that may be written: the first EXTRACTED of a kind; updates of known
    records of the same type; new ones whose description no known record of the type and scope has."""
    few = items.withColumn("__n", F.row_number().over(Window.partitionBy("kind").orderBy(F.asc_nulls_last("place")))).where(F.col("__n") <= EXTRACTED).drop("__n")
    updates = few.where(F.col("id").isNotNull()).join(known.select("scope", "id", F.col("type").alias("kind")), ["scope", "id", "kind"], "left_semi")
    new = few.where(F.col("id").isNull()).join(known.select("scope", "description", F.col("type").alias("kind")), ["scope", "description", "kind"], "left_anti")
    return updates.unionByName(new)


#: Tokens of a recalled text at most, and the characters that stand for one (as in the conversation's estimates).
RECALL_TOKENS, TOKEN_CHARS = 2_000, 4


def recall_text(few: DataFrame, keys: list[int], tokens: int = RECALL_TOKENS) -> DataFrame:
    """(text): the chosen of candidates() (RECALLED at most, in the order of keys) as one text of bounded length."""
    chosen = list(dict.fromkeys(keys))[:RECALLED]
    order = F.array_position(F.array(*map(F.lit, chosen)), F.col("key")) if chosen else F.lit(0)
    rows = few.where(F.col("key").isin(chosen)).select(order.alias("o"), F.to_json(F.struct("id", "type", "scope", "description", "content")).alias("j"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "j"))), lambda x: x["j"]), ", ")  # RECALLED rows at most
    return rows.agg(F.substring(F.concat(F.lit("Memories, for reference; what the user says now comes first: ["), lines, F.lit("]")), 1, tokens * TOKEN_CHARS).alias("text"))


def recalled(selected: Column, known: Column, most: int = RECALLED) -> Column:
    """The first selected keys that exist, each once."""
    return F.slice(F.array_intersect(F.array_distinct(selected), known), 1, most)
