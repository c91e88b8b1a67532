"""Compaction of conversations: rows (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.hashing import short_name
from tessella.storage import materialize

TOOL_CHARS, PREVIEW_CHARS, MOST_MESSAGES, TOOLS_KEPT, MOST_TOKENS, TOKENS_PER_MESSAGE = 200 * 1024, 2000, 50, 3, 128_000, 10
DISABLING = ("不要使用记忆", "禁用记忆", "停止记忆")


def tool_budget(messages: DataFrame, role: str = "tool", most: int = TOOL_CHARS, preview: int = PREVIEW_CHARS) -> DataFrame:
    """Very long tool results as a preview with the name of the file that holds the whole."""
    big = (F.col("role") == role) & (F.length("text") > most)
    name = F.concat(F.lit("tool_result_"), short_name(F.col("text")), F.lit(".txt"))
    return messages.withColumn("text", F.when(big, F.concat(F.lit("[Tool result too large] File: "), name, F.lit("\nPreview:\n"), F.substring("text", 1, preview))).otherwise(F.col("text")))


def snip(messages: DataFrame, most: int = MOST_MESSAGES) -> DataFrame:
    """Of longer conversations the first and last half of `most` messages, and between them a note of how many are gone."""
    conv = Window.partitionBy("conv_id")
    rows = messages.withColumn("__i", F.row_number().over(conv.orderBy("turn"))).withColumn("__n", F.count(F.lit(1)).over(conv))
    half = most // 2
    kept = rows.where((F.col("__n") <= most) | (F.col("__i") <= half) | (F.col("__i") > F.col("__n") - half))
    note = F.concat(F.lit("[Context trimmed: removed "), (F.col("__n") - most).cast("string"), F.lit(" messages in the middle]"))
    # The note comes out of the row before it, so the lines are sorted once.
    same = [F.col(c) for c in messages.columns]
    noted = [{"role": F.lit("user"), "text": note}.get(c, F.col(c)).alias(c) for c in messages.columns]
    one, two = F.struct(*same, F.lit(0).alias("note")), F.struct(*noted, F.lit(1).alias("note"))
    return kept.select(F.explode(F.when((F.col("__n") > most) & (F.col("__i") == half), F.array(one, two)).otherwise(F.array(one))).alias("__x")).select("__x.*")


def micro(messages: DataFrame, role: str = "tool", keep: int = TOOLS_KEPT) -> DataFrame:
    """All but the last tool results of a conversation as placeholders."""
    back = F.row_number().over(Window.partitionBy("conv_id", F.col("role") == role).orderBy(F.desc("turn")))
    old = (F.col("role") == role) & (F.col("__back") > keep)
    rows = messages.withColumn("__back", back)
    return rows.withColumns({"text": F.when(old, "[Previous tool result omitted, re-run if needed]").otherwise(F.col("text")), "role": F.when(old, "user").otherwise(F.col("role"))}).drop("__back")


def estimate(text: Column) -> Column:
    """Tokens of a message: a quarter of its characters, rounded up, and an allowance. A stand-in for a tokenizer."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4) + TOKENS_PER_MESSAGE


def token_totals(messages: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.sum(estimate(F.col("text"))).alias("tokens")).withColumn("over", F.col("tokens") > most)


def recent(messages: DataFrame, keep: int = 10, call_role: str | None = None, tool_role: str = "tool") -> DataFrame:
    """The last messages; with call_role, one more where the first kept is a tool result and the one before its call."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = messages.withColumn("__back", F.row_number().over(w))
    if call_role:
        rows = rows.withColumn("__next", F.lag("role").over(w))
        pair = (F.col("__back") == keep + 1) & (F.col("role") == call_role) & (F.col("__next") == tool_role)
        return rows.where((F.col("__back") <= keep) | pair).drop("__back", "__next")
    return rows.where(F.col("__back") <= keep).drop("__back")


def compact(messages: DataFrame, summaries: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """Budget, snip and micro for all; conversations still over the limit become their summary (conv_id, summary) and
    the last 10 messages, and if that is too long the last 5."""
    # Written, as every step below reads it; a task then sorts its conversations for one step at a time.
    small = materialize(micro(snip(tool_budget(messages)).drop("note")), "small")
    over = materialize(token_totals(small, most).where("over").select("conv_id"), "over")
    big, fine = small.join(over, "conv_id", "left_semi"), small.join(over, "conv_id", "left_anti")
    head = lambda label: summaries.join(over, "conv_id", "left_semi").select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit(f"[{label}] Summary: "), "summary").alias("text"))
    auto = materialize(recent(big, 10).unionByName(head("Auto Compacted"), allowMissingColumns=True), "auto")
    still = materialize(token_totals(auto, most).where("over").select("conv_id"), "still")
    react = recent(big.join(still, "conv_id", "left_semi"), 5, "assistant").unionByName(head("Reactive Compact").join(still, "conv_id", "left_semi"), allowMissingColumns=True)
    return fine.unionByName(auto.join(still, "conv_id", "left_anti")).unionByName(react)


def latest_user_text(messages: DataFrame, role: str = "user") -> DataFrame:
    """(conv_id, text, memory_enabled): the last message of a user, and whether it does not ask to leave memory out."""
    last = messages.where(F.col("role") == role).groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    off = F.lit(False)
    for word in DISABLING:
        off = off | F.col("text").contains(word)
    return last.withColumn("memory_enabled", ~F.coalesce(off, F.lit(False)))


def review_due(messages: DataFrame, interval: int = 10, call_role: str = "assistant", tool_role: str = "tool") -> DataFrame:
    """Conversations with `interval` or more tool rounds (a call, then its result), each turn counted once."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rounds = messages.dropDuplicates(["conv_id", "turn"]).withColumn("__next", F.lead("role").over(w)).where((F.col("role") == call_role) & (F.col("__next") == tool_role))
    return rounds.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rounds")).where(F.col("rounds") >= interval)
