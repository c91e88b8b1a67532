"""Decisions on tool calls: rows (tool, command) or (tool, path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is denied, what needs approval (substrings, compared as they stand), and words of risky commands.
DENIED = ("rm -rf /", "sudo", "shutdown", "reboot", "mkfs", "dd if=", "> /dev/sda")
DANGEROUS = (
    ("bash", "rm -rf"), ("bash", "sudo"), ("bash", "chmod 777"), ("bash", "curl.*\\|.*sh"), ("bash", "wget.*\\|.*sh"),
    ("write_file", "/etc/"), ("write_file", "/usr/"), ("edit_file", "/etc/"), ("edit_file", "/usr/"),
)
RISKY = ("rm ", "> /etc/", "chmod 777")
WRITERS = ("write_file", "edit_file")


def first_contained(text: Column, patterns) -> Column:
    """The first of some substrings that text has; null if none."""
    return F.coalesce(*[F.when(text.contains(p), F.lit(p)) for p in patterns])


def denied(command: Column) -> Column:
    return first_contained(command, DENIED)


def dangerous(tool: Column, subject: Column) -> Column:
    return F.coalesce(*[F.when((tool == t) & subject.contains(p), F.lit(p)) for t, p in DANGEROUS])


def outside(path: Column, root: str) -> Column:
    """Whether a path, taken from root, leaves it: absolute elsewhere, or with more .. than folders before."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    at = F.concat(F.lit("/"), F.array_join(walked, "/"))
    return (at != root.rstrip("/")) & ~at.startswith(root.rstrip("/") + "/")


def decide(calls: DataFrame, root: str = "/workspace") -> DataFrame:
    """calls (tool, command, path) with decision (deny, ask, allow) and reason: denials of shell commands before patterns, patterns before rules."""
    tool, command, path = F.col("tool"), F.coalesce("command", F.lit("")), F.coalesce("path", F.lit(""))
    subject = F.when(command != "", command).otherwise(path)
    no = F.when(tool == "bash", denied(command))
    pattern = dangerous(tool, subject)
    rule = F.when(tool.isin(*WRITERS) & outside(path, root), "Writing outside workspace").when((tool == "bash") & first_contained(command, RISKY).isNotNull(), "Potentially dangerous command")
    reason = F.coalesce(F.concat(F.lit("Blocked: '"), no, F.lit("' is on the deny list")), F.concat(F.lit("Operation matches dangerous pattern: "), pattern), rule)
    return calls.withColumn("decision", F.when(no.isNotNull(), "deny").when(reason.isNotNull(), "ask").otherwise("allow")).withColumn("reason", reason)
