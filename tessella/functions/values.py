"""Vectors, JSON objects, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys whose values are not logged.
SENSITIVE = ("api_key", "authorization", "command", "content", "prompt")
CONTEXT_FIELDS = ("service", "runtime_id", "agent_card_id", "agent_card_version", "thread_id", "task_id", "execution_id", "attempt", "event_id", "correlation_id")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 if one has no length."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(_dot(a, b) / norms)


def valid_vector(v: Column, dimension: int) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dimension) & finite


def json_merge(old: Column, new: dict[str, Column]) -> Column:
    """A JSON object of strings with some keys set; the right side wins, null counts as {}."""
    was = F.from_json(F.coalesce(old, F.lit("{}")), "map<string,string>")
    kept = F.map_filter(was, lambda k, _: ~k.isin(*new))
    return F.to_json(F.map_concat(kept, F.create_map(*[x for k, v in new.items() for x in (F.lit(k), v)])))


def redact(fields: Column) -> Column:
    """A map of strings with sensitive values hidden."""
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE), F.lit("***redacted***")).otherwise(v))


def after_seconds(at: Column, seconds: Column) -> Column:
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def backoff_seconds(retries: Column, base: float = 1.0, most: int = 10) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), F.least(retries, F.lit(most)))


def capped_backoff(attempt: Column, base: float = 1.0, factor: float = 2.0, cap: float = 60.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt), F.lit(cap))


def iso_millis(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
