"""Hashes that name things: content, cache keys, shards, projects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORK_SHARDS = 64


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def cache_key(file_hash: Column, text: Column) -> Column:
    """Key of an embedded text: changes with the file or with the text."""
    return F.sha2(F.concat(file_hash, F.lit("\x00"), text), 256)


def work_shard(task_type: Column, task_id: Column, shards: int = WORK_SHARDS) -> Column:
    """The first 8 bytes, as an unsigned number, of the SHA-256 of "type:id", modulo the number of shards."""
    first = F.conv(F.substring(F.sha2(F.concat(task_type, F.lit(":"), task_id), 256), 1, 16), 16, 10)
    return (first.cast("decimal(20,0)") % shards).cast("int")


def project_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def short_name(content: Column) -> Column:
    return F.substring(F.md5(content), 1, 8)


def provider_identity(provider: Column, url: Column, model: Column) -> Column:
    return F.concat_ws(":", provider, F.substring(F.sha2(url, 256), 1, 16), model)
