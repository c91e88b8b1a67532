"""What changed in a working tree: the output of `git status --porcelain=v1 -z`, and paths given by hand."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession

from tessella.operators.graph import EXTENSIONS


def status_paths(output: str) -> list[str]:
    """Changed source files of a status, both sides of a rename or copy, sorted."""
    found, fields = set(), iter(output.split("\0"))
    for field in fields:
        if not field:
            continue
        paths = [field[3:]]
        if set(field[:2]) & set("RC"):
            paths.append(next(fields, ""))
        found |= {posixpath.normpath(p.replace("\\", "/")) for p in paths if p}
    return sorted(p for p in found if posixpath.splitext(p)[1].lower() in EXTENSIONS)


def inside(root: str, paths: list[str], absolute: bool = True) -> list[str]:
    """Paths relative to root, each once, sorted; a path outside root (or an absolute one where none is allowed) is an error."""
    out, top = set(), posixpath.normpath(root)
    for p in paths:
        if posixpath.isabs(p) and not absolute:
            raise ValueError(f"path must be relative: {p}")
        full = posixpath.normpath(posixpath.join(top, p))
        if full != top and not full.startswith(top.rstrip("/") + "/"):
            raise ValueError(f"path is outside the project: {p}")
        out.add(posixpath.relpath(full, top))
    return sorted(out)


def as_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Changed paths for impact queries; none gives an empty table."""
    return spark.createDataFrame([(p,) for p in paths], "path string")
