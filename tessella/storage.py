"""Tables between the steps of an operator: in the folder that driver and executors share, never on an executor's disk."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (local runs)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tessella/{label}-{uuid.uuid4().hex}"


_open: list[Scratch] = []


class Scratch:
    """The tables that materialize() makes while it is open; they are deleted when it closes, but for those to keep()."""

    def __init__(self):
        self.paths: dict[str, tuple[SparkSession, str]] = {}  # by the last part of the path, which is unique

    def add(self, spark: SparkSession, path: str) -> None:
        self.paths[os.path.basename(path)] = (spark, path)

    def keep(self, df: DataFrame) -> None:
        for f in df.inputFiles():
            self.paths.pop(os.path.basename(os.path.dirname(f)), None)

    def __enter__(self) -> Scratch:
        _open.append(self)
        return self

    def __exit__(self, *_) -> None:
        _open.remove(self)
        for at in self.paths.values():
            _delete(*at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch() -> Scratch:
    return Scratch()


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Writes df to the shared folder and reads it back: later jobs neither recompute it nor depend on an executor's disk."""
    spark = df.sparkSession
    path = new_path(spark, label)
    for s in _open:
        s.add(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables made by materialize() that no later plan reads."""
    for df in tables:
        for name in {os.path.dirname(f) for f in df.inputFiles()}:
            if "/tessella/" in name:
                _delete(df.sparkSession, name)
