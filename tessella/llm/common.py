"""What the operators of this package share: shared storage, row numbers, text expressions."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.storage import discard, materialize, new_path, scratch, shared_dir  # noqa: F401  used by the operators

#: ASCII white space that separates words, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]"
#: A word of a text.
WORD = r"[^\x20\x09-\x0D]+"
#: The number of a row inside an operator.
RID = "__tsl_rid"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_tessella_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if not os.path.isdir(os.path.join(top, "tessella")):  # already inside a zip
        return
    out = os.path.join(tempfile.mkdtemp(prefix="tessella-code-"), "tessella_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "tessella")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(out)
    sc._tessella_shipped = True


def number_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with RID, a long that is different for every row and the same whenever the plan runs again.

    It is the id itself where no id is null or repeated; else the rows are written once with a generated number.
    """
    n, ids, distinct = docs.agg(F.count(F.lit(1)), F.count(id_col), F.count_distinct(F.col(id_col))).first()
    if n == ids == distinct:
        return docs.withColumn(RID, F.col(id_col).cast("long"))
    return materialize(docs.withColumn(RID, F.monotonically_increasing_id()), "rows")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does that for texts of ASCII alone, and much faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def read_documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
