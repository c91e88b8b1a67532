"""Places in lines of any length: no line is one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.storage import materialize

#: The number of a row of ordered(): rises with the order over the whole table, without being dense.
SEQ = "__tsl_seq"
#: Lower bits of SEQ, which count the rows of one range.
RANGE_BITS = 33


def ordered(df: DataFrame, *order: str | Column) -> DataFrame:
    """df as a table with SEQ, dealt out in ranges of the order.

    The order must tell all rows apart: a range then has the same rows whenever a task runs again, and a value that
    half of all rows share is cut into as many ranges as any other rows.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return materialize(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn(SEQ, F.monotonically_increasing_id()), "ordered")


def placed(table: DataFrame, line: list[str], name: str = "place") -> DataFrame:
    """A table of ordered(), whose order began with the columns of line, with each row's place in its line (long, from 1).

    The rows of a line are counted for each range; the sums of the ranges before are added to a row's number in its own
    range. Counting is dealt out however long a line is; what meets in one task are the counts of a line, one for each
    range. Null lines are a line of their own.
    """
    rows = table.withColumn("__run", F.shiftright(SEQ, RANGE_BITS))
    runs = rows.groupBy(*line, "__run").agg(F.min(SEQ).alias("__lo"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*line).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    # Written, so that adaptive execution can split the join's other side.
    runs = materialize(runs.select(*[F.col(c).alias(f"__l{i}") for i, c in enumerate(line)], F.col("__run").alias("__r"), (F.coalesce(before, F.lit(0)) - F.col("__lo") + 1).alias("__add")), "runs")
    same = F.col("__run") == F.col("__r")
    for i, c in enumerate(line):
        same &= F.col(c).eqNullSafe(F.col(f"__l{i}"))
    return rows.join(runs, same).select(*[c for c in table.columns if c != SEQ], (F.col(SEQ) + F.col("__add")).alias(name))


def numbered(df: DataFrame, line: list[str], order: list[str | Column], name: str = "place") -> DataFrame:
    """df with each row's place in its line; the order must tell the rows of a line apart."""
    return placed(ordered(df, *line, *order), line, name)
