"""Mixing sources to target weights by iterative proportional fitting.

The tokens of all documents are summed in cells (source, language, topic). The cells' weights are raked: scaled
to the target share of each source, then of each language, then of each topic, again and again until all three
hold. A cell's factor is its raked weight over its tokens; a document is kept with probability factor / largest
factor, so that the kept tokens have the target shares in expectation. Whether it is kept depends on its id and
the seed alone: the same documents are kept whatever the partitions, and when a task runs again.

Targets are given as shares by value (for each dimension a dict or a table of value and share), or as a power:
share ~ natural share ** power (1: as it is, 0: uniform). However many values and cells there are, raking ends by the
same rule; up to MAX_CELLS cells are raked on the driver, more as a table.
Values without a target get none of the weight; a target of a value that does not occur is spread over the rest.

Null texts count as empty. A null source or language is a value of its own ("" in the cells). Documents without
tokens have the probability of their cell; if the cell has no tokens at all, 1. Repeated rows are decided alike.
No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD, discard, materialize

#: Cells that are raked on the driver and broadcast (some 10 MB); more are raked as a table.
MAX_CELLS = 100_000
#: Rounds of raking at most, and the largest relative error of a share at which it stops.
ROUNDS, ERROR = 200, 1e-10
#: Targets of the query: each natural share to this power.
POWER = 0.9
SEED = "mix-1"
DIMS = ("source", "lang", "topic")


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def topic_of(tokens: Column) -> Column:
    """The tables have no topic; a class by length stands in for one."""
    return F.when(tokens < 150, "note").when(tokens < 600, "article").when(tokens < 2500, "report").otherwise("book")


def target_tables(cells: DataFrame, targets: dict | None, power: float = POWER) -> dict[str, DataFrame]:
    """(value, share) of the values with tokens of each dimension, summing to 1: as given (a dict or such a table by
    dimension), without targets by power."""
    spark, out = cells.sparkSession, {}
    for d in DIMS:
        natural = cells.where("tokens > 0").groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("t"))
        if targets is None:
            raised = natural.select("value", F.pow(F.col("t") / F.lit(float(natural.agg(F.sum("t")).first()[0] or 1)), F.lit(power)).alias("share"))
        else:
            given = targets[d] if isinstance(targets[d], DataFrame) else spark.createDataFrame(list(targets[d].items()), "value string, share double")
            raised = natural.join(given, "value", "left").select("value", F.coalesce("share", F.lit(0.0)).alias("share"))
        raised = materialize(raised, f"targets-{d}")
        out[d] = raised.withColumn("share", F.col("share") / F.lit(raised.agg(F.sum("share")).first()[0] or 1.0))
    return out


def rake(cells: list[tuple], targets: dict[str, dict[str, float]], rounds: int = ROUNDS, error: float = ERROR) -> list[float]:
    """Weights of cells (source, lang, topic, tokens), summing to 1, with the target shares."""
    w = [float(c[3]) for c in cells]
    share = []
    for k, d in enumerate(DIMS):
        present = {c[k] for c in cells if c[3] > 0}
        whole = sum(v for x, v in targets[d].items() if x in present) or 1.0
        share.append({x: targets[d].get(x, 0.0) / whole for x in present})
    for _ in range(rounds):
        worst = 0.0
        for k in range(len(DIMS)):
            have: dict = {}
            for c, x in zip(cells, w, strict=True):
                have[c[k]] = have.get(c[k], 0.0) + x
            scale = {x: share[k].get(x, 0.0) / v if v else 0.0 for x, v in have.items()}
            worst = max([worst, *(abs(s - 1) for x, s in scale.items() if have[x])])
            w = [x * scale[c[k]] for c, x in zip(cells, w, strict=True)]
        if worst < error:
            break
    return w


def _rake_table(cells: DataFrame, targets: dict | None, rounds: int = ROUNDS, error: float = ERROR, power: float = POWER) -> DataFrame:
    """rake() over a table of many cells, with its rule to stop: sums by value and joins, written each round."""
    tables = target_tables(cells, targets, power)
    now = cells.withColumn("w", F.col("tokens").cast("double"))
    for i in range(rounds):
        last, now = now, now.withColumn("off", F.lit(0.0))
        for d in DIMS:
            have = now.groupBy(d).agg(F.sum("w").alias("have")).join(tables[d].withColumnRenamed("value", d), d, "left")
            scale = have.select(d, F.when(F.col("have") > 0, F.coalesce(F.col("share") / F.col("have"), F.lit(0.0))).alias("scale"))
            now = now.join(scale, d, "left").withColumns({"w": F.col("w") * F.coalesce("scale", F.lit(0.0)), "off": F.greatest("off", F.abs(F.col("scale") - 1))}).drop("scale")
        now = materialize(now, "raked")
        if i:
            discard(last)
        if (now.agg(F.max("off")).first()[0] or 0.0) < error:
            break
    return now.drop("off")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None) -> DataFrame:
    """docs with the columns that mixing adds, under names of its own."""
    tokens = docs.withColumn("__mix_tokens", token_count(F.col(text_col)))
    return (
        tokens.withColumn("__mix_source", F.coalesce(F.col(source_col).cast("string"), F.lit("")))
        .withColumn("__mix_lang", F.coalesce(F.col(lang_col).cast("string"), F.lit("")))
        .withColumn("__mix_topic", topic if topic is not None else topic_of(F.col("__mix_tokens")))
    )


def chance(id_column: Column, seed: str) -> Column:
    """A number in [0, 1) from the id and the seed."""
    digits = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(id_column.cast("string"), F.lit(""))), 256), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**12))


def mix(docs: DataFrame, targets: dict | None = None, power: float = POWER, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> DataFrame:
    """docs with __mix_tokens, __mix_source, __mix_lang, __mix_topic, __mix_weight (factor), __mix_p and __mix_kept."""
    spark = docs.sparkSession
    rows = _keyed(docs, id_col, text_col, source_col, lang_col, topic)
    cells = materialize(
        rows.groupBy(F.col("__mix_source").alias("source"), F.col("__mix_lang").alias("lang"), F.col("__mix_topic").alias("topic")).agg(F.sum("__mix_tokens").alias("tokens")), "cells"
    )
    targets = targets or None
    few = cells.limit(MAX_CELLS + 1).count() <= MAX_CELLS
    if few:
        got = [tuple(r) for r in cells.select(*DIMS, "tokens").collect()]
        shares = {d: dict(t.collect()) for d, t in target_tables(cells, targets, power).items()}
        whole = sum(c[3] for c in got) or 1
        factor = [(*c[:3], w / (c[3] / whole) if c[3] else 1.0) for c, w in zip(got, rake(got, shares), strict=True)]
        factors = spark.createDataFrame(factor, "source string, lang string, topic string, factor double")
        top = max([f[3] for f in factor], default=1.0) or 1.0
    else:
        whole = cells.agg(F.sum("tokens")).first()[0]
        factors = _rake_table(cells, targets, power=power).select(*DIMS, F.when(F.col("tokens") > 0, F.col("w") / (F.col("tokens") / F.lit(whole))).otherwise(1.0).alias("factor"))
        top = factors.agg(F.max("factor")).first()[0] or 1.0
    factors = factors.select(*[F.col(d).alias(f"__cell_{d}") for d in DIMS], "factor")
    joined = rows.join(F.broadcast(factors) if few else factors, [F.col(f"__mix_{d}") == F.col(f"__cell_{d}") for d in DIMS])
    p = F.least(F.col("factor") / F.lit(top), F.lit(1.0))
    out = joined.withColumn("__mix_weight", F.col("factor")).withColumn("__mix_p", p).withColumn("__mix_kept", chance(F.col(id_col), seed) < p)
    return out.drop("factor", *[f"__cell_{d}" for d in DIMS])


def sample(docs: DataFrame, **options) -> DataFrame:
    """The documents that mix() keeps, with the columns of docs."""
    return mix(docs, **options).where("__mix_kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return mix(docs).select(
        "doc_id", F.col("__mix_source").alias("source"), F.col("__mix_lang").alias("lang"), F.col("__mix_topic").alias("topic"), F.col("__mix_tokens").alias("n_tokens"),
        F.round("__mix_weight", 6).alias("weight"), F.round("__mix_p", 6).alias("probability"), F.col("__mix_kept").alias("kept"),
    )


def mixed_sql(table: str) -> str:
    """DuckDB SQL that decides on the rows of table: doc_id, source, lang, topic, n_tokens, weight, probability, kept (unrounded)."""
    step = "SELECT it, source, lang, topic, t, w * s / sum(w) OVER (PARTITION BY it, {d}) AS w FROM ({inner}) JOIN (SELECT {d}, s FROM share_{d}) USING ({d})"
    share = "share_{d} AS (SELECT {d}, pow(x, {p}) / sum(pow(x, {p})) OVER () AS s FROM (SELECT {d}, sum(t) / (SELECT sum(t) FROM cells) AS x FROM cells GROUP BY {d}))"
    inner = "SELECT it + 1 AS it, source, lang, topic, t, w FROM ipf WHERE it < 60"
    for d in DIMS:
        inner = step.format(d=d, inner=inner)
    return f"""
WITH RECURSIVE c AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS t FROM {table}),
k AS (SELECT *, CASE WHEN t < 150 THEN 'note' WHEN t < 600 THEN 'article' WHEN t < 2500 THEN 'report' ELSE 'book' END AS topic FROM c),
cells AS (SELECT source, lang, topic, CAST(sum(t) AS DOUBLE) AS t FROM k GROUP BY source, lang, topic),
{", ".join(share.format(d=d, p=POWER) for d in DIMS)},
ipf AS (SELECT 0 AS it, source, lang, topic, t, t AS w FROM cells UNION ALL {inner}),
f AS (SELECT source, lang, topic, w / (t / (SELECT sum(t) FROM cells)) AS factor FROM ipf WHERE it = 60),
d AS (SELECT k.doc_id, k.source, k.lang, k.topic, k.t AS n_tokens, factor AS weight, factor / (SELECT max(factor) FROM f) AS probability,
        CAST('0x' || substr(sha256('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) / {float(16**12)} AS u
      FROM k JOIN f USING (source, lang, topic))
SELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, weight, probability, u < probability AS kept FROM d
"""


OP10_SQL = f"SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability, kept FROM ({mixed_sql('documents')})"
