"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Equal blocks get one integer name, found by sorting the
blocks themselves, so two different blocks never share a name. Adjacent names are then paired, equal pairs get
one integer name of the next level, and so on until each document has a single name. Documents with the same
number of blocks and the same last name have the same text: no hash is trusted anywhere.

The name of a block (pair) is the smallest position at which it occurs, as one integer. That makes it the same
whenever a stage runs again, so a lost executor cannot change names half-way.

Blocks that occur very often would fill one task of the sort-merge join. There are at most HOT_BLOCKS of them
by the way the threshold is chosen, whatever the input, so they are broadcast instead.

Nulls count as empty texts; an empty text is one empty block. A very long text is many blocks, one row each. Repeated
rows are rows of their own: one of them stays. Repeated or null ids are allowed. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import RID, ascii_lower, discard, materialize, number_rows

#: Bytes in a block.
BLOCK_BYTES = 4096
#: At most so many blocks are treated as hot: HOT_BLOCKS * BLOCK_BYTES bounds the broadcast (8 MB).
HOT_BLOCKS = 2000


def _position(rid: Column, idx: Column) -> Column:
    """One integer for a row and a place in it."""
    return rid.cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + idx.cast("decimal(10,0)")


def _blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """rows (RID, doc_id, text) as (RID, doc_id, n, idx, block, sha); sha only at idx 0."""
    body = rows.select(RID, "doc_id", ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("norm")).select(
        RID, "doc_id", F.encode("norm", "UTF-8").alias("body"), F.sha2(F.encode("norm", "UTF-8"), 256).alias("sha")
    )
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block_bytes)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes)))
    out = body.select(RID, "doc_id", "sha", n.alias("n"), F.posexplode(cut).alias("idx", "block"))
    return out.withColumn("sha", F.when(F.col("idx") == 0, F.col("sha")))


def _name_blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Level 0: (RID, doc_id, sha, n, idx, name)."""
    total = rows.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(F.col("text"), F.lit(""))) / block_bytes)))).first()[0] or 0
    often = max(100, int(total) // HOT_BLOCKS)
    blocks = _blocks(rows, block_bytes)
    names = blocks.groupBy("block").agg(F.min(_position(F.col(RID), F.col("idx"))).alias("name"), F.count(F.lit(1)).alias("times"))
    hot = names.where(F.col("times") > often).select(F.col("block").alias("hot_block"), F.col("name").alias("hot_name"))
    # A row whose block is hot has its name already: it carries no block on, and a second key of its own spreads it over
    # the tasks and matches nothing.
    apart = F.when(F.col("hot_name").isNull(), F.lit("")).otherwise(F.concat(F.col(RID).cast("string"), F.lit(":"), F.col("idx").cast("string")))
    left = blocks.join(F.broadcast(hot), F.col("block") == F.col("hot_block"), "left").select(
        RID, "doc_id", "sha", "n", "idx", "hot_name", F.when(F.col("hot_name").isNull(), F.col("block")).otherwise(F.lit(b"")).alias("key"), apart.alias("apart")
    )
    # Of names, only those of repeated blocks move on: a block that occurs once is named by its own position. The second key
    # is always empty here but no constant to the optimiser, so both keys deal the rows out, and as names is dealt anew by
    # them, adaptive execution can split what is left of skew.
    right = names.where(F.col("times") > 1).select(F.col("block").alias("key"), F.when(F.col("times") > 0, F.lit("")).otherwise(F.lit("-")).alias("apart"), "name")
    own = _position(F.col(RID), F.col("idx"))
    return left.join(right, ["key", "apart"], "left").select(RID, "doc_id", "sha", "n", "idx", F.coalesce("hot_name", "name", own).alias("name"))


def identities(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows (RID, doc_id, text) to (RID, doc_id, sha, n_blocks, name): equal (n_blocks, name) means equal text."""
    level = materialize(_name_blocks(rows, block_bytes).withColumn("n_blocks", F.col("n")), "names")
    done = level.where("n = 1").select(RID, "doc_id", "sha", "n_blocks", "name")
    while level.where("n > 1").limit(1).count():
        half = (F.col("idx") / 2).cast("int")
        pairs = materialize(
            level.where("n > 1")
            .groupBy(RID, half.alias("at"))
            .agg(
                F.max("doc_id").alias("doc_id"),
                F.max("sha").alias("sha"),
                F.max("n_blocks").alias("n_blocks"),
                F.ceil(F.max("n") / 2).cast("int").alias("n"),
                F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"),
                F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))).alias("b"),
            ),
            "pairs",
        )
        names = materialize(pairs.groupBy(F.col("a").alias("na"), F.col("b").alias("nb")).agg(F.min(_position(F.col(RID), F.col("at"))).alias("name")), "pair-names")
        met = pairs.join(names, F.col("a").eqNullSafe(F.col("na")) & F.col("b").eqNullSafe(F.col("nb")))
        level = materialize(met.select(RID, "doc_id", "sha", "n", F.col("at").alias("idx"), "name", "n_blocks"), "names")
        discard(pairs)
        discard(names)
        done = done.unionByName(level.where("n = 1").select(RID, "doc_id", "sha", "n_blocks", "name"))
    return done


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: RID, doc_id, keep_rid, keep_id, group_size, kept, text_sha256.

    Of equal texts (A-Z lower-cased), the row with the largest id stays; of those, the one with the largest row number.
    """
    rows = number_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return _grouped(identities(rows, block_bytes))


def _grouped(done: DataFrame) -> DataFrame:
    groups = materialize(
        done.groupBy(F.col("n_blocks").alias("g_blocks"), F.col("name").alias("g_name")).agg(
            F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", RID)).alias("keep")
        ),
        "groups",
    )
    met = done.join(groups, (F.col("n_blocks") == F.col("g_blocks")) & (F.col("name") == F.col("g_name")))
    return met.select(
        RID, "doc_id", F.col(f"keep.{RID}").alias("keep_rid"), F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col(f"keep.{RID}") == F.col(RID)).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows whose text another row that stays has; all columns as they were."""
    numbered = number_rows(docs, id_col)
    rows = numbered.select(RID, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kept = _grouped(identities(rows, block_bytes)).where("kept").select(RID)
    return numbered.join(kept, RID, "left_semi").drop(RID)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
