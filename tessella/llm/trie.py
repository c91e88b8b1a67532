"""Prefix trie of conversations by partition refinement.

A node of depth d is a distinct sequence of d turns; its members are the conversations that begin with it. All
conversations are one class at first, the root. Each round splits the active classes by their members' next turn: a class
of several members stays active, a class of one is retired, and its remaining turns are emitted at once as a chain of nodes
with one child each. So a round costs time in proportion to the turns that several conversations still share, and there
are as many rounds as the longest shared beginning has turns. Then the values of subtrees are folded back, from the
deepest level to the root; a retired class counts as one leaf.

A turn is known by the SHA-256 of its role and text: texts move once, to be ordered. A class is known by its smallest
member. Turns are numbered in ranges over the whole table (ranking.placed()); the table that the rounds read is sorted by
depth, so that a round reads its own turns. Class sizes are partial sums before they move, and the joins of members with
classes have a written table on one side, so a first turn that a third of all conversations share is dealt out.

Null roles and texts are empty; null turns come first, ties in turn are ordered by role and text; repeated rows are turns
of their own. Rows with a null conversation id belong to no conversation. Further columns have no effect; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD, discard, materialize, new_path, ship
from tessella.llm.repair import EMPTY_SHA256, crc32_sql, digests
from tessella.operators.ranking import SEQ, ordered, placed

#: Conversations that are rebuilt from one, and the turns that they may take from it, less one.
FAMILY, HEADS = 20, 4

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, name, words) of each turn, as a table; name is the digest of role and text."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text"), F.monotonically_increasing_id().alias("__row"))
    table = ordered(rows, "conv_id", F.col("turn").asc_nulls_first(), "role", "text", "__row")
    name = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    out = materialize(placed(table.select("conv_id", SEQ, name.alias("name"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), ["conv_id"], "pos"), "turns")
    discard(table)
    return out


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations (conv_id, len)) where each conversation c begins with the first h turns of conversation
    c - c % family (as many as it has, none if it is absent) and goes on with its own after its first h; h = crc32(c) % heads."""
    lens = materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len")), "lens")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    plan = lens.select("conv_id", "len", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    plan = plan.join(lens.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len")), "base", "left").withColumn("lead", F.least("h", F.coalesce("base_len", F.lit(0))))
    plan = materialize(plan.select("conv_id", "base", "h", "lead", (F.col("lead") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("len")), "plan")
    own = turns.join(plan, "conv_id").where("pos > h").select("conv_id", (F.col("lead") + F.col("pos") - F.col("h")).alias("pos"), "name", "words")
    first = turns.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base")
    taken = plan.where("lead > 0").join(first, "base").where("pos <= lead").select("conv_id", "pos", "name", "words")
    return own.unionByName(taken), plan.select("conv_id", "len")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes (NODES) of conversations (conv_id, len) with turns (conv_id, pos from 1 to len, name, words).

    A node's conv_id is its smallest member, n_leaves and saved_tokens are those of its subtree (tokens of its last turn for
    each member but one), ends_sha256 hashes the ids of the conversations that end there.
    """
    spark = turns.sparkSession
    n, least = conversations.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    if not n:
        return spark.createDataFrame([], NODES)
    ship(spark)
    by_depth = materialize(turns.select("pos", "conv_id", "name", "words").repartitionByRange("pos", "conv_id").sortWithinPartitions("pos", "conv_id"), "by_depth")
    classes, members, folded = (new_path(spark, x) for x in ("classes", "members", "folded"))
    read = lambda path, schema, d=None: spark.read.schema(schema).parquet(path if d is None else f"{path}/depth={d}")
    class_schema, member_schema, fold_schema = "parent long, name binary, node long, n long, words long", "conv_id long, len long, node long", "node long, parent long, n long, n_children long, leaves long, saved long"

    spark.createDataFrame([(None, None, least, n, 0)], class_schema).coalesce(1).write.parquet(f"{classes}/depth=0")
    conversations.select("conv_id", F.col("len").cast("long").alias("len"), F.lit(least).cast("long").alias("node")).write.parquet(f"{members}/depth=0")
    depth = 0
    while True:  # splits the active classes of this depth
        active = read(members, member_schema, depth).where(F.col("len") > depth)
        now = active.join(by_depth.where(F.col("pos") == depth + 1).select("conv_id", "name", "words"), "conv_id")
        now.groupBy(F.col("node").alias("parent"), "name").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words")).write.parquet(f"{classes}/depth={depth + 1}")
        several = read(classes, class_schema, depth + 1).where("n > 1")
        if several.isEmpty():
            break
        split = several.select(F.col("parent").alias("node"), "name", F.col("node").alias("child"))
        now.join(split, ["node", "name"]).select("conv_id", "len", F.col("child").alias("node")).write.parquet(f"{members}/depth={depth + 1}")
        depth += 1

    for d in range(depth, -1, -1):  # folds the classes of several members back; retired ones are a leaf each and save nothing
        kids = read(classes, class_schema, d + 1).select(F.col("parent").alias("of"), "node")
        if d < depth:
            kids = kids.join(read(folded, fold_schema, d + 1).select("node", "leaves", "saved"), "node", "left")
        else:
            kids = kids.withColumns({"leaves": F.lit(None).cast("long"), "saved": F.lit(None).cast("long")})
        below = kids.groupBy("of").agg(F.count(F.lit(1)).alias("n_children"), F.sum(F.coalesce("leaves", F.lit(1))).alias("leaves"), F.sum(F.coalesce("saved", F.lit(0))).alias("saved"))
        here = read(classes, class_schema, d).where("n > 1 or parent is null")
        met = here.join(below, here["node"] == below["of"], "left")
        met.select("node", "parent", "n", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("leaves"), ((F.col("n") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))).alias("saved")).write.parquet(f"{folded}/depth={d}")

    ends = read(members, f"{member_schema}, depth long").where("len = depth")
    place = lambda c: F.concat_ws(":", "depth", c).alias("at")
    # A node's ids are a sorted stream: no list of them is ever whole in memory.
    rows = ends.select(place("node"), "conv_id").repartition("at").sortWithinPartitions("at", "conv_id").select("at", F.col("conv_id").cast("string").alias("piece"))
    hashed = materialize(digests(rows, "at", "string", ","), "ends")
    inner = read(folded, f"{fold_schema}, depth long").withColumn("at", place("node")).join(hashed, "at", "left")
    inner = inner.select(F.col("node").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
    retired = read(classes, f"{class_schema}, depth long").where("n = 1 and parent is not null").select(F.col("node").alias("conv_id"), "depth", "parent").join(conversations, "conv_id")
    tails = by_depth.select("conv_id", "pos").join(materialize(retired, "retired"), "conv_id").where("pos >= depth")
    last, zero = F.col("pos") == F.col("len"), F.lit(0).cast("long")
    chains = tails.select(
        "conv_id", F.col("pos").cast("long").alias("depth"), F.when(F.col("pos") == F.col("depth"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(last, zero).otherwise(zero + 1).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
    return inner.unionByName(chains)


def op12(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP12_SQL = f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), lens AS (
  SELECT conv_id, count(*) AS len, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {HEADS} AS h FROM t GROUP BY conv_id
), plan AS (
  SELECT a.conv_id, a.conv_id - a.conv_id % {FAMILY} AS base, a.h, least(a.h, coalesce(b.len, 0)) AS lead FROM lens a LEFT JOIN lens b ON b.conv_id = a.conv_id - a.conv_id % {FAMILY}
), r AS (
  SELECT conv_id, lead + pos - h AS pos, role, text FROM t JOIN plan USING (conv_id) WHERE pos > h
  UNION ALL SELECT plan.conv_id, pos, role, text FROM plan JOIN t ON t.conv_id = plan.base WHERE pos <= lead
), p AS (
  SELECT conv_id, 0 AS d, '' AS k, 0 AS w FROM plan
  UNION ALL SELECT conv_id, pos, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY pos)), len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) FROM r
), node AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, max(w) AS w FROM p GROUP BY d, k
), linked AS (
  SELECT node.*, up.conv_id AS parent FROM node LEFT JOIN p ON p.conv_id = node.conv_id AND p.d = node.d - 1 LEFT JOIN node up ON up.d = p.d AND up.k = p.k
), kids AS (
  SELECT d - 1 AS d, parent AS conv_id, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY d, parent
), full_nodes AS (
  SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN kids USING (d, conv_id)
), subtree AS (
  SELECT p.d, p.k, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n - 1) * f.w) AS saved FROM full_nodes f JOIN p ON p.conv_id = f.conv_id AND p.d <= f.d GROUP BY p.d, p.k
), ends AS (
  SELECT d, k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS len FROM p) WHERE d = len GROUP BY d, k
)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, f.parent AS parent_conv_id, f.n AS n_convs, f.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM full_nodes f JOIN subtree s USING (d, k) LEFT JOIN ends e USING (d, k)
"""
