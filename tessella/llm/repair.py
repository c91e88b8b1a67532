"""Conversation structure repair: the cheapest edits that make the turns of a conversation alternate.

The roles of a repaired conversation begin as (system? (user assistant)+)? by their first letters. Edits of a turn: Keep
(0), Rerole to user or assistant (2), Delete (3; blank turns and duplicates must go); Insert an empty user or assistant
turn anywhere (2). A truncated turn that stays costs 1 more. The audit is the string of the edits' initials; of audits of
equal cost the least one counts.

Four states tell what a prefix of the repaired turns ends in: o (nothing yet), s, u, a. For each the fold carries the least
(cost, audit). At one place in the conversation two audits of equal cost are never the beginning of one another (further
letters would be inserts, which cost), so the least prefix leads to the least whole. An audit and its first state also give
the roles of what is reroled and inserted.

1. All turns are sorted in ranges over the whole table (ranking.ordered()), however long a conversation is.
2. Windows over digests of (role, text) find duplicates, in salted parts first.
3. Runs of at most CHUNK turns of a conversation are folded, from one start state if the run certainly is the first of its
   conversation, from all four if not; a second fold runs over the runs of a conversation.
4. The audit is applied to the turns as a sorted stream.

What stays in one task for one conversation is what the result asks for: its audit as one string, and its text for one
SHA-256, which is sequential; the text is streamed.

Null roles and texts are treated as one space. Null turns come first; ties in turn are ordered by role and text. Null
conversation ids are a conversation of their own. Repeated rows are duplicates. Further columns have no effect; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import discard, let, materialize, ship
from tessella.operators.ranking import SEQ, ordered

#: Turns of a run, as a power of two.
RUN_BITS = 12
#: Parts in which equal turns of a conversation are looked for at first.
PARTS = 64
#: A cost above that of all edits of a run.
FAR = 1 << 40
SPACES = " \t\n\x0b\x0c\r"
#: Pairs of neighbouring role initials that are in order.
LEGAL = ("su", "ua", "au")
STATES = ("o", "s", "u", "a")
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


# --- the fold ---


def _plus(state: Column, cost, letter: str) -> Column:
    return F.struct((state["c"] + cost).alias("c"), F.concat(state["a"], F.lit(letter)).alias("a"))


def _at(cost: int, audit: str = "") -> Column:
    return F.struct(F.lit(cost).cast("long").alias("c"), F.lit(audit).alias("a"))


def _vector(**states: Column) -> Column:
    return F.struct(*[states[x].alias(x) for x in STATES])


def _inserted(v: Column) -> Column:
    """v after any inserts (two at most: a third would be in a state that has been left)."""
    user = F.least(v["u"], *[_plus(v[x], 2, "I") for x in ("o", "s", "a")])
    return let(user, lambda u: _vector(o=v["o"], s=v["s"], u=u, a=F.least(v["a"], _plus(u, 2, "I"))))


def _step(v: Column, t: Column) -> Column:
    """v after the turn t (initial, forced, truncated) and any inserts."""
    stays = ~t["forced"]
    begins = F.least(v["o"], v["s"], v["a"])
    new = _vector(
        o=_plus(v["o"], 3, "D"),
        s=F.least(_plus(v["s"], 3, "D"), F.when(stays & (t["initial"] == "s"), _plus(v["o"], t["truncated"], "K"))),
        u=F.least(_plus(v["u"], 3, "D"), F.when(stays & (t["initial"] == "u"), _plus(begins, t["truncated"], "K")), F.when(stays, _plus(begins, t["truncated"] + 2, "R"))),
        a=F.least(_plus(v["a"], 3, "D"), F.when(stays & (t["initial"] == "a"), _plus(v["u"], t["truncated"], "K")), F.when(stays, _plus(v["u"], t["truncated"] + 2, "R"))),
    )
    return let(new, _inserted)


def _begin() -> Column:
    """The vector before the first turn."""
    return _vector(o=_at(0), s=_at(FAR), u=_at(2, "I"), a=_at(4, "II"))


def _only(state: str) -> Column:
    return _vector(**{x: _at(0 if x == state else FAR) for x in STATES})


def _then(v: Column, run: Column) -> Column:
    """v after a run: its one vector if it begins the conversation, else through its vector for each start state."""
    ends = {end: F.least(*[F.struct((v[x]["c"] + run[k][end]["c"]).alias("c"), F.concat(v[x]["a"], run[k][end]["a"]).alias("a")) for k, x in enumerate(STATES)]) for end in STATES}
    return F.when(F.size(run) == 1, run[0]).otherwise(_vector(**ends))


def _illegal(pairs: Column) -> Column:
    return F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL)))


# --- the operator ---


def flagged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, SEQ) without text, with initial and the first fault of each: blank, duplicate, truncated or null."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = turns.select("conv_id", "turn", SEQ, F.substring("role", 1, 1).alias("initial"), last.alias("last"), F.when(last != "", same).alias("same"))
    # Only the first of each part can be the first of all; what is not goes to a task of its own in the second window.
    spread = F.xxhash64(SEQ)
    part = F.when(F.col("same").isNull(), spread).otherwise(F.pmod(spread, F.lit(PARTS)))
    near = Window.partitionBy("conv_id", "same", part).orderBy(SEQ)
    rows = rows.withColumn("again", F.row_number().over(near) > 1)
    whole = Window.partitionBy("conv_id", "same", F.when(F.col("again") | F.col("same").isNull(), spread)).orderBy(SEQ)
    again = F.col("again") | (F.row_number().over(whole) > 1)
    fault = F.when(F.col("last") == "", "blank").when(again, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "turn", SEQ, "initial", fault.alias("fault"))


def audits(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of turns (conv_id, turn, role, text, SEQ)."""
    rows = flagged(turns)
    is_ = lambda kind: F.coalesce(F.col("fault") == kind, F.lit(False))
    turn = F.struct(SEQ, "initial", (is_("blank") | is_("duplicate")).alias("forced"), is_("truncated").cast("long").alias("truncated"))
    counts = [F.count(F.when(F.col("fault") == k, 1)).alias(k) for k in ("blank", "duplicate", "truncated")]
    runs = rows.groupBy("conv_id", F.shiftright(SEQ, RUN_BITS).alias("run")).agg(F.sort_array(F.collect_list(turn)).alias("t"), *counts)  # at most 2 ** RUN_BITS turns
    first = F.col("t")[0]
    # Only a conversation that crosses from the run before can begin at a run's very first row.
    starts = F.when(first[SEQ].bitwiseAND(F.lit((1 << RUN_BITS) - 1)) != 0, F.array(_begin())).otherwise(F.array(*map(_only, STATES)))
    letters = F.transform("t", lambda t: t["initial"])
    pairs = F.zip_with(F.slice(letters, 1, F.size(letters) - 1), F.slice(letters, 2, F.size(letters) - 1), lambda x, y: F.concat(x, y))
    folded = runs.select("conv_id", "run", "blank", "duplicate", "truncated", _illegal(pairs).cast("long").alias("illegal"), first["initial"].alias("head"), F.element_at(letters, -1).alias("tail"), F.transform(starts, lambda v: F.aggregate("t", v, _step)).alias("v"))
    gathered = folded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "head", "tail", "v"))).alias("r"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    seams = F.zip_with(F.slice("r", 1, F.size("r") - 1), F.slice("r", 2, F.size("r") - 1), lambda x, y: F.concat(x["tail"], y["head"]))
    end = F.aggregate("r", _begin(), lambda v, r: _then(v, r["v"]), lambda v: F.least(v["o"], v["a"]))
    solved = gathered.select("conv_id", "blank", "duplicate", "truncated", (F.col("illegal") + _illegal(seams)).alias("illegal"), end.alias("e"))
    spans = turns.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    met = solved.join(spans.withColumnRenamed("conv_id", "__conv"), F.col("conv_id").eqNullSafe(F.col("__conv")))
    return met.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("e.c").alias("cost"), F.col("e.a").alias("audit"))


def _apply(batches):
    """Sorted (conv_id, audit, role, text), a row with the audit before the turns of a conversation, to repaired turns."""
    import pyarrow as pa

    conv, audit, place, at, now = None, "", 0, 0, "o"
    for batch in batches:
        ids, found, roles, texts = (batch.column(k).to_pylist() for k in range(4))
        out = []

        def emit(edit, role, text):
            nonlocal place, now
            place, now = place + 1, role[:1]
            out.append((conv, place, edit, role, text))  # noqa: B023

        def insert():
            nonlocal at
            while audit[at : at + 1] == "I":
                at += 1
                emit("I", "assistant" if now == "u" else "user", "")

        for cid, letters, role, text in zip(ids, found, roles, texts, strict=True):
            if letters is not None:
                conv, audit, place, at, now = cid, letters, 0, 0, "o"
                insert()
                continue
            edit = audit[at]
            at += 1
            if edit != "D":
                emit(edit, role if edit == "K" else "assistant" if now == "u" else "user", text)
            insert()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv_id", "place", "edit", "role", "text"])


def apply_audits(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Repaired turns (conv_id, place from 1, edit K, R or I, role, text): each partition has whole conversations, one after
    the other and in order, so that a stream over it may go on without a shuffle."""
    none = F.lit(None).cast("string")
    heads = found.select("conv_id", F.lit(-1).cast("long").alias(SEQ), "audit", none.alias("role"), none.alias("text"))
    rows = heads.unionByName(turns.select("conv_id", SEQ, none.alias("audit"), "role", "text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", SEQ).select("conv_id", "audit", "role", "text").mapInArrow(_apply, "conv_id long, place long, edit string, role string, text string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts of audits(), repaired turns of apply_audits(), table behind them) of conversations (conv_id, turn, role, text).

    Rows of conversations must come from files, so that a task which runs again sees them in the same order.
    """
    ship(conversations.sparkSession)
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", "turn", space("role"), space("text"), F.monotonically_increasing_id().alias("__row"))
    turns = ordered(rows, "conv_id", F.col("turn").asc_nulls_first(), "role", "text", "__row").drop("__row")
    found = materialize(audits(turns), "audits")
    return found, apply_audits(turns, found), turns


def damage(conversations: DataFrame) -> DataFrame:
    """conversations with faults, by crc32("conv_id:turn") % 20: 0 drops a row, 1 empties its text, 2 takes the marks .!?
    out of it, 3 repeats the row, 4 makes its role user."""
    c = conversations.select("conv_id", "turn", *[F.coalesce(F.col(x), F.lit(" ")).alias(x) for x in ("role", "text")])
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    c = c.withColumn("kind", kind).where("kind <> 0")
    c = c.withColumns({"text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")), "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return c.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def digests(sorted_pieces: DataFrame, key: str, kind: str, separator: str) -> DataFrame:
    """(key, sha256) of the pieces (key, piece) of each key joined by separator; rows of a key must follow one another in a partition.

    The pieces are a stream: a key of any length needs no memory of its own.
    """

    def run(batches):
        import pyarrow as pa

        now, state, any_yet = None, None, False
        for batch in batches:
            out = []
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or k != now:
                    if any_yet:
                        out.append((now, state.hexdigest()))
                    now, state, any_yet = k, hashlib.sha256(), True
                else:
                    state.update(separator.encode())
                state.update(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string() if kind == "string" else pa.int64()), pa.array([x[1] for x in out], pa.string())], [key, "sha256"])
        if any_yet:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string() if kind == "string" else pa.int64()), pa.array([state.hexdigest()])], [key, "sha256"])

    return sorted_pieces.mapInArrow(run, f"{key} {kind}, sha256 string")


def op11(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found, repaired, turns = repair(damage(conversations))
    hashed = materialize(digests(repaired.select("conv_id", F.concat("role", F.lit(":"), "text").alias("piece")), "conv_id", "long", "\n"), "digests")
    discard(turns)
    met = conversations.select("conv_id").distinct()
    for right in (found, hashed):
        met = met.join(right.withColumnRenamed("conv_id", "__conv"), F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return met.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))


def crc32_sql(key: str) -> str:
    bits = f"flatten(list_transform(string_split({key}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce({bits}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT)"


_SP = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_ST = "{{'c': {0}::BIGINT, 'a': {1}, 'r': {2}}}"
_INS = lambda x, role: _ST.format(f"{x}.c + 2", f"{x}.a || 'I'", f"list_append({x}.r, '{role}:')")

#: Recursive SQL: one row of the fold for each turn; r is the repaired conversation of a state.
OP11_SQL = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM named WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged
), faults AS (
  SELECT *, substr(role, 1, 1) AS ini, right(rtrim(text, {_SP}), 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS next FROM placed
), flagged AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM faults
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (next IS NOT NULL AND ini || next NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM flagged GROUP BY conv_id
), fold(conv_id, pos, o, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {_ST.format(0, "''", "[]::VARCHAR[]")}, {_ST.format(FAR, "''", "[]::VARCHAR[]")}, {_ST.format(2, "'I'", "['user:']")}, {_ST.format(4, "'II'", "['user:', 'assistant:']")} FROM counted
  UNION ALL
  SELECT conv_id, pos, o, s, u, least(a, {_INS("u", "assistant")}) FROM (
    SELECT conv_id, pos, o, s, least(u, {_INS("o", "user")}, {_INS("s", "user")}, {_INS("a", "user")}) AS u, a FROM (
      SELECT f.conv_id, f.pos, {_ST.format("b.o.c + 3", "b.o.a || 'D'", "b.o.r")} AS o,
        least({_ST.format("b.s.c + 3", "b.s.a || 'D'", "b.s.r")}, CASE WHEN f.stays AND f.ini = 's' THEN {_ST.format("b.o.c + f.cut", "b.o.a || 'K'", "list_append(b.o.r, f.piece)")} END) AS s,
        least({_ST.format("b.u.c + 3", "b.u.a || 'D'", "b.u.r")}, CASE WHEN f.stays AND f.ini = 'u' THEN {_ST.format("b.g.c + f.cut", "b.g.a || 'K'", "list_append(b.g.r, f.piece)")} END,
          CASE WHEN f.stays THEN {_ST.format("b.g.c + f.cut + 2", "b.g.a || 'R'", "list_append(b.g.r, 'user:' || f.text)")} END) AS u,
        least({_ST.format("b.a.c + 3", "b.a.a || 'D'", "b.a.r")}, CASE WHEN f.stays AND f.ini = 'a' THEN {_ST.format("b.u.c + f.cut", "b.u.a || 'K'", "list_append(b.u.r, f.piece)")} END,
          CASE WHEN f.stays THEN {_ST.format("b.u.c + f.cut + 2", "b.u.a || 'R'", "list_append(b.u.r, 'assistant:' || f.text)")} END) AS a
      FROM (SELECT *, least(o, s, a) AS g FROM fold) b
      JOIN (SELECT conv_id, pos, ini, text, role || ':' || text AS piece, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM flagged) f
        ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.pos = b.pos + 1))
), ended AS (
  SELECT c.*, least(f.o, f.a) AS e FROM counted c JOIN fold f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.pos = c.n
)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost,
  coalesce(e.a, '') AS audit, sha256(coalesce(array_to_string(e.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM d.conv_id
"""
