"""Strongly connected parts of a task graph, and one cycle of each, in rounds that grow with the logarithm of a chain.

Links are rows (blocker, id). Where each task has at most one next task, pointers are doubled: after k rounds a pointer spans
2 ** k links, so the end of a chain or the tasks of a ring are known after log2(tasks) rounds, whatever their length.

A round of components() first tries what is quick where ways are short: each task takes the largest name that leads to it, for
at most STEPS steps. If names settle, the tasks of one name that lead back to the task of that name are its part, and parts
go. Where ways are longer, the graph is made smaller:

1. Tasks from which every way leads, without a choice, to a task that blocks nothing are on no cycle, likewise those that
   are reached, without a choice, from one that nothing blocks. All of them go at once.
2. Each task that is left picks one dependent. The rings of these picks are parts of components: each is contracted to
   its smallest task.

After 1 every task has a dependent, so 2 finds a ring wherever links are left. Tables between the rounds are written to
the shared folder. Repeated links count once; a link of a task to itself is a ring.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.storage import discard, materialize


def _doubled(pairs: DataFrame) -> DataFrame:
    """(node, to, least): where pointers (node, to) lead after at least as many steps as there are pairs, null beyond an
    end; least is the smallest node on the way, which for a node of a ring is the ring's."""
    n = pairs.count()
    now = materialize(pairs.select("node", "to", F.col("node").alias("least")), "jump")
    span = 1
    while span < n:
        far = now.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("least").alias("more"))
        new = materialize(now.join(far, "to", "left").select("node", F.col("far").alias("to"), F.least("least", "more").alias("least")), "jump")
        discard(now)
        now, span = new, 2 * span
    return now


#: Steps in which names must settle, else the graph is contracted.
STEPS = 10


def _settled(links: DataFrame) -> DataFrame | None:
    """(node, name): parts of links, each with a name of its own (one task too); null if ways are longer than STEPS."""
    names = materialize(links.select(F.col("blocker").alias("node")).unionByName(links.select(F.col("id").alias("node"))).distinct().withColumn("name", F.col("node")), "names")
    for _ in range(STEPS):
        told = links.join(names.select(F.col("node").alias("blocker"), "name"), "blocker").groupBy(F.col("id").alias("node")).agg(F.max("name").alias("told"))
        new = materialize(names.join(told, "node", "left").select("node", F.greatest("name", "told").alias("name"), (F.col("told") > F.col("name")).alias("moved")), "names")
        discard(names)
        names = new.select("node", "name")
        if new.where("moved").isEmpty():
            break
    else:
        return None
    at = lambda c, n: names.select(F.col("node").alias(c), F.col("name").alias(n))
    inside = materialize(links.join(at("blocker", "name"), "blocker").join(at("id", "other"), "id").where("name = other").select("blocker", "id"), "inside")
    seen = open_ = materialize(names.where("node = name"), "seen")
    for _ in range(STEPS):
        new = inside.join(open_.select(F.col("node").alias("id"), "name"), "id").select(F.col("blocker").alias("node"), "name").distinct()
        open_ = materialize(new.join(seen.select("node"), "node", "left_anti"), "open")
        if open_.isEmpty():
            return seen
        seen = materialize(seen.unionByName(open_), "seen")
    return None


def _dead_ends(links: DataFrame, start: str, end: str) -> DataFrame:
    """(node): tasks from which all ways along start -> end, without a choice, lead to a task without a further one."""
    out = links.groupBy(F.col(start).alias("node")).agg(F.min(end).alias("to"), F.count(F.lit(1)).alias("ways"))
    single = materialize(out.where("ways = 1").select("node", "to"), "single")
    last = materialize(links.select(F.col(end).alias("node")).distinct().join(links.select(F.col(start).alias("node")), "node", "left_anti"), "last")
    # A chain ends at a last task or at one with a choice; the pointer of the latter leads to itself here.
    chain = single.join(links.select(F.col(start).alias("to")).distinct().join(single.select(F.col("node").alias("to")), "to", "left_anti").withColumn("choice", F.lit(True)), "to", "left")
    steps = chain.select("node", F.when(F.col("choice"), F.col("node")).otherwise(F.col("to")).alias("to"))
    gone = _doubled(steps.unionByName(last.select("node", F.lit(None).cast(dict(links.dtypes)[end]).alias("to"))))
    return gone.where("to is null").select("node")


def _rings(picks: DataFrame) -> DataFrame:
    """(node, ring) of the nodes that lie on a ring of pointers (node, to), by its smallest node."""
    far = _doubled(picks)
    on = far.where("to is not null").select(F.col("to").alias("node")).distinct()
    return far.join(on, "node").select("node", F.col("least").alias("ring"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of each task on a cycle: component is the smallest task of its strongly connected part."""
    kind = dict(links.dtypes)["id"]
    every = links.select("blocker", "id").where("blocker is not null and id is not null").distinct()
    own = materialize(every.where("blocker = id").select("id"), "own")
    now = materialize(every.where("blocker <> id"), "links")
    moves: list[DataFrame] = []
    while not now.isEmpty():
        if (parts := _settled(now)) is not None:
            least = materialize(parts.groupBy("name").agg(F.min("node").alias("ring"), F.count(F.lit(1)).alias("n")).where("n > 1").select("name", "ring"), "least")
            moves.append(materialize(parts.join(least, "name").select("node", "ring"), "rings"))
            left = now.join(parts.select(F.col("node").alias("blocker")), "blocker", "left_anti").join(parts.select(F.col("node").alias("id")), "id", "left_anti")
            now = materialize(left.select("blocker", "id"), "links")
            continue
        gone = _dead_ends(now, "blocker", "id").unionByName(_dead_ends(now, "id", "blocker")).distinct()
        gone = materialize(gone, "gone")
        left = now.join(gone.select(F.col("node").alias("blocker")), "blocker", "left_anti").join(gone.select(F.col("node").alias("id")), "id", "left_anti")
        left = materialize(left.select("blocker", "id"), "links")
        discard(now)
        # By hash, so that picks differ from round to round; a pick that leads out of its part costs a round, nothing else.
        turn = F.lit(len(moves))
        alive = left.join(left.select(F.col("blocker").alias("id")).distinct(), "id", "left_semi")
        picks = alive.groupBy(F.col("blocker").alias("node")).agg(F.min_by("id", F.struct(F.xxhash64("id", turn), "id")).alias("to"))
        rings = materialize(_rings(materialize(picks, "picks")), "rings")
        to = lambda c, name: rings.select(F.col("node").alias(c), F.col("ring").alias(name))
        met = left.join(to("blocker", "a"), "blocker", "left").join(to("id", "b"), "id", "left").select(F.coalesce("a", "blocker").alias("blocker"), F.coalesce("b", "id").alias("id"))
        now = materialize(met.where("blocker <> id").distinct(), "links")
        discard(left)
        moves.append(rings)
    if not moves:
        return own.select("id", F.col("id").alias("component"))
    # Each contraction names its ring by its smallest task, which is a name of a later one in turn.
    found = moves[-1].select(F.col("node").alias("id"), F.col("ring").alias("component"))
    for rings in moves[-2::-1]:
        later = found.select(F.col("id").alias("ring"), F.col("component").alias("c"))
        found = found.unionByName(rings.join(later, "ring", "left").select(F.col("node").alias("id"), F.coalesce("c", "ring").alias("component")))
    found = materialize(found.groupBy("id").agg(F.min("component").alias("component")).select(F.col("id").cast(kind), "component"), "found")
    least = materialize(found.groupBy("component").agg(F.min("id").alias("least")), "least")
    named = found.join(least, "component").select("id", F.col("least").alias("component"))
    alone = own.join(named.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return named.unionByName(alone)


def cycle_of_each(links: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(component, path): one cycle of each part (components()), from its smallest task back to it.

    Each task goes on to its smallest dependent within the part; the cycle is the one that this leads to from the smallest
    task of the part. Its order comes from doubled pointers with their lengths: a cycle of n tasks takes log2(n) rounds.
    """
    parts = materialize(components(links) if parts is None else parts, "parts")
    at = lambda c, name: parts.select(F.col("id").alias(c), F.col("component").alias(name))
    inside = links.select("blocker", "id").join(at("blocker", "component"), "blocker").join(at("id", "other"), "id").where("component = other")
    picks = materialize(inside.groupBy("component", F.col("blocker").alias("node")).agg(F.min("id").alias("to")), "picks")
    far = materialize(_doubled(picks.select("node", "to")), "far")
    first = parts.where("id = component").join(far.select(F.col("node").alias("id"), F.col("to").alias("on")), "id")
    chosen = first.join(far.select(F.col("node").alias("on"), F.col("least").alias("ring")), "on").select("component", "ring")
    chosen = materialize(chosen, "chosen")
    on = far.where("to is not null").select(F.col("to").alias("node")).distinct()
    ring = picks.join(on, "node").join(far.select("node", F.col("least").alias("ring")), "node").join(chosen, ["component", "ring"])
    # Cut before the smallest task, a ring is a line: the steps to its end give the order.
    steps = materialize(ring.select("component", "node", F.when(F.col("to") == F.col("ring"), F.lit(None)).otherwise(F.col("to")).alias("to"), F.when(F.col("to") == F.col("ring"), 0).otherwise(1).cast("long").alias("steps")), "steps")
    n, span = steps.count(), 1
    while span < n:
        ahead = steps.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"))
        new = materialize(steps.join(ahead, "to", "left").select("component", "node", F.col("far").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "steps")
        discard(steps)
        steps, span = new, 2 * span
    nodes = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("s"), "node"))), lambda x: x["node"])
    return steps.groupBy("component").agg(nodes.alias("p")).select("component", F.array_append("p", F.get("p", F.lit(0))).alias("path"))
