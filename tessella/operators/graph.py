"""Operators on a property graph: nodes (qualified_name, ...) and edges (source_qualified, target_qualified, kind, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import cycles
from tessella.storage import materialize

#: Edge kinds that each relation follows.
RELATIONS = {
    "callers_of": ("CALLS",), "callees_of": ("CALLS",), "importers_of": ("IMPORTS",), "inheritors_of": ("INHERITS",),
    "references_to": ("REFERENCES",), "tests_for": ("CALLS", "REFERENCES"), "children_of": (),
}
IMPACT_KINDS = ("CALLS", "IMPORTS", "INHERITS", "REFERENCES")
#: File suffixes and their languages.
EXTENSIONS = {".py": "python", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hh": "cpp", ".hpp": "cpp"}


def resolve_target(nodes: DataFrame, target: str) -> tuple[str | None, str | None, list[str]]:
    """(qualified name, error, candidates): the exact qualified name, else the only node of that name; all candidates of an
    ambiguous one."""
    if nodes.where(F.col("qualified_name") == target).limit(1).count():
        return target, None, []
    names = [r[0] for r in nodes.where(F.col("name") == target).select("qualified_name").orderBy("qualified_name").collect()]
    if len(names) == 1:
        return names[0], None, []
    return None, "ambiguous_target" if names else "target_not_found", names


def related(nodes: DataFrame, edges: DataFrame, relation: str, qualified: str, limit: int = 20) -> DataFrame:
    """Nodes in a relation to a node, by name; the limit counts different names, before names without a node drop out."""
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation: {relation}")
    if relation == "children_of":
        return nodes.where(F.col("parent_qualified") == qualified).orderBy("qualified_name").limit(limit)
    here, there = ("source_qualified", "target_qualified") if relation == "callees_of" else ("target_qualified", "source_qualified")
    found = edges.where((F.col(here) == qualified) & F.col("kind").isin(*RELATIONS[relation])).select(F.col(there).alias("qualified_name"))
    if relation == "callees_of":
        found = found.where(F.col("qualified_name").isNotNull())
    if relation == "tests_for":
        found = found.join(nodes.where("is_test").select("qualified_name"), "qualified_name", "left_semi")
    few = found.distinct().orderBy("qualified_name").limit(limit)
    return nodes.join(F.broadcast(few), "qualified_name", "left_semi").orderBy("qualified_name")  # limit names at most


def indegree(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """Nodes with most incoming edges other than CONTAINS."""
    counts = edges.where((F.col("kind") != "CONTAINS") & F.col("target_qualified").isNotNull()).groupBy(F.col("target_qualified").alias("qualified_name")).agg(F.count(F.lit(1)).alias("indegree"))
    return nodes.join(counts, "qualified_name").orderBy(F.desc("indegree"), "qualified_name").limit(limit)


def count_by(df: DataFrame, column: str, section: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("count")).select(F.lit(section).alias("section"), "key", "count")


def top_directories(files: DataFrame) -> DataFrame:
    """Files under each first directory; files without a directory do not count."""
    return files.where(F.size(F.split("path", "/")) > 1).groupBy(F.split("path", "/")[0].alias("key")).agg(F.count(F.lit(1)).alias("count"))


def overview(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, key, count): languages, first directories, kinds of nodes and edges, symbols of tests."""
    tests = nodes.where("is_test and kind <> 'file'").agg(F.count(F.lit(1)).alias("count")).select(F.lit("test_symbols").alias("section"), F.lit("").alias("key"), "count")
    parts = [count_by(files, "language", "languages"), top_directories(files).select(F.lit("top_level_directories").alias("section"), "key", "count"), count_by(nodes, "kind", "nodes"), count_by(edges, "kind", "edges"), tests]
    return reduce(DataFrame.unionByName, parts)


def resolve_edges(edges: DataFrame, nodes: DataFrame, edge_key: str = "id") -> DataFrame:
    """edges with target_qualified: the exact name, else for other kinds than IMPORTS the only node of that name in the
    same file and parent, else in the same file, else anywhere. Only a name's candidates meet an edge, and the three
    counts are taken before: nothing is multiplied by the number of nodes of a common name. What is looked up are the
    different (source, name, file) of the edges, and the edges move once, to what was found. The tables of names and what was
    found are written first, so that adaptive execution can split the edges of a name that many have."""
    base = edges.drop("target_qualified")
    asked = ["source_qualified", "target_name", "file_path"]

    def only(keys: list[str], name: str) -> DataFrame:
        g = nodes.groupBy(*[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"), F.max("qualified_name").alias(name))
        return materialize(g.where("n = 1").drop("n").withColumnRenamed("name", "target_name"), "only")

    exact = materialize(nodes.select(F.col("qualified_name").alias("target_name"), F.col("qualified_name").alias("t_exact")).distinct(), "exact")
    parents = nodes.select(F.col("qualified_name").alias("source_qualified"), F.col("parent_qualified").alias("s_parent"))
    scoped = only(["name", "file_path", "parent_qualified"], "t_scope").withColumnRenamed("parent_qualified", "s_parent")
    local, anywhere = only(["name", "file_path"], "t_local"), only(["name"], "t_any")
    met = base.select(*asked).distinct().join(exact, "target_name", "left").join(parents, "source_qualified", "left").join(scoped, ["target_name", "file_path", "s_parent"], "left")
    met = met.join(local, ["target_name", "file_path"], "left").join(anywhere, "target_name", "left")
    guess = F.coalesce(F.when(F.col("s_parent") != "", F.col("t_scope")), F.col("t_local"), F.col("t_any"))
    found = materialize(met.select(*[F.col(c).alias(f"__{c}") for c in asked], "t_exact", guess.alias("t_guess")), "found")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in asked]
    return base.join(found, same, "left").withColumn("target_qualified", F.coalesce(F.col("t_exact"), F.when(F.col("kind") != "IMPORTS", F.col("t_guess")))).select(*base.columns, "target_qualified")


def import_candidates(source_file: Column, target: Column) -> Column:
    """Paths that an import may mean, in order: relative ones, then the text as a path and with dots as slashes, then both with suffixes."""
    folder = F.regexp_replace(F.regexp_replace(source_file, r"[^/]*$", ""), r"/$", "")
    clean = F.regexp_replace(F.replace(target, F.lit("\\"), F.lit("/")), r"^[./]+|[./]+$", "")
    joined = F.when(folder == "", target).otherwise(F.concat(folder, F.lit("/"), target))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    above = lambda a: (F.size(a) == 0) | (F.get(a, F.size(a) - 1) == "..")
    # "a/b/../c" is "a/c", at any depth; what is above the first folder stays.
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & ~above(a), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    up = F.when(F.size(walked) == 0, ".").otherwise(F.concat(F.when(joined.startswith("/"), "/").otherwise(""), F.array_join(walked, "/")))
    relative = F.when(target.startswith("."), F.array(up, F.concat(up, F.lit(".py")), F.concat(up, F.lit("/__init__.py")))).otherwise(F.array().cast("array<string>"))
    dotted = F.replace(clean, F.lit("."), F.lit("/"))
    stems = [clean, dotted]
    more = [F.concat(s, F.lit(x)) for s in stems for x in (*EXTENSIONS, "/__init__.py")]
    return F.concat(relative, F.array(*stems, *more))


def resolve_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """IMPORTS edges with target_qualified: the first candidate that is a file, else the only file whose stem is the last part."""
    base, key = edges.where("kind = 'IMPORTS'").drop("target_qualified"), ["file_path", "target_name"]
    paths = files.select(F.col("path").alias("candidate"))
    # Once for each import of a file, however many edges have it; no generated id, which a task that runs again may deal otherwise.
    tries = base.select(*key).distinct().select(*key, F.posexplode(import_candidates(F.col("file_path"), F.col("target_name"))).alias("at", "candidate"))
    first = tries.join(paths, "candidate").groupBy(*key).agg(F.min_by("candidate", "at").alias("hit"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    stems = files.groupBy(stem.alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.max("path").alias("by_stem")).where("n = 1").drop("n")
    stems = materialize(stems, "stems")  # a stem that many imports have can be split
    clean = F.regexp_replace(F.replace(F.col("target_name"), F.lit("\\"), F.lit("/")), r"^[./]+|[./]+$", "")
    leaf = F.element_at(F.split(F.element_at(F.split(clean, "/"), -1), r"\."), -1)
    met = base.withColumn("leaf", leaf).join(first, key, "left").join(stems, "leaf", "left")
    return met.select(*base.columns, F.coalesce("hit", "by_stem").alias("target_qualified"))


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, limit: int | None = None, snapshot_edges: DataFrame | None = None) -> DataFrame:
    """What depends on the seeds (qualified_name), two steps against the edges: qualified_name, depth, via_relation, via_target, path.

    Found as by a breadth-first search from the seeds by name, and in its order if sorted by (depth, path): each node is
    found by its target of smallest path, then by kind. A path (array of names from the seed on) stands for the place in
    the queue, so nothing is numbered in one task. Two joins, each against the edges that point at the level before;
    names without a node end there.
    """
    use = edges.where(F.col("target_qualified").isNotNull() & F.col("kind").isin(*IMPACT_KINDS)).select("source_qualified", "target_qualified", "kind")
    if snapshot_edges is not None:
        use = use.unionByName(snapshot_edges.select("source_qualified", "target_qualified", "kind"))
    seen = seeds.select("qualified_name").distinct()
    level = seen.withColumn("path", F.array("qualified_name"))
    known, found = nodes.select("qualified_name"), []
    for depth in (1, 2):
        hits = use.join(level.select(F.col("qualified_name").alias("target_qualified"), "path"), "target_qualified").withColumnRenamed("source_qualified", "qualified_name")
        hits = hits.join(seen, "qualified_name", "left_anti")
        best = hits.groupBy("qualified_name").agg(F.min(F.struct("path", "kind", "target_qualified")).alias("b"))
        next_seen = best.select("qualified_name")
        best = best.join(known, "qualified_name", "left_semi").select("qualified_name", "b.kind", "b.target_qualified", F.array_append("b.path", F.col("qualified_name")).alias("path"))
        level = best.select("qualified_name", "path")
        found.append(best.select("qualified_name", F.lit(depth).alias("depth"), F.col("kind").alias("via_relation"), F.col("target_qualified").alias("via_target"), "path"))
        seen = seen.unionByName(next_seen)
    every = found[0].unionByName(found[1])
    return every if limit is None else every.orderBy("depth", "path").limit(limit)


def changed_nodes(nodes: DataFrame, previous: DataFrame, changed_files: DataFrame) -> DataFrame:
    """Nodes of changed files now, and those of the snapshot that are gone, with deleted."""
    now = nodes.join(changed_files, nodes["file_path"] == changed_files["path"], "left_semi").withColumn("deleted", F.lit(False))
    gone = previous.join(changed_files, previous["file_path"] == changed_files["path"], "left_semi").join(now.select("qualified_name"), "qualified_name", "left_anti")
    return now.unionByName(gone.select(*nodes.columns).withColumn("deleted", F.lit(True)))


# --- checks of a task graph: tasks (id, blocked_by array) ---


def dag_errors(tasks: DataFrame) -> DataFrame:
    """(rule, detail) of each duplicate id, dangling reference, and the lack of a root."""
    duplicate = tasks.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("rule"), F.col("id").alias("detail"))
    links = tasks.select("id", F.explode("blocked_by").alias("blocker"))
    missing = links.join(tasks.select(F.col("id").alias("blocker")).distinct(), "blocker", "left_anti").select(F.lit("missing_reference").alias("rule"), F.concat("id", F.lit(" -> "), "blocker").alias("detail"))
    roots = tasks.agg(F.count(F.when(F.size("blocked_by") == 0, 1)).alias("r"), F.count(F.lit(1)).alias("n"))
    empty = roots.where("n = 0").select(F.lit("empty").alias("rule"), F.lit("no tasks").alias("detail"))
    no_root = roots.where("n > 0 and r = 0").select(F.lit("no_root").alias("rule"), F.lit("every task is blocked").alias("detail"))
    return duplicate.unionByName(missing).unionByName(no_root).unionByName(empty)


def cycle_nodes(links: DataFrame) -> DataFrame:
    """Tasks that lie on a cycle or between cycles: those that a part of components() leads to and that lead to one.

    Two searches, from the parts along the links and against them; a round takes all open tasks one link further, with as
    many rounds as the longest way outside a part has links."""
    known = materialize(cycles.components(links).select("id"), "parts")
    steps = links.select("blocker", "id").where("blocker is not null and id is not null").distinct()

    def reached(start: str, end: str) -> DataFrame:
        seen = open_ = known
        while True:
            new = steps.select(F.col(start).alias("id"), F.col(end).alias("next")).join(open_, "id").select(F.col("next").alias("id")).distinct()
            open_ = materialize(new.join(seen, "id", "left_anti"), "open")
            if open_.isEmpty():
                return seen
            seen = materialize(seen.unionByName(open_), "seen")

    return reached("blocker", "id").join(reached("id", "blocker"), "id", "left_semi")
