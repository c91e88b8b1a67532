"""The engine's operators on small tables with known answers."""

import hashlib
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella import schemas
from tessella.functions import hashing, text, values
from tessella.operators import conversation, cycles, graph, memory, messaging, policy, ranking, scheduler, search, skills
from tessella.plans import index
from tessella.sources import files, records

TREE = {
    "lib.py": b"import os\n\nclass Base:\n    pass\n\nclass Child(Base):\n    def run(self):\n        return helper()\n\ndef helper():\n    return 1\n",
    "app.py": b"from lib import helper\n\ndef main(callback):\n    helper()\n    callback()\n    return helper\n",
    "tests/test_app.py": b"from app import main\n\ndef test_main():\n    assert main(print)\n",
    "one.py": b"def duplicate():\n    pass\n", "two.py": b"def duplicate():\n    pass\n",
    "src/a.c": b'#include "a.h"\nstruct Point { int x; };\nint twice(int x) {\n  return add(x, x);\n}\n', "src/a.h": b"int add(int a, int b) {\n  return a + b;\n}\n",
    "node_modules/x.py": b"def no(): pass\n", "big.py": b"#" * (2 * 1024 * 1024 + 1), "bin.py": b"a\x00b", "notes.txt": b"text",
}


def tree(spark, contents):
    return files.classify(spark.createDataFrame([(p, bytearray(c), 1) for p, c in contents.items()], "path string, content binary, mtime_ns long"))


@pytest.fixture(scope="module")
def code(spark):
    classified = tree(spark, TREE).persist()
    nodes, edges = files.symbols(classified)
    use = classified.where("language is not null and skip is null").select("path", "language", "content_hash")
    nodes = nodes.persist()
    return classified, nodes, index.link(nodes, edges, use).persist(), use


def names(df):
    return sorted(r.qualified_name for r in df.collect())


def test_scan_rules(code):
    skipped = {r.path: r.skip for r in code[0].where("skip is not null").collect()}
    assert skipped == {"node_modules/x.py": "ignored folder", "big.py": "too large", "bin.py": "binary"}
    assert code[0].where("path = 'notes.txt'").first().language is None


def test_relations(code):
    _, nodes, edges, _ = code
    related = lambda r, t, n=20: names(graph.related(nodes, edges, r, t, n))
    assert related("callers_of", "lib.py::helper") == ["app.py::main", "lib.py::Child.run"]
    assert related("callees_of", "app.py::main") == ["lib.py::helper"]
    assert related("importers_of", "lib.py") == ["app.py"]
    assert related("inheritors_of", "lib.py::Base") == ["lib.py::Child"]
    assert related("references_to", "lib.py::helper") == ["app.py::main"]
    assert related("tests_for", "app.py::main") == ["tests/test_app.py::test_main"]
    assert related("children_of", "lib.py") == ["lib.py::Base", "lib.py::Child", "lib.py::helper"]
    assert len(related("callers_of", "lib.py::helper", 1)) == 1
    assert related("callers_of", "src/a.h::add") == ["src/a.c::twice"] and related("importers_of", "src/a.h") == []  # "a.h" is taken from the root


def test_targets(code):
    nodes = code[1]
    assert graph.resolve_target(nodes, "helper") == ("lib.py::helper", None, [])
    assert graph.resolve_target(nodes, "duplicate")[1:] == ("ambiguous_target", ["one.py::duplicate", "two.py::duplicate"])
    assert graph.resolve_target(nodes, "nothing")[1] == "target_not_found"


def test_shadowed_names_are_no_references(code):
    assert not code[2].where("kind = 'REFERENCES' and target_name = 'callback'").count()


def test_overview_and_indegree(code):
    classified, nodes, edges, use = code
    got = {(r.section, r.key): r["count"] for r in graph.overview(use, nodes, edges).collect()}
    assert got["languages", "python"] == 5 and got["languages", "c"] == 2 and got["top_level_directories", "src"] == 2
    assert got["test_symbols", ""] == 1
    assert graph.indegree(nodes, edges, 1).first().qualified_name == "lib.py::helper"


def test_impact_order_and_depth(spark, code):
    _, nodes, edges, _ = code
    seeds = nodes.where("file_path = 'lib.py'").select("qualified_name")
    got = [(r.qualified_name, r.depth, r.via_relation) for r in graph.impact(nodes, edges, seeds, 10).orderBy("depth", "path").collect()]
    assert got[0] == ("app.py", 1, "IMPORTS") and ("app.py::main", 1, "CALLS") in got and ("tests/test_app.py::test_main", 2, "CALLS") in got


def bfs(nodes, edges, seeds):
    """The queue form of impact, on the driver."""
    incoming = {}
    for s, t, k in edges:
        incoming.setdefault(t, []).append((s, k))
    queue, seen, out = [(s, 0) for s in sorted(seeds)], set(seeds), []
    while queue:
        at, d = queue.pop(0)
        if d < 2:
            for s, k in sorted(incoming.get(at, [])):
                if s not in seen:
                    seen.add(s)
                    if s in nodes:
                        out.append((s, d + 1, k, at))
                        queue.append((s, d + 1))
    return out


def test_impact_equals_a_queue(spark):
    import random

    rng = random.Random(5)
    for _ in range(3):
        nodes = [f"n{i}" for i in range(25)]
        edges = [(rng.choice(nodes + ["ghost"]), rng.choice(nodes), rng.choice(graph.IMPACT_KINDS)) for _ in range(60)]
        df = spark.createDataFrame(edges, "source_qualified string, target_qualified string, kind string")
        got = graph.impact(spark.createDataFrame([(n,) for n in nodes], "qualified_name string"), df, spark.createDataFrame([("n3",), ("n1",)], "qualified_name string"))
        assert [(r.qualified_name, r.depth, r.via_relation, r.via_target) for r in got.orderBy("depth", "path").collect()] == bfs(set(nodes), edges, {"n1", "n3"})


def test_index_refresh(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    first = {k: v for k, v in TREE.items() if k in ("lib.py", "app.py", "one.py")}
    assert index.refresh(spark, root, tree(spark, first), None)["mode"] == "full"
    assert index.refresh(spark, root, tree(spark, first), 1) == {"mode": "unchanged", "version": 1, "updated_files": 0, "deleted_files": 0, "skipped_files": 0}
    second = {"lib.py": b"def other():\n    pass\n", "app.py": TREE["app.py"]}
    got = index.refresh(spark, root, tree(spark, second), 1)
    assert (got["mode"], got["version"], got["updated_files"], got["deleted_files"]) == ("incremental", 2, 1, 1)
    nodes, edges = index.read(spark, root, 2, "nodes"), index.read(spark, root, 2, "edges")
    assert "lib.py::helper" not in names(nodes)
    old_nodes, old_edges = index.read(spark, root, 2, "old_nodes"), index.read(spark, root, 2, "old_edges")
    changed = spark.createDataFrame([("lib.py",), ("one.py",)], "path string")
    both = graph.changed_nodes(nodes, old_nodes, changed)
    assert {r.qualified_name for r in both.where("deleted").collect()} >= {"lib.py::helper", "one.py::duplicate"}
    hit = graph.impact(nodes, edges, both.select("qualified_name"), 10, old_edges)
    assert "app.py::main" in names(hit)  # it called what is gone


def everything(spark, root, version):
    return {t: sorted(map(repr, index.read(spark, root, version, t).collect())) for t in ("files", "nodes", "edges")}


def test_refresh_parses_once(spark, tmp_path, monkeypatch):
    """A build parses each file once, a refresh each changed file once, however often nodes and edges are read."""
    parse, log = files.parse, f"{tmp_path}/log"

    def logged(rows):
        def run(batches):
            for pdf in batches:
                with open(log, "a") as f:
                    f.writelines(f"{path}\n" for path in pdf["file_path"][pdf["kind"] == "file"])
                yield pdf

        return parse(rows).mapInPandas(run, files.PARSED)

    monkeypatch.setattr(files, "parse", logged)
    root, first = f"{tmp_path}/index", {k: TREE[k] for k in ("lib.py", "app.py", "one.py")}
    index.refresh(spark, root, tree(spark, first), None)
    assert sorted(open(log).read().split()) == sorted(first)
    index.refresh(spark, root, tree(spark, first | {"lib.py": b"def other():\n    pass\n", "two.py": TREE["two.py"]}), 1)
    assert sorted(open(log).read().split()) == sorted([*first, "lib.py", "two.py"])


def test_refresh_writes_what_changed(spark, tmp_path):
    """After each change the index is that of a build from nothing; untouched buckets are those of the version before."""
    many = {f"m{i}.py": f"from m{(i + 1) % 24} import f{(i + 1) % 24}\n\ndef f{i}():\n    return f{(i + 1) % 24}() + shared()\n".encode() for i in range(24)}
    steps = [many, many | {"lib.py": b"def shared():\n    return 1\n"}, many | {"lib.py": b"def shared():\n    return 2\n"}]
    steps += [{k: v for k, v in steps[2].items() if k != "m7.py"}, steps[2] | {"m7.py": b"def f7():\n    pass\n", "two.py": b"def shared():\n    pass\n"}]
    root, version, written = f"{tmp_path}/index", None, []
    for k, step in enumerate(steps):
        got = index.refresh(spark, root, tree(spark, step), version, head="h")
        version = got["version"]
        index.refresh(spark, f"{tmp_path}/whole{k}", tree(spark, step), None, head="h")
        assert everything(spark, root, version) == everything(spark, f"{tmp_path}/whole{k}", 1)
        written.append(got.get("written"))
        if k:
            before, after = index.manifest(spark, root, version - 1), index.manifest(spark, root, version)
            for t in index.BUCKETED:
                assert sum(before[t].get(b) != s for b, s in after[t].items()) <= got["written"][t]
    assert written[1]["nodes"] == 1 and written[1]["edges"] > 8  # all calls of shared() have a target now
    assert written[2] == {"nodes": 1, "edges": 1}  # another body changes no target
    assert written[3]["nodes"] == 1 and written[3]["edges"] <= 3  # m6.py called what is gone

    # The snapshot goes on while the head is the same and begins anew with another, without any change of files too.
    assert index.read(spark, root, version, "old_nodes").where("file_path = 'lib.py'").count() > 0
    assert index.refresh(spark, root, tree(spark, steps[-1]), version, head="h")["mode"] == "unchanged"
    moved = index.refresh(spark, root, tree(spark, steps[-1]), version, head="other")
    assert moved["version"] == version + 1 and moved["written"] == {"nodes": 0, "edges": 0}
    assert index.read(spark, root, version + 1, "old_nodes").count() == index.read(spark, root, version + 1, "old_edges").count() == 0
    assert everything(spark, root, version + 1) == everything(spark, root, version)


def test_embeddings_resume(spark, tmp_path):
    """An embedder that fails at its third batch of five: two are kept, the next run asks for the others only."""
    src = {f"s{i}.py": f"def f{i}():\n    pass\n".encode() for i in range(45)}
    use = tree(spark, src)
    nodes, _ = files.symbols(use)
    current, log, broken = use.select("path", "language", "content_hash"), f"{tmp_path}/calls", f"{tmp_path}/broken"
    open(broken, "w").close()

    def embed(texts):
        import os

        with open(log, "a") as f:
            f.write(f"{len(texts)}\n")
        if os.path.exists(broken) and len(open(log).readlines()) == 3:
            raise OSError("service is down")
        return [[float(len(t)), 1.0] for t in texts]

    call = lambda: index.embed_with_ledger(spark, f"{tmp_path}/ledger", nodes, current, embed, 2, "i", wave_batches=1)
    with pytest.raises(RuntimeError, match="service is down"):
        call()
    assert open(log).read().split() == ["20", "20", "20"] and index.ledger(spark, f"{tmp_path}/ledger").count() == 40
    __import__("os").remove(broken)
    got = call()
    assert open(log).read().split() == ["20"] * 5 + ["10"] and got.count() == 90
    want = {r.qualified_name: float(len(r.text)) for r in index.embedding_inputs(nodes, current).collect()}
    assert {r.qualified_name: r.vector[0] for r in got.collect()} == want
    assert call().count() == 90 and len(open(log).read().split()) == 6  # nothing is asked again


def test_embedding_cache(spark, code):
    _, nodes, _, use = code
    calls = []

    def embed(texts):
        return [[1.0, 0.0] if "helper" in t else [0.0, 1.0] for t in texts]

    empty = spark.createDataFrame([], schemas.EMBEDDINGS)
    full = index.refresh_embeddings(nodes, use, empty, embed, 2, "i", "p", "m").persist()
    assert full.count() == nodes.count()
    missing = index.cache_misses(index.embedding_inputs(nodes, use), full)
    assert missing.count() == 0
    changed = use.withColumn("content_hash", F.when(F.col("path") == "one.py", "new").otherwise(F.col("content_hash")))
    assert index.cache_misses(index.embedding_inputs(nodes, changed), full).count() == 2
    with pytest.raises(Exception, match="another length"):
        index.refresh_embeddings(nodes, use, empty, lambda t: [[1.0]] * len(t), 2, "i", "p", "m").collect()
    vectors = nodes.join(full.select("qualified_name", "vector"), "qualified_name")
    best = search.semantic_search(vectors, [1.0, 0.0], 1, "helper").first()
    assert best.qualified_name == "lib.py::helper" and best.score == pytest.approx(4.0)
    both = search.hybrid_search(nodes, vectors, "helper", [1.0, 0.0], 3)
    assert both.first().qualified_name == "lib.py::helper" and not calls
    mode, rows, warning = search.search(nodes, "helper", "hybrid", None, None, True)
    assert mode == "fts" and warning and rows.count()
    with pytest.raises(PermissionError):
        search.search(nodes, "helper", "hybrid", None, None, False)


def test_search_modes(spark):
    rows = [("function", "load_profile", "users/account.py::load_profile", "users/account.py", ""), ("function", "load_settings", "users/account.py::load_settings", "users/account.py", ""), ("file", "users/account.py", "users/account.py", "users/account.py", "")]
    nodes = spark.createDataFrame(rows, "kind string, name string, qualified_name string, file_path string, parent_qualified string")
    mode, got = search.fts_search(nodes, "users load_profile", 5)
    assert mode == "fts" and [r.name for r in got.collect()] == ["load_profile"]
    assert search.fts_search(nodes, "ofile", 5)[0] == "keyword" and search.fts_search(nodes, "%", 5)[1].count() == 0
    assert [r.file_path for r in search.keyword_search(nodes, "load", 1, context=["users/account.py"]).collect()] == ["users/account.py"]


def test_bm25_formula(spark):
    texts = ["a b a", "a c", "d d d d", "a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = {r.id: r.bm25 for r in search.bm25_scores(df, ["t"], "b").collect()}
    docs = [t.split() for t in texts]
    avg, n = sum(map(len, docs)) / 4, 2
    idf = max(math.log((4 - n + 0.5) / (n + 0.5)), 0) or 1e-6
    want = {i: idf * d.count("b") * 2.2 / (d.count("b") + 1.2 * (0.25 + 0.75 * len(d) / avg)) for i, d in enumerate(docs) if "b" in d}
    assert got == pytest.approx(want)


def test_stems():
    # Words and stems of the algorithm's description.
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "triplicate": "triplic", "formalize": "formal", "revival": "reviv", "adjustment": "adjust", "probate": "probat", "controll": "control", "sky": "sky", "generalizations": "gener"}
    assert {w: text.porter(w) for w in pairs} == pairs


def test_rank_fusion_is_symmetric(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "qualified_name string, rank int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "qualified_name string, rank int")
    one, two = ({r[0]: r[1] for r in search.reciprocal_ranks(x).collect()} for x in ([a, b], [b, a]))
    assert one == pytest.approx(two) and one["y"] == pytest.approx(1 / 62 + 1 / 61)


def test_dag_checks(spark):
    df = spark.createDataFrame([("a", ["z"]), ("b", ["a"]), ("b", ["c"]), ("c", ["b"])], "id string, blocked_by array<string>")
    assert {(r.rule, r.detail) for r in graph.dag_errors(df).collect()} == {("duplicate_id", "b"), ("missing_reference", "a -> z"), ("no_root", "every task is blocked")}
    links = df.select("id", F.explode("blocked_by").alias("blocker"))
    assert sorted(r.id for r in graph.cycle_nodes(links).collect()) == ["b", "c"]
    assert [tuple(r) for r in cycles.cycle_of_each(links).collect()] == [("b", ["b", "c", "b"])]
    assert graph.dag_errors(df.limit(0)).first().rule == "empty"


def test_vectors_of_any_dimension_are_checked(spark, tmp_path):
    from tessella import catalog

    rows = [(1, [1.0, 2.0]), (2, [1.0, float("nan")]), (3, [float("inf"), 1.0]), (4, [1.0] * 64), (5, [1.0] * 63 + [float("nan")]), (6, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {tuple(r) for r in catalog.vector_dim_check(spark, str(tmp_path)).collect()} == {(2, 3, 1), (64, 2, 1), (0, 1, 0)}


def test_imports_from_any_depth(spark):
    edges = spark.createDataFrame([("a/b/c/d/m.c", "../../../../x.h"), ("a/b/c/d/e/m.c", "../../.././../../q/x.h"), ("a/m.c", "./y.h"), ("a/m.c", "../../x.h")], "file_path string, target_name string")
    files = spark.createDataFrame([("x.h",), ("q/x.h",), ("a/y.h",), ("b/y.h",)], "path string")
    got = graph.resolve_imports(edges.withColumn("kind", F.lit("IMPORTS")), files).collect()
    want = {"../../../../x.h": "x.h", "../../.././../../q/x.h": "q/x.h", "./y.h": "a/y.h"}
    found = {r.target_name: r.target_qualified for r in got}
    assert {k: found[k] for k in want} == want


def test_rings_and_chains_of_any_length(spark):
    """A ring of 10,000 tasks with chains to and from it, small parts, a task that blocks itself: rounds grow with the logarithm."""
    n, made = 10_000, []
    links = [(f"r{i:05d}", f"r{(i + 1) % n:05d}") for i in range(n)] + [("x", "y"), ("y", "x"), ("y", "z"), ("z", "x"), ("w", "w")]
    links += [(f"in{i:04d}", f"in{i + 1:04d}") for i in range(500)] + [("in0500", "r00007"), ("r00100", "out0000")] + [(f"out{i:04d}", f"out{i + 1:04d}") for i in range(500)]
    plain = cycles.materialize
    cycles.materialize = lambda df, label: (made.append(label), plain(df.coalesce(2), label))[1]
    try:
        df = spark.createDataFrame(links, "blocker string, id string").coalesce(2)
        parts = plain(cycles.components(df), "parts")
        rounds = len(made)
        paths = {r.component: r.path for r in cycles.cycle_of_each(df, parts).collect()}
    finally:
        cycles.materialize = plain
    got = {(r.id, r.component) for r in parts.collect()}
    assert got == {(f"r{i:05d}", "r00000") for i in range(n)} | {(c, "x") for c in "xyz"} | {("w", "w")}
    assert rounds < 200
    assert paths == {"r00000": [*(f"r{i:05d}" for i in range(n)), "r00000"], "x": ["x", "y", "x"], "w": ["w", "w"]}


def test_components_against_brute_force(spark):
    random.seed(8)
    for n, m in ((40, 55), (12, 60)):
        links = [(random.randrange(n), random.randrange(n)) for _ in range(m)]
        reach = {a: {a} for a in range(n)}
        for _ in range(n):
            for a, b in links:
                for x in reach.values():
                    if a in x:
                        x.add(b)
        loops = {a for a, b in links if a == b}
        want = {}
        for a in range(n):
            part = {b for b in reach[a] if a in reach[b]}
            if len(part) > 1 or a in loops:
                want[a] = min(part)
        df = spark.createDataFrame(links + links[:3], "blocker long, id long").coalesce(1)
        parts = cycles.components(df)
        assert {r.id: r.component for r in parts.collect()} == want
        for r in cycles.cycle_of_each(df, parts).collect():
            assert r.path[0] == r.path[-1] == min(r.path) and len(set(r.path)) == len(r.path) - 1
            assert all((a, b) in links for a, b in zip(r.path, r.path[1:], strict=False)) and {want[x] for x in r.path} == {r.component}


def test_places_in_a_hot_line(spark):
    """Nine rows of ten in one line: places as by a window, and no range holds the line."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 > 0, "cold").alias("line"), (F.xxhash64("id") % 50).alias("v"))
    got = ranking.numbered(df, ["line"], ["v", "id"])
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("line").orderBy("v", "id")))
    assert got.join(want, "id").where("place = want").count() == 20_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else ranges of a few rows are put together
    try:
        ranges = ranking.ordered(df, "line", "v", "id").where("line = 'hot'").groupBy(F.shiftright(ranking.SEQ, ranking.RANGE_BITS)).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) > 1 and max(r["count"] for r in ranges) < 14_000


def test_hashes(spark):
    row = spark.createDataFrame([("fetch", "t1")], "k string, i string").select(hashing.work_shard(F.col("k"), F.col("i")).alias("s"), hashing.content_hash(F.col("i")).alias("h")).first()
    assert row.s == int.from_bytes(hashlib.sha256(b"fetch:t1").digest()[:8], "big") % 64 and row.h == hashlib.sha256(b"t1").hexdigest()


def test_scheduler_flow(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    reply = '```json\n{"plan_summary": "p", "tasks": [{"id": "a", "subject": "s", "description": "d", "blockedBy": [], "metadata": {"priority": "2"}}, {"id": "b", "subject": "s", "description": "d", "blockedBy": ["a"]}, {"id": "c", "subject": "s", "description": "d", "blockedBy": [], "metadata": {"priority": "x"}}]}\n```'
    dags = records.parse_dags(spark.createDataFrame([(reply,)], "reply string")).where(F.size("errors") == 0).select(F.lit("t").alias("thread_id"), F.lit("o").alias("owner"), "dag")
    out = scheduler.publish_dag(dags, now)
    tasks = out["tasks"].withColumns({"work_shard": F.lit(0), "current_attempt": F.lit(None).cast("int"), "current_execution_id": F.lit(None).cast("string"), "claimed_at": F.lit(None).cast("timestamp"), "lease_expires_at": F.lit(None).cast("timestamp")})
    assert sorted(r.id for r in out["messages"].collect()) == ["a", "c"] and out["events"].count() == 3
    runtimes = spark.createDataFrame([("r1", "idle"), ("r2", "stopped"), ("r3", "idle"), ("r4", "idle")], "runtime_id string, status string").withColumns({"thread_id": F.lit("t"), "task_type": F.lit("general"), "work_shard": F.lit(0)})
    won = {r.runtime_id: r.id for r in scheduler.claim(tasks, runtimes, now).collect()}
    assert won == {"r1": "a", "r3": "c"}
    done = tasks.withColumn("status", F.when(F.col("id") == "a", "completed").otherwise(F.col("status")))
    assert [r.task_id for r in scheduler.unblocked_by(done.where("id = 'a'"), out["dependencies"], done).collect()] == ["b"]


def test_fencing_and_leases(spark):
    now = F.lit("2024-01-01 00:02:00").cast("timestamp")
    tasks = spark.createDataFrame([("t", "x", 2, "{}", "o")], "id string, current_execution_id string, current_attempt int, metadata string, owner string").withColumns({"status": F.lit("in_progress"), "claimed_at": now, "lease_expires_at": now, "updated_at": now, "task_type": F.lit("g"), "work_shard": F.lit(0)})
    runs = spark.createDataFrame([("t", "x", 1, "r1", "failed"), ("t", "x", 2, "r2", "running")], "task_id string, execution_id string, attempt int, runtime_id string, status string").withColumn("lease_expires_at", F.lit("2024-01-01 00:01:00").cast("timestamp"))
    updates = spark.createDataFrame([("t", "x", 1, "r1", "complete"), ("t", "x", 2, "r2", "complete"), ("t", "x", 2, "r9", "fail")], "task_id string, execution_id string, attempt int, runtime_id string, operation string")
    got = {(r.attempt, r.runtime_id): r.event_type for r in scheduler.fence(updates, runs, tasks).collect()}
    assert got == {(1, "r1"): "execution.stale_update_rejected", (2, "r2"): "execution.completed", (2, "r9"): "execution.stale_update_rejected"}
    over = scheduler.expired(runs, tasks, now)
    assert [(r.attempt, r.retry_scheduled) for r in over.collect()] == [(2, False)]
    assert [r.event_type for r in scheduler.expiry_events(over).orderBy("place").collect()] == ["execution.expired", "card.unload_started", "card.unloaded"]
    after = scheduler.task_after_failure(tasks, over, F.lit("lease_expired"), now).first()
    assert after.status == "failed" and after.metadata == '{"last_error":"lease_expired"}' and after.owner is None


def test_cards(spark):
    cards = spark.createDataFrame([("a", "1", "active", ["x"], "d", "h"), ("b", "1", "active", ["y"], "d", "h"), ("c", "1", "active", ["y"], "d", "h"), ("d", "1", "revoked", ["z"], "d", "h")], "agent_card_id string, version string, status string, task_types array<string>, bundle_digest string, config_hash string")
    tasks = spark.createDataFrame([("1", "x", None), ("2", "y", None), ("3", "y", '{"agent_card_id":"c","version":"1"}'), ("4", "x", '{"agent_card_id":"d","version":"1"}')], "id string, task_type string, card_selector string")
    assert {r.id: r.agent_card_id for r in scheduler.resolve_cards(tasks, cards).collect()} == {"1": "a", "2": None, "3": "c", "4": None}
    runs = spark.createDataFrame([("a", "1", "d", "h"), ("b", "1", "other", "h")], "agent_card_id string, agent_card_version string, agent_card_digest string, agent_card_config_hash string")
    assert {r.agent_card_id: r.intact for r in scheduler.frozen_cards(runs, cards).collect()} == {"a": True, "b": False}
    assert schemas.changed_cards(cards, cards.withColumn("status", F.lit("revoked"))).count() == 0
    assert schemas.changed_cards(cards, cards.withColumn("config_hash", F.lit("z"))).count() == 4


def test_claims_close_up(spark):
    """Tasks without a card, or whose frozen card changed, fail one by one; their runtimes go on to the next task."""
    cards = spark.createDataFrame([("a", "1", "active", ["x"], "d", "h")], "agent_card_id string, version string, status string, task_types array<string>, bundle_digest string, config_hash string")
    pin = '{"agent_card_id":"none","version":"1"}'
    rows = [(f"t{i}", "th", "x", 0, "pending", 0, None, i, pin if i in (0, 1, 2, 5, 8) else None, f"e{i}" if i in (3, 4) else None, 1 if i in (3, 4) else None) for i in range(10)]
    rows += [("z0", "th", "y", 0, "pending", 0, None, 0, None, None, None), ("z1", "th", "y", 0, "pending", 0, None, 1, None, None, None)]
    tasks = spark.createDataFrame(rows, "id string, thread_id string, task_type string, work_shard int, status string, blocked_by_count int, metadata string, updated_at int, card_selector string, current_execution_id string, current_attempt int")
    runs = spark.createDataFrame([("e3", 1, "a", "1", "d", "h"), ("e4", 1, "a", "1", "old", "h")], "execution_id string, attempt int, agent_card_id string, agent_card_version string, agent_card_digest string, agent_card_config_hash string")
    runtimes = spark.createDataFrame([("r1", "idle", "th", "x", 0), ("r2", "idle", "th", "x", 0), ("r3", "idle", "th", "x", 0), ("r4", "stopped", "th", "x", 0), ("r5", "idle", "th", "y", 0)], "runtime_id string, status string, thread_id string, task_type string, work_shard int")
    got = scheduler.claim_with_cards(tasks, runtimes, cards, runs, F.lit("2024-01-01").cast("timestamp"))
    # Round 1: t0, t1, t2 fail. Round 2: r1 claims t3, t4 and t5 fail. Round 3: r2 and r3 claim t6 and t7.
    assert {(r.task_id, r.runtime_id, r.attempt) for r in got["executions"].collect()} == {("t3", "r1", 2), ("t6", "r2", 1), ("t7", "r3", 1)}
    assert {r.id for r in got["failed"].collect()} == {"t0", "t1", "t2", "t4", "t5", "z0", "z1"}
    assert [r.event_type for r in got["events"].where("task_id = 't3'").orderBy("place").collect()] == ["execution.claimed", "card.resolved"]


def test_claims_of_long_lines(spark, monkeypatch):
    """Claims are those of a queue of runtimes, and a runtime that meets many tasks takes no job for each of them."""
    from collections import deque

    rng, written = random.Random(7), []
    lines = {"long": [False] * 24 + [True], "idle": [True, False, True, False], "busy": [rng.random() < 0.3 for _ in range(60)], "none": [False] * 5, "mixed": [rng.random() < 0.4 for _ in range(40)]}
    many = {"long": 1, "idle": 6, "busy": 7, "none": 2, "mixed": 11, "empty": 2}
    cards = spark.createDataFrame([("a", "1", "active", ["no"], "d", "h")], "agent_card_id string, version string, status string, task_types array<string>, bundle_digest string, config_hash string")
    rows = [(f"{k}{i:02}", "th", k, 0, "pending", 0, None, i, f'{{"agent_card_id":"{"a" if ok else "b"}","version":"1"}}', None, None) for k, flags in lines.items() for i, ok in enumerate(flags)]
    tasks = spark.createDataFrame(rows, "id string, thread_id string, task_type string, work_shard int, status string, blocked_by_count int, metadata string, updated_at int, card_selector string, current_execution_id string, current_attempt int")
    runtimes = spark.createDataFrame([(f"{k}-{i:02}", "idle", "th", k, 0) for k, n in many.items() for i in range(n)], "runtime_id string, status string, thread_id string, task_type string, work_shard int")
    runs = spark.createDataFrame([], "execution_id string, attempt int, agent_card_id string, agent_card_version string, agent_card_digest string, agent_card_config_hash string")
    materialize = scheduler.materialize
    monkeypatch.setattr(scheduler, "materialize", lambda df, label="table": written.append(label) or materialize(df, label))
    got = scheduler.claim_with_cards(tasks, runtimes, cards, runs, F.lit("2024-01-01").cast("timestamp"))
    claimed, failed = set(), set()
    for k, flags in lines.items():
        queue = deque(f"{k}-{i:02}" for i in range(many[k]))
        for i, ok in enumerate(flags):
            if queue:
                one = queue.popleft()
                if ok:
                    claimed.add((f"{k}{i:02}", one))
                else:
                    failed.add(f"{k}{i:02}")
                    queue.append(one)
    assert {(r.task_id, r.runtime_id) for r in got["executions"].collect()} == claimed
    assert {r.id for r in got["failed"].collect()} == failed
    assert len(written) <= 10  # 24 links of one runtime are five doublings


def test_messages(spark):
    rows = [("e1", "task_available", "s", None, {"task_type": "g", "work_shard": "3"}, "t1"), ("e2", "execution_cancel", "s", "r", {}, "t1"), ("e3", "execution_cancel", "s", None, {}, None), ("e4", "note", "", None, {}, None), ("e5", "permission.requested", "s", None, {}, None), ("e6", "card.loaded", "s", "", {}, "")]
    df = spark.createDataFrame(rows, "event_id string, event_type string, sender string, target string, payload map<string,string>, task_id string").withColumns({"execution_id": F.lit(None).cast("string"), "attempt": F.lit(None).cast("int"), "request_id": F.lit(None).cast("string")})
    got = {r.event_id: (r.topic, r.message_key, r.e) for r in messaging.route(df).withColumn("e", messaging.envelope_error()).collect()}
    assert got["e1"] == ("agent-command", "t1", None) and got["e2"] == ("agent-command", "r", None) and got["e3"][2] and got["e4"][2]
    assert got["e5"][0] == "permission-event" and got["e6"] == ("task-event", "e6", None)


def test_outbox_and_inbox(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    box = spark.createDataFrame([("a", 0, None), ("b", 3, "down"), ("c", 11, "down")], "event_id string, retry_count int, error string").withColumn("created_at", now)
    got = {r.event_id: (r.status, r.retry_count, r.wait) for r in messaging.after_dispatch(box, now).withColumn("wait", F.col("next_retry_at").cast("double") - now.cast("double")).collect()}
    assert got == {"a": ("published", 0, None), "b": ("pending", 4, 16.0), "c": ("failed", 12, None)}
    log = spark.createDataFrame([("w", "e", 1, "receive"), ("w", "e", 2, "retry"), ("w", "f", 1, "receive"), ("w", "f", 2, "ack")], "consumer_name string, event_id string, at int, action string")
    assert {r.event_id: (r.result, r.retries) for r in messaging.inbox_state(log).collect()} == {"e": (None, 1), "f": ("consumed", 0)}
    acts = {"rar": ["receive", "ack", "receive"], "rat": ["receive", "ack", "retry"], "rtr": ["receive", "retry", "receive"], "a": ["ack"], "ar": ["ack", "receive"], "t": ["retry"]}
    log = spark.createDataFrame([("w", k, i, a) for k, v in acts.items() for i, a in enumerate(v)], "consumer_name string, event_id string, at int, action string")
    assert {r.event_id: r.result for r in messaging.inbox_state(log).collect()} == {"rar": "consumed", "rat": "consumed", "rtr": "processing", "a": None, "ar": "processing", "t": None}
    good, bad = messaging.parse_messages(spark.createDataFrame([('{"event_id":"1","event_type":"x"}',), ("junk",)], "value string"), schemas.ENVELOPE)
    assert good.count() == 1 and bad.count() == 1


def test_conversations(spark):
    rows = [(1, i, "tool" if i % 2 else "assistant", f"m{i}") for i in range(10)] + [(2, 0, "user", "禁用记忆 please")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversation.snip(df, 4).where("conv_id = 1").orderBy("turn", "note").collect()
    assert [r.turn for r in got] == [0, 1, 1, 8, 9] and got[2].text == "[Context trimmed: removed 6 messages in the middle]"
    kept = conversation.micro(df, keep=3).where("conv_id = 1 and role = 'tool'").orderBy("turn").collect()
    assert [r.turn for r in kept] == [5, 7, 9]
    assert [r.turn for r in conversation.recent(df, 1, "assistant").where("conv_id = 1").orderBy("turn").collect()] == [8, 9]
    assert not conversation.latest_user_text(df).where("conv_id = 2").first().memory_enabled
    assert conversation.review_due(df, 5).first().rounds == 5
    small = conversation.compact(df, spark.createDataFrame([(1, "sum")], "conv_id long, summary string"), 90)
    assert small.where("conv_id = 1").orderBy("turn").first().text.startswith("[Reactive Compact] Summary: sum")


def test_memory(spark):
    rows = [(f"u{i}", "semantic", "user", f"d{i}", "c", "s", "0", f"{i:03d}") for i in range(120)] + [("p1", "project", "project", "d", "c", "s", "0", "500")]
    df = spark.createDataFrame(rows, schemas.MEMORY)
    got = memory.candidates(df).orderBy("key").collect()
    assert len(got) == 101 and got[0].id == "u119" and got[-1].id == "p1" and got[-1].key == 101
    writes = spark.createDataFrame([("u1", "semantic", "user", " new ", "c", "s", None, "900"), ("u2", "project", "project", "x", "c", "s", None, "900"), ("u3", "semantic", "project", "x", "c", "s", None, "900"), ("p1", "episodic", "project", "x", "c", "s", None, "900")], schemas.MEMORY)
    after = {(r.id, r.scope): r for r in memory.saved(df, writes).collect()}
    assert after["u1", "user"].description == "new" and after["u1", "user"].created_at == "0" and after["u2", "project"].type == "project" and ("u3", "project") not in after and after["p1", "project"].type == "project"
    assert memory.page(df, 1).first().id == "p1"
    picked = spark.createDataFrame([(["3", "9", "3", "1"],)], "k array<string>").select(memory.recalled(F.col("k"), F.array(F.lit("1"), F.lit("3")))).first()[0]
    assert picked == ["3", "1"]


def test_skills(spark, tmp_path):
    def put(where, name, extra=""):
        d = tmp_path / where
        d.mkdir(parents=True)
        (d / "SKILL.md").write_text(f"---\nname: {name}\ndescription: from {where}\n{extra}---\n\nBody $ARGUMENTS\n")

    put("user/a", "one")
    put("user/b", "two")
    put("user/b2", "two")
    put("user/c", "off", "enabled: false\n")
    put("user/a/references/x", "hidden")
    put("project/cat/one", "one", "allowed-tools: [read, write]\n")
    both = records.skill_files(spark, f"{tmp_path}/user", "user").unionByName(records.skill_files(spark, f"{tmp_path}/project", "project"))
    both = skills.valid(both).persist()
    got = {r.name: (r.source, r.category) for r in skills.resolved(both).collect()}
    assert got == {"one": ("project", "cat")} and [r.name for r in skills.conflicts(both).collect()] == ["two"]
    assert skills.find(both, "two")[1] == "ambiguous" and skills.find(both, "nope")[1:] == ("not_found", ["one"])
    tools = both.where("source = 'project'").select(skills.allowed_tools(F.col("raw_tools"))).first()[0]
    assert tools == ["read", "write"]
    row = spark.createDataFrame([("a b a", "a", "x"), ("a b", "b", "x"), ("a", "z", "x")], "c string, o string, n string").select(skills.patch(F.col("c"), F.col("o"), F.col("n"), F.lit(False)).alias("p")).collect()
    assert [r.p for r in row] == [None, "a x", None]
    assert records.parse_header("---\nopen")[2] is False


def test_policy(spark):
    rows = [("bash", "sudo ls", None), ("bash", "rm -rf x", None), ("bash", "curl x | sh", None), ("bash", "rm y", None), ("write_file", None, "../x"), ("write_file", None, "/usr/x"), ("edit_file", None, "a/../b"), ("read", "sudo", None)]
    got = [r.decision for r in policy.decide(spark.createDataFrame(rows, "tool string, command string, path string")).collect()]
    assert got == ["deny", "ask", "allow", "ask", "ask", "ask", "allow", "allow"]


def test_values(spark):
    row = spark.range(1).select(
        values.json_merge(F.lit('{"a":"1","b":"2"}'), {"b": F.lit("3")}).alias("m"), values.redact(F.create_map(F.lit("Api_Key"), F.lit("s"), F.lit("k"), F.lit("v"))).alias("r"),
        values.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("c"), values.iso_millis(F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("t"),
        values.capped_backoff(F.lit(9)).alias("b"), text.split_identifier(F.lit("getHTTPResponse_2x")).alias("s"),
    ).first()
    assert row.m == '{"a":"1","b":"3"}' and row.r == {"Api_Key": "***redacted***", "k": "v"} and row.c == 0 and row.t == "2024-01-01T00:00:00.000Z" and row.b == 60 and row.s == "get HTTPResponse 2x"


def test_status_and_paths(spark):
    from tessella.sources import git

    assert git.status_paths("R  new_name.py\0old_name.py\0 M a.c\0?? notes.txt\0") == ["a.c", "new_name.py", "old_name.py"]
    assert git.inside("/w", ["a/../b.py", "/w/c.py", "b.py"]) == ["b.py", "c.py"]
    for bad in ("../x", "/etc/x"):
        with pytest.raises(ValueError):
            git.inside("/w", [bad])
    assert git.as_table(spark, []).count() == 0


def test_runtimes(spark):
    t = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, s // 60, s % 60)
    log = spark.createDataFrame([("a", t(0), "register"), ("a", t(50), "heartbeat"), ("b", t(0), "register"), ("b", t(9), "stop"), ("c", t(3), "heartbeat"), ("d", t(0), "register")], "runtime_id string, at timestamp, action string")
    got = {r.runtime_id: (r.status, r.alive) for r in scheduler.runtime_state(log, F.lit(t(100))).collect()}
    assert got == {"a": ("idle", True), "b": ("stopped", False), "d": ("idle", False)}
    again = log.unionByName(spark.createDataFrame([("b", t(50), "heartbeat"), ("d", t(20), "stop"), ("d", t(30), "register"), ("d", t(35), "heartbeat")], log.schema))
    got = {r.runtime_id: (r.status, r.last_heartbeat, r.lease_expires_at) for r in scheduler.runtime_state(again, F.lit(t(100))).collect()}
    assert got == {"a": ("idle", t(50), t(110)), "b": ("stopped", t(0), t(9)), "d": ("idle", t(35), t(95))}
    runtimes = spark.createDataFrame([("a", "unloading", "x", 1), ("b", "unloading", "y", 1)], "runtime_id string, status string, current_execution_id string, current_attempt int")
    runs = spark.createDataFrame([("x", 1, "completed"), ("y", 1, "running")], "execution_id string, attempt int, status string")
    assert {r.runtime_id: (r.status, r.current_execution_id) for r in scheduler.finish_unload(runtimes, runs).collect()} == {"a": ("idle", None), "b": ("unloading", "y")}


def test_envelope_and_links(spark):
    rows = spark.createDataFrame([("s/references/a.md",), ("s/x.md",), ("t/references/b.md",)], "path string")
    assert [tuple(r) for r in skills.linked_files(rows, "s").collect()] == [("references", ["references/a.md"])]
    assert '"data": [{"path": ' in search.envelope(rows, "search") and '"ok": false' in search.envelope(rows, "search", error="graph_busy")


def test_transitions_record_a_good_run_in_order(spark):
    from tessella.operators import scheduler

    key = "task_id string, execution_id string, attempt int, runtime_id string"
    tasks = spark.createDataFrame([("t", "x", 1)], "id string, current_execution_id string, current_attempt int")
    got = ["execution.claimed", "card.resolved"]
    for op, was in (("load_card", "claimed"), ("start", "claimed"), ("heartbeat", "running"), ("complete", "running")):
        runs = spark.createDataFrame([("t", "x", 1, "r", was)], key + ", status string")
        fenced = scheduler.fence(spark.createDataFrame([("t", "x", 1, "r", op)], key + ", operation string"), runs, tasks)
        got += [r.event_type for r in scheduler.transition_events(fenced).orderBy("place").collect()]
    assert got == list(scheduler.GOOD_RUN[:-1])
    runs = spark.createDataFrame([("t", "x", 1, "r", "running")], key + ", status string")
    again = scheduler.fence(spark.createDataFrame([("t", "x", 1, "r", "start"), ("t", "x", 1, "r", "fail_card")], key + ", operation string"), runs, tasks)
    assert {r.operation: r.event_type for r in again.collect()} == {"start": None, "fail_card": "execution.failed"}
    assert [r.event_type for r in scheduler.transition_events(again).orderBy("place").collect()] == ["card.load_failed", "execution.failed", "card.unload_started", "execution.retried", "task_available"]


def test_code_graph_call(spark, tmp_path):
    import json

    from tessella.plans import index, tool

    root = f"{tmp_path}/graph"
    first = {"core.py": b"def calc():\n    return 1\n", "feature.py": b"from core import calc\n\ndef feature():\n    return calc()\n"}
    assert index.latest_version(spark, root) is None
    index.refresh(spark, root, tree(spark, first), None)
    assert index.latest_version(spark, root) == 1
    call = lambda **request: json.loads(tool.code_graph(spark, root, 1, request, "/p"))
    codes = {
        "invalid_action": {"action": "x"}, "invalid_max_results": {"action": "overview", "max_results": True}, "missing_query": {"action": "search", "query": " "}, "invalid_search_mode": {"action": "search", "query": "q", "mode": "x"},
        "invalid_kind": {"action": "search", "query": "q", "kind": "x"}, "invalid_context_path": {"action": "search", "query": "q", "context_files": ["../../x"]}, "invalid_query": {"action": "query", "target": "calc", "relation": "x"},
        "invalid_changed_files": {"action": "impact", "changed_files": ["/etc/x"]}, "target_not_found": {"action": "query", "target": "zzz", "relation": "callers_of"}, "embedding_consent_required": {"action": "search", "query": "q", "mode": "semantic"},
    }
    for code, request in codes.items():
        assert call(**request)["error"]["code"] == code
    assert [r["qualified_name"] for r in call(action="query", target="calc", relation="callers_of")["results"]] == ["feature.py::feature"]
    assert call(action="search", query="feature", kind="function")["results"][0]["qualified_name"] == "feature.py::feature"
    hit = call(action="impact", changed_files=["core.py"])
    assert hit["changed_files"] == ["core.py"] and "feature.py::feature" in [r["qualified_name"] for r in hit["results"]]
    assert call(action="overview")["ok"]


def test_scan_opens_source_files_alone(spark, tmp_path):
    from tessella.sources import files as source_files

    top = tmp_path / "a+b (x).d"
    for name, body in {"m.py": b"x = 1\n", "n.PY": b"y = 2\n", "notes.txt": b"text", "big.c": b"x" * (source_files.MOST_BYTES + 1), "sub/node_modules/h.py": b"z = 1\n", "nul.h": b"a\0b"}.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[-1]: (r.skip, r.content is None) for r in source_files.scan(spark, str(top)).collect()}
    assert got == {"m.py": (None, False), "n.PY": (None, False), "big.c": ("too large", True), "h.py": ("ignored folder", False), "nul.h": ("binary", False)}


def test_memory_get_and_recall(spark):
    from tessella.operators import memory

    rows = [(f"{i:08x}-0000-4000-8000-000000000000", "project", "project", f"d{i}", "c" * 3000, "s", "t", f"u{i}") for i in range(7)]
    records = spark.createDataFrame(rows, "id string, type string, scope string, description string, content string, source string, created_at string, updated_at string")
    assert records.where(memory.valid_id(F.col("id"))).count() == 7 and memory.get(records, "project", rows[0][0]).count() == 1
    with pytest.raises(LookupError):
        memory.get(records, "user", rows[0][0])
    text = memory.recall_text(memory.candidates(records), [3, 1, 3, 99, 2, 4, 5]).first().text
    assert len(text) == 8000 and text.index("d4") < text.index("d6")


def test_skill_files(spark):
    from tessella.operators import skills

    files = spark.createDataFrame([("user", "s", "scripts/a.sh", "one two"), ("user", "s", "scripts/b.sh", "x")], "source string, name string, path string, content string")
    change = "source string, name string, path string, action string, content string, old string, new string, replace_all boolean, at int"
    changes = [("user", "s", "scripts/a.sh", "patch", None, "two", "2", False, 1), ("user", "s", "scripts/b.sh", "remove_file", None, None, None, None, 1), ("user", "s", "assets/c", "write_file", "new", None, None, None, 1), ("user", "s", "assets/../c", "write_file", "out", None, None, None, 1), ("user", "s", "c", "write_file", "out", None, None, None, 1)]
    got = {r.path: r.content for r in skills.apply_file_changes(files, spark.createDataFrame(changes, change)).collect()}
    assert got == {"scripts/a.sh": "one 2", "assets/c": "new"}
    more = [("user", "s", "assets/n", "patch", None, "b", "c", False, 3), ("user", "s", "assets/n", "write_file", "a b", None, None, None, 2), ("user", "s", "scripts/a.sh", "patch", None, "one", "1", False, 1), ("user", "s", "scripts/a.sh", "patch", None, "two", "2", False, 2)]
    more += [("user", "s", "scripts/b.sh", "patch", None, "x", "y", False, 1), ("user", "s", "scripts/b.sh", "remove_file", None, None, None, None, 2), ("user", "s", "scripts/b.sh", "patch", None, "x", "y", False, 3)]
    got = {r.path: r.content for r in skills.apply_file_changes(files, spark.createDataFrame(more, change)).collect()}
    assert got == {"scripts/a.sh": "1 2", "assets/n": "a c"}
    have = spark.createDataFrame([("project", "old", "one")], "source string, name string, content string")
    acts = [("project", "new", "edit", "second", None, None, None, 2), ("project", "new", "create", "first", None, None, None, 1), ("project", "new", "patch", None, "second", "2nd", False, 3), ("project", "old", "create", "no", None, None, None, 1), ("project", "old", "patch", None, "one", "1", False, 2), ("project", "gone", "create", "x", None, None, None, 1), ("project", "gone", "delete", None, None, None, None, 2), ("project", "none", "edit", "x", None, None, None, 1)]
    got = {r.name: r.content for r in skills.apply_changes(have, spark.createDataFrame(acts, "source string, name string, action string, content string, old string, new string, replace_all boolean, at int")).collect()}
    assert got == {"new": "2nd", "old": "1"}


def test_posting_counts(spark):
    rows = spark.createDataFrame([(1, "a b a", "a"), (1, "b c", None), (2, "a", ""), (None, "a a d", "x"), (None, "d", None), (3, None, None)], "id long, t string, u string")
    want = search.postings(rows, "id", ["t", "u"]).groupBy("token").agg(F.count_distinct("id").alias("docs"), F.count(F.lit(1)).alias("hits"))
    got = search.posting_counts(rows, "id", ["t", "u"])
    assert sorted(got.collect()) == sorted(want.collect()) == [("a", 2, 6), ("b", 1, 2), ("c", 1, 1), ("d", 0, 2), ("x", 0, 1)]
    # Rows of different keys move by token alone.
    plan = search.posting_counts(rows.where("id > 1"), "id", ["t"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(token" in plan


def test_resolve_edges_moves_edges_once(spark):
    nodes = spark.createDataFrame([("f", "x", "f"), ("f", "a", "f.a"), ("g", "a", "g.a"), ("g", "b", "g.b"), ("h", "b", "h.b1"), ("h", "b", "h.b2")], "file_path string, name string, qualified_name string").withColumn("parent_qualified", F.when(F.col("qualified_name") == "h.b1", "h.c").otherwise(""))
    nodes = nodes.unionByName(spark.createDataFrame([("h", "m", "h.m", "h.c")], "file_path string, name string, qualified_name string, parent_qualified string"))
    rows = [("1", "CALLS", None, "a", "f", "f.a"), ("2", "CALLS", "f.a", "a", "f", "f.a"), ("3", "CALLS", "f.a", "a", "f", "f.a"), ("4", "IMPORTS", "f.a", "a", "f", None), ("5", "CALLS", "h.m", "b", "h", "h.b1"), ("6", "CALLS", "g.a", "b", "h", None),
            ("7", "CALLS", "z", "x", None, "f"), ("8", "IMPORTS", "z", "g.b", "z", "g.b"), ("9", "CALLS", "z", None, "f", None), ("10", "CALLS", "z", "b", "f", None)]
    edges = spark.createDataFrame(rows, "id string, kind string, source_qualified string, target_name string, file_path string, want string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = graph.resolve_edges(edges, nodes)
        assert {r.id: r.target_qualified for r in got.collect()} == {r[0]: r[5] for r in rows}
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_compact_sorts_for_one_step_at_a_time(spark):
    rows = spark.createDataFrame([("a", t, "tool" if t % 9 == 0 else "user" if t % 2 else "assistant", f"t{t}") for t in range(1, 60)] + [("b", 1, "user", "short")], "conv_id string, turn long, role string, text string")
    notes = spark.createDataFrame([("a", "s")], "conv_id string, summary string")
    got = conversation.compact(rows, notes, 115)
    assert sorted((r.conv_id, r.turn) for r in got.collect()) == [("a", -1), *[("a", t) for t in range(50 + 5, 60)], ("b", 1)]
    small = conversation.snip(rows)
    assert {(r.turn, r.role, r.text, r.note) for r in small.where("turn = 25").collect()} == {(25, "user", "t25", 0), (25, "user", "[Context trimmed: removed 9 messages in the middle]", 1)}
    assert small.count() == 52
    # No line is sorted twice for its note, and the steps read what the first ones wrote.
    assert small._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window") <= 1


def test_memory_save_errors_of_odd_documents(spark, tmp_path):
    import duckdb

    from tessella import catalog

    long = "x" * 16_001
    rows = [(1, "text", "en", "src1", 4), (2, long, "de", "src1", 16_001), (3, long[1:], "en", "src1", 16_000), (4, None, "en", "src1", 0), (5, "", "de", "src1", 0), (6, " " * 90 + long, None, "src1", 16_091), (7, "text", "en", None, 4)]
    rows += [(8, "text", "en", " ", 4), (9, "text", "en", "s" * 2001, 4), (10, long, "en", None, None), (None, "text", "en", "src1", 4), (None, long, "en", "src1", 4), (-11, "\u00e9" * 16_000, "en", "src1", 4)]
    rows += [(i, "text", "en", "src1", 4) for i in range(20, 40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("memory_save_errors", "memory_candidates", "memory_page", "memory_writes", "memory_extracted"):
        got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got, key=str) == sorted(con.execute(catalog.ORACLE_SQL[name]).fetchall(), key=str), name
    # What is saved is still held to all rules.
    odd = spark.createDataFrame([("a", "semantic", "user", "d", "c", "s", "0", "1"), ("b", "semantic", "user", "d", None, "s", "0", "1"), ("c", "semantic", "user", " ", "c", "s", "0", "1"), ("d", "semantic", "user", "d", "c", "s" * 2001, "0", "1"), ("e", "semantic", "project", "d", "c", "s", "0", "1")], schemas.MEMORY)
    errors = {r.id: r.error for r in odd.select("id", memory.save_error().alias("error")).collect()}
    assert errors == {"a": None, "b": "content is empty or too long", "c": "description is empty or too long", "d": "source is empty or too long", "e": "type does not allow this scope"}
