"""The index of a source tree: what changed, versioned snapshots, and the cache of embeddings."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella import schemas
from tessella.functions.hashing import cache_key
from tessella.functions.text import embedding_text
from tessella.functions.values import valid_vector
from tessella.operators.graph import resolve_edges, resolve_imports
from tessella.operators.ranking import numbered
from tessella.sources.files import symbols
from tessella.storage import discard, materialize, scratch

EMBED_BATCH = 20
#: The mark of a version that is whole.
COMMITTED = "_COMMITTED"
#: Tables that lie in buckets of files, and how many.
BUCKETED, BUCKETS = ("nodes", "edges"), 32


def diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state): deleted, added, changed or unchanged, by content hash alone."""
    s, c = stored.select("path", F.col("content_hash").alias("was")), current.select("path", F.col("content_hash").alias("now"))
    state = F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull(), "added").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return s.join(c, "path", "full_outer").select("path", state.alias("state"))


def refresh_mode(initial: bool, changed: int, deleted: int) -> str:
    return "full" if initial else "incremental" if changed or deleted else "unchanged"


def _lines(spark: SparkSession, path: str) -> dict | None:
    at, fs = _folder(spark, path)
    return json.loads(spark.read.text(path, wholetext=True).first().value) if fs.exists(at) else None


def bucket_of(file_path: Column) -> Column:
    return F.pmod(F.crc32(F.encode(file_path, "UTF-8")), F.lit(BUCKETS)).cast("int")


def manifest(spark: SparkSession, root: str, version: int) -> dict:
    """What a version is made of: for nodes and edges the segment of each bucket, and the head that its snapshot belongs to."""
    return _lines(spark, f"{root}/v{version}/manifest") or {"nodes": {}, "edges": {}, "head": None}


def read(spark: SparkSession, root: str, version: int, table: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """A table of a version; of nodes and edges, some buckets of files if only those are wanted."""
    if table not in BUCKETED:
        return spark.read.parquet(f"{root}/v{version}/{table}")
    found = manifest(spark, root, version)
    paths = [f"{root}/{table}/{segment}/bucket={b}" for b, segment in found[table].items() if buckets is None or int(b) in buckets]
    schema = StructType.fromJson(found["schemas"][table])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _write_buckets(rows: DataFrame, root: str, table: str, segment: str) -> list[int]:
    """Writes rows (which have file_path) as one segment, a folder for each bucket; gives the buckets that have rows."""
    spark = rows.sparkSession
    rows.withColumn("bucket", bucket_of(F.col("file_path"))).repartition("bucket", F.pmod(F.xxhash64("file_path"), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{table}/{segment}")
    path, fs = _folder(spark, f"{root}/{table}/{segment}")
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if "=" in s.getPath().getName())


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write(spark: SparkSession, root: str, version: int, found: dict, **tables: DataFrame) -> None:
    """A new version beside the old ones: readers of the old see no change. The mark COMMITTED comes last; a version without
    it is not there (latest_version()), and the next run writes it again."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/v{version}/{name}")
    spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/v{version}/manifest")
    path, fs = _folder(spark, f"{root}/v{version}/{COMMITTED}")
    fs.create(path, True).close()


def latest_version(spark: SparkSession, root: str) -> int | None:
    """The newest version that was written to its end."""
    path, fs = _folder(spark, root)
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    whole = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(_folder(spark, f"{root}/{n}/{COMMITTED}")[0])]
    return max(whole, default=None)


def link(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """edges with targets: names first, then imports as paths. The former are written, as both parts begin with them."""
    named = materialize(resolve_edges(edges, nodes), "named")
    imports = named.where("kind = 'IMPORTS' and target_qualified is null")
    return named.where("kind <> 'IMPORTS' or target_qualified is not null").unionByName(resolve_imports(imports, files).select(*named.columns))


def relink(old_edges: DataFrame, new_edges: DataFrame, old_nodes: DataFrame, new_nodes: DataFrame, files: DataFrame, touched: DataFrame, moved: bool) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Edges after a change of files: those that are linked again, with changed (true where the target is another one or the
    file was touched), and a function that leaves of edges before (all, or some buckets) those that stay as they are.

    old_edges and old_nodes are those before, touched (file_path) the files whose nodes and edges were made anew (new_nodes,
    new_edges). A target can only change for a name that gained or lost a node, and for imports if files came or went (moved);
    only those edges are linked, against the nodes that they can mean. The others keep their targets and are not moved.
    """
    mark = ["qualified_name", "name", "file_path", "parent_qualified"]
    before = old_nodes.join(touched, "file_path", "left_semi").select(*mark).distinct()
    delta = before.unionByName(new_nodes.select(*mark).distinct()).groupBy(*mark).agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    affected = materialize(delta.select(F.explode(F.array("name", "qualified_name")).alias("target_name")).distinct().withColumn("__hit", F.lit(True)), "names")
    again = F.coalesce("__hit", F.lit(False)) | (F.lit(moved) & (F.col("kind") == "IMPORTS"))

    def kept(edges: DataFrame, linked_again: bool) -> DataFrame:
        rows = edges.join(touched, "file_path", "left_anti").join(affected, "target_name", "left")
        return rows.where(again if linked_again else ~again).select(*old_edges.columns)

    stale = kept(old_edges, True).withColumnsRenamed({"target_qualified": "__was"}).withColumn("__new", F.lit(False))
    fresh = new_edges.select(*[c for c in old_edges.columns if c != "target_qualified"]).withColumns({"__was": F.lit(None).cast("string"), "__new": F.lit(True)})
    open_ = materialize(stale.unionByName(fresh), "open")
    wanted = materialize(open_.select(F.explode(F.array("target_name", "source_qualified")).alias("__wanted")).distinct().withColumn("__hit", F.lit(True)), "wanted")
    # All nodes of a name that is looked up, so that it is counted as among all nodes.
    near = old_nodes.join(touched, "file_path", "left_anti").select(*mark).unionByName(new_nodes.select(*mark))
    for name in ("name", "qualified_name"):
        near = near.join(wanted.select(F.col("__wanted").alias(name), F.col("__hit").alias(f"__{name}")), name, "left")
    near = materialize(near.where("__name or __qualified_name").select(*mark), "near")
    linked = link(near, open_, files).withColumn("changed", F.col("__new") | ~F.col("target_qualified").eqNullSafe(F.col("__was")))
    return materialize(linked.select(*old_edges.columns, "changed"), "relinked"), lambda edges: kept(edges, False)


def refresh(spark: SparkSession, root: str, classified: DataFrame, version: int | None, head: str | None = None) -> dict:
    """Brings the index at root from version (None: none yet) to the next; only files whose content changed are parsed.

    Nodes and edges lie in buckets of files. A refresh links the edges whose targets can have changed (relink()) and writes
    the buckets of changed files and of edges with another target; all other buckets are those of the version before.
    Nodes of changed and deleted files, and the edges that pointed at them, are kept in a snapshot for impact queries, which
    begins anew when head (the commit that the tree is on) is another than before.
    """
    use_it = F.col("language").isNotNull() & F.col("skip").isNull()
    # Read and hashed once; of files that are skipped the content is not kept.
    every = classified.withColumn("content", F.when(use_it, F.col("content"))).persist()
    try:
        with scratch():
            return _refresh(spark, root, every.where(use_it), every.where(F.col("skip").isNotNull()).count(), version, head)
    finally:
        every.unpersist()


def _refresh(spark: SparkSession, root: str, use: DataFrame, skipped: int, version: int | None, head: str | None) -> dict:
    current = use.select("path", "language", "size", "mtime_ns", "content_hash")
    if version is None:
        nodes, edges = symbols(use)
        linked = link(nodes, edges, current)
        shape = {"nodes": nodes.schema.jsonValue(), "edges": linked.schema.jsonValue()}
        found = {"nodes": {str(b): "s1" for b in _write_buckets(nodes, root, "nodes", "s1")}, "edges": {str(b): "s1" for b in _write_buckets(linked, root, "edges", "s1")}, "head": head, "schemas": shape}
        write(spark, root, 1, found, files=current, old_nodes=nodes.limit(0), old_edges=linked.limit(0))
        return {"mode": "full", "version": 1, "updated_files": current.count(), "deleted_files": 0, "skipped_files": skipped}
    states = materialize(diff(read(spark, root, version, "files"), current), "states")
    counts = {r.state: r["count"] for r in states.groupBy("state").count().collect()}
    changed, deleted = counts.get("added", 0) + counts.get("changed", 0), counts.get("deleted", 0)
    mode = refresh_mode(False, changed, deleted)
    found = manifest(spark, root, version)
    same_head = head == found["head"]
    if mode == "unchanged" and same_head:
        return {"mode": mode, "version": version, "updated_files": 0, "deleted_files": 0, "skipped_files": skipped}
    new = version + 1
    touched = states.where("state <> 'unchanged'").select(F.col("path").alias("file_path"))
    old_nodes, old_edges = read(spark, root, version, "nodes"), read(spark, root, version, "edges")
    new_nodes, new_edges = symbols(use.join(touched.select(F.col("file_path").alias("path")), "path", "left_semi"))
    new_nodes = new_nodes.select(*old_nodes.columns)
    linked, unlinked = relink(old_edges, new_edges, old_nodes, new_nodes, current, touched, bool(counts.get("added", 0) or deleted))
    # BUCKETS numbers at most.
    of_nodes = sorted(r[0] for r in touched.select(bucket_of(F.col("file_path"))).distinct().collect())
    of_edges = sorted({r[0] for r in linked.where("changed").select(bucket_of(F.col("file_path"))).distinct().collect()} | set(of_nodes))
    again = linked.drop("changed").where(bucket_of(F.col("file_path")).isin(of_edges))
    rows = {
        "nodes": (read(spark, root, version, "nodes", of_nodes).join(touched, "file_path", "left_anti").unionByName(new_nodes), of_nodes),
        "edges": (again.unionByName(unlinked(read(spark, root, version, "edges", of_edges))), of_edges),
    }
    after = dict(found, head=head)
    for table, (some, buckets) in rows.items():
        have = _write_buckets(some, root, table, f"s{new}")
        after[table] = {b: s for b, s in found[table].items() if int(b) not in buckets} | {str(b): f"s{new}" for b in have}
    gone = old_nodes.join(touched, "file_path", "left_semi")
    incoming = old_edges.join(gone.select(F.col("qualified_name").alias("target_qualified")), "target_qualified", "left_semi").select(*old_edges.columns)
    if same_head:
        gone, incoming = read(spark, root, version, "old_nodes").unionByName(gone), read(spark, root, version, "old_edges").unionByName(incoming)
    write(spark, root, new, after, files=current, old_nodes=gone.dropDuplicates(["qualified_name"]), old_edges=incoming.dropDuplicates(["source_qualified", "target_qualified", "kind", "line"]))
    return {"mode": mode, "version": new, "updated_files": changed, "deleted_files": deleted, "skipped_files": skipped, "written": {t: len(b) for t, (_, b) in rows.items()}}


def cache_misses(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """wanted (qualified_name, text_hash) without those that the cache has with the same hash."""
    return wanted.join(cached.select("qualified_name", "text_hash"), ["qualified_name", "text_hash"], "left_anti")


def embedding_inputs(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(qualified_name, text, text_hash) of each node."""
    met = nodes.join(files.select(F.col("path").alias("file_path"), "language", "content_hash"), "file_path")
    text = embedding_text(F.col("kind"), F.col("name"), F.col("qualified_name"), F.col("file_path"), F.col("parent_qualified"), F.col("language"))
    rows = met.select("qualified_name", "content_hash", text.alias("text"))
    return rows.select("qualified_name", "text", cache_key(F.col("content_hash"), F.col("text")).alias("text_hash"))


def refresh_embeddings(nodes: DataFrame, files: DataFrame, cached: DataFrame, embed: Callable[[list[str]], Sequence[Sequence[float]]], dimension: int, identity: str, provider: str, model: str) -> DataFrame:
    """All current embeddings of one provider: cached ones whose text is unchanged, new ones by embed in batches of EMBED_BATCH.

    Vectors of another length, or with values that are no finite numbers, stop the run.
    """
    wanted = embedding_inputs(nodes, files)
    mine = cached.where(F.col("provider_identity") == identity)
    hits = mine.join(wanted.select("qualified_name", "text_hash"), ["qualified_name", "text_hash"], "left_semi")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            vectors = []
            for at in range(0, len(pdf), EMBED_BATCH):
                texts = pdf["text"].iloc[at : at + EMBED_BATCH].tolist()
                got = embed(texts)
                if len(got) != len(texts):
                    raise ValueError("the embedder returned another number of vectors")
                vectors += [[float(x) for x in v] for v in got]
            yield pd.DataFrame({"qualified_name": pdf["qualified_name"], "text_hash": pdf["text_hash"], "vector": vectors})

    new = cache_misses(wanted, mine).mapInPandas(run, "qualified_name string, text_hash string, vector array<float>")
    good = F.when(valid_vector(F.col("vector"), dimension), F.col("vector")).otherwise(F.raise_error(F.lit("embedding of another length or not finite")))
    new = new.select("qualified_name", F.lit(identity).alias("provider_identity"), "text_hash", good.alias("vector"), F.lit(dimension).alias("dimension"), F.lit(provider).alias("provider"), F.lit(model).alias("model"))
    columns = [f.name for f in schemas.EMBEDDINGS]
    return hits.select(*columns).unionByName(new.select(*columns))


LEDGER = "identity string, qualified_name string, text_hash string, vector array<float>, error string, wave int"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(identity, qualified_name, text_hash, vector) that runs have committed below path; the last write of a key wins."""
    at, fs = _folder(spark, path)
    if not fs.exists(at):
        return spark.createDataFrame([], LEDGER).drop("error", "wave")
    rows = spark.read.schema(LEDGER).parquet(path).where("error is null")
    return rows.groupBy("identity", "qualified_name", "text_hash").agg(F.max_by("vector", "wave").alias("vector"))


def embed_with_ledger(spark: SparkSession, path: str, nodes: DataFrame, files: DataFrame, embed: Callable[[list[str]], Sequence[Sequence[float]]], dimension: int, identity: str, wave_batches: int = 500) -> DataFrame:
    """The current embeddings of one provider (as ledger()); what a run has done is kept if it fails half-way.

    Texts that the ledger lacks are numbered by hash in batches of EMBED_BATCH; a wave of at most wave_batches batches is a
    job that commits as a whole. A batch whose embedder fails, or gives vectors that are not valid, ends the work of its
    task with an error row; the wave is committed with all batches that are done, then the run stops with the error. The
    next run begins with what is missing.
    """
    wanted = embedding_inputs(nodes, files)

    def run(tables):
        import pandas as pd

        rows, stopped = pd.concat([t for t in tables] or [pd.DataFrame({"batch": [], "qualified_name": [], "text": [], "text_hash": []})]), None
        for _, pdf in rows.groupby("batch", sort=True):
            vectors: list = [None] * len(pdf)
            if stopped is None:
                try:
                    got = [[float(x) for x in v] for v in embed(pdf["text"].tolist())]
                    if len(got) != len(pdf) or any(len(v) != dimension or not all(map(math.isfinite, v)) for v in got):
                        raise ValueError("another number of vectors, or vectors of another length or not finite")
                    vectors = got
                except Exception as e:  # what the embedder raises is reported when the wave is committed
                    stopped = f"{type(e).__name__}: {e}"[:500]
            yield pd.DataFrame({"identity": identity, "qualified_name": pdf["qualified_name"], "text_hash": pdf["text_hash"], "vector": vectors, "error": stopped})

    wave = (spark.read.schema(LEDGER).parquet(path).agg(F.max("wave")).first()[0] or 0) if _folder(spark, path)[1].exists(_folder(spark, path)[0]) else 0
    while True:
        have = ledger(spark, path).where(F.col("identity") == identity)
        missing = wanted.join(have.select("qualified_name", "text_hash"), ["qualified_name", "text_hash"], "left_anti")
        placed = numbered(missing, [], ["text_hash", "qualified_name"]).withColumn("batch", F.floor((F.col("place") - 1) / EMBED_BATCH))
        now = materialize(placed.where(F.col("batch") < wave_batches).select("batch", "qualified_name", "text", "text_hash"), "wave")
        if now.isEmpty():
            return have.join(wanted.select("qualified_name", "text_hash"), ["qualified_name", "text_hash"], "left_semi").select("identity", "qualified_name", "text_hash", "vector")
        wave += 1
        out = now.repartition("batch").sortWithinPartitions("batch").mapInPandas(run, "identity string, qualified_name string, text_hash string, vector array<float>, error string")
        out.withColumn("wave", F.lit(wave)).write.mode("append").parquet(path)
        discard(now)
        failed = spark.read.schema(LEDGER).parquet(path).where((F.col("wave") == wave) & F.col("error").isNotNull()).select("error").first()
        if failed:
            raise RuntimeError(f"embeddings stopped: {failed.error}")


def vectors_of(embeddings: DataFrame, nodes: DataFrame, identity: str, kind: str | None = None) -> DataFrame:
    """Nodes (of a kind) with their vectors of one provider, for semantic search."""
    mine = embeddings.where(F.col("provider_identity") == identity).select("qualified_name", "vector", "dimension")
    return (nodes if kind is None else nodes.where(F.col("kind") == kind)).join(mine, "qualified_name")


def checked_query(vectors: DataFrame, query: Sequence[float]) -> Sequence[float]:
    """query, if the stored vectors have its length and its values are finite numbers."""
    stored = vectors.select("dimension").limit(1).collect()
    if stored and stored[0][0] != len(query):
        raise ValueError(f"the query has {len(query)} dimensions, the index {stored[0][0]}")
    if not all(math.isfinite(x) for x in query):
        raise ValueError("the query has values that are no finite numbers")
    return query


def live_embeddings(embeddings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Embeddings whose node exists."""
    return embeddings.join(nodes.select("qualified_name"), "qualified_name", "left_semi")
