"""Approximate nearest neighbours by inner product: a graph by NN-descent, queries by greedy search of the graph.

1. Equal vectors are one node (of smallest id); copies come back at the end, so any number of them costs nothing.
2. First lists of neighbours: rows are sorted by the signs of random projections, TREES times, and each LEAF rows that
   follow one another are compared.
3. NN-descent: edges meet at the node that they point to. Up to REVERSE nodes that have one neighbour in common, and that
   neighbour itself, are compared, all pairs of them of which one edge is new, since neighbours of neighbours are likely
   neighbours. A node brings its own vector along its edges, so no other join is needed. Each keeps the best LOCAL that beat
   its list; lists are merged and cut to NEIGHBOURS. Ends when less than SETTLED of the edges are new. Edges that the limit
   leaves out at their end stay in the list of their source.
4. Greedy search: a query has a beam of the BEAM best nodes met so far. A round expands those that were not expanded yet: it
   joins them with their neighbours, sends those that are not in the beam to the blocks of vectors, and takes what beats
   the beam. It ends when a round leaves the best FINAL as they were or all nodes of the beam are expanded. Queries begin at their own node and its neighbours.
5. The exact inner product of the best FINAL nodes, their copies, the first TOP by score and id.

The graph is compared in half precision, the search and the results in double precision on the vectors as given. Queries are
never broadcast and no list of a node grows with the corpus: what points to one node is cut before it moves (a limit in a
window), partial lists are too, and the joins of the search have written tables on both sides. All rows are indexed, none is
sampled.

Null ids, and vectors that are null, empty, zero or hold null or non-finite numbers take no part. Shorter vectors end in
zeros. Of several vectors of one id the least counts. With few rows all others are found. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import discard, materialize, ship
from tessella.llm.shingles import mix

NEIGHBOURS, REVERSE, LOCAL, SETTLED, ROUNDS = 32, 48, 8, 0.3, 8
TREES, LEAF, LEAF_ROWS = 6, 1024, 16384
BEAM, FINAL = 256, 40
TOP = 20
#: Nodes of a block of vectors.
BLOCK = 2048
#: Rows that a task works on at a time, at least.
CHUNK = 20_000
#: Pairs of a task that are merged to lists before they move.
COMBINE = 1_000_000

GRAPH = "node long, half binary, nbrs array<long>, scores array<float>, fresh array<boolean>"
STATE = "q long, vec array<double>, ids array<long>, scores array<double>, done array<boolean>"


def whole_keys(batches, at_least: int = CHUNK):
    """Tables of batches that are sorted by their first column (long): no key is in two tables."""
    import pyarrow as pa

    kept, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        n += batch.num_rows
        if n < at_least:
            continue
        table = pa.Table.from_batches(kept)
        key = table.column(0).to_numpy()
        before = np.flatnonzero(key != key[-1])
        if len(before):
            yield table.slice(0, before[-1] + 1)
            kept = table.slice(before[-1] + 1).to_batches()
            n = n - before[-1] - 1
    if n:
        yield pa.Table.from_batches(kept)


def _flat(column):
    """(row number, values) of a list column; null lists are empty."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    sizes = np.asarray(column.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _lists(offsets: np.ndarray, values: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _halves(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), -1).astype(np.float32)


def _best(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int, old: np.ndarray | None = None):
    """The k best different b of each a: (different a, offsets, b, s, old)."""
    old = np.zeros(len(a), bool) if old is None else old
    order = np.lexsort((~old, b, a))
    a, b, s, old = a[order], b[order], s[order], old[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, s, old = a[keep], b[keep], s[keep], old[keep]
    order = np.lexsort((b, -s, a))
    a, b, s, old = a[order], b[order], s[order], old[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    a, b, s, old = a[keep], b[keep], s[keep], old[keep]
    which, first = np.unique(a, return_index=True)
    return which, np.append(first, len(a)), b, s, old


def _emit(found, half=None, fresh=None):
    import pyarrow as pa

    which, offsets, b, s, _ = found
    n = len(which)
    return pa.RecordBatch.from_arrays(
        [pa.array(which, pa.int64()), pa.array(half if half is not None else [None] * n, pa.binary()), _lists(offsets, b.astype(np.int64)), _lists(offsets, s.astype(np.float32)), _lists(offsets, fresh) if fresh is not None else pa.nulls(n, pa.list_(pa.bool_()))],
        ["node", "half", "nbrs", "scores", "fresh"],
    )


# --- the graph ---


def _project(bits: int, scale: float):
    """(node, vec) to a row for each tree: signs of projections, one more projection, the vector in half precision."""

    def run(batches):
        import pyarrow as pa

        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1) / scale
            if planes is None:
                planes = np.random.default_rng(13).normal(size=(x.shape[1], TREES, bits + 1))
            p = np.einsum("nd,dtb->ntb", x, planes)
            code = ((p[:, :, :bits] > 0) * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
            half = [v.tobytes() for v in x.astype(np.float16)]
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code[:, t]), pa.array(p[:, t, bits]), batch.column(0), pa.array(half, pa.binary())], ["tree", "code", "along", "node", "half"])

    return run


def _leaves(batches):
    """Sorted (tree, node, half) to lists of neighbours within LEAF rows that follow one another."""
    import pyarrow as pa

    def compare(rows):
        node, x = rows.column(1).to_numpy(), _halves(rows.column(2))
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        k = min(NEIGHBOURS, len(node) - 1)
        if k < 1:
            return _emit(_best(node[:0], node[:0], s[0, :0], 1))
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return _emit(_best(np.repeat(node, k), node[top].ravel(), np.take_along_axis(s, top, 1).ravel(), k))

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        while table.num_rows:
            same = int(np.searchsorted(table.column(0).to_numpy(), table.column(0)[0].as_py(), side="right"))
            if same == table.num_rows and same < 2 * LEAF:
                break  # the tree may go on
            cut = LEAF if same >= 2 * LEAF else same  # so that the end of a tree is no small leaf
            yield compare(table.slice(0, cut))
            table = table.slice(cut)
        rest = table
    if rest is not None and rest.num_rows:
        yield compare(rest)


def _merge(batches):
    """Sorted rows of GRAPH, of each node one with its vector, to one row: the best edges, new unless that row has them."""
    for table in whole_keys(batches):
        node, half = table.column(0).to_numpy(), table.column(1)
        has = ~np.asarray(half.combine_chunks().is_null())
        row, b = _flat(table.column(2))
        s = _flat(table.column(3))[1]
        which = node[has]
        vectors = half.filter(has).to_pylist()
        found, offsets, b, s, old = _best(np.searchsorted(which, node[row]), b, s, NEIGHBOURS, has[row])
        sizes = np.zeros(len(which), np.int64)
        sizes[found] = np.diff(offsets)
        yield _emit((which, np.concatenate([[0], np.cumsum(sizes)]), b, s, old), vectors, ~old)


def _local_join(batches):
    """Sorted (w, v, fresh, half, worst): compares the members v of each w, gives lists of what beats their worst."""
    found, n = [], 0
    for table in whole_keys(batches):
        w, v = table.column(0).to_numpy(), table.column(1).to_numpy()
        _, group, size = np.unique(w, return_inverse=True, return_counts=True)
        at = np.arange(len(w)) - np.searchsorted(w, w)
        shape = (len(size), int(size.max()))
        x = _halves(table.column(3))
        ids, new, worst, vec = np.full(shape, -1), np.zeros(shape, bool), np.full(shape, np.inf, np.float32), np.zeros((*shape, x.shape[1]), np.float32)
        real = np.zeros(shape, bool)
        ids[group, at], new[group, at], worst[group, at], vec[group, at], real[group, at] = v, table.column(2).to_numpy(), table.column(4).to_numpy(), x, True
        s = vec @ vec.transpose(0, 2, 1)
        fits = (new[:, :, None] | new[:, None, :]) & real[:, :, None] & real[:, None, :] & (ids[:, :, None] != ids[:, None, :]) & (s > worst[:, :, None])
        s[~fits] = -np.inf
        k = min(LOCAL, shape[1])
        top = np.argpartition(-s, k - 1, axis=2)[:, :, :k]
        best = np.take_along_axis(s, top, 2)
        g, i, j = np.nonzero(best > -np.inf)
        found.append((ids[g, i], ids[g, top[g, i, j]], best[g, i, j]))
        n += len(g)
        if n >= COMBINE:
            yield _emit(_best(*map(np.concatenate, zip(*found, strict=True)), NEIGHBOURS))
            found, n = [], 0
    if n:
        yield _emit(_best(*map(np.concatenate, zip(*found, strict=True)), NEIGHBOURS))


def _merged(rows: DataFrame) -> DataFrame:
    return materialize(rows.repartition("node").sortWithinPartitions("node").mapInArrow(_merge, GRAPH), "graph")


def neighbour_graph(nodes: DataFrame, n: int, scale: float) -> DataFrame:
    """GRAPH of nodes (node, vec), n rows of finite numbers up to scale."""
    bits = max(1, min(40, int(np.ceil(np.log2(max(n, 2) / LEAF))) + 1))
    projected = nodes.select("node", "vec").mapInArrow(_project(bits, scale), "tree int, code long, along double, node long, half binary")
    order = ("tree", "code", "along", "node")
    leaves = projected.repartitionByRange(max(1, -(-n * TREES // LEAF_ROWS)), *order).sortWithinPartitions(*order).select("tree", "node", "half").mapInArrow(_leaves, GRAPH)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("nbrs", "array<long>"), ("scores", "array<float>"), ("fresh", "array<boolean>"))]
    graph = _merged(leaves.unionByName(projected.where("tree = 0").select("node", "half", *none)))
    for turn in range(ROUNDS):
        worst = F.when(F.size("scores") < NEIGHBOURS, F.lit(float("-inf")).cast("float")).otherwise(F.element_at("scores", -1))
        ends = F.arrays_zip(F.array_append("nbrs", F.col("node")).alias("w"), F.array_append("fresh", F.lit(False)).alias("fresh"))
        edges = graph.select(F.explode(ends).alias("e"), F.col("node").alias("v"), "half", worst.alias("worst")).select("e.w", "v", "e.fresh", "half", "worst")
        nth = F.row_number().over(Window.partitionBy("w").orderBy(F.col("w") != F.col("v"), F.xxhash64("v", F.lit(turn)), "v"))
        members = edges.withColumn("nth", nth).where(F.col("nth") <= REVERSE + 1).drop("nth")
        # The window has brought the rows of each w into one partition.
        better = members.sortWithinPartitions("w").mapInArrow(_local_join, GRAPH)
        new = _merged(graph.unionByName(better))
        discard(graph)
        graph = new
        fresh, total = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("fresh"))).first()
        if not total or fresh < SETTLED * total:
            break
    return graph


# --- the search ---


def _blocks_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def _name_blocks(blocks: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            block = _blocks_of(batch.column(0).to_numpy(), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), batch.column(0), batch.column(1)], ["block", "node", "vec"])

    return run


def _ask(blocks: int):
    """Sorted (q, vec, ids): a query's row with its vector, beam and bar, then lists of neighbours; to requests (block, q, vec, ids, bar)."""

    def run(batches):
        import pyarrow as pa

        for table in whole_keys(batches, 4 * CHUNK // BEAM):
            q = table.column(0).to_numpy()
            starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            row, ids = _flat(table.column(2))
            cut = np.searchsorted(row, np.arange(len(q) + 1))
            vecs, bars = table.column(1).take(pa.array(starts)).to_pylist(), table.column(3).take(pa.array(starts)).to_numpy()
            out = []
            for k, (x, y) in enumerate(zip(starts, np.append(starts[1:], len(q)), strict=True)):
                asked = np.setdiff1d(ids[cut[x + 1] : cut[y]], ids[cut[x] : cut[x + 1]])
                block = _blocks_of(asked, blocks)
                order = np.argsort(block, kind="stable")
                at = np.flatnonzero(np.append(True, np.diff(block[order]) != 0)) if len(asked) else []
                for part in np.split(order, at[1:]) if len(asked) else ():
                    out.append((int(block[part[0]]), int(q[x]), vecs[k], asked[part], bars[k]))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.float64())
            for a in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out[a : a + 2000]], kind) for k, kind in enumerate(kinds)], ["block", "q", "vec", "ids", "bar"])

    return run


def _score(batches):
    """Sorted (block, q, vec, ids, bar), the nodes of a block (null q, one id) first; to what beats the bar: (q, ids, scores)."""
    import pyarrow as pa

    now, nodes, vectors, matrix = None, [], [], None
    for batch in batches:
        blocks, qs, bars = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(4).to_pylist()
        flat = batch.column(3).flatten().to_numpy()
        cut = np.asarray(batch.column(3).offsets) - batch.column(3).offsets[0].as_py()
        values = batch.column(2).flatten().to_numpy()
        dim = len(values) // max(1, batch.num_rows)
        out = []
        for k in range(batch.num_rows):
            if blocks[k] != now:
                now, nodes, vectors, matrix = blocks[k], [], [], None
            vec, ids = values[k * dim : (k + 1) * dim], flat[cut[k] : cut[k + 1]]
            if qs[k] is None:
                nodes.append(ids[0])
                vectors.append(vec)
                continue
            if matrix is None:
                order = np.argsort(nodes)
                names, matrix = np.array(nodes)[order], np.array(vectors)[order]
            s = matrix[np.searchsorted(names, ids)] @ vec
            keep = np.flatnonzero(s > bars[k])
            if len(keep):
                out.append((qs[k], ids[keep], s[keep]))
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)], ["q", "ids", "scores"])


def _advance(batches):
    """Sorted STATE rows, a query's own first (its vec is not null), then what was found: to its next state. All is done if the
    best FINAL are those of before."""
    import pyarrow as pa

    for table in whole_keys(batches, 4 * CHUNK // BEAM):
        q = table.column(0).to_numpy()
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        row, ids = _flat(table.column(2))
        scores, cut = _flat(table.column(3))[1], np.searchsorted(row, np.arange(len(q) + 1))
        held = np.diff(cut)[starts]
        out = []
        for k, (x, y) in enumerate(zip(starts, np.append(starts[1:], len(q)), strict=True)):
            i, s = ids[cut[x] : cut[y]], scores[cut[x] : cut[y]]
            d = np.arange(len(i)) < held[k]
            order = np.lexsort((i, -s))[:BEAM]
            same = set(order[:FINAL].tolist()) == set(range(min(FINAL, held[k])))
            out.append((i[order], s[order], d[order] | same))
        sizes = np.concatenate([[0], np.cumsum([len(x[0]) for x in out])])
        yield pa.RecordBatch.from_arrays([pa.array(q[starts]), table.column(1).take(pa.array(starts)).combine_chunks(), *[_lists(sizes, np.concatenate([x[c] for x in out])) for c in range(3)]], ["q", "vec", "ids", "scores", "done"])


def search(graph: DataFrame, nodes: DataFrame, n: int, scale: float, starts: DataFrame) -> DataFrame:
    """STATE of each query of starts (q, vec, node) when its beam has nothing left to expand; nodes (node, vec) has n rows."""
    blocks = max(1, -(-n // BLOCK))
    vectors = materialize(nodes.select("node", "vec").mapInArrow(_name_blocks(blocks), "block long, node long, vec array<double>"), "blocks")
    # Scores of the first beam are those of the graph, in half precision; what is returned is computed anew.
    own = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    first = starts.join(graph.select("node", "nbrs", F.transform("scores", lambda s: s.cast("double") * scale * scale).alias("near")).hint("merge"), "node")
    beam = F.sort_array(F.arrays_zip(F.concat(F.array(own), "near").alias("s"), F.concat(F.array("node"), "nbrs").alias("i")), asc=False)
    first = first.select("q", "vec", beam.alias("b"))
    state = materialize(first.select("q", "vec", F.transform("b", lambda x: x["i"]).alias("ids"), F.transform("b", lambda x: x["s"]).alias("scores"), F.transform("b", lambda x: F.lit(False)).alias("done")), "state")
    while not (open_ := state.where(F.exists("done", lambda x: ~x))).isEmpty():
        bar = F.when(F.size("ids") < BEAM, F.lit(float("-inf"))).otherwise(F.element_at("scores", -1))
        frontier = open_.select("q", F.explode(F.filter(F.arrays_zip("ids", "done"), lambda x: ~x["done"])).alias("x")).select("q", F.col("x.ids").alias("node"))
        near = frontier.join(graph.select("node", "nbrs").hint("merge"), "node").select("q", F.lit(None).cast("array<double>").alias("vec"), F.col("nbrs").alias("ids"), F.lit(None).cast("double").alias("bar"))
        asked = open_.select("q", "vec", "ids", bar.alias("bar")).unionByName(near).repartition("q").sortWithinPartitions("q", F.col("vec").isNull()).mapInArrow(_ask(blocks), "block long, q long, vec array<double>, ids array<long>, bar double")
        stored = vectors.select("block", F.lit(None).cast("long").alias("q"), "vec", F.array("node").alias("ids"), F.lit(None).cast("double").alias("bar"))
        scored = stored.unionByName(asked).repartition("block").sortWithinPartitions("block", F.col("q").isNotNull()).mapInArrow(_score, "q long, ids array<long>, scores array<double>")
        scored = scored.select("q", F.lit(None).cast("array<double>").alias("vec"), "ids", "scores", F.lit(None).cast("array<boolean>").alias("done"))
        new = open_.unionByName(scored).repartition("q").sortWithinPartitions("q", F.col("vec").isNull()).mapInArrow(_advance, STATE)
        new = materialize(state.where(~F.exists("done", lambda x: ~x)).unionByName(new), "state")
        discard(state)
        state = new
    discard(vectors)
    return state


def nearest(vectors: DataFrame, queries: Column, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) that fulfils queries (on vec_id) its nearest others."""
    spark = vectors.sparkSession
    ship(spark)
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull()).where(fine).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(e.cast("array<double>")).alias("vec"))
    rows = materialize(rows, "vectors")
    dim, scale = rows.agg(F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", lambda x: F.abs(x))))).first()
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    padded = F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vec")))
    whole = rows.select("vec_id", F.transform(padded, lambda x: x + 0.0).alias("vec"))  # no negative zeros
    nodes = materialize(whole.groupBy("vec").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")).select("node", "vec", "n"), "nodes")
    n = nodes.count()
    # The first top + 1 ids of each node; the limit goes below the exchange of the window. Only nodes with copies are joined.
    several = nodes.where("n > 1")
    copies = whole.join(several.select("vec", "node").hint("merge"), "vec").select("node", "vec_id").withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("nth") <= top + 1).drop("nth")
    copies = materialize(copies.unionByName(nodes.where("n = 1").select("node", F.col("node").alias("vec_id"))), "copies")
    asked = materialize(whole.where(queries).join(nodes.select("vec", "node").hint("merge"), "vec").select(F.col("vec_id").alias("query_id"), "node"), "queries")
    graph = neighbour_graph(nodes, n, scale)
    starts = nodes.join(asked.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("q"), "vec", "node")
    state = search(graph, nodes, n, scale, starts)
    found = state.select("q", F.posexplode(F.slice("ids", 1, max(FINAL, 2 * top))).alias("at", "node"), "vec")
    dot = F.aggregate(F.zip_with("vec", "own", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    exact = found.join(nodes.select("node", F.col("vec").alias("own")).hint("merge"), "node").select("q", "node", dot.alias("score"))
    exact = exact.join(copies.hint("merge"), "node").select("q", "vec_id", "score")
    # A node of many queries: one list of top + 1 answers serves them all.
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    lists = materialize(exact.withColumn("nth", nth).where(F.col("nth") <= top + 1), "lists")
    met = asked.join(lists.withColumnRenamed("q", "node"), "node").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = met.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= top)
    discard(graph, state, rows)
    return out


def op13(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
