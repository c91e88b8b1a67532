"""Near-duplicates of texts by DartMinHash.

A text is a weighted set: its five-word shingles with their numbers of occurrences. Hashed darts fall on the plane
(weight, rank) of each shingle with density one, the same ones in every text; a dart hits a text if its weight
coordinate lies below the shingle's weight there. Each dart belongs to one of COORDINATES coordinates; the text's
signature has the hit of lowest rank in each. Ranks are looked at in regions that double in width, until every
coordinate has its dart, so a text costs time in proportion to its shingles plus the darts it needs. Two texts
agree in a coordinate with the probability of their weighted Jaccard similarity.

Bands of ROWS coordinates give the keys of buckets. What follows is exact for the pairs that share a bucket:

1. Texts of the same words are one node (any number of copies).
2. Each member of a bucket is compared with the bucket's smallest node, its leader; pairs from SIMILARITY on are links.
3. Buckets whose members are in several classes get another node to compare with, PIVOTS times.
4. What is left are buckets of texts of graded similarity. Those of one leader are a group, a group is cut in blocks of
   bounded size, and one task takes two blocks: it compares the pairs of different classes that share a bucket of this
   leader and none of a smaller one (so each pair is compared in one group), and returns a spanning set of the links.
   Pairs are never rows, and a pair that the links found so far connect is not compared.
5. Classes are the connected components of the links.

Comparisons with one node (2 and 3) are dealt out in parts of at most STAR_NODES members, each with a copy of that node,
so a node that a third of all texts is compared with is no hot task. The work of 4 grows with the square of a bucket's
different, unconnected texts, as blocks are read in pairs; nothing is left out to avoid that.

Comparisons use whole texts. All tables between the steps are written to the shared folder; joins on keys that
many rows share can be split by adaptive execution. Nulls count as empty; a text without words is a class of its
own. Repeated rows and ids are rows of their own. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import RID, discard, materialize, number_rows, ship
from tessella.llm.shingles import elements, in_chunks, mix, word_hashes, words_of

#: Coordinates of a signature, and those of a band: a pair of similarity 0.8 is missed with probability 5e-8.
COORDINATES, ROWS = 128, 4
SIMILARITY = 0.8
#: Further nodes that unresolved buckets are compared with before blocks of them.
PIVOTS = 2
#: Members of a part of a star; nodes and words of a block; elements whose matrix columns are multiplied at a time.
STAR_NODES, BLOCK_NODES, BLOCK_WORDS, COLUMNS = 256, 1024, 500_000, 2048
#: Width of the lowest region of ranks, as a power of two.
LOWEST = -4


def _poisson(width: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, ... darts in a region of this area."""
    p, total, out, i = np.exp(-width), 0.0, [], 0
    while i < width or p > 1e-18:
        total += p
        out.append(total)
        i += 1
        p *= width / i
    return np.array(out)


def _fractions(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(elems: np.ndarray, counts: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """A row of k dart ids for each text (zeros for texts without elements)."""
    n = len(counts)
    ids, filled = np.zeros(n * k, np.uint64), np.zeros(n * k, bool)
    todo = counts > 0
    doc = np.repeat(np.arange(n), counts)
    low, level = 0.0, LOWEST
    while todo.any():
        high = 2.0**level
        use = todo[doc]
        e, d = elems[use], doc[use]
        seed = mix(e + np.uint64((level + 64) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        many = np.searchsorted(_poisson(high - low), _fractions(seed), side="right")
        hit = many > 0
        e, d, seed, many = e[hit], d[hit], seed[hit], many[hit]
        number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        dart = mix(np.repeat(seed, many) + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
        slot = np.repeat(d, many) * k + (dart % np.uint64(k)).astype(np.int64)
        free = ~filled[slot]
        dart, slot = dart[free], slot[free]
        rank = mix(dart)  # uniform in the region; lower regions are over already
        order = np.lexsort((rank, slot))
        slot, dart = slot[order], dart[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        ids[slot[first]], filled[slot[first]] = dart[first], True
        todo &= ~filled.reshape(n, k).all(axis=1)
        low, level = high, level + 1
    return ids.reshape(n, k)


def band_keys(sigs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band of each signature."""
    n, k = sigs.shape
    parts = sigs.reshape(n, k // rows, rows)
    key = np.repeat(np.arange(k // rows, dtype=np.uint64)[None, :], n, axis=0)
    for j in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key


def _sign(batches):
    """(RID, doc_id, text, tie) to RID, doc_id, tie, two halves of a hash of the words, number of shingles, band keys."""
    import pyarrow as pa
    import xxhash

    for batch in batches:
        texts = batch.column(2).to_pylist()
        for a, b in in_chunks(texts):
            words = [words_of(t) for t in texts[a:b]]
            same = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
            lengths = np.array([len(w) for w in words], np.int64)
            elems, counts = elements(word_hashes([x for w in words for x in w]), lengths)
            keys = band_keys(signatures(elems, counts)).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, keys.shape[1], 0))]).astype(np.int32)
            halves = np.frombuffer(b"".join(same), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], batch.column(1)[a:b], batch.column(3)[a:b], pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(counts), pa.ListArray.from_arrays(offsets, pa.array(keys[counts > 0].ravel()))],
                ["rid", "doc_id", "tie", "h1", "h2", "size", "keys"],
            )


def _elements(text: str | None) -> np.ndarray:
    w = words_of(text)
    return elements(word_hashes(w), np.array([len(w)], np.int64))[0]


def _compare(similarity: float):
    """(centre, part, node, text), the centre first in each part, to links (a, b) of the centre."""

    def run(batches):
        import pyarrow as pa

        now, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            centres, parts, nodes = (batch.column(c).to_pylist() for c in range(3))
            out = []
            for k, (centre, part, node) in enumerate(zip(centres, parts, nodes, strict=True)):
                have = _elements(batch.column(3)[k].as_py())
                if (centre, part) != now:
                    assert node == centre, "a part must begin with its centre"
                    now, mine = (centre, part), np.unique(have)
                    continue
                both = len(np.intersect1d(mine, have))
                if both >= similarity * (len(mine) + len(have) - both):
                    out.append((min(node, centre), max(node, centre)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def _star_links(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links among distinct pairs (node, centre), as a table; texts (node, text) has every node and centre."""
    parts = materialize(pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STAR_NODES).cast("int").alias("parts")), "parts")
    members = pairs.join(parts, "centre").select("centre", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node")
    centres = parts.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("centre").alias("node"))
    rows = members.unionByName(centres).join(texts.hint("merge"), "node").select("centre", "part", "node", "text")
    dealt = rows.repartition("centre", "part").sortWithinPartitions("centre", "part", F.col("node") != F.col("centre"), "node")
    links = materialize(dealt.mapInArrow(_compare(similarity), "a long, b long"), "links")
    discard(parts)
    return links


def _block_links(similarity: float):
    def run(table):
        """Links between two blocks (i, j) of a leader's buckets (within one if they are the same): a, b."""
        import pyarrow as pa

        i, j, leader = (table[c][0].as_py() for c in ("i", "j", "leader"))
        node, block = table["node"].to_numpy(), table["block"].to_numpy()
        _, root = np.unique(table["label"].to_numpy(), return_inverse=True)
        sets = [np.unique(_elements(t.as_py())) for t in table["text"]]
        size = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        owner = np.repeat(np.arange(len(node)), size)
        _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(times > 1) - 1  # an element of one text alone is in no intersection
        use = times[code] > 1
        code, owner = column[code[use]], owner[use]
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        both = np.zeros((len(left), len(right)), np.float32)
        for low in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
            x, y = np.searchsorted(code, (low, low + COLUMNS))
            has = np.zeros((len(node), COLUMNS), np.float32)
            has[owner[x:y], code[x:y] - low] = 1
            both += has[left] @ has[right].T
        fits = both >= similarity * (size[left][:, None] + size[right][None, :] - both)
        if i == j:
            fits &= left[:, None] < right[None, :]
        # Buckets that a pair shares: each has a key and a leader, and the pair belongs to the smallest leader.
        shared, counts = table["buckets"].combine_chunks(), table["buckets"].combine_chunks().value_lengths().to_numpy()
        flat = shared.flatten()
        keys, leaders, whose = flat.field("key").to_numpy(), flat.field("leader").to_numpy(), np.repeat(np.arange(len(node)), counts)
        here = {}
        for k in np.flatnonzero(leaders <= leader):
            here.setdefault(int(whose[k]), {})[int(keys[k])] = int(leaders[k])
        out = []
        for x, y in zip(*np.nonzero(fits), strict=True):
            a, b = left[x], right[y]
            if root[a] == root[b]:
                continue
            met = [found for key, found in here.get(int(a), {}).items() if key in here.get(int(b), {})]
            if met and min(met) == leader:
                out.append((min(node[a], node[b]), max(node[a], node[b])))
                root[root == root[b]] = root[a]
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


def _group_links(left: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links within unresolved buckets, as a table: left (key, node, size, leader, label) has all their members."""
    each = left.groupBy("node").agg(F.collect_list(F.struct("key", "leader")).alias("buckets"), F.max("size").alias("size"), F.max("label").alias("label"))  # at most a bucket for each band
    rows = materialize(each.select("node", "size", "label", "buckets", F.explode(F.array_distinct(F.transform("buckets", lambda x: x["leader"]))).alias("leader")), "rows")
    cut = rows.groupBy("leader").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("size") / BLOCK_WORDS)).cast("int").alias("blocks"))
    cut = materialize(cut, "cut")
    placed = rows.join(cut, "leader").withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")).join(texts.hint("merge"), "node")
    pairs = placed.select("leader", "node", "label", "buckets", "text", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    links = materialize(pairs.groupBy("leader", "i", "j").applyInArrow(_block_links(similarity), "a long, b long"), "links")
    discard(rows, cut)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): label is the smallest node of the component.

    Each round takes every node to that of itself and its neighbours which comes first in an order of the round's own
    and contracts the edges. The first order is by id: links run from leaders, which are the smallest of their buckets, so
    that a star is one node after one round (by hash it would take rounds in proportion to the logarithm of its members).
    Later ones are by hash, so the nodes of a component become fewer by half or so in each round, whatever its shape and
    its ids: 1,000 nodes in a chain take about 10 rounds.
    """
    tidy = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    now = materialize(edges.select(*tidy("a", "b")).where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not now.isEmpty():
        ends = now.select(F.col("a").alias("node"), F.col("b").alias("near")).unionAll(now.select(F.col("b").alias("node"), F.col("a").alias("near")))
        first = lambda c, turn=len(steps): F.struct((F.xxhash64(c, F.lit(turn)) if turn else F.col(c)).alias("h"), F.col(c).alias("to"))
        step = materialize(ends.groupBy("node").agg(F.min(first("near")).alias("near")).select("node", F.least(first("node"), "near")["to"].alias("to")), "step")
        x, y = step.select(F.col("node").alias("a"), F.col("to").alias("x")), step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        new = materialize(now.join(x, "a").join(y, "b").select(*tidy("x", "y")).where("a <> b").distinct(), "edges")
        discard(now)
        now, steps = new, [*steps, step]
    if not steps:
        return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    end = steps[-1]
    for step in steps[-2::-1]:
        end = step.join(end.select(F.col("node").alias("to"), F.col("to").alias("end")), "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    end = materialize(end, "ends")
    least = materialize(end.groupBy("to").agg(F.min("node").alias("label")), "least")
    labels = materialize(end.join(least, "to").select("node", "label"), "labels")
    discard(now, end, least, *steps)
    return labels


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels after further links: only the links between classes are looked at."""
    if labels is None:
        return components(links)
    at = lambda end, to: labels.select(F.col("node").alias(end), F.col("label").alias(to))
    between = links.join(at("a", "x"), "a", "left").join(at("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    higher = components(between)
    moved = higher.select(F.col("node").alias("label"), F.col("label").alias("end"))
    kept = labels.join(moved, "label", "left").select("node", F.coalesce("end", "label").alias("label"))
    fresh = higher.join(labels.select("node"), "node", "left_anti").select("node", "label")
    out = materialize(kept.unionByName(fresh), "labels")
    discard(labels, higher)
    return out


def near_classes(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(RID, doc_id, tie, label) of each row of rows (RID, doc_id, text): label is the smallest RID of its class, tie a hash of the text."""
    spark = rows.sparkSession
    ship(spark)
    named = rows.select(RID, "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    signed = materialize(named.mapInArrow(_sign, "rid long, doc_id long, tie long, h1 long, h2 long, size long, keys array<long>"), "signed")
    nodes = materialize(signed.where("size > 0").groupBy("h1", "h2").agg(F.min("rid").alias("node")), "nodes")
    bands = signed.select(F.col("rid").alias("node"), "size", "keys").join(nodes.select("node"), "node", "left_semi").select("node", "size", F.explode("keys").alias("key"))
    bands = materialize(bands, "bands")
    crowded = bands.groupBy("key").agg(F.min(F.struct("node", "size")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("first.node").alias("leader"), F.col("first.size").alias("leader_size"))
    crowded = materialize(crowded, "crowded")  # as a table, so that adaptive execution can split the join
    buckets = materialize(bands.join(crowded, "key").select("key", "node", "size", "leader", "leader_size"), "buckets")
    discard(bands, crowded)
    # Shuffled at every size: what is wanted grows with the corpus.
    wanted = buckets.select("node").distinct().hint("merge")
    texts = materialize(rows.select(F.col(RID).alias("node"), F.coalesce("text", F.lit("")).alias("text")).join(wanted, "node", "left_semi"), "texts")

    fits = lambda x, y: F.least(x, y) >= F.greatest(x, y) * similarity
    star = buckets.where("node <> leader").where(fits("size", "leader_size")).select("node", F.col("leader").alias("centre")).distinct()
    labels, tables = None, [signed, nodes, texts]
    for turn in range(PIVOTS + 2):
        links = _star_links(star, texts, similarity) if turn <= PIVOTS else _group_links(left, texts, similarity)
        if labels is None or not links.isEmpty():
            labels = _merged(labels, links)
        discard(links)
        if turn > PIVOTS:
            break
        named = materialize(buckets.join(labels.withColumnRenamed("label", "found"), "node", "left").select("key", "node", "size", "leader", "leader_size", F.coalesce("found", "node").alias("label")), "named")
        several = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("x"), "node", "size", "label")).alias("p"))
        several = materialize(several.where("lo <> hi and n > 2").select("key", "p.node", "p.size", "p.label"), "several")  # two members have been compared
        left = materialize(named.join(several.select("key"), "key", "left_semi"), "buckets")
        discard(named, buckets)
        buckets = left
        if several.isEmpty():
            discard(several)
            break
        if turn < PIVOTS:
            other = several.select("key", F.col("node").alias("centre"), F.col("size").alias("centre_size"), F.col("label").alias("centre_label"))
            met = left.join(other, "key").where((F.col("label") != F.col("centre_label")) & fits("size", "centre_size") & (F.col("centre") != F.col("leader")))
            star = materialize(met.select("node", "centre").distinct(), "pairs")
            tables.append(star)
        tables.append(several)
    tables += [buckets, labels]
    named = nodes.join(labels.withColumnRenamed("label", "found"), "node", "left").select("h1", "h2", F.coalesce("found", "node").alias("label"))
    classed = signed.where("size > 0").join(named, ["h1", "h2"]).select(F.col("rid").alias(RID), "doc_id", "tie", "label")
    out = materialize(classed.unionByName(signed.where("size = 0").select(F.col("rid").alias(RID), "doc_id", "tie", F.col("rid").alias("label"))), "classed")
    discard(*tables)
    return out


def _first_of_classes(classed: DataFrame) -> DataFrame:
    """(label, class_size, first) of each class; first has the row of smallest id, then of smallest text hash.

    Neither depends on how rows are numbered: only rows of one id and one text are told apart by RID.
    """
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie", RID)
    return materialize(classed.groupBy("label").agg(F.count(F.lit(1)).alias("class_size"), F.min(first).alias("first")), "classes")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest id of its class), class_size, kept (the row of that id; of several
    rows of that id the one whose text has the smallest hash)."""
    rows = number_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    classed = near_classes(rows, similarity)
    classes = _first_of_classes(classed)
    return classed.join(classes, "label").select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col(RID) == F.col(f"first.{RID}")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class, the one that near_groups() keeps, all columns as they were."""
    numbered = number_rows(docs, id_col)
    rows = numbered.select(RID, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    classed = near_classes(rows, similarity)
    kept = _first_of_classes(classed).select(F.col(f"first.{RID}").alias(RID))
    discard(classed)
    return numbered.join(kept, RID, "left_semi").drop(RID)


def op2(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
