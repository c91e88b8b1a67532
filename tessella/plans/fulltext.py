"""A stored full-text index: postings in buckets of tokens, cut in cells of documents, read with block-max pruning.

Layout below a root: ``postings/<segment>/bucket=<b>`` has rows (token, cell, keys, tfs, lens, positions, n, max_tf, min_len),
sorted by token and cell; ``keys/<segment>`` has the length of each document that the segment brought or took away (alive);
``manifest/<version>`` names the folders that make up a version and is written last, so a version is there as a whole or not.

- A token's bucket is crc32(token) % buckets: a query opens the folders of its tokens and no others.
- A document's cell is its class of length (four to a doubling) and a hash part within, about CELL documents. All tokens are
  cut by the same cells, so a document's postings meet within one cell, and documents of a cell have nearly one length: a
  cell's largest term count and smallest length then bound its scores closely.
- update() writes one segment with the postings of the changed documents. A posting counts as long as no later segment
  has its document, so nothing that exists is rewritten. merge() rewrites the buckets that have many segments, and only those.
- top() reads the bounds of the cells that have all tokens, scores the cells of highest bound, and then only cells whose
  bound reaches the score of rank ``limit``. What it leaves out cannot be in the result.

Texts move once, to their cells, and become rows of postings there; a token of all documents is as many rows as there are
cells (more, if the documents of a cell have more than GROUP tokens).
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import stem_tokens, tokens
from tessella.operators.search import B, K1, LEAST_IDF, phrases
from tessella.storage import discard, materialize

BUCKETS, CELL = 64, 1024
#: Segments of a bucket from which merge() rewrites it.
MOST_SEGMENTS = 4
#: Cells that are scored for the first bar.
FIRST_CELLS = 16
#: Tokens that become postings at once (documents of one cell).
GROUP = 1 << 20


def bucket_of(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode()) % buckets


# --- versions ---


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The newest version: number, folders (bucket, segment, seq: the last change it has), deltas, n, total, parts."""
    path, fs = _fs(spark, f"{root}/manifest")
    if not fs.exists(path):
        return None
    versions = [int(s.getPath().getName()) for s in fs.listStatus(path) if fs.exists(_fs(spark, f"{s.getPath()}/_SUCCESS")[0])]
    if not versions:
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(f"{root}/manifest/{max(versions)}", wholetext=True).collect()))


def _commit(spark: SparkSession, root: str, found: dict) -> dict:
    spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest/{found['version']}")
    return found


# --- writing ---


def _length_class(length: Column) -> Column:
    return F.floor(F.log2(length + 1) * 4).cast("int")


def _of_class(kind: Column, numbers: dict[str, int]) -> Column:
    """The number of a class of length, 1 where there is none."""
    table = F.create_map(*[x for k, v in numbers.items() for x in (F.lit(int(k)), F.lit(v))]) if numbers else F.create_map().cast("map<int,int>")
    return F.coalesce(table[kind], F.lit(1)).cast("long")


def _cell(key: Column, length: Column, parts: dict[str, int]) -> Column:
    kind = _length_class(length)
    part = F.pmod(F.xxhash64(key), _of_class(kind, parts))
    return kind.cast("long") * (1 << 32) + part


def _words(rows: DataFrame, key: str, columns: Sequence[str], stem: bool) -> DataFrame:
    """(key, len, w): each row's number of tokens, and its tokens as one text for each column, a space between them."""
    split = [stem_tokens(tokens(F.col(c).cast("string"))) if stem else tokens(F.col(c).cast("string")) for c in columns]
    t = rows.select(F.col(key).alias("key"), F.array(*split).alias("t"))
    return t.select("key", reduce(lambda a, b: a + b, [F.size(F.col("t")[i]) for i in range(len(columns))]).alias("len"), F.transform("t", lambda w: F.array_join(w, " ")).alias("w"))


def _classes(lengths: DataFrame) -> list:
    """Documents and tokens of each class of length."""
    return lengths.groupBy(_length_class(F.col("len")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total")).collect()


def _blocks_of(table):
    """The rows of postings of some documents of one cell: their tokens, sorted by token, document and place."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    table = table.sort_by("key")
    keys, lens, w = (table[c].combine_chunks() for c in ("key", "len", "w"))
    base, words, docs, places = np.zeros(len(keys), np.int64), [], [], []
    for column in range(len(w[0])):
        text = pc.list_element(w, column)
        lists = pc.split_pattern(pc.if_else(pc.equal(text, ""), pa.scalar(None, text.type), text), " ")
        of, n = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words.append(lists.flatten())
        docs.append(of)
        places.append(np.arange(len(of)) - (np.cumsum(n) - n)[of] + base[of])
        base += n + 1  # a place between two columns is empty, so that no phrase goes over the end of a column
    code = pa.chunked_array(words).combine_chunks().dictionary_encode()
    codes, doc, place = code.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(docs), np.concatenate(places)
    pairs = codes << 32 | doc
    order = np.argsort(pairs, kind="stable")  # places of a pair stay in their order
    pairs, place = pairs[order], place[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))  # of each token and document
    of = pairs[first]
    block = np.flatnonzero(np.diff(of >> 32, prepend=-1))  # of each token
    tfs, d = np.diff(np.append(first, len(pairs))), of & 0xFFFFFFFF
    length, size = lens.to_numpy(zero_copy_only=False)[d], np.diff(np.append(block, len(of)))
    int32 = lambda x: pa.array(x, pa.int32())
    each = lambda x: pa.ListArray.from_arrays(int32(np.append(block, len(of))), x)
    return pa.table({
        "token": code.dictionary.take(pa.array(of[block] >> 32)), "cell": pa.repeat(table["cell"][0], len(block)), "keys": each(keys.take(pa.array(d))), "tfs": each(int32(tfs)), "lens": each(int32(length)),
        "positions": each(pa.ListArray.from_arrays(int32(np.append(first, len(pairs))), int32(place))),
        "n": int32(size), "max_tf": int32(np.maximum.reduceat(tfs, block)), "min_len": int32(np.minimum.reduceat(length, block)),
    })


def _write_segment(words: DataFrame, root: str, segment: str, parts: dict[str, int], classes: list, buckets: int) -> None:
    """Texts meet by cells, in groups of about GROUP tokens, and are written as rows of postings where they met: postings,
    which are several times the texts, never move. Each task writes a file for each bucket."""
    chunks = {str(r.kind): -(-r.total // (parts.get(str(r.kind), 1) * GROUP)) for r in classes}
    many = _of_class(_length_class(F.col("len")), {k: v for k, v in chunks.items() if v > 1})
    met = words.where("len > 0").select("key", "len", "w", _cell(F.col("key"), F.col("len"), parts).alias("cell"), F.pmod(F.xxhash64(F.lit("chunk"), "key"), many).alias("chunk"))
    key = words.schema["key"].dataType.simpleString()
    blocks = met.groupBy("cell", "chunk").applyInArrow(_blocks_of, f"token string, cell long, keys array<{key}>, tfs array<int>, lens array<int>, positions array<array<int>>, n int, max_tf int, min_len int")
    _store(blocks.withColumn("bucket", _bucket(buckets)), root, segment)


def _write_postings(each: DataFrame, root: str, segment: str, buckets: int) -> None:
    """each (token, cell, key, tf, len, positions), a row for each token and document; a cell bounds what meets in a row."""
    blocks = each.groupBy("token", "cell").agg(F.sort_array(F.collect_list(F.struct("key", "tf", "len", "positions"))).alias("p"))
    of = lambda c: F.transform("p", lambda x: x[c])
    rows = blocks.select(
        "token", "cell", of("key").alias("keys"), of("tf").alias("tfs"), of("len").alias("lens"), of("positions").alias("positions"), F.size("p").alias("n"),
        F.array_max(of("tf")).alias("max_tf"), F.array_min(of("len")).alias("min_len"), _bucket(buckets).alias("bucket"),
    )
    _store(rows.repartitionByRange("bucket", "token", "cell"), root, segment)


def _bucket(buckets: int) -> Column:
    return (F.crc32("token") % buckets).cast("int")


def _store(rows: DataFrame, root: str, segment: str) -> None:
    rows.sortWithinPartitions("bucket", "token", "cell").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/postings/{segment}")


def _folders_of(spark: SparkSession, root: str, segment: str) -> list[int]:
    path, fs = _fs(spark, f"{root}/postings/{segment}")
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if "=" in s.getPath().getName())


def build(rows: DataFrame, root: str, key: str, columns: Sequence[str], stem: bool = False, buckets: int = BUCKETS) -> dict:
    """The first version of an index over rows with different keys. Nulls are empty texts."""
    spark = rows.sparkSession
    words = materialize(_words(rows, key, columns, stem), "words")
    words.select("key", "len", F.lit(True).alias("alive")).write.mode("overwrite").parquet(f"{root}/keys/1")
    counts = _classes(spark.read.parquet(f"{root}/keys/1"))
    parts = {str(r.kind): -(-r.n // CELL) for r in counts}
    _write_segment(words, root, "1", parts, counts, buckets)
    discard(words)
    return _commit(spark, root, {
        "version": 1, "folders": [[b, "1", 1] for b in _folders_of(spark, root, "1")], "deltas": [], "n": sum(r.n for r in counts), "total": sum(r.total for r in counts),
        "parts": parts, "key": key, "columns": list(columns), "stem": stem, "buckets": buckets,
    })


def _keys(spark: SparkSession, root: str, versions: Sequence[int]) -> DataFrame:
    """(key, seq, len, alive): the last change of each key in some versions."""
    every = reduce(DataFrame.unionByName, [spark.read.parquet(f"{root}/keys/{v}").withColumn("seq", F.lit(v)) for v in versions])
    return every.groupBy("key").agg(F.max_by(F.struct("seq", "len", "alive"), "seq").alias("x")).select("key", "x.*")


def update(spark: SparkSession, root: str, changed: DataFrame, deleted: DataFrame | None = None) -> dict:
    """The next version: rows of changed are new or take the place of those of their key, keys of deleted are gone."""
    now = manifest(spark, root)
    version, key = now["version"] + 1, now["key"]
    words = materialize(_words(changed, key, now["columns"], now["stem"]), "words")
    fresh = words.select("key", "len", F.lit(True).alias("alive"))
    if deleted is not None:
        gone = deleted.select(F.col(key).alias("key")).distinct().join(fresh, "key", "left_anti")
        fresh = fresh.unionByName(gone.select("key", F.lit(0).alias("len"), F.lit(False).alias("alive")))
    fresh.write.mode("overwrite").parquet(f"{root}/keys/{version}")
    fresh = spark.read.parquet(f"{root}/keys/{version}")
    before = _keys(spark, root, [1, *now["deltas"]]).where("alive").join(fresh.select("key"), "key", "left_semi")
    lost, less = before.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    counts = _classes(fresh.where("alive"))
    won, more = sum(r.n for r in counts), sum(r.total for r in counts)
    # A class that no document had before is cut by what comes now; the others keep their cells.
    parts = {str(r.kind): -(-r.n // CELL) for r in counts} | now["parts"]
    _write_segment(words, root, str(version), parts, counts, now["buckets"])
    discard(words)
    folders = now["folders"] + [[b, str(version), version] for b in _folders_of(spark, root, str(version))]
    return _commit(spark, root, now | {"version": version, "folders": folders, "deltas": [*now["deltas"], version], "parts": parts, "n": now["n"] - lost + won, "total": now["total"] - less + more})


def merge(spark: SparkSession, root: str, most: int = MOST_SEGMENTS) -> list[int]:
    """Rewrites the buckets with more than most segments, without what was replaced, as a new version; gives those buckets."""
    now = manifest(spark, root)
    by: dict[int, list] = {}
    for b, segment, seq in now["folders"]:
        by.setdefault(b, []).append((segment, seq))
    many = sorted(b for b, x in by.items() if len(x) > most)
    if not many:
        return []
    version = now["version"] + 1
    rows = _live(spark, root, now, [f for f in now["folders"] if f[0] in many], ["positions"])
    _write_postings(rows, root, f"m{version}", now["buckets"])
    left = [f for f in now["folders"] if f[0] not in many]
    _commit(spark, root, now | {"version": version, "folders": left + [[b, f"m{version}", now["version"]] for b in _folders_of(spark, root, f"m{version}")]})
    return many


# --- reading ---


def folders(now: dict, wanted: Sequence[str]) -> list:
    """The folders that have postings of some tokens."""
    mine = {bucket_of(t, now["buckets"]) for t in wanted}
    return [f for f in now["folders"] if f[0] in mine]


def _blocks(spark: SparkSession, root: str, some: list, wanted: Sequence[str] | None = None) -> DataFrame:
    by: dict[int, list[str]] = {}
    for b, segment, seq in some:
        by.setdefault(seq, []).append(f"{root}/postings/{segment}/bucket={b}")
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(*paths).withColumn("seq", F.lit(seq)) for seq, paths in sorted(by.items())])
    return rows if wanted is None else rows.where(F.col("token").isin(*wanted))


def _live(spark: SparkSession, root: str, now: dict, some: list, more: Sequence[str] = (), wanted: Sequence[str] | None = None, cells: DataFrame | None = None) -> DataFrame:
    """(token, cell, key, tf, len and more) of the postings that no later segment replaces."""
    blocks = _blocks(spark, root, some, wanted)
    blocks = blocks if cells is None else blocks.join(cells, "cell", "left_semi")
    lists = ["keys", "tfs", "lens", *more]
    rows = blocks.select("token", "cell", "seq", F.explode(F.arrays_zip(*lists)).alias("x"))
    rows = rows.select("token", "cell", "seq", F.col("x.keys").alias("key"), F.col("x.tfs").alias("tf"), F.col("x.lens").alias("len"), *[f"x.{c}" for c in more])
    later = [v for v in now["deltas"] if v > min(f[2] for f in some)]
    if later:
        last = _keys(spark, root, later).select("key", F.col("seq").alias("last"))
        rows = rows.join(last, "key", "left").where("last is null or seq >= last").drop("last")
    return rows.drop("seq")


def _idf(n: int, df: int) -> float:
    idf = math.log((n - df + 0.5) / (df + 0.5))
    return idf if idf > 0 else LEAST_IDF


def _part(idf: float, tf: Column, length: Column, average: float) -> Column:
    return F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _back(k: int):
    return lambda place: place - k


class Index:
    """One version of an index for queries."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.now = spark, root, manifest(spark, root)
        self.average = self.now["total"] / self.now["n"] if self.now["n"] else 0.0

    def _none(self) -> DataFrame:
        kind = self.spark.read.parquet(f"{self.root}/keys/1").schema["key"].dataType.simpleString()
        return self.spark.createDataFrame([], f"key {kind}, bm25 double")

    def _wanted(self, query: str) -> list[list[str]] | None:
        wanted = phrases(query, self.now["stem"])
        present = {b for b, _, _ in self.now["folders"]}
        if not wanted or not all(wanted) or any(bucket_of(t, self.now["buckets"]) not in present for p in wanted for t in p):
            return None
        return wanted

    def _hits(self, wanted: list[list[str]], cells: DataFrame | None = None) -> DataFrame:
        """(key, len, f0, f1, ...): how often each phrase stands in the documents that have all its tokens; some may be 0."""
        every = sorted({t for p in wanted for t in p})
        long = any(len(p) > 1 for p in wanted)
        rows = _live(self.spark, self.root, self.now, folders(self.now, every), ["positions"] if long else [], every, cells)
        of = {t: F.max(F.when(F.col("token") == t, F.col("positions" if long else "tf"))).alias(f"t{i}") for i, t in enumerate(every)}
        met = rows.groupBy("key").agg(F.max("len").alias("len"), *of.values())
        column = {t: F.col(f"t{i}") for i, t in enumerate(every)}

        def count(phrase: list[str]) -> Column:
            if not long:
                return F.coalesce(column[phrase[0]], F.lit(0))
            at = column[phrase[0]]
            for k, t in enumerate(phrase[1:], start=1):
                at = F.array_intersect(at, F.transform(column[t], _back(k)))
            return F.coalesce(F.size(at), F.lit(0))

        return met.select("key", "len", *[F.greatest(count(p), F.lit(0)).alias(f"f{k}") for k, p in enumerate(wanted)])

    def scores(self, query: str) -> DataFrame:
        """(key, bm25) of the documents that hold every phrase of query, as search.bm25_scores() computes them."""
        if (wanted := self._wanted(query)) is None:
            return self._none()
        hits = materialize(self._hits(wanted), "hits")
        df = hits.agg(*[F.count(F.when(F.col(f"f{k}") > 0, 1)) for k in range(len(wanted))]).first()
        return self._scored(hits, list(df))

    def _scored(self, hits: DataFrame, df: Sequence[int]) -> DataFrame:
        found = hits.where(reduce(lambda a, b: a & b, [F.col(f"f{k}") > 0 for k in range(len(df))]))
        return found.select("key", reduce(lambda a, b: a + b, [_part(_idf(self.now["n"], d), F.col(f"f{k}"), F.col("len"), self.average) for k, d in enumerate(df)]).alias("bm25"))

    def document_counts(self, wanted: Sequence[str]) -> dict[str, int]:
        """How many documents have each token: sums of the blocks' counts, of live postings where changes are not merged."""
        some = folders(self.now, wanted)
        if any(v > min(f[2] for f in some) for v in self.now["deltas"]):
            rows = _live(self.spark, self.root, self.now, some, (), wanted).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        else:
            rows = _blocks(self.spark, self.root, some, wanted).groupBy("token").agg(F.sum("n").alias("n"))
        return {t: 0 for t in wanted} | {r.token: r.n for r in rows.collect()}  # a row for each token of the query

    def bounds(self, wanted: Sequence[str], df: dict[str, int]) -> DataFrame:
        """(cell, bound): the highest score that a document of each cell with all the tokens can have. Reads no postings."""
        blocks = _blocks(self.spark, self.root, folders(self.now, wanted), wanted).groupBy("token", "cell").agg(F.max("max_tf").alias("tf"), F.min("min_len").alias("len"))
        part = F.coalesce(*[F.when(F.col("token") == t, _part(_idf(self.now["n"], df[t]), F.col("tf"), F.col("len"), self.average)) for t in wanted])
        cells = blocks.groupBy("cell").agg(F.count(F.lit(1)).alias("tokens"), F.sum(part).alias("bound"))
        return cells.where(F.col("tokens") == len(wanted)).select("cell", "bound")

    def top(self, query: str, limit: int) -> DataFrame:
        """The first limit rows of scores() by score and key. Phrases of several tokens are scored without bounds."""
        if (wanted := self._wanted(query)) is None:
            return self._none()
        first = lambda rows: rows.orderBy(F.desc("bm25"), "key").limit(limit)
        single = [p[0] for p in wanted]
        if any(len(p) > 1 for p in wanted):
            return first(self.scores(query))
        distinct = list(dict.fromkeys(single))
        df = self.document_counts(distinct)
        if not all(df.values()):
            return self._none()
        cells = materialize(self.bounds(distinct, df).withColumn("bound", F.col("bound") * (len(single) if len(single) > len(distinct) else 1)), "cells")
        best = cells.orderBy(F.desc("bound"), "cell").limit(FIRST_CELLS).select("cell")
        score = lambda some: self._scored(self._hits(wanted, some), [df[t] for t in single])
        bar = first(score(best)).agg(F.count(F.lit(1)), F.min("bm25")).first()
        cut = bar[1] if bar[0] == limit else 0.0
        # A sum of the same terms in another order may differ in its last digits.
        self.last_cells = cells.where(F.col("bound") * (1 + 1e-9) >= cut)
        return first(score(self.last_cells.select("cell")))
