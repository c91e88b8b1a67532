"""Search over rows with name, qualified_name, file_path and kind: keyword, BM25, cosine, and their fusion.

BM25 needs two passes over the rows and no shuffle of them: the first sums how many rows hold each phrase (a few
numbers), the second scores. A stored index of postings serves many queries (postings()).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import porter, query_tokens, stem_tokens, tokens
from tessella.functions.values import cosine
from tessella.storage import materialize

DEFAULT_RESULTS, MOST_RESULTS = 20, 100
#: BM25 and fusion constants.
K1, B, LEAST_IDF, RRF_K = 1.2, 0.75, 1e-6, 60
INDEXED = ("name", "qualified_name", "file_path", "kind", "parent_qualified")


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MOST_RESULTS:
        raise ValueError(f"limit must be between 1 and {MOST_RESULTS}")
    return limit


def _tier(query: str) -> Column:
    name = F.lower("name")
    return F.when(name == query.lower(), 0).when(name.startswith(query.lower()), 1).otherwise(2)


def ranking_boost(query: str, context: Iterable[str] = ()) -> Column:
    """3 for the exact name, 2 for its beginning, and 1 more for a row of a context file."""
    files = list(context)
    near = F.when(F.col("file_path").isin(files), 1.0).otherwise(0.0) if files else F.lit(0.0)
    return F.when(_tier(query) == 0, 3.0).when(_tier(query) == 1, 2.0).otherwise(0.0) + near


def _of_kind(nodes: DataFrame, kind: str | None) -> DataFrame:
    return nodes if kind is None else nodes.where(F.col("kind") == kind)


def _top(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.desc("score"), "qualified_name").limit(limit)


def keyword_search(nodes: DataFrame, query: str, limit: int = DEFAULT_RESULTS, kind: str | None = None, context: Iterable[str] = ()) -> DataFrame:
    """Rows whose name, qualified name or path contains every word; scored 1 plus boost, of the first 3 * limit by tier."""
    words = query.lower().split()
    if not words:
        return nodes.withColumn("score", F.lit(0.0)).limit(0)
    has = lambda w: reduce(lambda a, b: a | b, [F.lower(c).contains(w) for c in ("name", "qualified_name", "file_path")])
    found = _of_kind(nodes, kind).where(reduce(lambda a, b: a & b, map(has, words)))
    first = found.orderBy(_tier(query), "qualified_name").limit(3 * limit)
    return _top(first.withColumn("score", 1.0 + ranking_boost(query, context)), limit)


def phrases(query: str, stem: bool = False) -> list[list[str]]:
    """Each white-space separated term as a phrase of tokens."""
    return [[porter(t) if stem else t for t in query_tokens(term)] for term in query.split()]


def _goes_on(token: str, so_far: Column, word: Column) -> Column:
    return so_far & F.coalesce(word == token, F.lit(False))


def _hits(words: Column, phrase: Sequence[str]) -> Column:
    """How often a phrase stands in an array of tokens: a flag for each place, and-ed with those of the shifted array."""
    at = F.transform(words, lambda w: w == phrase[0])
    for k, p in enumerate(phrase[1:], start=2):
        at = F.zip_with(at, F.slice(words, k, F.size(words)), partial(_goes_on, p))
    return F.size(F.filter(at, lambda f: f))


def bm25_scores(rows: DataFrame, columns: Sequence[str], query: str, stem: bool = False) -> DataFrame:
    """rows that hold every phrase of query, with bm25; all rows count for the statistics.

    The tokens of a row are bound once and counted in the row that a generator makes of them, so that no filter on
    the counts can copy the tokenisation: time is linear in the text.
    """
    wanted = phrases(query, stem)
    if not wanted or not all(wanted):
        return rows.withColumn("bm25", F.lit(0.0)).limit(0)
    split = [stem_tokens(tokens(F.col(c).cast("string"))) if stem else tokens(F.col(c).cast("string")) for c in columns]
    names = [f"t{i}" for i in range(len(columns))]
    words = F.struct(*[t.alias(n) for n, t in zip(names, split, strict=True)])
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    hits = [f"f{k}" for k in range(len(wanted))]
    count = lambda t: F.struct(total([F.size(t[n]) for n in names]).alias("d"), *[total([_hits(t[n], p) for n in names]).alias(f) for f, p in zip(hits, wanted, strict=True)])
    counted = rows.withColumn("__t", words).select(*rows.columns, F.explode(F.transform(F.array("__t"), count)).alias("__c"))
    has = [F.col(f"__c.{f}") for f in hits]
    stats = counted.agg(F.count(F.lit(1)).alias("__n"), F.avg("__c.d").alias("__avg"), *[F.count(F.when(h > 0, 1)).alias(f"__df_{f}") for h, f in zip(has, hits, strict=True)])
    both = counted.where(reduce(lambda a, b: a & b, [h > 0 for h in has])).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for h, f in zip(has, hits, strict=True):
        idf = F.log((F.col("__n") - F.col(f"__df_{f}") + 0.5) / (F.col(f"__df_{f}") + 0.5))
        score = score + F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf) * h * (K1 + 1) / (h + K1 * (1 - B + B * F.col("__c.d") / F.col("__avg")))
    return both.withColumn("bm25", score).select(*rows.columns, "bm25")


def bm25_search(nodes: DataFrame, query: str, limit: int = DEFAULT_RESULTS, kind: str | None = None, context: Iterable[str] = (), stem: bool = True) -> DataFrame:
    """The first 3 * limit rows by tier and BM25, then by score with boost. A kind filters after the match, so statistics stay."""
    found = _of_kind(bm25_scores(nodes, [c for c in INDEXED if c in nodes.columns], query, stem), kind)
    first = found.orderBy(_tier(query), F.desc("bm25"), "qualified_name").limit(3 * limit)
    return _top(first.withColumn("score", F.greatest(F.lit(0.0), F.col("bm25")) + ranking_boost(query, context)).drop("bm25"), limit)


def fts_search(nodes: DataFrame, query: str, limit: int = DEFAULT_RESULTS, kind: str | None = None, context: Iterable[str] = (), stem: bool = True) -> tuple[str, DataFrame]:
    """The mode that answered (fts, or keyword if that finds nothing) and its rows."""
    rows = bm25_search(nodes, query, limit, kind, context, stem)
    return ("fts", rows) if rows.limit(1).count() else ("keyword", keyword_search(nodes, query, limit, kind, context))


def semantic_search(vectors: DataFrame, query: Sequence[float], limit: int = DEFAULT_RESULTS, text: str = "", kind: str | None = None, context: Iterable[str] = ()) -> DataFrame:
    """Rows with a column vector, by cosine with the query's vector plus boost; every row is compared."""
    of = F.array(*[F.lit(float(x)) for x in query])
    return _top(_of_kind(vectors, kind).withColumn("score", cosine(F.col("vector"), of) + (ranking_boost(text, context) if text else F.lit(0.0))), limit)


def reciprocal_ranks(lists: Sequence[DataFrame], key: str = "qualified_name", k: int = RRF_K) -> DataFrame:
    """(key, score): the sum over lists (key, rank) of 1 / (k + rank)."""
    every = reduce(DataFrame.unionByName, [x.select(key, "rank") for x in lists])
    return every.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def ranked(rows: DataFrame, key: str = "qualified_name") -> DataFrame:
    """Rank of each row of a short candidate list (300 at most) by score."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def hybrid_search(nodes: DataFrame, vectors: DataFrame, query: str, query_vector: Sequence[float], limit: int = DEFAULT_RESULTS, kind: str | None = None, context: Iterable[str] = (), stem: bool = True) -> DataFrame:
    """Lexical and semantic candidates fused by rank; context counts only after fusion."""
    many = min(300, 3 * limit)
    lexical = fts_search(nodes, query, many, kind, (), stem)[1]
    semantic = semantic_search(vectors, query_vector, many, query, kind)
    fused = reciprocal_ranks([ranked(lexical), ranked(semantic)])
    rows = nodes.join(F.broadcast(fused), "qualified_name")  # 600 rows at most
    return _top(rows.withColumn("score", F.col("score") + ranking_boost(query, context)), limit)


def search(nodes: DataFrame, query: str, mode: str = "fts", vectors: DataFrame | None = None, embed=None, consent: bool = False, **options) -> tuple[str, DataFrame, str | None]:
    """(mode that answered, rows, warning). Semantic search is strict; hybrid falls back to fts, but not for lack of consent."""
    if mode in ("semantic", "hybrid"):
        if not consent:
            raise PermissionError("embedding_consent_required")
        try:
            if embed is None or vectors is None:
                raise ValueError("embeddings are not configured")
            vector = embed(query)
            if mode == "semantic":
                return mode, semantic_search(vectors, vector, text=query, **options), None
            return mode, hybrid_search(nodes, vectors, query, vector, **options), None
        except Exception as e:
            if mode == "semantic":
                raise
            found, rows = fts_search(nodes, query, **options)
            return found, rows, f"hybrid search is not available: {e}"
    found, rows = fts_search(nodes, query, **options)
    return found, rows, None


def postings(rows: DataFrame, key: str, columns: Sequence[str], stem: bool = False) -> DataFrame:
    """An inverted index: (key, column, position, token), to be stored clustered by token."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), (stem_tokens(tokens(F.col(c))) if stem else tokens(F.col(c))).alias("words")) for c in columns])
    return rows.select(key, F.explode(each).alias("x")).select(key, "x.column", F.posexplode("x.words").alias("position", "token"))


def posting_counts(rows: DataFrame, key: str, columns: Sequence[str], stem: bool = False) -> DataFrame:
    """(token, docs, hits) of postings(): different keys and places of each token. Null keys count as no document.

    A row tells how often it has a token and that it has it, so counts are added up by token before they move. Only rows
    whose key other rows have too are counted by token and key.
    """
    each = rows.select(F.col(key).alias("__key"), F.flatten(F.array(*[stem_tokens(tokens(F.col(c))) if stem else tokens(F.col(c)) for c in columns])).alias("__words"))
    # A key's rows are counted without their texts.
    again = materialize(rows.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and __key is not null").select("__key"), "keys")
    if not again.isEmpty():
        shared = each.join(again, "__key", "left_semi").select("__key", F.explode("__words").alias("token"))
        shared = shared.groupBy("token", "__key").agg(F.count(F.lit(1)).alias("hits")).select("token", F.lit(1).alias("docs"), "hits")
        each = each.join(again, "__key", "left_anti")
    # The words of a row and behind them its different words: what stands before the row's length is a hit, the rest a document.
    each = each.select(F.col("__key").isNotNull().alias("known"), F.size("__words").alias("n"), F.posexplode(F.concat("__words", F.array_distinct("__words"))).alias("at", "token"))
    counts = each.groupBy("token").agg(F.count(F.when(F.col("known") & (F.col("at") >= F.col("n")), 1)).alias("docs"), F.count(F.when(F.col("at") < F.col("n"), 1)).alias("hits"))
    return counts if again.isEmpty() else counts.unionByName(shared).groupBy("token").agg(F.sum("docs").alias("docs"), F.sum("hits").alias("hits"))


def index_stats(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Embedded nodes by provider and model, beside the number of indexed nodes."""
    sets = embeddings.groupBy("provider_identity", "provider", "model").agg(F.count(F.lit(1)).alias("embedded"))
    return sets.crossJoin(F.broadcast(nodes.agg(F.count(F.lit(1)).alias("indexed"))))


def envelope(rows: DataFrame, action: str, summary: str = "", error: str | None = None) -> str:
    """A short result (MOST_RESULTS rows at most) as one JSON object for a tool."""
    import json

    if error:
        return json.dumps({"ok": False, "action": action, "error": error}, ensure_ascii=False)
    data = [json.loads(x) for x in (r[0] for r in rows.limit(MOST_RESULTS).select(F.to_json(F.struct("*"))).collect())]
    return json.dumps({"ok": True, "action": action, "summary": summary, "data": data}, ensure_ascii=False)
