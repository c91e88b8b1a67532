"""Language-model scores by deleted interpolation of bigrams.

Tokens are words (A-Z lower-cased) and one end per text; the context of a text's first token is the end before
it. Maximum-likelihood estimates of the token given its context, of the token alone, and a uniform share of
V + 1 kinds are mixed with weights that depend on how often the context occurs (buckets by powers of two). The
weights are learned by expectation-maximisation on the training documents of one fold (WEIGHTS), each of whose tokens is
held out in its turn: its own occurrence is deleted from the counts that the estimates come from. So no text of the
held-out fold has a part in any score but its own.

How the counts meet the texts: documents are packed in chunks of CHUNK_BYTES, written once. Every chunk asks for
its distinct n-grams, as sorted 64-bit hashes in ranges; one task per range adds up the training counts of all
chunks and answers each chunk in the order of its question. So each distinct n-gram of a chunk moves once, in a
few bytes, however often it occurs. A question is cut in FANOUT ranges at most. Where that leaves ranges of more than
RANGE_BYTES, the questions of some FANOUT chunks about a range are merged to one, which is cut again, and so on; the
answers come back the same way. So questions are as many as chunks times FANOUT in each of log(ranges) / log(FANOUT)
levels, and no group grows with the corpus: ranges and chunks become more, not larger. An n-gram that half of all texts
hold is one entry per chunk, and per group of chunks. Two n-grams of one hash would share a count; among 10^8 n-grams
that is expected to happen 3 times in 10^4 runs.

The statistics for the weights are binned (bucket and logarithms of the estimates), so the driver receives a table whose
size has a fixed bound; the weights it returns are a few numbers.

Nulls count as empty texts: one end token. A null id counts as the empty string for the split. Repeated rows are
documents of their own. A very long text is a chunk of its own. Further columns are ignored, whatever their names. An
empty table gives no rows; without training documents all counts are 0, and without any of the fold WEIGHTS the weights
are DEFAULTS.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, materialize, ship
from tessella.llm.shingles import mix

#: Bytes of text in a chunk (a longer text is a chunk of its own), and text for which there is one range of hashes.
CHUNK_BYTES, RANGE_BYTES = 8_000_000, 8_000_000
#: Ranges that a question is cut in at most.
FANOUT = 256
#: Documents with crc32(id) % FOLDS == HELD_OUT are held out; of the others, those of WEIGHTS also teach the weights.
FOLDS, HELD_OUT, WEIGHTS = 7, 2, 3
#: Rounds of expectation-maximisation, bins of an estimate per factor of two, buckets of context frequency.
ROUNDS, BINS, BUCKETS = 60, 8, 24
#: Weights (bigram, token, uniform) that the rounds begin with.
DEFAULTS = (0.4, 0.5, 0.1)
CACHE_WORDS = 200_000
#: What a chunk's documents are for: counts alone, counts and weights, neither.
COUNTS, BOTH, NEITHER = 0, 1, 2

_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()
#: The end token; no word has a space.
_END_TOKEN = b" end"


def _fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def is_held_out(doc_id: int | None) -> bool:
    return _fold(doc_id) == HELD_OUT


def pack(a: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def _token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of texts, one after another, and the tokens of each."""
    if len(_words) > CACHE_WORDS:
        _words.clear()
    parts, lengths = [], []
    for t in texts:
        w = (t or "").encode().lower().split()
        w.append(_END_TOKEN)
        parts.append(np.fromiter(map(_words.__getitem__, w), np.uint64, len(w)))
        lengths.append(len(w))
    return np.concatenate(parts), np.array(lengths, np.int64)


CHUNK = "chunk long, role int, doc_ids array<long>, lengths array<long>, hashes binary, ranks binary, tokens binary"


def _make_chunks(batches):
    """(doc_id, text) to chunks of documents of one role."""
    import pyarrow as pa
    from pyspark import TaskContext

    task, made = TaskContext.get().partitionId(), 0
    held: dict[int, list] = {COUNTS: [], BOTH: [], NEITHER: []}
    sizes = dict.fromkeys(held, 0)

    def chunk(role: int):
        nonlocal made
        docs = held[role]
        tokens = np.concatenate([h for _, h in docs])
        keys, at, times = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # frequent tokens get small numbers, which pack well
        rank = np.empty(len(keys), np.uint32)
        rank[order] = np.arange(len(keys), dtype=np.uint32)
        row = [(task << 32) + made, role, [i for i, _ in docs], [len(h) for _, h in docs], pack_sorted(keys), pack(order.astype(np.uint32)), pack(rank[at])]
        made += 1
        held[role], sizes[role] = [], 0
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["chunk", "role", "doc_ids", "lengths", "hashes", "ranks", "tokens"])

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for k, i in enumerate(ids):
            t = batch.column(1)[k].as_py()
            role = {HELD_OUT: NEITHER, WEIGHTS: BOTH}.get(_fold(i), COUNTS)
            held[role].append((i, _token_hashes([t])[0]))
            sizes[role] += len(t or "")
            if sizes[role] >= CHUNK_BYTES:
                yield chunk(role)
    for role, docs in held.items():
        if docs:
            yield chunk(role)


def _decode(hashes: bytes, ranks: bytes, tokens: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of a chunk's tokens; each token's place among them; each context's place; hashes of all bigrams."""
    keys = unpack_sorted(hashes)
    at = unpack(ranks, np.uint32)[unpack(tokens, np.uint32)].astype(np.int64)
    end = np.searchsorted(keys, np.uint64(_words[_END_TOKEN]))
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = end
    return keys, at, before, mix(keys[before] * _ODD + keys[at])


QUESTION = "ngram int, part long, who long, keys binary, counts binary"
_QUESTION = ["ngram", "part", "who", "keys", "counts"]


def _questions(ngram: int, part: int, parts: int, fan: int, who: int, keys: np.ndarray, counts: np.ndarray | None) -> list[tuple]:
    """Sorted hashes of one of `parts` equal ranges, cut in `fan` ranges."""
    bounds = np.array([((part * fan + k) << 64) // (parts * fan) for k in range(1, fan)], np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
    return [
        (ngram, part * fan + k, who, pack_sorted(keys[a:b]), None if counts is None else pack(counts[a:b].astype(np.uint64)))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
        if b > a
    ]


def _question_columns(rows: list[tuple]) -> list:
    import pyarrow as pa

    return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]


def _ask(fan: int):
    """Chunks to questions; counts only of training chunks."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                chunk, role, lengths, hashes, ranks, tokens = (batch.column(c)[r].as_py() for c in range(6))
                keys, at, _, pairs = _decode(hashes, ranks, tokens, np.array(lengths, np.int64))
                rows = []
                for ngram, k, n in ((1, keys, np.bincount(at, minlength=len(keys))), (2, *np.unique(pairs, return_counts=True))):
                    rows += _questions(ngram, 0, 1, fan, chunk, k, None if role == NEITHER else n)
                yield pa.RecordBatch.from_arrays(_question_columns(rows), _QUESTION)

    return run


def _summed(table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The hashes of each question, all different ones, and their counts."""
    keys = [unpack_sorted(b.as_py()) for b in table["keys"]]
    counts = [np.zeros(len(k), np.uint64) if b.as_py() is None else unpack(b.as_py(), np.uint64) for k, b in zip(keys, table["counts"], strict=True)]
    every, each = np.concatenate(keys), np.concatenate(counts)
    by = np.argsort(every, kind="stable")
    every, each = every[by], each[by]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    return keys, every[new], np.add.reduceat(each, np.flatnonzero(new))


ANSWER = "ngram int, part long, who long, totals binary, kinds long, tokens long"


def _answer_rows(ngram: int, part: int, who: list[int], totals: list[bytes | None], kinds: int | None = None, tokens: int | None = None):
    import pyarrow as pa

    n = len(who)
    columns = [pa.array([ngram] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.array(who, pa.int64()), pa.array(totals, pa.binary())]
    last = [pa.array([None] * (n - 1) + [x], pa.int64()) for x in (kinds, tokens)]
    return pa.Table.from_arrays([*columns, *last], ["ngram", "part", "who", "totals", "kinds", "tokens"])


def _answer(table):
    """All questions of one range: training counts for each, and a row (who -1) of kinds and tokens."""
    keys, every, sums = _summed(table)
    totals = [pack(sums[np.searchsorted(every, k)]) for k in keys]
    return _answer_rows(table["ngram"][0].as_py(), table["part"][0].as_py(), [*table["who"].to_pylist(), -1], [*totals, None], int((sums > 0).sum()), int(sums.sum()))


def _merge(parts: int, fan: int):
    """The questions of a group about one range to one question about each of its parts."""

    def run(table):
        import pyarrow as pa

        _, every, sums = _summed(table)
        rows = _questions(table["ngram"][0].as_py(), table["part"][0].as_py(), parts, fan, table["team"][0].as_py(), every, sums)
        return pa.Table.from_arrays(_question_columns(rows), _QUESTION)

    return run


def _settle(table):
    """The questions of a group and the answers about all parts of the range to an answer for each question."""
    rows = table.to_pylist()
    asked = [(r["who"], unpack_sorted(r["keys"])) for r in rows if r["keys"] is not None]
    every = np.unique(np.concatenate([k for _, k in asked]))
    got = np.concatenate([unpack(r["totals"], np.uint64) for r in sorted((r for r in rows if r["keys"] is None), key=lambda r: r["below"])])
    totals = [pack(got[np.searchsorted(every, k)]) for _, k in asked]
    return _answer_rows(rows[0]["ngram"], rows[0]["part"], [w for w, _ in asked], totals)


def _answers(asked: DataFrame, askers: int, parts: int, fan: int, levels: int) -> DataFrame:
    """Answers, as a table, to questions about `parts` ranges: at once, or by way of merged questions about smaller ones."""
    if levels == 1:
        return materialize(asked.groupBy("ngram", "part").applyInArrow(_answer, ANSWER), "answers")
    teams = -(-askers // fan)
    asked = materialize(asked.withColumn("team", F.pmod(F.xxhash64("who"), F.lit(teams))), "asked")
    merged = asked.groupBy("ngram", "part", "team").applyInArrow(_merge(parts, fan), QUESTION)
    below = _answers(merged, teams, parts * fan, fan, levels - 1)
    none = lambda kind: F.lit(None).cast(kind)
    back = below.where("who >= 0").select("ngram", F.floor(F.col("part") / fan).alias("part"), F.col("who").alias("team"), none("long").alias("who"), none("binary").alias("keys"), F.col("part").alias("below"), "totals")
    both = asked.select("ngram", "part", "team", "who", "keys", none("long").alias("below"), none("binary").alias("totals")).unionByName(back)
    settled = both.groupBy("ngram", "part", "team").applyInArrow(_settle, ANSWER)
    out = materialize(settled.unionByName(below.where("who = -1")), "answers")
    discard(asked, below)
    return out


def _met(table):
    """A chunk and its answers: ids, lengths, and for each token its count, that of its context, that of both."""
    rows = table.to_pylist()
    chunk = next(r for r in rows if r["tokens"] is not None)
    lengths = np.array(chunk["lengths"], np.int64)
    keys, at, before, pairs = _decode(chunk["hashes"], chunk["ranks"], chunk["tokens"], lengths)
    totals = {o: [unpack(r["totals"], np.uint64) for r in sorted((r for r in rows if r["totals"] is not None and r["ngram"] == o), key=lambda r: r["part"])] for o in (1, 2)}
    one, two = np.concatenate(totals[1]), np.concatenate(totals[2])
    _, place = np.unique(pairs, return_inverse=True)
    return chunk["doc_ids"], lengths, one[at].astype(np.float64), one[before].astype(np.float64), two[place].astype(np.float64)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)


def _estimates(c: np.ndarray, h: np.ndarray, both: np.ndarray, n: int, kinds: int) -> tuple[np.ndarray, np.ndarray, float]:
    return both / np.maximum(h, 1), c / max(n, 1), 1.0 / (kinds + 1)


def _bins(n: int, kinds: int):
    """A chunk to (bucket, bins of the two estimates, tokens), each token's own occurrence deleted from the counts."""

    def run(table):
        import pyarrow as pa

        _, _, c, h, both = (x - 1 if i > 1 else x for i, x in enumerate(_met(table)))
        p2, p1, _ = _estimates(c, h, both, n - 1, kinds)
        q = [np.where(p > 0, np.round(-np.log2(np.where(p > 0, p, 1)) * BINS), 9999).astype(np.int64) for p in (p2, p1)]
        code, times = np.unique((_bucket(h) * 10_000 + q[0]) * 10_000 + q[1], return_counts=True)
        return pa.table({"bucket": (code // 10**8).astype(np.int32), "q2": (code // 10**4 % 10**4).astype(np.int32), "q1": (code % 10**4).astype(np.int32), "times": times.astype(np.int64)})

    return run


def mixture_weights(bins: list[tuple[int, int, int, int]], kinds: int, rounds: int = ROUNDS) -> np.ndarray:
    """BUCKETS rows of weights (bigram, token, uniform), by expectation-maximisation on (bucket, q2, q1, times)."""
    out = np.tile(np.array(DEFAULTS), (BUCKETS, 1))
    data = np.array(bins, np.float64).reshape(-1, 4)
    p = np.stack([np.where(data[:, 1] == 9999, 0, 2.0 ** (-data[:, 1] / BINS)), np.where(data[:, 2] == 9999, 0, 2.0 ** (-data[:, 2] / BINS)), np.full(len(data), 1.0 / (kinds + 1))], axis=1)

    def learn(use: np.ndarray, start: np.ndarray) -> np.ndarray:
        w, times = start, data[use, 3]
        for _ in range(rounds):
            part = p[use] * w
            w = (times[:, None] * part / part.sum(axis=1, keepdims=True)).sum(axis=0) / times.sum()
            w = np.maximum(w, 1e-9)
            w /= w.sum()
        return w

    if len(data):
        pooled = learn(np.ones(len(data), bool), out[0])
        for b in range(BUCKETS):
            use = data[:, 0] == b
            out[b] = learn(use, pooled) if use.any() else pooled
    return out


def _scores(n: int, kinds: int, weights: np.ndarray):
    def run(table):
        import pyarrow as pa

        ids, lengths, c, h, both = _met(table)
        p2, p1, p0 = _estimates(c, h, both, n, kinds)
        w = weights[_bucket(h)]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        total = lambda x: np.add.reduceat(x, starts)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([is_held_out(i) for i in ids]), "n_tokens": pa.array(lengths, pa.int64()),
                "n_known": pa.array(total((c > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array([n] * len(ids), pa.int64()),
                "base_score": total(np.log10((c + 1) / (n + kinds + 1))), "score": total(np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)),
            }
        )

    return run


def _with_answers(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Chunks and their answers in one table, for groups by chunk."""
    none = lambda kind: F.lit(None).cast(kind)
    a = chunks.select("chunk", "doc_ids", "lengths", "hashes", "ranks", "tokens", none("int").alias("ngram"), none("long").alias("part"), none("binary").alias("totals"))
    b = answers.where("who >= 0").select(F.col("who").alias("chunk"), none("array<long>").alias("doc_ids"), none("array<long>").alias("lengths"), *[none("binary").alias(c) for c in ("hashes", "ranks", "tokens")], "ngram", "part", "totals")
    return a.unionByName(b)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges, levels = max(1, -(-size // RANGE_BYTES)), 1
    while FANOUT**levels < ranges:
        levels += 1
    fan = int(np.ceil(ranges ** (1 / levels)))
    chunks = materialize(rows.mapInArrow(_make_chunks, CHUNK), "chunks")
    asked = chunks.select("chunk", "role", "lengths", "hashes", "ranks", "tokens").mapInArrow(_ask(fan), QUESTION)
    answers = _answers(asked, chunks.count(), fan, fan, levels)
    n, kinds = answers.where("who = -1 and ngram = 1").agg(F.sum("tokens"), F.sum("kinds")).first()
    n, kinds = n or 0, kinds or 0
    teach = chunks.where(F.col("role") == BOTH)
    theirs = answers.join(teach.select(F.col("chunk").alias("who")), "who", "left_semi")
    bins = _with_answers(teach, theirs).groupBy("chunk").applyInArrow(_bins(n, kinds), "bucket int, q2 int, q1 int, times long")
    binned = bins.groupBy("bucket", "q2", "q1").agg(F.sum("times").alias("times")).collect()  # BUCKETS * (64 * BINS)^2 rows at most, some 10^4 in fact
    weights = mixture_weights([tuple(r) for r in binned], kinds)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _with_answers(chunks, answers).groupBy("chunk").applyInArrow(_scores(n, kinds, weights), out)


def op4(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
