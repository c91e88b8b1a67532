"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split into pre-tokens by a pattern. A pre-token that is a token itself is found by one probe of a
minimal perfect hash (a displacement per bucket, as many slots as tokens). For the others, their bytes form a
linked list and a heap gives the adjacent pair whose joined bytes have the lowest rank, leftmost first, until
no pair can be joined.

Null texts count as empty and give no ids. Ids of repeated rows are the same. Texts of any length are encoded
whole; memory is a small multiple of the longest text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ship

#: Pre-tokens whose ids a worker keeps at most.
CACHE_WORDS = 400_000
#: Bytes that the tables sent to the workers may have at most.
MAX_TABLE_BYTES = 256 * 2**20

_coders: dict = {}


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _hashes(key: bytes) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


class PerfectHash:
    """A minimal perfect hash of byte strings: len(keys) slots, each with one key's number."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.m = n, max(1, (n + 3) // 4)
        buckets: list[list[tuple[int, int]]] = [[] for _ in range(self.m)]
        for k, key in enumerate(keys):
            a, b = _hashes(key)
            buckets[a % self.m].append((b, k))
        self.shift, self.slot = array("I", bytes(4 * self.m)), array("i", [-1]) * n
        for at in sorted(range(self.m), key=lambda x: -len(buckets[x])):
            if not buckets[at]:
                break
            d = 0
            while True:
                spots = [self._spot(b, d) for b, _ in buckets[at]]
                if len(set(spots)) == len(spots) and all(self.slot[s] < 0 for s in spots):
                    break
                d += 1
            self.shift[at] = d
            for s, (_, k) in zip(spots, buckets[at], strict=True):
                self.slot[s] = k

    def _spot(self, b: int, d: int) -> int:
        return ((b ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * 0xD6E8FEB86659FD93 >> 17) % self.n

    def candidate(self, key: bytes) -> int:
        """The number of the only key that key can be."""
        a, b = _hashes(key)
        return self.slot[self._spot(b, self.shift[a % self.m])]


class Coder:
    """Encodes and decodes with one vocabulary and pattern."""

    def __init__(self, tokens: list[bytes], pattern: str, perfect: PerfectHash | None = None):
        import regex

        self.tokens, self.perfect = tokens, perfect or PerfectHash(tokens)
        self.find = regex.compile(pattern).findall
        by_bytes = {t: k for k, t in enumerate(tokens)}
        self.byte = [by_bytes.get(bytes([b]), -1) for b in range(256)]
        self.size = len(tokens)
        #: (left id, right id) as one integer to the id of the joined bytes.
        self.pairs = {by_bytes[t[:i]] * self.size + by_bytes[t[i:]]: k for k, t in enumerate(tokens) for i in range(1, len(t)) if t[:i] in by_bytes and t[i:] in by_bytes}
        self.known: dict[str, bytes] = {}

    def whole(self, piece: bytes) -> int:
        k = self.perfect.candidate(piece)
        return k if self.tokens[k] == piece else -1

    def join(self, piece: bytes) -> list[int]:
        """The ids of a pre-token that is no token."""
        n, pairs, size = len(piece), self.pairs, self.size
        ids = [self.byte[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(k, i, ids[i], ids[i + 1]) for i in range(n - 1) if (k := pairs.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            k, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been joined meanwhile
            ids[i], ids[j], after[i] = k, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := pairs.get(k * size + ids[after[i]])) is not None:
                    heapq.heappush(heap, (x, i, k, ids[after[i]]))
            if (p := before[i]) >= 0 and (x := pairs.get(ids[p] * size + k)) is not None:
                heapq.heappush(heap, (x, p, ids[p], k))
        return [x for x in ids if x >= 0]

    def piece(self, text: str) -> bytes:
        raw = text.encode()
        k = self.whole(raw)
        ids = [k] if k >= 0 else self.join(raw)
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        self.known[text] = got = array("I", ids).tobytes()
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, piece = self.known, self.piece
        return b"".join([known.get(x) or piece(x) for x in self.find(text)])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that these ids stand for; an unknown id is an IndexError."""
        return b"".join(map(self.tokens.__getitem__, array("I", ids)))


def coder(key: str, tables) -> Coder:
    if key not in _coders:
        _coders[key] = Coder(*tables.value)
    return _coders[key]


def _tables(spark, path: str, pattern: str):
    tokens = load_ranks(path)
    if sum(map(len, tokens)) + 64 * len(tokens) > MAX_TABLE_BYTES:
        raise ValueError("the vocabulary is larger than what is sent to every worker")
    ship(spark)
    return spark.sparkContext.broadcast((tokens, pattern, PerfectHash(tokens)))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of each row."""
    tables = _tables(docs.sparkSession, path, pattern)

    def run(batches):
        import pyarrow as pa

        c = coder(f"{path} {pattern}", tables)
        for batch in batches:
            ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded (binary) of each row of (doc_id, ids)."""
    tables = _tables(coded.sparkSession, path, pattern)

    def run(batches):
        import pyarrow as pa

        c = coder(f"{path} {pattern}", tables)
        for batch in batches:
            texts = [c.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return coded.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each row: doc_id, n_tokens, and the SHA-256 of the ids and of the decoded bytes."""
    tables = _tables(docs.sparkSession, path, pattern)

    def run(batches):
        import pyarrow as pa

        c = coder(f"{path} {pattern}", tables)
        for batch in batches:
            n, ids, texts = [], [], []
            for t in batch.column(1).to_pylist():
                coded = c.encode(t or "")
                n.append(len(coded) // 4)
                ids.append(hashlib.sha256(coded).hexdigest())
                texts.append(hashlib.sha256(c.decode(coded)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
