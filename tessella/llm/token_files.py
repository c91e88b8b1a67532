"""Token ids in files of independent zstandard frames.

A file holds one frame per document (its ids as little-endian unsigned 32-bit integers), one frame with the
document ids (little-endian signed 64-bit; null is the smallest value), and a seek table in a skippable frame at
the end: for each frame its compressed size, its size, and a checksum (the low 32 bits of the XXH64 of its
content), then the number of frames, a descriptor byte and a magic number. Any zstandard decoder reads the files
as a whole; read_documents_at() decompresses only the frames of the documents asked for.

Files are written in ascending order of document id (ties: of a hash of the text, then of the text), one per range,
with FILE_BYTES of text or so, each under a name of its own attempt and then listed in a table; a task that runs twice
leaves a file that nothing lists. Null texts count as empty; an empty text is the end id alone. A very long text is one
frame. Repeated rows are frames of their own; null ids come first. Further columns of the documents are ignored,
whatever their names. No rows: no files, no result rows.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import uuid
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialize, new_path, ship

#: Fixed values of the seek table format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: The id that ends each document.
END_ID = 2
#: What stands for a null document id.
NO_ID = -(2**63)
#: Words whose ids a worker keeps at most.
CACHE_WORDS = 800_000
#: Bytes of text that a file holds, or so.
FILE_BYTES = 32_000_000

#: Punctuation that the splitter parts from the letters before it.
_STOPS = (b".", b",", b";", b":", b"!", b"?")

#: Letters below this have no combining marks and are composed already.
_LATIN_END = "\u0250"

_encoders: dict = {}


class WordEncoder(dict):
    """Encodes texts with a tokenizer whose result for a text is that of its space-separated parts, one after another.

    That holds where the normaliser lower-cases and turns white space into spaces, and the splitter drops them and parts
    letters from punctuation, as in word_bpe_49k.json. A part is encoded once and kept as its ids, those used of late
    first: two generations of CACHE_WORDS / 2 each. A-Z are lower-cased before that, but not in parts with other letters of
    a text with combining marks (U+0300 to U+037F, the only ones that compose with A-Z): the tokenizer composes first.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.older: dict[bytes, bytes] = {}
        # How byte-level models name bytes: printable ones by themselves, the others by characters from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.byte_names = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(plain)))}

    def _letters(self, word: str) -> bytes:
        """Ids of a run of lower-case letters, which normaliser and splitter leave as it is: the model alone decides."""
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)])

    @staticmethod
    def _stays_letters(text: str) -> bool:
        """Whether letters alone are left of it when it is composed and lower-cased."""
        return text.isalpha() and unicodedata.normalize("NFC", text).lower().isalpha()

    def __missing__(self, part: bytes) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            if part.isalpha():
                ids = self._letters(part.decode())
            elif part[-1:] in _STOPS and (part[:-1].isalpha() or self._stays_letters(part[:-1].decode())):
                ids = self[part[:-1]] + self[part[-1:]]
            elif (text := part.decode()).isalpha() and max(text) < _LATIN_END and text.lower().isalpha():
                ids = self._letters(text.lower().encode().decode("latin-1").translate(self.byte_names))
            else:
                got = self.tokenizer.encode(text, add_special_tokens=False).ids
                ids = struct.pack(f"<{len(got)}I", *got)
        self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if len(self) > CACHE_WORDS // 2:
            self.older = dict(self)
            self.clear()
        raw = text.encode()
        if b"\xcc" in raw or b"\xcd" in raw:  # the first bytes of those marks
            parts = [p.lower() if p.isascii() else p for p in raw.split()]
        else:
            parts = raw.lower().split()  # A-Z and ASCII white space alone
        return b"".join(map(self.__getitem__, parts))


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def filesystem(uri: str):
    """The file system of a URI and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class FrameWriter:
    """Writes frames to a binary file and the seek table at its end."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.table = out, []
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def add(self, content: bytes) -> None:
        import xxhash

        frame = self.zstd.compress(content)
        self.out.write(frame)
        self.table.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def finish(self) -> None:
        rows = b"".join(struct.pack("<III", *x) for x in self.table)
        foot = struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(rows) + len(foot)) + rows + foot)


class FrameReader:
    """Reads single frames of a file that FrameWriter made; the file needs read and seek."""

    def __init__(self, file):
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        end = file.seek(0, 2)
        file.seek(end - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("not a file of frames with a seek table")
        file.seek(end - 9 - 12 * count)
        rows = file.read(12 * count)
        self.table, self.starts, at = list(struct.iter_unpack("<III", rows)), [], 0
        for size, _, _ in self.table:
            self.starts.append(at)
            at += size

    def frame(self, k: int) -> bytes:
        import xxhash

        size, length, check = self.table[k]
        self.file.seek(self.starts[k])
        content = self.zstd.decompress(self.file.read(size), max_output_size=max(length, 1))
        if len(content) != length or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return content

    def doc_ids(self) -> list[int | None]:
        raw = self.frame(len(self.table) - 1)
        return [None if x == NO_ID else x for (x,) in struct.iter_unpack("<q", raw)]


def write_token_files(docs: DataFrame, tokenizer_path: str, out_uri: str, end_id: int = END_ID) -> DataFrame:
    """Writes docs (doc_id, text) to files under out_uri; the table (shard, path, n_docs, n_tokens) of those that count."""
    spark = docs.sparkSession
    ship(spark)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, end = TaskContext.get().partitionId(), struct.pack("<I", end_id)
        fs, top = filesystem(out_uri)
        fs.create_dir(top, recursive=True)
        path = f"{top}/tokens-{shard:06d}-{uuid.uuid4().hex}.zst"
        out, writer, ids, n = None, None, [], 0
        enc = encoder(tokenizer_path)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = fs.open_output_stream(path, compression=None)
                writer = FrameWriter(out)
            ids += [NO_ID if x is None else x for x in batch.column(0).to_pylist()]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for t in texts:
                content = enc.encode(t) + end
                writer.add(content)
                n += len(content) // 4
        if out is not None:
            writer.add(struct.pack(f"<{len(ids)}q", *ids))
            writer.finish()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([n], pa.int64())})

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["doc_id", F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text")).repartitionByRange(max(1, -(-size // FILE_BYTES)), *order)
    rows = rows.sortWithinPartitions(*order, "text")
    return materialize(rows.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long"), "token-files")


def read_token_files(files: DataFrame, out_uri: str) -> DataFrame:
    """Every document of the listed files: shard, place, doc_id, start (in all files), n_tokens, ids_crc32."""
    spark = files.sparkSession
    ship(spark)

    def read(batches):
        import pyarrow as pa

        fs, _ = filesystem(out_uri)
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(path) as file:
                    reader, start, rows = FrameReader(file), 0, []
                    ids = reader.doc_ids()
                    for k, doc_id in enumerate(ids):
                        content = reader.frame(k)
                        rows.append((k, doc_id, start, len(content) // 4, zlib.crc32(content)))
                        start += len(content) // 4
                        if len(rows) == 10_000 or k == len(ids) - 1:
                            cols = list(zip(*rows, strict=True))
                            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int32()), *(pa.array(c, pa.int64()) for c in cols)], ["shard", "place", "doc_id", "start_in_shard", "n_tokens", "ids_crc32"])
                            rows = []

    count = max(1, files.count())
    spread = files.select("shard", "path").repartition(min(count, 4 * spark.sparkContext.defaultParallelism))
    each = spread.mapInArrow(read, "shard int, place long, doc_id long, start_in_shard long, n_tokens long, ids_crc32 long")
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("shard", before.alias("before"))  # a row per file
    return each.join(starts, "shard").select("shard", "place", "doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")


def read_documents_at(path: str, places: list[int]) -> list[list[int]]:
    """The ids of the documents at these places of one file; no other frame is decompressed."""
    with open(path, "rb") as file:
        reader = FrameReader(file)
        return [list(struct.unpack(f"<{reader.table[k][1] // 4}I", reader.frame(k))) for k in places]


def op8(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = new_path(spark, "tokens")
    files = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), out)
    return read_token_files(files, out).select("doc_id", "start", "n_tokens", "ids_crc32")
