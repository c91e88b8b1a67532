"""Token files and byte-level BPE against the libraries themselves."""

import struct
import zlib

import public_tokenizers as P
import pytest

from tessella.llm import bpe, token_files

TEXTS = [None, "", " ", "a", "Hello  world\n\nit's 12345 naïve café", "é" * 300, "x" * 5000, "aaaa aaaa", "日本語 テキスト", " nbsp\x1cfs", "ß ẞ İ ΑΣ", "tab\tand\r\nlines   ", "word " * 2000, "<|endoftext|> no"]


def rows(spark):
    return spark.createDataFrame([(i * 3, t, i) for i, t in enumerate(TEXTS)] + [(3, "a again", 1)], "doc_id long, text string, n_tokens int")


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    tokens = bpe.load_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    docs = rows(spark)
    got = [(r.doc_id, list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)), bytes(r.decoded)) for r in bpe.decode_documents(bpe.encode_documents(docs, path, P.PATTERN), path, P.PATTERN).collect()]
    want = [(r.doc_id, enc.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect()]
    assert sorted(got) == sorted(want)
    assert bpe.round_trip(docs.limit(0), path, P.PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    keys = [b"k%d" % i for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot) == list(range(3000)) and all(h.candidate(k) == i for i, k in enumerate(keys))


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    docs = rows(spark)
    files = token_files.write_token_files(docs, path, f"file://{tmp_path}/out")
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(files, f"file://{tmp_path}/out").orderBy("start").collect()]
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id, r.text or "")):
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == want
    one = files.first()
    assert token_files.read_documents_at(one.path, [1]) == [t.encode(sorted((x or "") for d, x in [(r.doc_id, r.text) for r in docs.collect()] if d == 3)[0], add_special_tokens=False).ids + [2]] or one.n_docs < 3


def test_damaged_frame_is_found(spark, tmp_path):
    import io

    out = io.BytesIO()
    w = token_files.FrameWriter(out)
    w.add(b"abc" * 100)
    w.add(struct.pack("<q", 7))
    w.finish()
    raw = bytearray(out.getvalue())
    assert token_files.FrameReader(io.BytesIO(bytes(raw))).frame(0) == b"abc" * 100
    w.table[0] = (w.table[0][0], w.table[0][1], 1)
    bad = io.BytesIO(bytes(raw[: w.table[0][0] + w.table[1][0]]))
    bad.seek(0, 2)
    w.out = bad
    w.finish()
    with pytest.raises(ValueError):
        token_files.FrameReader(bad).frame(0)


def test_word_encoder_equals_the_library():
    """50,000 strings of capitals, combining marks, composed and decomposed letters, punctuation and white space."""
    import random
    import struct

    import public_tokenizers

    from tessella.llm.token_files import WordEncoder

    encoder, rng = WordEncoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(11)
    pool = "YHTWJyhtwjaeiouAEIOUS\u0130\u0131\u00df\u1e9e\u00c5\u212b\u03a3\u03c3\u03c2\ufb01\u01c5\u0390\u0958\u4e2d\ud55c\u1100\u1161\u11a8" + ",.!? \t\n'-\u00a0\u3000\u0085012"
    pool += "\u0327\u0331\u0323\u030a\u0308\u0300\u0345" * 2
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(50_000)] + ["Y\u030a", "H\u0331", "T\u0308", "W\u030a", "J\u030c", "\u0130.", "\u0958?"]
    for text, want in zip(texts, encoder.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(text) == struct.pack(f"<{len(want.ids)}I", *want.ids), ascii(text)
