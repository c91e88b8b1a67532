"""corpus_pipeline against brute force, stage by stage, on the smallest tables."""

import collections
import glob
import hashlib
import os
import re
import struct

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers  # noqa: E402

from tessella.llm import quality  # noqa: E402
from tessella.llm.common import shared_dir  # noqa: E402
from tests.llm.test_operators import ascii_lower, brute_classes  # noqa: E402

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def kept_by_quality():
    """The verdicts of the same rules in SQL, cutoffs included."""
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return {i for i, kept in con.execute(f"SELECT doc_id, kept FROM ({quality.judged_sql('documents')})").fetchall() if kept}


def kept_by_mixture(rows):
    tokens = [len(SPACE.findall(r.text or "")) for r in rows]
    cell = [(r.source or "", r.lang or "", "note" if n < 150 else "article" if n < 600 else "report" if n < 2500 else "book") for r, n in zip(rows, tokens, strict=True)]
    mass = collections.Counter()
    for c, n in zip(cell, tokens, strict=True):
        mass[c] += n
    total, weight, target = sum(mass.values()), {c: float(n) for c, n in mass.items()}, []
    for k in range(3):
        share = collections.Counter()
        for c, n in mass.items():
            share[c[k]] += n / total
        raised = {x: s**0.9 for x, s in share.items()}
        target.append({x: s / sum(raised.values()) for x, s in raised.items()})
    for _ in range(500):
        for k in range(3):
            have = collections.Counter()
            for c, w in weight.items():
                have[c[k]] += w
            weight = {c: w * target[k][c[k]] / have[c[k]] for c, w in weight.items()}
    factor = {c: weight[c] / (mass[c] / total) for c in mass}
    top = max(factor.values())
    chance = lambda i: int(hashlib.sha256(f"mix-1:{i}".encode()).hexdigest()[:12], 16) / 16**12
    return {r.doc_id for r, c in zip(rows, cell, strict=True) if chance(r.doc_id) < factor[c] / top}


def test_run_equals_its_stages(spark):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, names = docs.collect(), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_duplicates", "near_duplicates", "mixture", "tokens"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.createDataFrame(rows, docs.schema), SF)
        assert out.columns == docs.columns
        got = out.collect()
        if name == "quality_rules":
            assert {r.doc_id for r in got} == kept_by_quality()
        elif name == "exact_duplicates":
            last = {}
            for r in rows:
                last[ascii_lower(r.text)] = max(r.doc_id, last.get(ascii_lower(r.text), r.doc_id))
            assert {r.doc_id for r in got} == set(last.values())
        elif name == "near_duplicates":
            root = brute_classes([(r.doc_id, r.text) for r in rows])
            first = {}
            for r, x in zip(rows, root, strict=True):
                first[x] = min(r.doc_id, first.get(x, r.doc_id))
            assert {r.doc_id for r in got} == set(first.values())
        else:
            assert {r.doc_id for r in got} == kept_by_mixture(rows)
        rows = got
    ranks = load_tiktoken_bpe(public_tokenizers.path(corpus_pipeline.BPE_RANKS))
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for r in rows:
        ids = coder.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()))
    shared = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{shared}/tessella/*"))
    last = corpus_pipeline.run(spark, SF)
    left = set(glob.glob(f"{shared}/tessella/*")) - before
    assert len(left) == 1 and "/mixture-" in left.pop()  # what the last stage reads
    got = last.collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in got} == want and len(got) == len(rows)


def test_run_of_odd_tables(spark, tmp_path):
    """Null and repeated rows, null languages, and an empty table."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = docs.limit(30).unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (5, None, "en", None, 0)], docs.schema))
    for name, table, least in (("odd", odd, 1), ("none", docs.limit(0), 0)):
        os.makedirs(tmp_path / name)
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() >= least
