"""The stored full-text index against scores from the texts themselves."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import search
from tessella.plans import fulltext

WORDS = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]
SCHEMA = "name string, title string, text string, token string, cell long"


def some(i, n):
    random.seed(i)
    return (f"k{i:04d}", random.choice([None, "alpha beta", "Gamma", "beta"]), None if i % 31 == 0 else " ".join(random.choices(WORDS, range(1, 11), k=n)), "x", 1)


def check(spark, root, rows, queries=("kappa beta", "gamma gamma", "beta alpha_beta", "epsilon", "none")):
    index = fulltext.Index(spark, root)
    for q in queries:
        want = {r.name: round(r.bm25, 9) for r in search.bm25_scores(rows, ["title", "text"], q).collect()}
        assert {r.key: round(r.bm25, 9) for r in index.scores(q).collect()} == want
        top = [(r.key, round(r.bm25, 9)) for r in index.top(q, 5).collect()]
        assert [s for _, s in top] == sorted(want.values(), reverse=True)[:5] and all(want[k] == s for k, s in top)
    return index


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(fulltext, "CELL", 8)
    monkeypatch.setattr(fulltext, "FIRST_CELLS", 2)


def test_build_update_merge(spark, tmp_path, small_cells):
    root = f"{tmp_path}/index"
    rows = [some(i, 1 + i % 40) for i in range(300)]
    first = spark.createDataFrame(rows, SCHEMA)
    now = fulltext.build(first, root, "name", ["title", "text"], buckets=8)
    index = check(spark, root, first)
    # A query opens the folders of its tokens alone.
    assert {b for b, _, _ in fulltext.folders(now, ["alpha", "beta"])} == {fulltext.bucket_of(t, 8) for t in ("alpha", "beta")}
    # Cells whose bound does not reach the result are not read.
    index.top("kappa beta", 1).collect()
    df = index.document_counts(["kappa", "beta"])
    assert index.last_cells.count() < index.bounds(["kappa", "beta"], df).count()

    changed = [("k0003", "zeta", "zeta zeta alpha", "x", 1), ("new", None, "kappa iota", "x", 1)]
    after = fulltext.update(spark, root, spark.createDataFrame(changed, SCHEMA), spark.createDataFrame([("k0005",), ("absent",)], "name string"))
    current = [r for r in rows if r[0] not in ("k0003", "k0005")] + changed
    index = check(spark, root, spark.createDataFrame(current, SCHEMA))
    # Nothing that was there is written again; what is new are the buckets of the changed documents' words.
    assert after["folders"][: len(now["folders"])] == now["folders"]
    assert {f[0] for f in after["folders"][len(now["folders"]) :]} == {fulltext.bucket_of(t, 8) for t in ("zeta", "alpha", "kappa", "iota")}
    assert after["n"] == 300 and index.now["version"] == 2

    many = fulltext.merge(spark, root, 1)
    assert set(many) == {f[0] for f in after["folders"][len(now["folders"]) :]}
    merged = fulltext.manifest(spark, root)
    assert [f for f in merged["folders"] if f[0] not in many] == [f for f in now["folders"] if f[0] not in many]
    check(spark, root, spark.createDataFrame(current, SCHEMA), ("kappa beta", "zeta_zeta alpha"))
    assert fulltext.merge(spark, root, 1) == []

    # A document that changes after the merge takes its postings out of merged buckets too, and may come back.
    fulltext.update(spark, root, spark.createDataFrame([("k0005", None, "alpha", "x", 1), ("new", "eta", "theta", "x", 1)], SCHEMA))
    current = [r for r in current if r[0] != "new"] + [("k0005", None, "alpha", "x", 1), ("new", "eta", "theta", "x", 1)]
    check(spark, root, spark.createDataFrame(current, SCHEMA))


def test_a_version_without_its_mark_is_not_there(spark, tmp_path):
    root = f"{tmp_path}/index"
    rows = spark.createDataFrame([some(i, 9) for i in range(20)], SCHEMA)
    fulltext.build(rows, root, "name", ["text"], buckets=2)
    spark.createDataFrame([("half",)], "value string").coalesce(1).write.text(f"{root}/manifest/2")
    path, fs = fulltext._fs(spark, f"{root}/manifest/2/_SUCCESS")
    fs.delete(path, False)
    assert fulltext.manifest(spark, root)["version"] == 1


def test_empty_and_stems(spark, tmp_path):
    rows = spark.createDataFrame([], SCHEMA)
    fulltext.build(rows, f"{tmp_path}/none", "name", ["text"], buckets=2)
    assert fulltext.Index(spark, f"{tmp_path}/none").top("alpha", 5).collect() == []
    rows = spark.createDataFrame([("a", None, "running things", "x", 1), ("b", None, "a thing runs", "x", 1), ("c", None, "none", "x", 1)], SCHEMA)
    fulltext.build(rows, f"{tmp_path}/stems", "name", ["text"], stem=True, buckets=2)
    got = {r.key: round(r.bm25, 9) for r in fulltext.Index(spark, f"{tmp_path}/stems").top("run thing", 5).collect()}
    assert got == {r.name: round(r.bm25, 9) for r in search.bm25_scores(rows, ["text"], "run thing", stem=True).collect()} and set(got) == {"a", "b"}


def test_postings_are_written_where_texts_meet(spark, tmp_path, small_cells, monkeypatch):
    monkeypatch.setattr(fulltext, "GROUP", 64)
    root = f"{tmp_path}/groups"
    rows = spark.createDataFrame([("a", "alpha", "beta alpha beta", "x", 1), ("b", "beta", None, "x", 1), ("c", "", "", "x", 1), *[some(i, 40) for i in range(40)]], SCHEMA)
    moved = []
    monkeypatch.setattr(fulltext, "_store", lambda blocks, *a, was=fulltext._store: (moved.append(blocks._jdf.queryExecution().executedPlan().toString()), was(blocks, *a)))
    fulltext.build(rows, root, "name", ["title", "text"], buckets=2)
    # Only texts move, and only to their cells.
    assert moved[0].count("Exchange hashpartitioning(cell") == 1 and moved[0].count("Exchange") == 1
    # A cell of many tokens is several groups; none of them is much above GROUP.
    blocks = spark.read.parquet(f"{root}/postings/1")
    assert blocks.groupBy("token", "cell").count().where("count > 1").count() > 0
    check(spark, root, rows, ("beta_alpha kappa", "alpha_beta"))
    # Documents of a length that none had before are cut in cells, too.
    new = spark.createDataFrame([some(1000 + i, 300) for i in range(30)], SCHEMA)
    before = fulltext.manifest(spark, root)["parts"]
    after = fulltext.update(spark, root, new)["parts"]
    assert before.items() < after.items() and max(v for k, v in after.items() if k not in before) >= 2
    check(spark, root, rows.unionByName(new), ("kappa beta",))
