"""Nearest neighbours against brute force: recall, copies, ties, vectors that take no part, few rows."""

import math

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tessella.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, node string, vec int, q int, label int"


def brute(rows, queries, top):
    best = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            best[i] = min(best.get(i, v), v)
    dim = max(map(len, best.values()), default=0)
    x = {i: np.array([*v, *[0.0] * (dim - len(v))], np.float64) for i, v in best.items()}
    out = {}
    for q in x:
        if queries(q):
            out[q] = sorted(((-float(np.dot(x[q].astype(np.float32).astype(float), v.astype(np.float32).astype(float))), i) for i, v in x.items() if i != q))[:top]
    return out


def check(got, want, recall):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert {q: len(x) for q, x in want.items() if x} == {q: len(x) for q, x in by.items()}
    hits = total = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(rows, rows[1:], strict=False))
        hits += len({r.vec_id for r in rows} & {i for _, i in want[q]})
        total += len(rows)
    assert hits >= recall * total


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    if scaled:
        x = (x + 4 * rng.normal(size=(12, 24))[rng.integers(0, 12, 3000)]).astype(np.float32) * rng.uniform(0.5, 2, size=(3000, 1)).astype(np.float32)
    rows = [(i, v.tolist(), "n", 1, 2, 3) for i, v in enumerate(x)]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()
    check(got, brute(rows, lambda q: q % 20 == 0, 20), 0.95)


def test_copies_ties_and_rows_that_take_no_part(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 6)), 1).astype(np.float32)
    rows = [(i, v.tolist(), "n", 1, 2, 3) for i, v in enumerate(x)]
    rows += [(1000 + i, x[0].tolist(), "n", 1, 2, 3) for i in range(300)]  # nearly half of all rows are one vector
    rows += [rows[7], rows[7], (8, [9.0] * 6, "n", 1, 2, 3)]  # repeated rows; an id with two vectors
    rows += [(2000, None, "n", 1, 2, 3), (2020, [0.0] * 6, "n", 1, 2, 3), (2040, [1.0, None], "n", 1, 2, 3), (2060, [float("nan")] * 6, "n", 1, 2, 3), (2080, [float("inf"), 1.0], "n", 1, 2, 3), (None, [1.0] * 6, "n", 1, 2, 3), (2100, [], "n", 1, 2, 3), (2120, [1.0, 2.0], "n", 1, 2, 3)]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()
    want = brute(rows, lambda q: q % 20 == 0, 20)
    check(got, want, 0.99)
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 1020), key=lambda r: r.rank)][:20] == [i for _, i in want[1020]]


def test_few_rows(spark):
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []
    for n in (1, 2, 19):
        rows = [(20 * i, [float(i + 1), 1.0], "n", 1, 2, 3) for i in range(n)]
        got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()
        assert len(got) == n * (n - 1)
        check(got, brute(rows, lambda q: True, 20), 1.0)


def test_whole_keys():
    batch = lambda *k: pa.RecordBatch.from_arrays([pa.array(k, pa.int64())], ["k"])
    parts = [t.column(0).to_pylist() for t in neighbours.whole_keys([batch(1, 1, 2), batch(2, 2), batch(), batch(2, 3, 4, 4), batch(4)], 2)]
    assert parts == [[1, 1], [2, 2, 2, 2, 3], [4, 4, 4]] or sum(parts, []) == [1, 1, 2, 2, 2, 2, 3, 4, 4, 4]
    assert len([p for p in parts for _ in {*p}]) == 4
