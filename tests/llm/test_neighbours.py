"""Approximate neighbours against all inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, at int, score int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2) for i, v in rows], SCHEMA)


def expected(rows, k, by=20):
    out = {}
    for q, v in rows:
        if q % by == 0:
            scored = sorted((-float(np.dot(np.float64(v), np.float64(x))), i) for i, x in rows if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) / len(near) for q, near in want.items()])


@pytest.mark.parametrize("norms", ["one", "many"])
def test_recall_and_exact_scores(spark, norms):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True) * (1 if norms == "one" else rng.uniform(0.3, 1.5, (6000, 1)))
    rows = list(enumerate(x.astype(np.float32)))
    got, want = found(neighbours.search(table(spark, rows), F.col("vec_id") % 20 == 0)), expected(rows, 20)
    assert recall(got, want) >= 0.9 and all(len(v) == 20 for v in got.values()) and len(got) == 300
    for q, near in got.items():
        assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)
        assert all(abs(s - float(np.float64(x[q]) @ np.float64(x[i]))) < 1e-12 and i != q for i, s in near)


def test_hash_is_the_nearest_axis_of_a_rotation():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 32))
    y = neighbours.rotated(x, 1)
    assert np.allclose(y @ y.T, x @ x.T) and not np.allclose(y, neighbours.rotated(x, 2))
    order = neighbours.probe_order(x, 1)
    assert (order[:, 0] == neighbours.buckets(x)[:, 1]).all() and (np.sort(order, axis=1) == np.arange(64)).all()


def test_bad_vectors_ties_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0, 0]), (5, [1, 1, 0]), (3, [1, 1, 0]), (7, None), (8, []), (9, [1, None, 0]), (10, [nan, 0, 0]), (11, [inf, 0, 0]), (12, [0, 0, 0]), (40, [1, 0]), (41, [2, 0]), (20, [0, 0, 1]), (20, [0, 1, 0]), (6, [0.5, 0, 0]), (6, [0.25, 0, 0])]
    got = found(neighbours.search(table(spark, rows), F.col("vec_id") % 20 == 0, k=3))
    assert got[0] == [(3, 1.0), (5, 1.0), (6, 0.5)]
    assert got[20][:2] == [(3, 0.0), (5, 0.0)] or got[20][:2] == [(0, 0.0), (3, 0.0)]  # the first of its vectors in array order
    assert got[40] == [(41, 2.0)]
    assert neighbours.search(table(spark, rows[3:9]), F.col("vec_id") % 20 == 0).count() == 0


def test_one_vector_many_times(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", (64, 64))
    monkeypatch.setattr(neighbours, "CHUNK_PROBES", 16)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[::3] = x[0]
    x[1::50] = x[1]
    rows = list(enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)))
    got, want = found(neighbours.search(table(spark, rows), F.col("vec_id") % 20 == 0)), expected(rows, 20)
    assert recall(got, want) >= 0.9
    copies = [i for i in range(3, 1500, 3) if i % 50 != 1]
    assert [i for i, _ in got[0]] == copies[:20]  # equal scores, smallest ids first
