"""The permutation index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann, catalog


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 8))
    v[7] = v[11] = v[100] = v[13]  # ties
    rows = [(i, [float(x) for x in r], "q") for i, r in enumerate(v)]
    rows += [(1000, None, "q"), (1020, [0.0] * 8, "q"), (1040, [float("nan")] * 8, "q"), (1060, [None] + [1.0] * 7, "q"), (1080, [1.0, 2.0], "q"), (1100, [float("inf")] * 8, "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in range(300) if i % 20 == 0}
    for q, found in got.items():
        s = (v * v[q]).sum(axis=1)
        want = [int(i) for i in np.lexsort((np.arange(300), -s)) if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and [f[1] for f in found] == want
        assert all(abs(f[2] - s[f[1]]) < 1e-12 for f in found)


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1)]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("sigma", [0.0, 0.5])
def test_recall(spark, monkeypatch, sigma):
    """Over several blocks and parts of queries, for vectors of one length and of lognormal lengths."""
    monkeypatch.setattr(ann, "BLOCK", 2500)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 100)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 64))
    v = centres[rng.integers(0, 10, 8000)] + 0.8 * rng.normal(size=(8000, 64))
    v *= rng.lognormal(0, sigma, 8000)[:, None] / np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(got) == 400
    hits = 0
    for q, found in got.items():
        s = v @ v[q]
        s[q] = -1e9
        hits += len(found & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_registered_query_matches_brute_force(spark, tmp_path):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, r.tolist(), 1) for i, r in enumerate(v)] + [(300, None, 1), (320, [0.0] * 8, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in catalog.queries()["op10_permutation_index"](spark, str(tmp_path)).collect())
    w = v.astype(np.float64)
    want = [(q, k + 1, int(i)) for q in range(0, 300, 20) for k, i in enumerate([i for i in np.lexsort((np.arange(300), -(w * w[q]).sum(axis=1))) if i != q][:20])]
    assert got == sorted(want)
