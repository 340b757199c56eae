from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import vector_search as vs
from tickloom.llm.kdtree import KdTree
from tickloom.llm.vector_search import approximate_top_k, chi_square_cdf, exact_top_k


@pytest.fixture(autouse=True)
def small_parts(monkeypatch):
    """Several shards and blocks even for few vectors."""
    monkeypatch.setattr(vs, "SHARD_ROWS", 100)
    monkeypatch.setattr(vs, "BLOCK_ROWS", 8)
    monkeypatch.setattr(vs, "LEAF_ROWS", 16)
    monkeypatch.setattr(vs, "FLAT_LEAF_ROWS", 16)
    monkeypatch.setattr(vs, "SAMPLE_ROWS", 128)
    monkeypatch.setattr(vs, "PAGE_BOXES", 2)
    monkeypatch.setattr(vs, "MERGED", 2)


def vectors(spark, n=400, d=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, d))
    x = centres[rng.integers(0, 20, n)] + 0.3 * rng.normal(size=(n, d))
    x[5] = x[17]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(k, [float(v) for v in x[k]], "extra") for k in range(n)]
    odd = [(1000, None), (1001, [1.0, None] + [0.0] * (d - 2)), (1002, [float("nan")] * d), (1003, [float("inf")] * d), (1020, [0.0] * d), (1021, [0.5] * 3), (None, [float(v) for v in x[3]]), (1023, [])]
    return spark.createDataFrame(rows + [(a, b, "e") for a, b in odd], "vec_id long, vector array<float>, shard string").repartition(3), x


def test_exact_against_brute_force(spark):
    d, x = vectors(spark)
    got = exact_top_k(spark, d, F.col("vec_id") % 20 == 0, 7, 64).collect()
    q = np.floor(64 * x.astype(float)).astype(int)
    ids = np.array([*range(400), 1020, np.iinfo(np.int64).max])
    whole = np.vstack([q, np.zeros(x.shape[1], int), q[3]])
    for k in [*range(0, 400, 20), 1020]:
        mine = [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == k), key=lambda r: r["rank"])]
        s = whole @ whole[np.flatnonzero(ids == k)[0]]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != k][:7]
        assert mine == [(None if ids[i] == ids[-1] else int(ids[i]), int(s[i])) for i in order]
    assert {r["query_id"] for r in got} == {*range(0, 400, 20), 1020}


def test_approximate_recall(spark):
    d, x = vectors(spark, 600, 16, 3)
    got = approximate_top_k(spark, d, F.col("vec_id") % 20 == 0, 10).collect()
    v, hit = x.astype(float), 0
    for k in range(0, 600, 20):
        mine = sorted((r for r in got if r["query_id"] == k), key=lambda r: r["rank"])
        assert len(mine) == 10 and all(a["score"] >= b["score"] for a, b in zip(mine, mine[1:], strict=False))
        s = v @ v[k]
        for r in mine:
            assert r["score"] == pytest.approx(s[3 if r["vec_id"] is None else r["vec_id"]], abs=1e-12)
        s[k] = -9
        hit += len({r["vec_id"] for r in mine} & set(np.argsort(-s, kind="stable")[:10].tolist()))
    assert hit / (30 * 10) >= 0.9
    assert all(r["query_id"] != 1020 and r["vec_id"] != 1020 for r in got)  # zero vectors take no part


def test_few_and_no_candidates(spark):
    d = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0]), (20, [0.5, 0.5])], "vec_id long, vector array<double>")
    for search in (exact_top_k, approximate_top_k):
        got = search(spark, d, F.col("vec_id") % 20 == 0, 20).collect()
        assert sorted((r["query_id"], r["rank"]) for r in got) == [(0, 1), (0, 2), (20, 1), (20, 2)]
        assert search(spark, d.limit(0), F.col("vec_id") % 20 == 0).count() == 0
        assert search(spark, d, F.lit(False)).count() == 0
        assert search(spark, d.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_far_shards_are_left_out(spark, monkeypatch):
    """Clusters far apart: a block's queries go to few shards, and the results are those of brute force."""
    rng = np.random.default_rng(4)
    x = np.repeat(10 * rng.normal(size=(8, 6)), 150, axis=0) + 0.1 * rng.normal(size=(1200, 6))
    x[700:900] = x[700]  # more equal vectors than a shard takes
    d = spark.createDataFrame([(k, x[k].tolist()) for k in range(1200)], "vec_id long, vector array<double>").repartition(3)
    shards = []
    monkeypatch.setattr(vs.c.Workspace, "table", lambda self, df, name, put=vs.c.Workspace.table: (shards.append((name, put(self, df, name))), shards[-1][1])[1])
    got = exact_top_k(spark, d, F.col("vec_id") % 20 == 0, 5).collect()
    of = {}
    for name, df in shards:
        of.setdefault(name, df)
    assert of["rest"].count() < 0.6 * of["first"].count() * of["trees"].count()
    q = np.floor(64 * x)
    for k in range(0, 1200, 20):
        s = q @ q[k]
        want = [(int(i), int(s[i])) for i in np.lexsort((np.arange(1200), -s)) if i != k][:5]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == k), key=lambda r: r["rank"])] == want


def test_lengths_that_doubles_cannot_hold(spark):
    d = spark.createDataFrame([(0, [1e7, 1.0]), (1, [1.0, 1.0])], "vec_id long, vector array<double>")
    with pytest.raises(ValueError, match="too long"):
        exact_top_k(spark, d, F.col("vec_id") == 0)


def test_repeated_rows(spark):
    d = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, vector array<double>")
    got = exact_top_k(spark, d, F.col("vec_id") % 20 == 0, 5).collect()
    assert len(got) == 4 and {r["vec_id"] for r in got} == {1}


def test_tree_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    x[50:90] = x[50]
    tree = KdTree.build(x, 16)
    again, extra = KdTree.load(tree.dump(ids=np.arange(300)))
    assert sorted(again.order.tolist()) == list(range(300)) and len(extra["ids"]) == 300
    q = rng.normal(size=(4, 5))
    reach = again.inner_bounds(q)
    for n in range(4):
        seen, last = 0, np.inf
        for bound, a, b in again.best_first(reach[n]):
            assert bound <= last and (again.points[a:b] @ q[n]).max() <= bound + 1e-12
            last, seen = bound, seen + b - a
        assert seen == 300
        far = ((x - q[n]) ** 2).sum(axis=1)
        assert again.distance_bounds(q[n])[0] <= far.min() + 1e-12


def test_chi_square():
    draws = (np.random.default_rng(2).normal(size=(200_000, 8)) ** 2).sum(axis=1)
    for x in (2.0, 8.0, 15.5):
        assert chi_square_cdf(x, 8) == pytest.approx((draws <= x).mean(), abs=5e-3)
