from __future__ import annotations

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickloom.llm.mixing import mix, mixed_documents, route, targets, word_count


def mixed(spark, docs, **more):
    return mix(spark, docs, F.array("source"), word_count(F.col("text")), (3, 1, 2), 1.5, 2, 5, **more)


def test_targets_stop_at_their_bound():
    got = targets({"a": 10, "b": 100, None: 100}, (3, 1, 2), 1.5, 2)
    assert list(got) == ["a", "b", None] and got["a"] == 20
    assert got["b"] == pytest.approx(295 / 3) and got[None] == pytest.approx(2 * 295 / 3)
    assert targets({}, (1,), 1.5, 2) == {} and targets({"a": 0}, (1,), 1.5, 2) == {"a": 0}


def test_flow_costs_as_little_as_possible():
    """Against all integer flows of a small case with overlapping sources."""
    sizes, quotas = {("a",): 2, ("a", "b"): 2, ("b",): 1}, {"a": 4, "b": 3}
    got = route(sizes, quotas, 2)
    used = Counter()
    for (p, _), x in got.items():
        used[p] += x
    cost = lambda u: sum(max(0, u[p] - sizes[p]) for p in sizes)
    assert sum(got.values()) == pytest.approx(7)
    best = min(
        cost({("a",): aa, ("a", "b"): ab_a + ab_b, ("b",): bb})
        for aa, ab_a, ab_b, bb in itertools.product(range(5), range(5), range(5), range(3))
        if aa + ab_a == 4 and ab_b + bb == 3 and aa <= 4 and ab_a + ab_b <= 4 and bb <= 2
    )
    assert cost(used) == pytest.approx(best)


def test_a_few_words_beside_billions():
    sizes = {("a",): 7, ("b",): 10**10, ("b", "c"): 3}
    got = route(sizes, {"a": 14.0, "b": 1.5e10, "c": 2.4}, 2)
    by = Counter()
    for (_, s), x in got.items():
        by[s] += x
    assert by == {"a": 14, "b": 15 * 10**9, "c": 2}


def test_mix_meets_targets(spark, odd_docs):
    rows = mixed(spark, odd_docs).collect()
    assert len(rows) == odd_docs.count()
    sizes = Counter()
    for r in odd_docs.collect():
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    taken, wanted = Counter(), targets(dict(sizes), (3, 1, 2), 1.5, 2)
    for r in rows:
        s = r["about"][0]
        assert s["size"] == sizes[s["source"]] and s["target"] == pytest.approx(wanted[s["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and sum(x["words"] for x in r["taken_by"]) == r["taken"]
        taken[s["source"]] += r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in wanted)


def test_reruns_and_partitions_agree(spark, odd_docs):
    take = lambda d: Counter((r["doc_id"], r["size"], r["taken"]) for r in mixed(spark, d).collect())
    assert take(odd_docs) == take(odd_docs.repartition(2))


def test_whole_documents(spark, odd_docs):
    rows = mixed(spark, odd_docs, cut=False).collect()
    assert all(r["size"] == 0 or r["taken"] % r["size"] == 0 for r in rows)
    out = mixed_documents(spark, odd_docs, (3, 1, 2), seed=5)
    assert out.columns == odd_docs.columns
    copies = Counter(r["pack_id"] for r in out.collect())
    assert set(copies.values()) <= {1, 2}


def test_overlapping_sources_share_their_documents(spark):
    d = spark.createDataFrame([(k, ["a", "b"] if k % 3 == 0 else ["a"] if k % 3 == 1 else ["b", "b"], 10) for k in range(60)], "doc_id long, s array<string>, words long")
    rows = mix(spark, d, F.col("s"), F.col("words"), (1, 1), 1.0, 2).collect()
    by = Counter()
    for r in rows:
        for x in r["taken_by"]:
            by[x["source"]] += x["words"]
    # 1.0 of both sources' sizes, which count shared documents twice
    assert by["a"] == by["b"] == 400 and sum(r["taken"] for r in rows) == 800
    assert {len(r["about"]) for r in rows} == {1, 2}


def test_empty(spark, no_docs):
    assert mixed(spark, no_docs).count() == 0 and mixed_documents(spark, no_docs, (1,)).count() == 0
