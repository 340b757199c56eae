"""Substring, suffix-array and near-duplicate operators against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tickloom.llm import common as c
from tickloom.llm import jaccard_join as jj
from tickloom.llm.jaccard_join import jaccard_join, one_of_each
from tickloom.llm.substring_dedup import substring_dedup
from tickloom.llm.suffix_dedup import cut_repeats, suffix_dedup
from tickloom.llm.suffix_sort import lyndon_groups, suffix_array


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0)


def brute_words(rows, window):
    seen, out = set(), []
    for r in sorted(rows, key=key):
        w = (r["text"] or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if k in seen:
                gone[p : p + window] = [True] * window
            seen.add(k)
        out.append((r["doc_id"], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def brute_bytes(rows, length=100):
    seen, out = set(), []
    for r in sorted(rows, key=key):
        b = (r["text"] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((r["doc_id"], len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    if len(w) >= size:
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i]["doc_id"])
    low = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return Counter((rows[i]["doc_id"], len(sets[i]), low[find(i)]) for i in range(len(rows)))


@pytest.mark.parametrize(("window", "base"), [(20, 5), (8, 2), (7, 3)])
def test_words(spark, odd_docs, window, base):
    got = substring_dedup(spark, odd_docs, window, base).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_words(odd_docs.collect(), window)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_bytes(spark, odd_docs):
    got = suffix_dedup(spark, odd_docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_bytes(odd_docs.collect())
    for r in got:
        assert len(r["kept"]) == r["n_bytes"] - r["n_removed"] == r["n_bytes"] - sum(s["stop"] - s["start"] for s in r["removed"])


def test_cut_repeats_keeps_rows_columns_and_characters(spark, odd_docs):
    cut = cut_repeats(spark, odd_docs)
    assert cut.columns == odd_docs.columns
    rows = cut.collect()
    assert len(rows) == odd_docs.count() and sum(r["text"] is None for r in rows) == sum(r["text"] is None for r in odd_docs.collect())
    before = {r["pack_id"]: r["text"] for r in odd_docs.collect()}
    assert all(len(r["text"] or "") <= len(before[r["pack_id"]] or "") for r in rows)
    assert sum(len(r["text"] or "") for r in rows) < sum(len(t or "") for t in before.values())


def test_near_copies(spark, odd_docs):
    rows = odd_docs.collect()
    got = jaccard_join(spark, odd_docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)
    kept = one_of_each(spark, odd_docs)
    assert kept.columns == odd_docs.columns
    sets = [shingles(r["text"]) for r in kept.collect()]
    full = [s for s in sets if s]
    assert len(sets) - len(full) == sum(not shingles(r["text"]) for r in rows)
    assert all(100 * len(a & b) < 75 * len(a | b) for i, a in enumerate(full) for b in full[:i])


@pytest.mark.parametrize("hot", [4, 2048])
def test_templates_under_the_bound(spark, monkeypatch, hot):
    """Many documents that share most of their text but don't link, a few that do; by whole blocks and by pairs."""
    for name, value in (("BLOCK_ROWS", 8), ("HOT_ROWS", hot), ("BLOCK_ENTRIES", 3000), ("DENSE_COLUMNS", 32)):
        monkeypatch.setattr(jj, name, value)
    rng = random.Random(9)
    frame = [f"f{k}" for k in range(100)]
    rows = []
    for k in range(70):
        own = [f"o{k}x{j}" for j in range(rng.choice([18, 22, 30]))]
        text = frame[:60] + own + frame[60:]
        rows.append((k, " ".join(text)))
        if k % 9 == 0:
            text[rng.randrange(len(text))] = "changed"
            rows.append((1000 + k, " ".join(text)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(d.collect())
    assert len({x for *_, x in want}) > 50
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join(spark, d).collect()) == want


@pytest.mark.parametrize("seed, hot", [(1, 2048), (2, 3)])
def test_chains_of_near_copies(spark, seed, hot, monkeypatch):
    """Families in which many pairs miss the threshold and only chains connect them; blocks of a few rows."""
    monkeypatch.setattr(jj, "BLOCK_ROWS", 4)
    monkeypatch.setattr(jj, "HOT_ROWS", hot)
    monkeypatch.setattr(jj, "BLOCK_ENTRIES", 500)
    rng = random.Random(seed)
    rows = []
    for family in range(4):
        text = [f"w{rng.randrange(60)}" for _ in range(90)]
        for _ in range(14):
            for _ in range(rng.randrange(4)):
                text[rng.randrange(90)] = f"v{rng.randrange(400)}"
            rows.append((len(rows), " ".join(text[rng.randrange(3) :])))
            if rng.random() < 0.3:
                text = rows[rng.randrange(max(0, len(rows) - 5), len(rows))][1].split() + ["z"] * 90
                text = text[:90]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join(spark, d).collect())
    assert got == brute_components(d.collect())


def test_results_do_not_depend_on_partitioning(spark, odd_docs):
    docs = odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    for op in (substring_dedup, suffix_dedup):
        a = sorted((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in op(spark, docs.coalesce(1)).collect())
        b = sorted((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in op(spark, docs.repartition(9)).collect())
        assert a == b


def test_empty_tables(spark, no_docs):
    assert substring_dedup(spark, no_docs).count() == 0
    assert suffix_dedup(spark, no_docs).count() == 0
    assert cut_repeats(spark, no_docs).count() == 0
    assert jaccard_join(spark, no_docs).count() == 0
    assert one_of_each(spark, no_docs).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=25))
def test_groups_share_their_lyndon_prefix(text):
    """A suffix's Lyndon prefix reaches to its next smaller suffix."""
    n = len(text)

    def prefix(i):
        return text[i : next((j for j in range(i + 1, n) if text[j:] < text[i:]), n)]

    groups, group, _ = lyndon_groups(text)
    prefixes = [{tuple(prefix(i)) for i in own} for own in groups]
    assert all(len(p) == 1 for p in prefixes)
    flat = [next(iter(p)) for p in prefixes]
    assert flat == sorted(set(flat)) and all(i in groups[group[i]] for i in range(n))


def test_run_hashes_agree_with_whole_arrays():
    data = np.random.default_rng(0).integers(0, 256, 600_000).astype(np.uint8)
    start = np.arange(0, 599_000, 777)
    end = start + 500
    roll = c.Rolling(12345, len(data))
    want = c.mix(roll.runs(roll.prefix(c.byte_values(7)[data]), start, end) + np.uint64(500))
    assert (c.run_hashes(7, 12345, data, start, end) == want).all()
