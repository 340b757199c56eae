from __future__ import annotations

import hashlib

import duckdb
import pytest

import corpus_pipeline
from test_dedup import brute_bytes, shingles
from tickloom.llm import catalog
from tickloom.llm.mixing import targets

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, made = docs.columns, {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = made[name] = spark.read.parquet(str(tmp_path / name))
    assert all(made[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in made["quality"].collect()}
    clean = {i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0}
    assert len(clean & kept) >= 0.95 * len(clean)
    assert len({i for i, r in labels.items() if r["quality"] == 0} & kept) <= 0.3 * sum(r["quality"] == 0 for r in labels.values())
    sets = [shingles(r["text"]) for r in made["near_copies"].collect()]
    full = [s for s in sets if s]
    assert all(100 * len(a & b) < 75 * len(a | b) for i, a in enumerate(full) for b in full[:i])
    # a character that is covered in part stays whole, so a few bytes around a cut may still repeat
    again = brute_bytes(made["repeated_passages"].collect())
    assert sum(r[2] for r in again) <= 0.01 * sum(r[1] for r in again) and made["repeated_passages"].count() == made["near_copies"].count()
    sizes, taken = {}, {}
    for name, to in (("repeated_passages", sizes), ("mixed", taken)):
        for r in made[name].collect():
            to[r["source"]] = to.get(r["source"], 0) + len((r["text"] or "").encode().split())
    longest = max(len((r["text"] or "").split()) for r in made["repeated_passages"].collect())
    for s, wanted in targets(sizes, corpus_pipeline.WEIGHTS, corpus_pipeline.SHARE, corpus_pipeline.REPEATS).items():
        assert abs(taken.get(s, 0) - wanted) <= longest
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(corpus_pipeline.vocabulary_path())
    texts = {r["doc_id"]: r["text"] for r in made["mixed"].collect()}
    for r in made["encoded"].collect():
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == t.encode(text, add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF).toPandas()
    want = con.execute(catalog.oracle_sql()[name]).fetch_df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    text = lambda v: "null" if v is None or v != v else str(v)
    a, b = (sorted(tuple(map(text, row)) for row in x[columns].to_numpy(dtype=object).tolist()) for x in (got, want))
    assert a == b


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_queries_give_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
