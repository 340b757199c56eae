"""A corpus pipeline: junk out, near copies out, repeated passages out, sources mixed, texts encoded.

Every stage takes all documents that the one before kept, as Parquet, and returns
documents again, with all their columns; the last returns token ids.  An empty table
goes through every stage as one.  What the stages do with nulls, empty and very long
texts, ties and repeated rows is stated at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import common
from tickloom.llm.bpe import Vocabulary, bpe_id_lists
from tickloom.llm.jaccard_join import one_of_each
from tickloom.llm.mixing import mixed_documents
from tickloom.llm.quality import quality_filter
from tickloom.llm.suffix_dedup import cut_repeats

#: Weights that the sources take in turn.
WEIGHTS, SHARE, REPEATS, SEED = (3, 1, 2), 1.5, 2, 2


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like the trusted text of their language.

    Null and empty texts go; null lang is a language of its own; repeated rows are judged
    alike; a document as perplexing as the threshold stays.
    """
    return quality_filter(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    The smallest doc_id stays, nulls last, and one row of equal doc_ids; documents without
    words are nobody's copies and stay.
    """
    return one_of_each(spark, docs, size=5, percent=75)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without what stands in an earlier one; n_chars follows the text.

    All rows stay, if with empty text; null text stays null.  Null doc_ids stand after all
    others, equal ones in the order of their packs.
    """
    cut = cut_repeats(spark, docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source like another, the last in order; documents without words
    are never taken.  Ties in the seeded order go by doc_id, and reruns agree.
    """
    return mixed_documents(spark, docs, WEIGHTS, SHARE, REPEATS, SEED)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of what they decode to.

    Null and empty texts have no ids; repeated rows are encoded each.
    """
    return bpe_id_lists(spark, docs, Vocabulary(vocabulary_path()))


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixed", mixed),
    ("encoded", encoded),
]

#: No SQL expresses the language model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next; what a stage put by is removed then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = common.Workspace(spark)
    for name, stage in STAGES[:-1]:
        with common.released():
            docs = ws.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
