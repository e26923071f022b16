"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again as the next one's docs. The first four return the columns of documents; the mixing stage's
decision is the order of its rows, in which they are written. The packing reads that order from the files
and follows it in WINDOWS parts: sequences with ascending numbers hold pieces of ascending parts of it.

Defined results: null and empty texts are documents like others and reach the packing unless the classifier
rejects them; a null doc_id is no copy of another and stays; of repeated rows the near-duplicate stage, which
decides by doc_id, keeps all or none; texts of any length are read whole; an empty table gives an empty table
at each stage; other columns, whatever their names, are passed on up to the packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, near_dup, packing, quality, substring_dedup
from millrace.llm.common import documents, table_cut
from millrace.llm.queries import TARGETS, vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model rejects (score below 0.3) go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest doc_id stays."""
    return near_dup.keep_one(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier in the corpus are cut from the texts; n_chars is counted anew."""
    return substring_dedup.remove_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the order of the Pfair schedule for the target weights; all stay."""
    return mixing.interleave(docs, TARGETS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place, in the order of the rows of ``docs`` where that is a written table."""
    return packing.pack_documents(docs, vocabulary(), place=packing.file_order(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Learning, MinHash and packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table_cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
