"""The corpus pipeline: drop toxic documents, delete repeated lines, keep one near-copy, mix the sources, encode.

Each stage takes what the one before it kept, written as a table and read again.  All but the last return the columns of
``documents``.  The stages that run Python bound the session's Arrow batches by bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import bpe, lines, mixing, nearcopies, toxicity
from panelspark.llm.common import bounded_batches, cut_lineage, table, word_count


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.3 stay; labels of the held-out quarter of documents are not learned from."""
    bounded_batches(spark)
    known = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out("doc_id"))
    return toxicity.classify(docs, known).where("predicted = 0").select(docs.columns)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts; every document stays."""
    return lines.remove_repeated_runs(docs).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No two documents that stay have five-word shingle sets of similarity 0.8 or more; each that goes has one that stays."""
    bounded_batches(spark)
    return nearcopies.keep_dissimilar(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 3, 1, 2, repeating, and share one and a half times all words; documents occur as often as they are taken."""
    return mixing.repeat_rows(mixing.mix(docs, word_count("text"), mixing.cycle_weights(3, 1, 2))).select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document instead of its text."""
    bounded_batches(spark)
    return bpe.encode(docs, bpe.default_vocabulary(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", delete_repeated_lines),
    ("simhash near-dedup", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Not all stages can be said in SQL; the whole is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
