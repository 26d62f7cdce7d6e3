"""The registered queries of this folder and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import bpe, lines, lm, media, mixing, negatives, passages, pieces, sharding, simhash, spelling, topk, toxicity
from panelspark.llm.common import cut_lineage, documents, scratch_folder, table, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    sizes = cut_lineage(documents(spark, folder, "doc_id", "text", "source").select("doc_id", "source", word_count("text").alias("words")), "words")
    mixed = mixing.mix(sizes, F.col("words"), mixing.cycle_weights(3, 1, 2))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op2_mixing"] = mixing.ORACLE


@query
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard(documents(spark, folder, "doc_id", "text"), scratch_folder(spark, "slot_map"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot")


@query
def op10_lines(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.remove_repeated_runs(documents(spark, folder, "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "removed_lines", F.md5("text").alias("kept_md5"))


ORACLES["op10_lines"] = lines.oracle()


@query
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder, "doc_id", "text"))


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text")
    known = table(spark, folder, "labels").select("doc_id", "toxic").where(~toxicity.held_out("doc_id"))
    scored = toxicity.classify(docs, known)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


@query
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(documents(spark, folder, "doc_id", "text"), bpe.default_vocabulary(spark), digests=True, round_trip=True)


@query
def op6_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text")
    trie = lm.build(docs.where(~lm.held_out("doc_id")))
    return lm.score(docs, trie).withColumn("held_out", lm.held_out("doc_id"))


@query
def op7_media(spark: SparkSession, folder: str) -> DataFrame:
    return media.media_columns(documents(spark, folder, "doc_id", "text"), scratch_folder(spark, "media"))


@query
def op8_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


ORACLES["op8_topk"] = topk.ORACLE


@query
def op9_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, folder, "doc_id", "text"))


@query
def op11_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(documents(spark, folder, "doc_id", "text"), pieces.default_model(spark), digests=True, round_trip=True)


@query
def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    noisy = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(noisy, noisy.where("vec_id % 50 = 0"))


ORACLES["op12_negatives"] = negatives.ORACLE


@query
def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, folder, "doc_id", "text"))


ORACLES["op13_spelling"] = spelling.oracle()
