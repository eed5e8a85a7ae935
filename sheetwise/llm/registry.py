"""Queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm import jaccard, mixing, packing, pii, quality, substrings, tokencount, topk, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = topk.scaled(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64.0)
    return topk.top_k(v.filter(F.col("id") % 20 == 0), v, 20)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn_from_tables(docs, _table(spark, sf_dir, "labels"))
    held = toxicity.is_held_out(F.col("doc_id")).alias("held_out")
    scored = toxicity.score_texts(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held, "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(pii.labelled_windows(docs)))


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(_table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(_table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_topk_search, op2_toxicity, op3_pii, op4_warc_salvage, op5_mix_sources, op6_quality_cascade, op7_harmonic_packing, op8_suffix_dedup, op9_token_counts, op10_ngram_jaccard)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": topk.ORACLE, "op4_warc_salvage": warc.ORACLE, "op10_ngram_jaccard": jaccard.ORACLE, "op6_quality_cascade": quality.ORACLE, "op8_suffix_dedup": substrings.ORACLE}
