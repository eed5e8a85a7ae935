"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`. run() writes every stage as Parquet in the shared folder and hands the reread table on.

Defined results: a null or empty text is kept by the first three stages (it is not toxic, has no near duplicates and no
personal data) and has no words to mix, so it ends there; of equal rows of one doc_id one stays; rows without a doc_id are
kept apart from one another; texts are taken whole, however long; an empty table gives an empty result; further columns,
whatever their names, go through all stages but the last; with no labelled documents nothing is toxic.
The stages that run Python set the rows of an Arrow batch of their session to BATCH_ROWS; run() sets it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm import jaccard, mixing, packing, pii, toxicity
from sheetwise.llm.shared import materialise


#: Texts of a batch between Spark and Python: whole texts are long, and both sides hold a batch.
BATCH_ROWS = "1000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set(_BATCH, BATCH_ROWS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5; the model learns from the labels outside the held-out fold."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn_from_tables(docs, labels)
    score = "_toxicity"
    while score in docs.columns:
        score += "_"
    return toxicity.score_texts(docs, model, out=score).filter(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id."""
    _small_batches(spark)
    return jaccard.distinct_documents(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with spans of personal data replaced by their kind; n_chars follows the new text."""
    _small_batches(spark)
    net = pii.train(pii.labelled_windows(docs))
    return pii.redact(docs, net).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mixture takes, as one row per document and epoch."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    import public_tokenizers

    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), want_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mix_sources", mix_sources),
    ("harmonic_packing", pack_sequences),
]

#: The stages learn models and draw by hashes that SQL does not have; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(_BATCH)
    try:
        for name, stage in STAGES:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        spark.conf.set(_BATCH, before)
    return docs
