"""The corpus pipeline: five operators in turn over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontam, langid, packing, secrets, simhash
from lattica.llm.common import stored, tables


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; rejects those without a letter (und), a null text among them.

    Learns from the rows with a lang whose id is not held out; lang is no input of a prediction.
    """
    model = langid.train(docs.where(~langid.held_out()), "piece_bpe_32k.model")
    return langid.recognised(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that with the smallest doc_id, of rows that share it that with the least text.

    Rows that share a doc_id but are no near-duplicates all stay. Empty texts are one group.
    """
    return simhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with a benchmark item.

    A null or empty text overlaps with none; rows go by their own text, whatever their doc_id and whoever shares it.
    """
    return decontam.cleaned(docs, tables(spark, sf_dir, "benchmark"), decontam.WHOLE)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in text by a mark; n_chars follows where it is there. No document goes; a null text stays null."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens: a row per piece.

    A null or empty text is its end id alone; repeated ids are packed row by row; no documents, no pieces.
    """
    return packing.pack(docs, "word_bpe_49k.json", end_id=2, window=4096)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("pack", pack),
]

#: Language models, fingerprints of components and token ids have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
