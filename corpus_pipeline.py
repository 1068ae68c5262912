"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs; all but the last return the
columns of documents, the others' extra columns with them. Columns whose names
differ in case alone are one, the exact name's; a missing one counts as null.
Texts of any length are worked on whole, and no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestql.llm import byte_bpe, language_id, line_dedup, mixing, simhash
from nestql.llm.common import table, tidy, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike every language that was learned, go; a missing lang is filled in.

    Null and empty texts have no letter; null ids are no obstacle; equal texts
    share their fate, so repeated rows stay or go together; a tie of languages
    goes to the smaller name. Where no row has a lang, nothing can be learned and all go.
    """
    docs = tidy(docs, "doc_id", "text", "lang")
    found = language_id.identify(docs, language_id.train(docs)).filter(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go from the texts.

    A null text becomes an empty one; a null id counts as the last document;
    rows that repeat an id count as one document and keep their lines; n_chars is
    counted anew. Every document stays, with an empty text if all its lines go.
    """
    docs = tidy(docs, "doc_id", "text")
    found = line_dedup.dedup_lines(docs).withColumn("text", F.col("kept_text"))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id.

    Texts without words, null ones too, are copies of each other; of rows that
    repeat an id one stays; rows with a null id all stay.
    """
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target weights, as many as these allow.

    A null source or language is a value of its own; a text without words has
    no tokens and its cell's probability; rows that repeat an id are kept or go
    together, and rows with a null id share one draw.
    """
    docs = tidy(docs, "doc_id", "text", "source", "lang")
    return mixing.to_targets(docs).filter("kept").select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text (little-endian 32-bit integers), and whether they decode to it.

    A null text has no ids, like an empty one; repeated rows and null ids give a row each.
    """
    docs = tidy(docs, "doc_id", "text", "lang", "source")
    found = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "text", "lang", "source")))
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return found.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Language models and fingerprints aren't SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
