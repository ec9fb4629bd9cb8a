"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import language_id, line_dedup, near_dups, packing, quality
from ledgerlark.llm.common import fresh, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on those of them that have labels."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows."""
    return language_id.accepted(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; n_chars follows the text.

    Columns of the documents with the names of the operator's counts are set aside and come back unchanged.
    """
    aside = {c: fresh(docs, f"{c}_own") for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}
    kept = line_dedup.drop_repeated_lines(docs.withColumnsRenamed(aside)).drop("n_lines", "n_dropped")
    kept = kept.withColumnsRenamed({own: c for c, own in aside.items()})
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dups.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of 2,048."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("line_dedup", drop_lines),
    ("near_dedup", keep_one_of_each),
    ("packing", pack),
]

#: Two stages are trained models, which SQL cannot express; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
