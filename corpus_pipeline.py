"""The corpus pipeline: quality classifier, near-duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossweave.llm import decontam, mixing, quality, simhash, token_store
from glossweave.llm.common import materialize, read_table
from glossweave.llm.queries import MIX_TARGETS, labelled_domains, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rejects go."""
    return quality.select_quality(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such passages go."""
    return decontam.decontaminate(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken at the rates that bring the languages' token totals to their targets."""
    docs = docs.select(*COLUMNS)
    return mixing.mix(docs, labelled_domains(docs, read_table(spark, sf_dir, "labels")), MIX_TARGETS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ascending doc_id order, written in the token format and read back."""
    return token_store.token_table(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("token_output", token_stage),
]

#: No stage but the joins between them is expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
