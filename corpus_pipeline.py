"""Corpus pipeline: quality votes, near-duplicates, benchmark decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import common, decontam, mixing, neardup, quality, token_files


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix in ascending doc_id order, and what they hold of each document (a repeated one comes repeatedly)."""
    return token_files.write_and_read(docs).drop("path", "place")


STAGES = [
    ("quality", quality.keep_good),
    ("near duplicates", neardup.one_of_each),
    ("decontamination", decontam.clean_documents),
    ("mixing", mixing.mix_stage),
    ("token files", token_stage),
]

#: The vote, the tokenizer and the files cannot be written in SQL; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage left in the shared folder goes as soon as its result is written."""
    docs = common.load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = common.work_path(spark, f"pipeline-{name.replace(' ', '-')}")
        with common.scratch(spark):
            docs = common.written(stage(spark, docs, sf_dir), path=path)
    return STAGES[-1][1](spark, docs, sf_dir)
