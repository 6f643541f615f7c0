"""A training corpus from raw documents: quality rules, line dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of documents; the last adds the number of the copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm import decontam, linededup, minhash, mixing, quality
from veldt.llm.common import Table, drop_scratch, scratch_mark, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or exceed their language's certified policy go."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that later occurrences of repeated three-line windows cover go; n_chars follows the text."""
    return linededup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with 0.8 of their two-word shingles in common, as op9 links them, the smallest doc_id stays."""
    return minhash.deduplicated(docs, width=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with the number of the copy."""
    return mixing.mixed_documents(docs)


STAGES = [("quality", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix_sources)]

#: The quality policies and the near-duplicate components depend on one another's
#: rows; tests/llm/test_pipeline.py compares the rows of run() with all five stages
#: in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES[:-1]:
        kept = Table(stage(spark, docs, sf_dir), name)
        drop_scratch(mark, kept)
        docs = kept.df
    return STAGES[-1][1](spark, docs, sf_dir)
