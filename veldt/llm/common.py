"""Shared helpers of the corpus operators: document keys and the word patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.scratch import Table, drop_scratch, materialize, scratch_mark, scratch_root

__all__ = ["Table", "drop_scratch", "materialize", "scratch_mark", "scratch_root"]

#: A word between white space (regex character class of the separators).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Separators of alphanumeric words, before and after A-Z is lower-cased.
PUNCT_ANYCASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PUNCT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of white-space separated words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 4, is 2. Null doc_ids count as held out, so nothing is learned from them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def through_pandas(docs: DataFrame, step, schema: str, *columns: str | Column) -> DataFrame:
    """doc_id and columns through mapInPandas. doc_id travels as text, as pandas would make numbers of a batch with nulls floats; schema is that of the other columns."""
    kind = docs.schema["doc_id"].dataType
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), *columns).mapInPandas(step, f"doc_id string, {schema}")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def keyed(docs: DataFrame) -> DataFrame:
    """Add __id and __h: a document is its doc_id (null last) and its text, so repeated rows are one document."""
    return docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(2**63 - 1))).withColumn("__h", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()))


def row_key(*cols: str) -> Column:
    """doc_id, null or of any type, and a hash of cols as one text: rows alike in these are one, rows that share only a doc_id are not."""
    h = F.xxhash64(*[x for c in cols for x in (F.col(c), F.col(c).isNull())])
    return F.concat(h.cast("string"), F.coalesce(F.concat(F.lit("|"), F.col("doc_id").cast("string")), F.lit("")))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; it looks at one more at most."""
    return df.limit(rows + 1).count() <= rows
