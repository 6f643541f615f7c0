"""Line dedup over overlapping windows of three lines.

Windows are runs of three consecutive lines that have a word, trimmed of
spaces at both ends; lines without a word are passed over and always stay.
Equal windows are found in all documents by two 64-bit hashes. The first
occurrence, by doc_id (null last), the document's hash and position, stays;
each line that a later occurrence covers is removed. Judged on the input:
what goes does not make other lines neighbours.

Cases: null texts stay null; texts of fewer than three lines with a word stay
whole; rows of equal doc_id and text are one document, and all get its
result; an empty table gives an empty result; all columns of docs stay, and
names that start with two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, keyed, materialize, table

EDGES = f"^{SPACE}+|{SPACE}+$"


def _lines(docs: DataFrame) -> DataFrame:
    """Add __lines and __at, the places (from 0) of lines with a word."""
    d = docs.withColumn("__lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    return d.withColumn("__at", F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: F.get("__lines", i).rlike(WORD)))


def windows(docs: DataFrame) -> DataFrame:
    """__id, __h, j (the window's first line among lines with a word), h1, h2."""
    d = _lines(docs.select("__id", "__h", "text").where(F.col("text").isNotNull()))
    d = d.where(F.size("__at") >= 3).select("__id", "__h", F.transform("__at", lambda i: F.regexp_replace(F.get("__lines", i), EDGES, "")).alias("__t"))
    three = lambda j: F.slice("__t", j + 1, 3)
    w = F.transform(F.sequence(F.lit(0), F.size("__t") - 3), lambda j: F.struct(j.alias("j"), F.xxhash64(three(j)).alias("h1"), F.xxhash64(F.lit("second"), three(j)).alias("h2")))
    return d.select("__id", "__h", F.inline(w))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the text left, and n_lines (with a word), n_lines_removed."""
    k = keyed(docs)
    w = materialize(windows(k), "windows")
    # a row a repeated window, written out, so that the join below deals both sides and can split a hot window
    first = w.groupBy("h1", "h2").agg(F.min(F.struct("__id", "__h", "j")).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    first = materialize(first, "repeated")
    later = w.join(first, ["h1", "h2"]).where(F.struct("__id", "__h", "j") != F.col("__first"))
    cover = later.groupBy(F.col("__id").alias("__cid"), F.col("__h").alias("__ch")).agg(F.collect_set("j").alias("__js"))
    d = k.join(cover, (F.col("__id") == F.col("__cid")) & (F.col("__h") == F.col("__ch")), "left")
    d = _lines(d)
    gone = F.transform(F.array_distinct(F.flatten(F.transform("__js", lambda j: F.sequence(j, j + 2)))), lambda j: F.get("__at", j))
    d = d.withColumn("__gone", F.when(F.col("__js").isNotNull(), gone))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    d = d.withColumn("__left", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n")))
    return d.select(*[F.col("__left").alias("text") if c == "text" else F.col(c) for c in docs.columns], F.size("__at").cast("bigint").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint").alias("n_lines_removed"))


def op4_three_line_windows(spark, sf_dir: str) -> DataFrame:
    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.col("n_lines"), F.col("n_lines_removed").alias("n_removed"), F.char_length("text").cast("bigint").alias("n_chars_kept"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM l),
nb AS (SELECT doc_id, pos, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS line,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS j FROM u WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, j, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c FROM nb WINDOW o AS (PARTITION BY doc_id ORDER BY j)),
later AS (SELECT doc_id, j FROM w WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, j) > 1),
cov AS (SELECT DISTINCT doc_id, j + k AS j FROM later, (SELECT unnest(range(3)) AS k)),
kept AS (SELECT u.doc_id, string_agg(u.line, chr(10) ORDER BY u.pos) AS text FROM u LEFT JOIN nb ON u.doc_id = nb.doc_id AND u.pos = nb.pos
         LEFT JOIN cov ON nb.doc_id = cov.doc_id AND nb.j = cov.j WHERE cov.doc_id IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, (SELECT count(*) FROM nb WHERE nb.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM cov WHERE cov.doc_id = d.doc_id) AS n_removed,
  length(CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END)::BIGINT AS n_chars_kept,
  sha256(CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END) AS kept_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
