"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, its
source's target divided by its source's size. Their prefix sum within the
source, plus one random offset, crosses some integers; a document is emitted
once for each. Documents are ordered by size, so that neighbours are alike
and the words taken stay within about one longest document of the target.

Cases: a null or empty text has size 0 and may be emitted with 0 words; null
sources form one source, ordered last; a source of size 0 has target 0; an
empty table gives an empty result; repeated rows are separate documents, and
equal rows share one multiset of copies; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_key, table, word_count

#: Fixed-point unit of a copy.
UNIT = 1 << 30


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """source, source_size, target, __rate (copies a document, in UNITs), __u (offset, in UNITs).

    totals(source, source_size) has a row a source, so its one-task windows
    grow with the number of sources only. Sources reach their limit in the
    order of limit over weight: with the limits of those before it taken
    away, a source whose share of the rest is not below its limit is full.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    t = totals.withColumn("__i", F.row_number().over(by_name) - 1)
    t = t.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (F.col("__i") % n + 1).cast("int")).cast("bigint"))
    t = t.withColumn("__cap", F.col("source_size") * most).withColumn("__total", F.sum("source_size").over(Window.partitionBy()))
    full = Window.orderBy(F.col("__cap") / F.col("__w"), "__i")
    t = t.withColumn("__before", F.coalesce(F.sum("__cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("__weights", F.sum("__w").over(full.rowsBetween(0, Window.unboundedFollowing)))
    left = (F.col("__total") - F.col("__before")).cast("double") / F.col("__weights").cast("double")
    t = t.withColumn("__level", F.greatest(left, F.lit(0.0))).withColumn("__full", F.col("__level") * F.col("__w") >= F.col("__cap"))
    level = F.min(F.when(~F.col("__full"), F.struct(F.col("__before"), F.col("__level")))).over(Window.partitionBy())
    t = t.withColumn("target", F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(level["__level"] * F.col("__w")))
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(UNIT)))).otherwise(F.lit(0))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("source"), F.lit("")))), 1, 7), 16, 10).cast("bigint")
    return t.select("source", "source_size", "target", rate.cast("bigint").alias("__rate"), (u * 4).alias("__u"))


def ranked(rows: DataFrame, key: str, order: list) -> DataFrame:
    """Add __n, the place from 0 within key in that order, without one task a key.

    Rows are dealt by range, so a hot key spans many partitions; the places
    follow from how many rows of the key the partitions before hold, a table
    of at most partitions + keys rows.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, F.col(key).isNull(), F.col(key), *order).withColumn("__p", F.spark_partition_id())
    dealt = materialize(dealt, "ranged")
    counts = dealt.groupBy("__p", key).agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("__p").alias("__bp"), F.col(key).alias("__bk"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"))
    here = Window.partitionBy("__p", key).orderBy(*order)
    placed = dealt.withColumn("__r", F.row_number().over(here) - 1)
    joined = placed.join(base, (F.col("__p") == F.col("__bp")) & F.col(key).eqNullSafe(F.col("__bk")))
    return joined.withColumn("__n", F.col("__base") + F.col("__r")).drop("__p", "__bp", "__bk", "__base", "__r")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and the columns to keep for each row of docs; documents that tie are ordered by the latter."""
    # a digest of the id orders documents of one source and size at random, and rows that still tie are alike
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keep), "sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, seed)
    targets = materialize(targets.withColumnRenamed("source", "__s"), "targets")
    placed = ranked(sized, "source", [F.col("size"), F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), *map(F.col, keep)])
    # one row a source: Spark broadcasts it while it is small and shuffles, splitting hot sources, beyond that
    out = placed.join(targets, F.col("source").eqNullSafe(F.col("__s")))
    at = (F.col("__u") + (F.col("__n") % UNIT) * (F.col("__rate") % UNIT)) % UNIT
    return out.select("doc_id", "source", "size", "source_size", "target", F.floor((at + F.col("__rate")) / F.lit(UNIT)).cast("bigint").alias("copies"), *keep)


def op3_systematic_mix(spark, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (at most `most` times), with its copy's number from 1 as `copy`, or `copy_` and so on where docs has that column."""
    number = "copy"
    while number in docs.columns:
        number += "_"
    keyed = docs.withColumn("__k", row_key("source", "text"))
    keys = mix(keyed, keep=("__k",), **options).groupBy("__k").agg(F.count(F.lit(1)).alias("__rows"), F.min("copies").alias("__copies"), F.max("copies").alias("__most"), F.sum("copies").alias("__sum"))
    keys = materialize(keys.where("__most > 0"), "copies")
    joined = keyed.join(keys.where("__copies = __most"), "__k")
    uneven = keys.where("__copies < __most")
    if not uneven.isEmpty():
        # rows of one key have a number of copies or the next; so many of them as have the next take it
        placed = ranked(keyed.join(uneven, "__k").withColumn("__x", F.rand(7)), "__k", ["__x"])
        more = (F.col("__n") < F.col("__sum") - F.col("__rows") * F.col("__copies")).cast("bigint")
        joined = joined.unionByName(placed.withColumn("__copies", F.col("__copies") + more).where("__copies > 0").select(joined.columns))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias(number))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) AS i FROM totals),
w2 AS (SELECT source, source_size, i, (i % 3 + 1)::BIGINT AS wt, source_size * 3 AS cap, sum(source_size) OVER () AS total FROM w),
w3 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / wt, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
         sum(wt) OVER (ORDER BY cap::DOUBLE / wt, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wts FROM w2),
w4 AS (SELECT *, greatest((total - bef)::DOUBLE / wts::DOUBLE, 0.0::DOUBLE) AS lev FROM w3),
w5 AS (SELECT *, lev * wt >= cap AS is_full FROM w4),
tg AS (SELECT source, source_size,
         CASE WHEN is_full THEN cap::DOUBLE ELSE (SELECT arg_min(lev, bef) FROM w5 WHERE NOT is_full) * wt END AS target,
         ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 7))::BIGINT * 4 AS u FROM w5),
tr AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 1073741824.0::DOUBLE)::BIGINT ELSE 0 END AS rate FROM tg)
, pl AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.u, t.rate,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, md5('mix:' || coalesce(s.doc_id::VARCHAR, ''))) - 1 AS n
       FROM sized s JOIN tr t ON s.source IS NOT DISTINCT FROM t.source),
cp AS (SELECT *, (((u + (n % 1073741824) * (rate % 1073741824)) % 1073741824 + rate) // 1073741824)::BIGINT AS copies FROM pl)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM cp
"""
