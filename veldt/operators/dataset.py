"""Tools that build and check datasets: consistent scans, keys, splits, shards, exact random counts, validation.

Orders are those of a seeded hash of a row's key, so that runs agree whatever
the partitions; places within an order come from range partitions and their
counts, never from one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.scratch import materialize


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files, which must have the same columns of the same types; an error names the first that differs."""
    first = None
    for p in paths:
        found = [(f.name, f.dataType) for f in spark.read.parquet(p).schema]
        if first is None:
            first = found
        elif found != first:
            raise ValueError(f"{p} has columns {found}, {paths[0]} has {first}")
    return spark.read.parquet(*paths)


def drop_copies(df: DataFrame, order: str, ignore: tuple[str, ...]) -> DataFrame:
    """One row, the first by `order`, of rows equal in all columns but order and the ignored ones."""
    keys = [c for c in df.columns if c != order and c not in ignore]
    rest = [c for c in df.columns if c not in keys and c != order]
    first = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("__first"))
    return first.select(*[F.col(f"__first.{c}").alias(c) if c not in keys else F.col(c) for c in df.columns])


def ranked(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """df with each row's place from 0 in an order without ties: the rows are dealt by range, and a place is that within its partition after the counts of those before (a row a partition)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = materialize(dealt.select(*df.columns, F.spark_partition_id().alias("__p"), within.alias("__i")), "ranked")
    base, at = {}, 0
    for p, n in sorted(dealt.groupBy("__p").count().collect()):  # a row a partition
        base[p] = at
        at += n
    if not base:
        return dealt.select(*df.columns, F.col("__i").alias(name))
    offsets = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])
    return dealt.select(*df.columns, (offsets[F.col("__p")] + F.col("__i")).cast("bigint").alias(name))


def shuffled(key: str, seed: int) -> list[Column]:
    """A seeded random order of unique keys."""
    return [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]


def map_keys(left: DataFrame, left_key: str, right: DataFrame, right_key: str, seed: int) -> DataFrame:
    """A random one-to-one mapping (left_key, right_key) of distinct keys; as many rows as the smaller side has."""
    a = ranked(left.select(left_key).distinct(), shuffled(left_key, seed), "__a")
    b = ranked(right.select(right_key).distinct(), shuffled(right_key, seed + 1), "__b")
    return a.join(b, F.col("__a") == F.col("__b")).select(left_key, right_key)


def assign_keys(many: DataFrame, many_key: str, few: DataFrame, few_key: str, seed: int) -> DataFrame:
    """A random mapping (many_key, few_key) of each distinct key; the few are used in turn, so their numbers differ by 1 at most."""
    b = ranked(few.select(few_key).distinct(), shuffled(few_key, seed + 1), "__b")
    n = b.count()
    if not n:
        raise ValueError(f"{few_key} has no values")
    a = ranked(many.select(many_key).distinct(), shuffled(many_key, seed), "__a")
    return a.join(b, F.col("__a") % n == F.col("__b")).select(many_key, few_key)


def dense_keys(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the keys 0, 1, 2 and so on in an order without ties."""
    return ranked(df, list(order), name)


def split(df: DataFrame, key: str, n: int, seed: int, suffix: str = "_queries") -> tuple[DataFrame, DataFrame]:
    """n random rows with the suffix on their columns, and all others; keys are unique."""
    r = ranked(df, shuffled(key, seed), "__r")
    queries = r.where(F.col("__r") < n).drop("__r")
    return r.where(F.col("__r") >= n).drop("__r"), queries.select(*[F.col(c).alias(c + suffix) for c in queries.columns])


def write_shards(df: DataFrame, root: str, name: str, n: int, key: str) -> list[str]:
    """Files of about equal numbers of rows, `root/name-i.parquet`, in ranges of the key."""
    r = ranked(df, [key], "__r")
    total = df.count()
    paths = [f"{root.rstrip('/')}/{name}-{i}.parquet" for i in range(n)]
    for i, p in enumerate(paths):
        r.where((F.col("__r") >= total * i // n) & (F.col("__r") < total * (i + 1) // n)).drop("__r").write.mode("overwrite").parquet(p)
    return paths


def enforce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order, cast; a missing column, or a null where none may be, is an error."""
    if missing := [f.name for f in schema if f.name not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    out = df.select(*[F.col(f.name).cast(f.dataType) for f in schema])
    must = [f.name for f in schema if not f.nullable]
    if must:
        bad = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in must]).first().asDict()
        if wrong := {c: n for c, n in bad.items() if n}:
            raise ValueError(f"nulls in {wrong}")
    return out


def random_counts(keys: DataFrame, key: str, total: int, seed: int, sigma: float = 1.0) -> DataFrame:
    """key, n: log-normal numbers scaled so that they add up to total; the rounding's rest goes to the largest fractions."""
    u = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col(key)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = F.sqrt(-2 * F.log(u(0))) * F.cos(2 * F.pi() * u(1))
    w = keys.select(key).distinct().withColumn("__w", F.exp(normal * sigma))
    s = w.agg(F.sum("__w")).first()[0]
    if s is None:
        return w.select(key, F.lit(0).cast("bigint").alias("n"))
    share = F.col("__w") * F.lit(total / s)
    w = w.withColumn("__n", F.floor(share)).withColumn("__f", share - F.floor(share))
    rest = total - (w.agg(F.sum("__n")).first()[0] or 0)
    r = ranked(w, [F.col("__f").desc(), F.col(key)], "__r")
    return r.select(key, (F.col("__n") + (F.col("__r") < rest).cast("bigint")).alias("n"))


def validate(df: DataFrame, key: str, vector: str | None = None, foreign: dict[str, tuple[DataFrame, str]] | None = None, ranges: dict[str, tuple[float, float]] | None = None, unit: float | None = None) -> DataFrame:
    """check, n: how many rows, or values, break each rule; 0 everywhere for a sound dataset.

    Rules: nulls by column, repeated keys, repeated rows, and for the vector
    repeated ones, those of another length than most, with a value that is not
    finite, and with a norm off 1 by over `unit`; foreign keys without a row;
    values outside closed ranges.
    """
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"nulls:{c}") for c in df.columns], *[F.count_if(~F.col(c).between(lo, hi)).alias(f"range:{c}") for c, (lo, hi) in (ranges or {}).items()])
    parts = [one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("n")) for c in one.columns])).alias("x")).select("x.*")]

    def extra(name: str, *cols) -> DataFrame:
        groups = df.groupBy(*cols).count().where("count > 1")
        return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit(name).alias("check"), "n")

    parts += [extra("repeated keys", key), extra("repeated rows", F.xxhash64(*df.columns), key)]
    if vector:
        usual = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("s")).count().orderBy(F.desc("count"), "s").limit(1).collect()
        size = usual[0][0] if usual else 0
        odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        parts.append(df.where(F.col(vector).isNotNull()).groupBy(F.xxhash64(vector)).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit("repeated vectors").alias("check"), "n"))
        rules = {"vector length": F.size(vector) != size, "vector values": odd} | ({"vector norm": F.abs(norm - 1) > unit} if unit is not None else {})
        parts += [df.agg(F.count_if(c).alias("n")).select(F.lit(name).alias("check"), "n") for name, c in rules.items()]
    for c, (other, okey) in (foreign or {}).items():
        lost = df.where(F.col(c).isNotNull()).join(other.select(F.col(okey).alias("__k")), F.col(c) == F.col("__k"), "left_anti")
        parts.append(lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"foreign:{c}").alias("check"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
