"""Relational operators over DataFrames: joins with a collision rule, distinct, sort, limit, top-k, scatter and gather."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "left_semi": "left_semi", "left_anti": "left_anti", "right_semi": "left_semi", "right_anti": "left_anti"}


def join(left: DataFrame, right: DataFrame, kind: str, left_keys: list[str], right_keys: list[str], suffixes: tuple[str, str] = ("_l", "_r"), residual=None, null_safe: bool = False) -> DataFrame:
    """Equi-join. Names on both sides get their side's suffix, which must differ; semi and anti joins keep one side's columns.

    residual: a function of the two sides giving a further condition. Null
    keys match nothing unless null_safe.
    """
    if kind == "cross":
        return _suffixed(left, right, suffixes, lambda a, b: a.crossJoin(b))
    if kind not in JOINS:
        raise ValueError(f"unknown join {kind!r}")
    if kind.startswith("right_"):
        left, right, left_keys, right_keys = right, left, right_keys, left_keys

    def on(a: DataFrame, b: DataFrame, la: list[str], lb: list[str]) -> Column:
        parts = [a[x].eqNullSafe(b[y]) if null_safe else a[x] == b[y] for x, y in zip(la, lb, strict=True)]
        return reduce(lambda x, y: x & y, parts + ([residual(a, b)] if residual else []))

    if JOINS[kind] in ("left_semi", "left_anti"):
        return left.join(right, on(left, right, left_keys, right_keys), JOINS[kind])
    both = set(left.columns) & set(right.columns)
    fix = lambda names, s: [n + s if n in both else n for n in names]
    return _suffixed(left, right, suffixes, lambda a, b: a.join(b, on(a, b, fix(left_keys, suffixes[0]), fix(right_keys, suffixes[1])), JOINS[kind]))


def _suffixed(left: DataFrame, right: DataFrame, suffixes: tuple[str, str], joined) -> DataFrame:
    both = set(left.columns) & set(right.columns)
    if both and suffixes[0] == suffixes[1]:
        raise ValueError(f"suffixes must differ for {sorted(both)}")
    return joined(*[d.select(*[F.col(c).alias(c + s) if c in both else F.col(c) for c in d.columns]) for d, s in ((left, suffixes[0]), (right, suffixes[1]))])


def take(data: DataFrame, index: DataFrame, data_key: str, index_key: str) -> DataFrame:
    """data's rows with index's other columns, once for each equal key in index."""
    return data.join(index.withColumnRenamed(index_key, "__key"), F.col(data_key) == F.col("__key")).drop("__key")


def distinct(df: DataFrame, keys: list[str] | None = None, keep_all: bool = False) -> DataFrame:
    """Distinct keys; no keys mean all columns. keep_all keeps one whole row a key."""
    if keep_all:
        return df.dropDuplicates(keys) if keys else df.dropDuplicates()
    return (df.select(*keys) if keys else df).distinct()


def sort_keys(keys: list[tuple[str, str]], nulls: str = "first") -> list[Column]:
    """Null placement is absolute: `first` puts nulls first whichever the direction."""
    return [getattr(F.col(c), f"{d.lower()}_nulls_{nulls}")() for c, d in keys]


def order_by(df: DataFrame, keys: list[tuple[str, str]], nulls: str = "first") -> DataFrame:
    return df.orderBy(*sort_keys(keys, nulls))


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return (df.offset(offset) if offset else df).limit(n)


def top_k(df: DataFrame, keys: list[tuple[str, str]], k: int, nulls: str = "first") -> DataFrame:
    return order_by(df, keys, nulls).limit(k)


def limit_per_group(df: DataFrame, group: list[str], keys: list[tuple[str, str]], k: int, nulls: str = "first") -> DataFrame:
    """The first k rows of each group; Spark limits before and after the shuffle."""
    w = Window.partitionBy(*group).orderBy(*sort_keys(keys, nulls))
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k).drop("__rank")


def scatter(df: DataFrame, key: str, n: int) -> list[DataFrame]:
    """One DataFrame for each distinct key in order, n at most; an error if there are more."""
    keys = [r[0] for r in df.select(key).distinct().orderBy(key).limit(n + 1).collect()]
    if len(keys) > n:
        raise ValueError(f"{key} has more than {n} values")
    return [df.where(F.col(key).eqNullSafe(F.lit(k))) for k in keys]


def gather(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames of one schema."""
    return reduce(DataFrame.unionByName, frames)


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    """The listed columns under new names; others go."""
    return df.select(*[F.col(o).alias(n) for o, n in zip(old, new, strict=True)])
