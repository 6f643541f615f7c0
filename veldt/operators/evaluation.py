"""How near a result comes to the exact one: recall, precision, row recall, errors of scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimals that floating-point columns keep when rows are compared.
DECIMALS = 4


def recall(found: DataFrame, truth: DataFrame, keys: list[str]) -> float:
    """Share of truth's rows, by keys and counting repetitions, that found has; 1 if truth is empty."""
    n = truth.count()
    return truth.select(*keys).intersectAll(found.select(*keys)).count() / n if n else 1.0


def precision(found: DataFrame, truth: DataFrame, keys: list[str]) -> float:
    """Share of found's rows that truth has; 1 if found is empty."""
    return recall(truth, found, keys)


def recall_per_query(found: DataFrame, truth: DataFrame, query: str, key: str) -> DataFrame:
    """query, n_truth, n_hit, recall for each query of truth. Keys are unique within a query."""
    hit = found.select(F.col(query).alias("__q"), F.col(key).alias("__k")).distinct()
    j = truth.select(query, key).join(hit, (F.col(query) == F.col("__q")) & (F.col(key) == F.col("__k")), "left")
    out = j.groupBy(query).agg(F.count(F.lit(1)).alias("n_truth"), F.count("__k").alias("n_hit"))
    return out.withColumn("recall", F.col("n_hit") / F.col("n_truth"))


def _normal(df: DataFrame) -> list[Column]:
    """Columns as text, floating-point ones cut after DECIMALS, not rounded."""
    scale = 10.0**DECIMALS
    cut = lambda c: (F.when(F.col(c) < 0, F.ceil(F.col(c) * scale)).otherwise(F.floor(F.col(c) * scale)) / scale)
    return [(cut(c) if t in ("float", "double") else F.col(c)).cast("string").alias(c) for c, t in df.dtypes]


def row_recall(found: DataFrame, truth: DataFrame, ignore: tuple[str, ...] = ()) -> float:
    """Share of truth's rows that found has, as multisets and in any order; two empty results agree, and rows found beside an empty truth count 0."""
    t, f = (d.drop(*ignore) for d in (truth, found))
    n = t.count()
    if not n:
        return 1.0 if f.isEmpty() else 0.0
    return t.select(*_normal(t)).intersectAll(f.select(*_normal(f)).select(*t.columns)).count() / n


def strict_recall(found: DataFrame, truth: DataFrame, place: str) -> float:
    """Share of truth's rows that found has at the same place, a column that numbers the rows of both."""
    if place not in truth.columns or place not in found.columns:
        raise ValueError(f"no column {place!r}")
    return row_recall(found, truth)


def scalar_error(found: DataFrame, truth: DataFrame) -> tuple[float, float] | None:
    """Absolute and relative error of a result of one number; None if either has another shape or is null."""
    a, b = (d.limit(2).collect() for d in (truth, found))
    if len(a) != 1 or len(b) != 1 or len(a[0]) != 1 or len(b[0]) != 1 or a[0][0] is None or b[0][0] is None:
        return None
    off = float(b[0][0]) - float(a[0][0])
    return off, off / float(a[0][0]) if a[0][0] else float("nan")
