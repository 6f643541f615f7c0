"""Aggregates by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGREGATES = {
    "sum": F.sum,
    "mean": F.avg,
    "avg": F.avg,
    "count": F.count,
    "count_valid": F.count,
    "count_all": lambda c=None: F.count(F.lit(1)),
    "count_distinct": F.count_distinct,
    "min": F.min,
    "max": F.max,
    "stddev": F.stddev_pop,
    "median": F.median,
    "approximate_median": lambda c: F.percentile_approx(c, 0.5),
    "quantile_cont": F.median,
    #: any value; the smallest, so that runs agree
    "one": F.min,
    "list": F.collect_list,
}


def aggregate(name: str, column=None, alias: str | None = None) -> Column:
    """One aggregate call; its name is `<column>_<function>` unless alias says otherwise. Over no valid rows, sum is null and counts are 0."""
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}; known: {', '.join(AGGREGATES)}")
    out = AGGREGATES[name](column) if column is not None else AGGREGATES[name]()
    return out.alias(alias or (f"{column}_{name}" if column else name))
