"""Expression builders: predicates, conditionals, strings, dates and vectors, all as JVM-side columns."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def all_of(conditions) -> Column:
    return reduce(operator.and_, conditions)


def any_of(conditions) -> Column:
    return reduce(operator.or_, conditions)


def between(c, low, high) -> Column:
    """low <= c <= high."""
    return _c(c).between(low, high)


def in_range(c, low, high) -> Column:
    """low <= c < high."""
    return (_c(c) >= low) & (_c(c) < high)


def is_in(c, values) -> Column:
    return _c(c).isin(list(values))


def not_in(c, values) -> Column:
    return ~_c(c).isin(list(values))


def like(c, pattern: str) -> Column:
    return _c(c).like(pattern)


def starts_with(c, text: str) -> Column:
    return _c(c).startswith(text)


def ends_with(c, text: str) -> Column:
    return _c(c).endswith(text)


def product(factors) -> Column:
    return reduce(operator.mul, map(_c, factors))


def divide(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(_c(a), _c(b))


def if_else(condition: Column, yes, no) -> Column:
    return F.when(condition, yes).otherwise(no)


def choose(index, values) -> Column:
    """The value at a place counted from 0; null where there is none."""
    return F.get(F.array(*values), _c(index).cast("int"))


def substring0(c, start: int, stop: int) -> Column:
    """Characters start to stop, counted from 0, stop excluded."""
    return F.substring(_c(c), start + 1, stop - start)


def length(c) -> Column:
    return F.char_length(_c(c))


def extract(c, pattern: str, names) -> Column:
    """A struct of the pattern's groups, null fields where it does not match."""
    found = _c(c).rlike(pattern)
    return F.struct(*[F.when(found, F.regexp_extract(_c(c), pattern, i + 1)).alias(n) for i, n in enumerate(names)])


def year(c) -> Column:
    return F.year(_c(c)).cast("bigint")


def minute(c) -> Column:
    return F.minute(_c(c)).cast("bigint")


def l2sqr(a, b) -> Column:
    """Squared Euclidean distance of two array columns, as double."""
    d = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def inner_product(a, b) -> Column:
    """Inner product of two array columns, as double; larger is nearer."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


DISTANCES = {"L2": l2sqr, "IP": inner_product}
