"""Expressions over itemsets as sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " + "


def label(items: Column | str) -> Column:
    return F.array_join(items, SEPARATOR)


def combinations(items: Column, k: int) -> Column:
    """All k-element subsets of a sorted array, each sorted."""
    if k == 1:
        return F.transform(items, lambda x: F.array(x))
    later = lambda i: F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0)))
    return F.flatten(F.transform(items, lambda x, i: F.transform(combinations(later(i), k - 1), lambda c: F.concat(F.array(x), c))))


def subset(items: Column, mask: Column) -> Column:
    """The elements whose bits are set."""
    return F.filter(items, lambda _, i: F.getbit(mask, i) == 1)


def proper_masks(items: Column) -> Column:
    """Masks of the non-empty proper subsets; none for a single item."""
    top = F.pow(F.lit(2), F.size(items)).cast("long") - 2
    return F.when(F.size(items) >= 2, F.sequence(F.lit(1).cast("long"), top)).otherwise(F.array().cast("array<bigint>"))


def min_count(min_support: float, n: Column) -> Column:
    """The smallest count that has the wanted support, with a little room for rounding, and 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.lit(float(min_support)) * n - F.lit(1e-9))).cast("long")


def share(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def check_fraction(name: str, x: float, closed: bool = True) -> None:
    if not 0 < x <= 1 or not closed and x == 1:
        raise ValueError(f"{name} must be in (0, 1{']' if closed else ')'}, not {x}")
