"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ends(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    """The lesser and the greater of two columns: a key that doesn't depend on their order."""
    return F.least(a, b), F.greatest(a, b)


def pairs(n: str | Column) -> Column:
    """How many unordered pairs n things have: n(n-1)/2, as a signed number, so 0 for none."""
    n = F.col(n) if isinstance(n, str) else n
    return (n * (n - 1) / 2).cast("long")


def without(values: str | Column, *xs: Column) -> Column:
    """The entries of an array that equal none of xs."""
    def other(v: Column) -> Column:
        kept = F.lit(True)
        for x in xs:
            kept = kept & (v != x)
        return kept

    return F.filter(values, other)


def common(a: str | Column, b: str | Column) -> Column:
    """Entries of two sets that are held as arrays."""
    return F.array_intersect(a, b)


def total(col: str | Column) -> Column:
    """A sum that is 0 over no rows."""
    return F.coalesce(F.sum(col), F.lit(0)).cast("long")


def part_name(prefix: str, number: int) -> str:
    """Name of one file of a multi-part edge list."""
    return f"{prefix}{number:05d}"
