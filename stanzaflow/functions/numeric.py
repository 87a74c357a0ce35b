"""Number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio100(numerator: Column, denominator: Column) -> Column:
    """100 times a ratio; 0 where the denominator is 0 or there is none."""
    return F.coalesce(F.try_divide(100.0 * numerator, denominator), F.lit(0.0))


def pooled(numerator: str | Column, denominator: str | Column) -> Column:
    """Ratio of sums as an aggregate, times 100: never a mean of ratios."""
    return ratio100(F.sum(numerator), F.sum(denominator))


def truthy(x: Column) -> Column:
    """Neither null nor 0."""
    return x.isNotNull() & (x != 0)


def hashed_draw(n: Column, *parts: Column) -> Column:
    """A number below n that depends on the parts alone: 32 bits of an MD5 by n."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n)
