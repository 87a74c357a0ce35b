"""Array functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Elements that are summed together.
STEP = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(sizes: Column) -> Column:
    """Running sums of an array of longs that isn't empty.

    By blocks of STEP: an appended array is copied, which over a whole array would cost the square of its length.
    """
    nothing = F.array().cast("array<bigint>")

    def within(block: Column, base: Column) -> Column:
        first = F.struct(base.alias("at"), nothing.alias("out"))
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"] + x).alias("out"))
        return F.aggregate(block, first, step, lambda s: s["out"])

    def sums(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda t, x: t + x))
        bases = F.aggregate(totals, F.array(F.lit(0).cast("long")), lambda s, t: F.array_append(s, F.element_at(s, -1) + t))
        return let(bases, lambda base: F.flatten(F.transform(blocks, lambda b, i: within(b, F.get(base, i)))))

    count = F.floor((F.size(sizes) - 1) / STEP).cast("int")
    return let(F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(sizes, i * STEP + 1, F.lit(STEP))), sums)
