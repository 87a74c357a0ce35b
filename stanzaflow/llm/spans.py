"""Shared span shape and its digests.

A span is struct<start, rank, kind, end, score>: code-point offsets, end exclusive; rank is the place of
its kind in the operator's list and orders spans that start together.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double>>"


def joined(spans: Column) -> Column:
    """kind:start:end of each span by start, then rank, comma-joined; '' where there are none."""
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def digest_columns(spans: Column, base_kinds: list[str]) -> list[Column]:
    """A count for each base kind, the SHA-256 of the base spans, and all spans as text."""
    n = len(base_kinds)

    def count(rank: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(base_kinds)]
    base = F.filter(spans, lambda s: s["rank"] < n)
    return [*counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans")]
