"""Shared-folder materialisation, which cuts lineage so that a lost executor costs only a re-read; keys of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, NullType, ShortType

from stanzaflow.sources import scratch as _scratch
from stanzaflow.sources.scratch import bounded_batches, discard, shared_dir, written  # noqa: F401  the operators' own


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet below the shared folder and return a scan of what was written."""
    bounded_batches(df.sparkSession)
    return _scratch.materialise(df)


def integer_key(df: DataFrame, key: str) -> Column:
    """The column as a long; a key of another type is refused, as a cast would make nulls of it."""
    kind = df.schema[key].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType, NullType)):
        raise TypeError(f"key column {key} is of type {kind.simpleString()}, not an integer")
    return F.col(key).cast("long")
