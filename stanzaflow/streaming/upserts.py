"""Keyed results of a stream: a table of versions that a batch may write twice, and its latest rows.

The batch functions serve as they are: the last row of a key and its first place are a streaming aggregation, whose state is one row a key,
kept by Spark and recovered with the query. Late rows count by their sequence, not by when they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from stanzaflow.operators.selecting import last_wins


def upserted(stream: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row of each key by seq, with `place`, the least seq: rows of keys that a batch has changed, in update mode."""
    return last_wins(stream, key, seq)


def versions(changed: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that lays each batch's changed rows below path under the batch's number; a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The newest version of each key's row."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    row = F.struct(*[c for c in rows.columns if c != "batch"])
    return rows.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)]).agg(F.max_by(row, "batch").alias("_row")).select("_row.*")
