"""File sources with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped, a malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object over many lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """CSV with a header line. With a key, the last line of each counts; lines are numbered as they are read, within a file."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    if key is None:
        return rows
    numbered = rows.select(F.struct(*rows.columns).alias("_row"), F.monotonically_increasing_id().alias("_line"))
    return numbered.groupBy(f"_row.{key}").agg(F.max_by("_row", "_line").alias("_last")).select("_last.*")


def read_export(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """An export by its suffix: .jsonl and .json as JSON lines, anything else as TSV whose values stay text."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    if path.lower().endswith((".jsonl", ".json")):
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


#: Bytes of files up to which a table is dealt over all cores.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if its files are SMALL: they may have been written in one piece, which one core would read."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether an optional input is there, on any file system that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of some paths that is there."""
    return next((p for p in paths if exists(spark, p)), None)


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A static relation."""
    return spark.createDataFrame(rows, schema)
