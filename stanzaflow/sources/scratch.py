"""Tables written to the shared folder, which cut lineage so that a lost executor costs only a re-read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes and rows of a batch that goes to Python.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096

_written: list[tuple[SparkSession, str]] = []


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, set to hand rows to Python in batches of a few MB, whatever the length of a row's text.

    A batch is held several times: in the JVM's direct memory, in transit, and by the worker that reads it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and the master is local, a folder of our own, set once."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='stanzaflow-')}"
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession) -> str:
    """A path below the shared folder that is removed when the driver ends."""
    path = f"{shared_dir(spark)}/stanzaflow/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet below the shared folder and return a scan of what was written."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables are there: what discard() counts from."""
    return len(_written)


def discard(since: int, but_last: bool = True) -> None:
    """Remove the tables written since a mark, but for the last; nothing that is still to run may read them."""
    gone = _written[since : len(_written) - but_last]
    del _written[since : len(_written) - but_last]
    for spark, path in gone:
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    """Remove what this driver wrote; a session that has already stopped leaves it to the folder's owner."""
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the gateway is gone
            return
