"""Folders of lines that change in one step.

A Python data source writes the lines. Each task writes files of its own below `data/<run>` and tells the driver
their names in its commit message; when all tasks have ended, one small file below `versions` names the files of the
new version, and that file's move into place is the change. Whatever stops a task, the job or the driver before it,
the version that stood still stands whole, and readers of it are not disturbed; files that no version names are not
read. A version may take over the files of the one before it, so that an append writes its own lines only.

The lines are made by Spark (to_json, to_csv) and written batch by batch from Arrow. Paths are those that
pyarrow.fs reads (file, hdfs, s3, gs), on a folder that the driver and all executors share.

Defined results: no rows make a version without files, which reads as an empty table; a null in a column is left out of JSON
and empty in CSV; a path that was never published is an error for read() and an empty folder for merge(). Two writers that
follow the same version are told apart when the later one commits, which fails; a version's name is taken by one run only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import RecordBatch
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from stanzaflow.functions.text import fixed
from stanzaflow.operators.selecting import upsert

DATA, VERSIONS = "data", "versions"


class Conflict(RuntimeError):
    """Another version came between the one that was read and the one to be published."""


@dataclass
class Part(WriterCommitMessage):
    """A task's file, with its partition, lines and bytes."""

    partition: int
    name: str
    lines: int
    bytes: int


def _listed(path: str, kind: str) -> list[str]:
    fs, root = FileSystem.from_uri(path)
    return sorted(f.base_name for f in fs.get_file_info(FileSelector(f"{root}/{kind}", allow_not_found=True)) if not f.base_name.startswith((".", "_")))


def versions(path: str) -> list[int]:
    """The numbers of the versions that are there, the last one being what is read."""
    return [int(name.partition("-")[0]) for name in _listed(path, VERSIONS)]


def manifest(path: str, version: int | None = None) -> dict | None:
    """A version's number, run and files (name, lines, bytes); the newest one's, or None where nothing was published."""
    fs, root = FileSystem.from_uri(path)
    names = [n for n in _listed(path, VERSIONS) if version is None or int(n.partition("-")[0]) == version]
    if not names:
        return None
    with fs.open_input_stream(f"{root}/{VERSIONS}/{names[-1]}") as f:
        return json.loads(f.read())


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.run, self.suffix = options["path"], options["run"], options.get("suffix", "")
        self.header, self.append = options.get("header"), options.get("append") == "true"
        self.follows = int(options["follows"]) if "follows" in options else None

    def write(self, iterator: Iterator[RecordBatch]) -> WriterCommitMessage | None:
        partition = TaskContext.get().partitionId()
        name, lines = f"{self.run}/part-{partition:06d}-{uuid.uuid4().hex}{self.suffix}", 0
        fs, root = FileSystem.from_uri(self.path)
        out = None
        for batch in iterator:
            if batch.num_rows:
                if out is None:
                    fs.create_dir(f"{root}/{DATA}/{self.run}", recursive=True)
                    out = fs.open_output_stream(f"{root}/{DATA}/{name}")
                    if self.header:
                        out.write(f"{self.header}\n".encode())
                out.write(("\n".join(batch.column(0).to_pylist()) + "\n").encode())
                lines += batch.num_rows
        if out is None:
            return Part(partition, "", 0, 0)
        out.close()
        return Part(partition, name, lines, fs.get_file_info(f"{root}/{DATA}/{name}").size)

    def commit(self, messages: list[Part | None]) -> None:
        fs, root = FileSystem.from_uri(self.path)
        before = manifest(self.path)
        last = before["version"] if before else 0
        if self.follows is not None and self.follows != last:
            raise Conflict(f"version {last} of {self.path} came after version {self.follows}")
        parts = sorted((m for m in messages if m is not None and m.lines), key=lambda m: m.partition)
        for m in parts:
            if fs.get_file_info(f"{root}/{DATA}/{m.name}").size != m.bytes:
                raise RuntimeError(f"{m.name} isn't what its task wrote")
        files = [[m.name, m.lines, m.bytes] for m in parts]
        if self.append and before:
            files = before["files"] + files
        fs.create_dir(f"{root}/{VERSIONS}", recursive=True)
        hidden = f"{root}/{VERSIONS}/_{self.run}"
        with fs.open_output_stream(hidden) as f:
            f.write(json.dumps({"version": last + 1, "run": self.run, "at": time.time(), "files": files}).encode())
        fs.move(hidden, f"{root}/{VERSIONS}/{last + 1:020d}-{self.run}.json")

    def abort(self, messages: list[Part | None]) -> None:
        fs, root = FileSystem.from_uri(self.path)
        if fs.get_file_info(f"{root}/{DATA}/{self.run}").type == FileType.Directory:
            fs.delete_dir(f"{root}/{DATA}/{self.run}")


class PublishedLines(DataSource):
    """Lines, the one column of what is written, as the next version of a folder."""

    @classmethod
    def name(cls) -> str:
        return "published_lines"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def _publish(lines: DataFrame, path: str, suffix: str, header: str | None, append: bool, follows: int | None) -> None:
    lines.sparkSession.dataSource.register(PublishedLines)
    options = {"path": path.rstrip("/"), "run": uuid.uuid4().hex, "suffix": suffix, "append": str(append).lower()}
    options |= {"header": header} if header is not None else {}
    options |= {"follows": str(follows)} if follows is not None else {}
    lines.write.format("published_lines").mode("append").options(**options).save()


def write_jsonl(df: DataFrame, path: str, append: bool = False, follows: int | None = None) -> None:
    """JSON lines as the next version, behind those of the version before if they are to be kept."""
    _publish(df.select(F.to_json(F.struct("*")).alias("line")), path, ".json", None, append, follows)


def write_csv(df: DataFrame, path: str, order: list[str], decimals: list[str], follows: int | None = None) -> None:
    """CSV in order as the next version, each file with a header; the named columns with three decimals. Files are ranges, named in order."""
    rows = df.orderBy(*order).withColumns({c: fixed(F.col(c)) for c in decimals})
    header = ",".join(c if c.isidentifier() else '"' + c.replace('"', '""') + '"' for c in df.columns)
    _publish(rows.select(F.to_csv(F.struct("*")).alias("line")), path, ".csv", header, False, follows)


def read(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest one if none is named; it stays readable while others are published."""
    found = manifest(path, version)
    if found is None:
        raise FileNotFoundError(f"nothing was published at {path}" + (f" as version {version}" if version else ""))
    names = [f"{path.rstrip('/')}/{DATA}/{name}" for name, _, _ in found["files"]]
    if not names:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.option("header", True).csv(names) if names[0].endswith(".csv") else reader.json(names)


def merge_jsonl(df: DataFrame, path: str, schema: str, key: list[str], seq: str) -> None:
    """Lay df over the newest version by key and publish what comes of it; fails if another version was published meanwhile."""
    before = manifest(path)
    if before:
        df = upsert(read(df.sparkSession, path, f"{schema}, {seq} long", before["version"]), df, key, seq).drop("place")
    write_jsonl(df, path, follows=before["version"] if before else 0)


def vacuum(path: str, keep: int = 2, idle: float = 86400.0) -> int:
    """Remove all but the last `keep` versions, and the runs that none of these names and that were last written to over `idle` seconds ago; how many runs went."""
    fs, root = FileSystem.from_uri(path)
    names = _listed(path, VERSIONS)
    kept = {name.partition("/")[0] for n in names[-keep:] for name, _, _ in manifest(path, int(n.partition("-")[0]))["files"]}
    for n in names[:-keep]:
        fs.delete_file(f"{root}/{VERSIONS}/{n}")
    gone = 0
    for run in set(_listed(path, DATA)) - kept:
        written = [f.mtime.timestamp() for f in fs.get_file_info(FileSelector(f"{root}/{DATA}/{run}", recursive=True)) if f.mtime]
        if time.time() - max(written, default=0) > idle:
            fs.delete_dir(f"{root}/{DATA}/{run}")
            gone += 1
    return gone
