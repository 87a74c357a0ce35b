"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stanzaflow.functions.text import fixed
from stanzaflow.operators.selecting import upsert
from stanzaflow.sources.files import exists, read_jsonl


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, replaced; characters beyond ASCII are kept as they are."""
    df.write.mode("overwrite").json(path)


def merge_jsonl(df: DataFrame, path: str, schema: str, key: list[str], seq: str) -> None:
    """Lay df over the JSON lines at a path by key.

    The merge is written beside them and takes their place, which is emptied by renaming: whatever stops it, either the
    lines or the merge are there whole. A place found empty with its old lines beside it gets them back first.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    beside, aside = f"{path}.merging", f"{path}.before"
    target, new, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside, aside))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(old) and not files.exists(target):
        files.rename(old, target)
    files.delete(old, True)
    if exists(spark, path):
        df = upsert(read_jsonl(spark, path, f"{schema}, {seq} long"), df, key, seq).drop("place")
    df.write.mode("overwrite").json(beside)
    if files.exists(target):
        files.rename(target, old)
    files.rename(new, target)
    files.delete(old, True)


def write_csv(df: DataFrame, path: str, order: list[str], decimals: list[str]) -> None:
    """CSV with a header in order; the named columns with three decimals. Sorted in ranges: a large table gives several files, whose names are in order."""
    df.orderBy(*order).withColumns({c: fixed(F.col(c)) for c in decimals}).write.mode("overwrite").option("header", True).csv(path)


def summary(df: DataFrame) -> DataFrame:
    """One JSON document, `json`, of a one-row DataFrame."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def series(df: DataFrame, x: str, ys: list[str], mark: int) -> DataFrame:
    """Plot-ready rows x, series, y and whether x lies at or after a marked place, in order."""
    long = df.unpivot([x], ys, "series", "y")
    return long.withColumn("marked", F.col(x) >= mark).orderBy("series", x)


def notebook(title: str, cells: list[str], blobs: dict[str, bytes]) -> str:
    """A self-contained notebook as JSON text: blobs ride along in base64, a first cell restores them."""
    import base64
    import json

    packed = {name: base64.b64encode(data).decode() for name, data in blobs.items()}
    restore = f"import base64, pathlib\nfor name, data in {packed!r}.items():\n    pathlib.Path(name).write_bytes(base64.b64decode(data))\n"
    code = [{"cell_type": "code", "metadata": {}, "execution_count": None, "outputs": [], "source": c} for c in [restore, *cells]]
    head = {"cell_type": "markdown", "metadata": {}, "source": f"# {title}"}
    return json.dumps({"cells": [head, *code], "metadata": {}, "nbformat": 4, "nbformat_minor": 5}, ensure_ascii=False)


def notebooks(title: Column, cells: list[str], blobs: Column) -> Column:
    """A self-contained notebook for each row, as JSON text: its blobs (array of name, data) ride along in base64, a first cell restores them."""
    pairs = F.concat_ws(", ", F.transform(blobs, lambda b: F.concat(F.lit("'"), b["name"], F.lit("': '"), F.regexp_replace(F.base64(b["data"]), r"\s", ""), F.lit("'"))))
    head = "import base64, pathlib\nfor name, data in {"
    tail = "}.items():\n    pathlib.Path(name).write_bytes(base64.b64decode(data))\n"
    plain = lambda kind, source, rest: F.concat(F.lit(f'{{"cell_type":"{kind}","metadata":{{}},{rest}"source":'), F.to_json(F.array(source)), F.lit("}"))
    ran = '"execution_count":null,"outputs":[],'
    every = [plain("markdown", F.concat(F.lit("# "), title), ""), *(plain("code", c, ran) for c in (F.concat(F.lit(head), pairs, F.lit(tail)), *map(F.lit, cells)))]
    return F.concat(F.lit('{"cells":['), F.concat_ws(",", *every), F.lit('],"metadata":{},"nbformat":4,"nbformat_minor":5}'))
