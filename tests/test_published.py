import pytest
from pyspark.sql import functions as F

from stanzaflow.sources import published as pb

SCHEMA = "author string, n long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def some(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def test_versions_appends_and_old_readers(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        pb.read(spark, path, SCHEMA)
    pb.write_jsonl(some(spark, ("作", 1), ('a "b"\n,c', None)).repartition(3), path)
    first = pb.read(spark, path, SCHEMA)
    pb.write_jsonl(some(spark, ("z", 2)), path, append=True)
    assert rows(pb.read(spark, path, SCHEMA)) == [('a "b"\n,c', None), ("z", 2), ("作", 1)]
    pb.write_jsonl(some(spark, ("new", 3)), path)
    assert rows(pb.read(spark, path, SCHEMA)) == [("new", 3)]
    assert rows(first) == rows(pb.read(spark, path, SCHEMA, version=1)) == [('a "b"\n,c', None), ("作", 1)]
    assert pb.versions(path) == [1, 2, 3] and pb.manifest(path)["files"][0][1] == 1
    pb.write_jsonl(some(spark).limit(0), path)
    assert pb.read(spark, path, SCHEMA).count() == 0 and pb.manifest(path)["files"] == []


def test_a_failed_task_leaves_the_version_that_stood(spark, tmp_path):
    path = str(tmp_path / "t")
    pb.write_jsonl(some(spark, ("a", 1)), path)
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("torn"))).otherwise("x").alias("author"), F.col("id").alias("n"))
    with pytest.raises(Exception, match="torn"):
        pb.write_jsonl(bad, path)
    assert rows(pb.read(spark, path, SCHEMA)) == [("a", 1)] and pb.versions(path) == [1]
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_what_a_stopped_driver_leaves_is_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    pb.write_jsonl(some(spark, ("a", 1)), path)
    run = pb.manifest(path)["run"]
    for at in (f"data/{run}/part-000000-torn.json", "data/dead/part-000000-x.json", "versions/_dead"):
        (tmp_path / "t" / at).parent.mkdir(exist_ok=True)
        (tmp_path / "t" / at).write_text('{"author": "to')
    assert rows(pb.read(spark, path, SCHEMA)) == [("a", 1)]
    pb.write_jsonl(some(spark, ("b", 2)), path)
    pb.write_jsonl(some(spark, ("c", 3)), path)
    assert pb.vacuum(path) == 0 and pb.versions(path) == [2, 3]
    assert pb.vacuum(path, keep=1, idle=-1) == 3 and pb.versions(path) == [3]
    assert rows(pb.read(spark, path, SCHEMA)) == [("c", 3)]


def test_a_second_attempt_of_a_task_counts_once(spark, tmp_path):
    writer = pb._Writer({"path": str(tmp_path), "run": "r", "suffix": ".json"})
    for name in ("r/part-0-first.json", "r/part-0-second.json"):
        (tmp_path / "data" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "data" / name).write_text('{"author":"a"}\n')
    writer.commit([pb.Part(0, "r/part-0-second.json", 1, 15), pb.Part(1, "", 0, 0), None])
    assert rows(pb.read(spark, str(tmp_path), SCHEMA)) == [("a", None)]
    with pytest.raises(RuntimeError, match="wrote"):
        writer.commit([pb.Part(0, "r/part-0-second.json", 1, 14)])


def test_merges_follow_what_they_read(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda a, n, s: spark.createDataFrame([(a, n, s)], f"{SCHEMA}, seq long")
    pb.merge_jsonl(row("a", 1, 1).union(row("b", 1, 2)), path, SCHEMA, ["author"], "seq")
    pb.merge_jsonl(row("b", 7, 1), path, SCHEMA, ["author"], "seq")
    assert rows(pb.read(spark, path, SCHEMA)) == [("a", 1), ("b", 7)]
    with pytest.raises(Exception, match="came after version 1"):
        pb.write_jsonl(some(spark, ("late", 1)), path, follows=1)
    assert pb.versions(path) == [1, 2] and rows(pb.read(spark, path, SCHEMA)) == [("a", 1), ("b", 7)]


def test_csv_in_order(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(3, 'x,"y"', 1e9), (1, None, float("nan")), (2, "", -0.0625)], "year int, name string, d double")
    pb.write_csv(df, path, ["year"], ["d"])
    text = "".join((tmp_path / "t" / "data" / f[0]).read_text() for f in pb.manifest(path)["files"])
    assert [line for line in text.split("\n") if line and line != "year,name,d"] == ["1,,nan", '2,"",-0.062', '3,"x,\\"y\\"",1000000000.000']
    assert rows(pb.read(spark, path, "year int, name string, d string")) == [(1, None, "nan"), (2, None, "-0.062"), (3, 'x,"y"', "1000000000.000")]
