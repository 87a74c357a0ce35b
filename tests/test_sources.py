import json
import urllib.parse

from pyspark.sql import functions as F

from stanzaflow import schemas
from stanzaflow.operators import lexicon as lx, selecting as sl
from stanzaflow.plans.sample import CONTROL, KEEP, SIGNAL
from stanzaflow.sources import files, sinks, web
from stanzaflow.streaming.scoring import score_stream, windowed_density


def ask(**params):
    return urllib.parse.urlencode(sorted(params.items()))


def test_jsonl_round_trip_and_merge(spark, tmp_path):
    path = f"{tmp_path}/rows"
    rows = spark.createDataFrame([("作", "a", 1), ("作", "b", 2)], "author string, title string, seq long")
    sinks.merge_jsonl(rows, path, "author string, title string", ["author", "title"], "seq")
    sinks.merge_jsonl(spark.createDataFrame([("作", "b", 9)], "author string, title string, seq long"), path, "author string, title string", ["author", "title"], "seq")
    got = files.read_jsonl(spark, path, "author string, title string, seq long").collect()
    assert sorted(map(tuple, got)) == [("作", "a", 1), ("作", "b", 9)]
    assert any("作" in p.read_text() for p in (tmp_path / "rows").glob("*.json"))
    assert files.first_existing(spark, [f"{tmp_path}/none", path]) == path
    sinks.write_jsonl(rows.select("title"), f"{tmp_path}/plain")
    assert files.read_jsonl(spark, f"{tmp_path}/plain", "title string").count() == 2


def test_malformed_lines_raise(spark, tmp_path):
    import pytest

    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a int").collect()


def test_lexicon_document(spark, tmp_path):
    entry = {"id": "x", "forms": ["ab", "abc"], "category": "c", "gloss_en": "g"}
    (tmp_path / "l.json").write_text(json.dumps({"lexicon": "l", "categories": {"c": "d"}, "entries": [entry, entry | {"id": "y", "forms": ["zzz"], "specificity": 0.4}]}, indent=1))
    got = lx.load(spark, f"{tmp_path}/l.json")
    assert [(e.id, e.specificity) for e in got.entries] == [("x", 1.0), ("y", 0.4)]
    assert [f for _, f, _ in got.ordered()] == ["abc", "zzz", "ab"]
    table = lx.form_table(lx.table(spark, got)).orderBy("ord").collect()
    assert [r.form for r in table] == ["abc", "zzz", "ab"]
    assert files.read_document(spark, f"{tmp_path}/l.json", schemas.LEXICON).first().categories == {"c": "d"}


def test_csv_and_exports(spark, tmp_path):
    (tmp_path / "m.csv").write_text("poet,birth,death\n甲,1800,\n")
    assert files.read_csv(spark, f"{tmp_path}/m.csv", "poet string, birth int, death int").first().death is None
    (tmp_path / "e.tsv").write_text("author\tyear\nx\t1895\n")
    (tmp_path / "e.jsonl").write_text('{"author": "x", "year": "1895"}\n')
    for name in ("e.tsv", "e.jsonl"):
        assert tuple(files.read_export(spark, f"{tmp_path}/{name}", ["author", "year"]).first()) == ("x", "1895")
    yearly = spark.createDataFrame([(1900, 0.0625), (1890, 2.0)], "year int, d double")
    sinks.write_csv(yearly, f"{tmp_path}/y", ["year"], ["d"])
    assert next((tmp_path / "y").glob("*.csv")).read_text().split() == ["year,d", "1890,2.000", "1900,0.062"]
    assert json.loads(sinks.summary(yearly.limit(1)).first().json)["year"] == 1900
    assert [r.marked for r in sinks.series(yearly, "year", ["d"], 1894).collect()] == [False, True]
    assert files.literal(spark, [(1,)], "a int").count() == 1
    assert json.loads(sinks.notebook("t", ["1"], {"a": b"x"}))["nbformat"] == 4


def test_web_sources_from_files(spark):
    J = {"format": "json"}
    more = {"action": "query", "prop": "links", "titles": "作者:甲", "plnamespace": 0, "pllimit": "max", **J}
    answers = {
        ask(action="parse", page="p", prop="wikitext", **J): {"parse": {"wikitext": {"*": "text"}}},
        ask(action="parse", page="作者:甲", prop="links", **J): {"parse": {"links": [{"ns": 0, "*": "a"}, {"ns": 4, "*": "no"}]}},
        ask(**more): {"query": {"pages": {"1": {"links": [{"title": "b"}]}}}, "continue": {"plcontinue": "c"}},
        ask(**more, plcontinue="c"): {"query": {"pages": {"1": {"links": [{"title": "a"}]}}}},
        ask(action="query", list="search", srsearch="甲", srlimit=50, **J): {"query": {"search": [{"title": "d（甲）"}, {"title": "e"}]}},
        ask(action="query", list="prefixsearch", pssearch="g/", pslimit=60, **J): {"query": {"prefixsearch": [{"title": "g/1"}]}},
        ask(title="t"): {"books": [{"title": "a t", "urn": "u"}]},
        ask(urn="u"): {"fulltext": ["one", 5], "subsections": ["u", {"urn": "v"}]},
        ask(urn="v"): {"text": ["two"]},
    }
    how = {"transport": "stanzaflow.sources.web.FileTransport", "answers": json.dumps(answers)}
    assert [tuple(r) for r in web.read(spark, "wiki_pages", ["p", "missing"], **how).collect()] == [("p", "text")]
    links = web.links(spark, ["甲"], prefix="作者:", **how).orderBy("seq").collect()
    assert [r.link for r in links] == ["a", "b", "a", "d（甲）"]
    assert web.read(spark, "wiki_prefix", ["g"], **how).first().page == "g/1"
    assert web.read(spark, "text_books", ["t"], **how).first().urn == "u"
    tree = web.read(spark, "text_tree", ["u"], **how).collect()
    assert sorted((r.urn, r.parent or "", r.passage or "") for r in tree) == [("u", "", "one"), ("v", "", "two"), ("v", "u", "")]


def test_streamed_scores_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, "thering and the nation" * i) for i in range(6)], "id int, t string").withColumn("ts", F.timestamp_seconds(F.col("id") * 3600))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    scored = score_stream(stream, "t", SIGNAL, CONTROL, 0.8, keep=KEEP)
    q = scored.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = score_stream(rows, "t", SIGNAL, CONTROL, 0.8, keep=KEEP)
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(str, batch.collect()))
    windows = windowed_density(batch, "ts", "2 hours", "1 hour").collect()
    assert sorted(r.units for r in windows) == [2, 2, 2]


def test_an_interrupted_merge_loses_nothing(spark, tmp_path):
    path, schema = f"{tmp_path}/rows", "k int, v string"
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], f"{schema}, seq long")
    sinks.merge_jsonl(rows, path, schema, ["k"], "seq")
    (tmp_path / "rows").rename(tmp_path / "rows.before")  # stopped between the two renamings
    sinks.merge_jsonl(spark.createDataFrame([(2, "B", 3)], f"{schema}, seq long"), f"{path}/", schema, ["k"], "seq")
    assert sorted(map(tuple, files.read_jsonl(spark, path, schema).collect())) == [(1, "a"), (2, "B")]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["rows"]


def test_keyed_csv_and_lookups_take_the_last_row(spark, tmp_path):
    (tmp_path / "m.csv").write_text("poet,birth\n甲,1800\n乙,1810\n甲,1801\n")
    meta = files.read_csv(spark, f"{tmp_path}/m.csv", "poet string, birth int", "poet")
    assert sorted(map(tuple, meta.collect())) == [("乙", 1810), ("甲", 1801)]
    left = spark.createDataFrame([("甲",), ("甲",), ("丙",), (None,)], "poet string")
    twice = spark.createDataFrame([("甲", 1800, 2), ("甲", 1801, 1), (None, 7, 1)], "poet string, birth int, seq int")
    got = sl.lookup(left, twice, "poet", {"birth": 0}, "seq").collect()
    assert sorted((r.poet or "", r.birth) for r in got) == [("", 0), ("丙", 0), ("甲", 1800), ("甲", 1800)]
    assert {r.birth for r in sl.lookup(left, twice.drop("seq"), "poet", {"birth": 0}).filter("poet = '甲'").collect()} == {1801}


def test_books_by_query_and_trees_of_many_children(spark):
    books = spark.createDataFrame([("x", 0, "abc"), ("x", 1, "a x"), ("y", 0, "abc"), ("y", 1, None), ("z", 0, None)], "query string, pos int, title string")
    assert {r["query"]: r.title for r in sl.best_titles(books).collect()} == {"x": "a x", "y": "abc", "z": None}
    assert sl.best_title(books.filter("query = 'x'").drop("query"), "bc").first().title == "abc"
    edges = spark.createDataFrame([("a", "r", 5), ("b", "r", 999_999), ("c", "r", 1_000_000), ("d", "r", 12_345_678), ("e", "a", 0)], "urn string, parent string, pos long")
    assert [r.urn for r in sl.tree_walk(edges, "r").orderBy("path").collect()] == ["r", "a", "e", "b", "c", "d"]


def test_a_small_table_is_dealt_over_all_cores(spark, tmp_path, monkeypatch):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    assert files.spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and files.spread(rows).count() == 100
    monkeypatch.setattr(files, "SMALL", 10)
    assert files.spread(rows).rdd.getNumPartitions() == 1
