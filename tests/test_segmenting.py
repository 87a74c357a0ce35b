from pyspark.sql import functions as F

from stanzaflow.operators import segmenting as sg, selecting as sl


def test_positions_and_backward_asof(spark):
    rows = [(1, "x乾隆『一二三四五六七八九十一二』甲午『ab』『一二三四五六七八九十丙午』尾"), (2, "『一二三四五六七八九十百千』"), (3, None)]
    df = spark.createDataFrame(rows, "v int, t string")
    quotes = sg.quoted_spans(df, ["v"], "t")
    marks = sg.marker_scan(df, ["v"], "t")
    assert sorted((r.v, r.pos, r.year) for r in marks.collect()) == [(1, 1, 1760), (1, 17, 1894), (1, 34, 1906)]
    got = sg.asof_backward(quotes.withColumnRenamed("offset", "pos"), marks, ["v"], "pos", ["marker", "year"])
    assert sorted((r.v, r.pos, r.n_chars, r.year) for r in got.collect()) == [(1, 3, 12, 1760), (1, 23, 12, 1894), (2, 0, 12, None)]


def test_asof_fixture_with_ties(spark):
    left = spark.createDataFrame([(1, 20), (1, 35), (2, 5), (1, 30)], "v int, p int")
    right = spark.createDataFrame([(1, 10, 1700), (1, 30, 1894)], "v int, p int, y int")
    got = sg.asof_backward(left, right, ["v"], "p", ["y"]).collect()
    assert sorted((r.v, r.p, r.y) for r in got) == [(1, 20, 1700), (1, 30, 1894), (1, 35, 1894), (2, 5, None)]


def test_dated_sections_and_front_matter(spark):
    head = "乙未（光緒二十一年，一八九五）"
    text = f"甲子（同治三年，一八{'x'}四）序{head}詩一\n丙申（光緒，一八九六）詩二\n甲午（光緒，一八九四）詩三{head}詩四"
    pages = spark.createDataFrame([("p", text)], "p string, t string")
    got = sg.dated_sections(pages, "p", "t").orderBy("offset").collect()
    assert [(r.year, r.text) for r in got] == [(1895, "詩一\n"), (1896, "詩二\n"), (1894, "詩三"), (1895, "詩四")]
    assert got[0].ganzhi == "乙未" and got[0].year_raw == head and all(text[r.offset :].startswith(r.text) for r in got)
    kept = sg.cut_front_matter(sg.dated_sections(pages, "p", "t"), "p")
    assert sorted(r.text for r in kept.collect()) == ["詩三", "詩四"]


def lines(n, size, char="天"):
    return "，".join([char * size] * n)


def test_verse_runs(spark):
    rows = [
        (1, lines(4, 7) + "。一二三"), (2, lines(3, 5)), (3, lines(24, 5)), (4, lines(25, 5)), (5, lines(4, 5) + "！" + lines(5, 7)),
        (6, "天天天天也，" + lines(3, 5)), (7, "天天天天也，" + lines(4, 5)), (8, lines(4, 6)), (9, None), (10, "　，，"),
    ]
    got = sg.verses(spark.createDataFrame(rows, "id int, t string"), ["id"], "t").collect()
    assert sorted((r.id, r.n, r.lines) for r in got) == [(1, 7, 4), (3, 5, 24), (5, 5, 4), (5, 7, 5), (7, 5, 5)]
    assert {r.id: r.text for r in got}[1] == "天" * 28


def test_joined_passages(spark):
    df = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("v", 1, "c")], "u string, o int, t string")
    assert sorted(map(tuple, sg.joined_passages(df, ["u"], "o", "t").collect())) == [("u", "a\nb"), ("v", "c")]


def test_selection(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("m", 2, "b"), ("k", 3, "c")], "k string, seq int, v string")
    assert sorted((r.k, r.v, r.place) for r in sl.last_wins(df, ["k"], "seq").collect()) == [("k", "c", 1), ("m", "b", 2)]
    new = spark.createDataFrame([("m", 1, "x"), ("n", 2, "y")], "k string, seq int, v string")
    assert sorted((r.k, r.v) for r in sl.upsert(df, new, ["k"], "seq").collect()) == [("k", "c"), ("m", "x"), ("n", "y")]
    titles = spark.createDataFrame([("作者:x", 0), ("b", 1), ("a", 2), ("b", 3)], "t string, seq int")
    assert sorted(map(tuple, sl.ordered_distinct(titles, "t", "seq").collect())) == [("a", 2), ("b", 1)]
    books = spark.createDataFrame([(0, "other", "u0"), (1, "my text", "u1")], "pos int, title string, urn string")
    assert sl.best_title(books, "text").first().urn == "u1" and sl.best_title(books, "none").first().urn == "u0"
    bands = spark.range(5).filter(sl.length_band(F.col("id"), 1, 3)).count(), spark.range(5).filter(sl.length_band(F.col("id"))).count()
    assert bands == (3, 5)
