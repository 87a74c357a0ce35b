import pytest
from pyspark.sql import functions as F

from stanzaflow.operators import segmenting as sg, tables

HEAD = "甲申（光緒一八八四）"
PAGES = [
    (1, f"序{HEAD}春江潮水連，海上明月共。春江潮水連，海上明月共。光緒『一二三四五六七八九十天地玄黃』終 乙未（光緒十年）無年甲午（光緒 一八九四 ）尾"),
    (2, "『一二三四五六七八九十天地玄黃』前康熙『一二三四五六七八九十乾隆天地』後『短』"),
    (3, None), (4, ""), (5, "\x1c，𠀀𠀀 　，春江潮水連。海上明月共。灩灩隨波千。何處春江無。也也也也也。"), (2, "甲申（民國一九一二）再"),
]


@pytest.fixture(scope="module")
def pages(spark):
    tables.register(spark)
    df = spark.createDataFrame(PAGES, "doc_id long, text string").withColumn("extra", F.lit("x"))
    df.createOrReplaceTempView("udtf_pages")
    return df


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_sections_are_those_of_the_dataframe(spark, pages):
    want = sg.dated_sections(pages, "doc_id", "text")
    got = spark.sql("SELECT * FROM dated_sections(TABLE(udtf_pages), key => array('doc_id'))")
    assert got.columns == want.columns and rows(got) == rows(want) and len(rows(want)) >= 2


def test_quotes_are_those_of_the_asof_join(spark, pages):
    single = pages.filter("doc_id <> 2 OR text LIKE '『%'")
    single.createOrReplaceTempView("udtf_single")
    quotes = sg.quoted_spans(single, ["doc_id"], "text")
    marks = sg.marker_scan(single, ["doc_id"], "text").withColumnRenamed("pos", "offset")
    want = sg.asof_backward(quotes, marks, ["doc_id"], "offset", ["marker", "year"])
    got = spark.sql("SELECT doc_id, offset, text, n_chars, marker, year FROM dated_quotes(TABLE(udtf_single))")
    assert rows(got) == rows(want.select(got.columns))
    assert {(r.doc_id, r.marker, r.year) for r in got.collect()} == {(1, "光緒", 1888), (2, None, None), (2, "康熙", 1700)}


def test_verses_are_those_of_the_dataframe(spark, pages):
    unique = pages.filter("doc_id <> 2")
    unique.createOrReplaceTempView("udtf_unique")
    for setting in ("", ", least => 2, most => 3, lengths => array(5), per_line => 0.5"):
        how = {} if not setting else {"least": 2, "most": 3, "lengths": (5,), "per_line": 0.5}
        want = sg.verses(unique, ["doc_id"], "text", **how)
        got = spark.sql(f"SELECT doc_id, start, n, lines, text FROM verses(TABLE(udtf_unique){setting})")
        assert rows(got) == rows(want.select(got.columns)), setting
    assert spark.sql("SELECT * FROM verses(TABLE(udtf_unique))").columns == ["doc_id", "extra", "start", "n", "lines", "text"]


def test_nothing_is_shuffled_and_only_named_columns_are_read(spark, pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/p")
    spark.read.parquet(f"{tmp_path}/p").createOrReplaceTempView("udtf_stored")
    plan = spark.sql("SELECT * FROM dated_sections(TABLE(udtf_stored), key => array('doc_id'))")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "extra" not in plan


def test_empty_table_repeats_and_errors(spark, pages):
    pages.limit(0).createOrReplaceTempView("udtf_none")
    for name in tables.FUNCTIONS:
        assert spark.sql(f"SELECT * FROM {name}(TABLE(udtf_none))").count() == 0
    pages.union(pages).createOrReplaceTempView("udtf_twice")
    once = spark.sql("SELECT * FROM dated_sections(TABLE(udtf_pages))").count()
    assert spark.sql("SELECT * FROM dated_sections(TABLE(udtf_twice))").count() == 2 * once
    pages.withColumn("year", F.lit(1)).createOrReplaceTempView("udtf_clash")
    for call, says in [
        ("dated_sections(TABLE(udtf_clash))", "own"),
        ("dated_sections(TABLE(udtf_pages), text => 'body')", "no column body"),
        ("verses(TABLE(udtf_pages), depth => 3)", "no setting"),
        ("verses(1)", "is a table"),
    ]:
        with pytest.raises(Exception, match=says):
            spark.sql(f"SELECT * FROM {call}").collect()
    kept = spark.sql("SELECT * FROM dated_sections(TABLE(udtf_clash), key => array('doc_id'))")
    assert kept.count() == once
