"""More of the catalog: sources and sinks as round trips, and the remaining operators.

Round trips write below spark.checkpoint.dir, or a folder of their own where the master is local.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stanzaflow import schemas
from stanzaflow.functions import text as tx
from stanzaflow.operators import density as dn, inference, lexicon as lx, matching as mt, probe, segmenting as sg, selecting as sl
from stanzaflow.plans import analyses
from stanzaflow.plans.catalog import _MID, _RUP, long, query, r6, scored, table, units
from stanzaflow.plans.catalog_more import _HEADER, _NUMERALS, _SECTIONS, _contains
from stanzaflow.plans.sample import CONTROL, KEEP, SIGNAL, UNITS, Sql, scored as scored_sql
from stanzaflow.sources import answers as web, files, sinks
from stanzaflow.sources.scratch import new_path
from stanzaflow.streaming import upserts
from stanzaflow.streaming.scoring import score_stream, windowed_density


# ---- files --------------------------------------------------------------------------------------------


@query("io_jsonl", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(spark, d):
    path = new_path(spark)
    sinks.write_jsonl(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), path)
    return files.read_jsonl(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")


@query(
    "io_document",
    """WITH e AS (SELECT p_brand, list(p_name ORDER BY p_partkey) AS forms, count(*) AS n FROM part GROUP BY p_brand)
SELECT (row_number() OVER (ORDER BY p_brand) - 1)::INTEGER AS entry_pos, p_brand AS id, left(p_brand, 7) AS category, round(1 / n, 6) AS specificity, n::INTEGER AS forms FROM e""",
)
def _(spark, d):
    """A lexicon document made of a table, one entry a brand, written as one JSON object and read back."""
    path = new_path(spark)
    parts = F.array_sort(F.collect_list(F.struct("p_partkey", "p_name")))
    entries = table(spark, d, "part").groupBy("p_brand").agg(F.transform(parts, lambda p: p["p_name"]).alias("forms"))
    entry = F.struct(
        F.col("p_brand").alias("id"), "forms", F.substring("p_brand", 1, 7).alias("category"), F.round(1 / F.size("forms"), 6).alias("specificity")
    )
    document = entries.agg(F.array_sort(F.collect_list(entry)).alias("entries")).select(F.lit("brands").alias("lexicon"), F.lit("1").alias("version"), "entries")
    document.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.text(path)  # a lexicon is one document
    read = lx.entries_table(files.read_document(spark, path, schemas.LEXICON))
    return read.select("entry_pos", "id", "category", "specificity", F.size("forms").alias("forms"))


@query("io_csv_last_wins", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def _(spark, d):
    path = new_path(spark)
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role").orderBy("turn").coalesce(1)
    rows.write.option("header", True).csv(path)
    return files.read_csv(spark, path, "conv_id long, turn long, role string", "conv_id")


@query("io_export_tsv", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def _(spark, d):
    path = new_path(spark)
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).option("sep", "\t").csv(path)
    return files.read_export(spark, path, ["n_nationkey", "n_name", "n_regionkey"])


@query(
    "io_merge_jsonl",
    "SELECT n_nationkey, CASE WHEN n_nationkey >= 10 THEN n_name || '!' ELSE n_name END AS n_name FROM nation",
)
def _(spark, d):
    path, schema = new_path(spark), "n_nationkey int, n_name string"
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_nationkey").cast("long").alias("seq"))
    sinks.merge_jsonl(rows.filter("n_nationkey < 15"), path, schema, ["n_nationkey"], "seq")
    sinks.merge_jsonl(rows.filter("n_nationkey >= 10").withColumn("n_name", F.concat("n_name", F.lit("!"))), path, schema, ["n_nationkey"], "seq")
    return files.read_jsonl(spark, path, schema)


@query("io_csv_decimals", "SELECT c_custkey, printf('%.3f', c_acctbal / 7) AS balance FROM customer")
def _(spark, d):
    path = new_path(spark)
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal").cast("double") / 7).alias("balance"))
    sinks.write_csv(rows, path, ["c_custkey"], ["balance"])
    return files.read_csv(spark, path, "c_custkey long, balance string")


@query(
    "io_summary",
    """SELECT '{"orders":' || count(*) || ',"customers":' || count(DISTINCT o_custkey) || ',"first":"' || min(o_orderstatus) || '"}' AS json FROM orders""",
)
def _(spark, d):
    orders = table(spark, d, "orders")
    return sinks.summary(orders.agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.min("o_orderstatus").alias("first")))


@query(
    "io_series",
    """SELECT year, series, y, year >= 1894 AS marked FROM (
  SELECT 1600 + n_nationkey * 14 AS year, n_regionkey::DOUBLE AS region, n_nationkey::DOUBLE AS nation FROM nation) UNPIVOT (y FOR series IN (region, nation))""",
)
def _(spark, d):
    rows = table(spark, d, "nation").select(
        (1600 + F.col("n_nationkey") * 14).alias("year"), F.col("n_regionkey").cast("double").alias("region"), F.col("n_nationkey").cast("double").alias("nation")
    )
    return sinks.series(rows, "year", ["region", "nation"], 1894)


@query("io_notebook", "SELECT doc_id, base64(encode(coalesce(text, ''))) AS packed, 3::INTEGER AS cells FROM documents")
def _(spark, d):
    """A notebook for each document, which carries its text, read back from its first cell."""
    blobs = F.array(F.struct(F.concat("doc_id", F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("data")))
    books = table(spark, d, "documents").select("doc_id", sinks.notebooks(F.concat(F.lit("Document "), "doc_id"), ["print(1)"], blobs).alias("book"))
    cells = F.from_json("book", "cells array<struct<cell_type: string, source: array<string>>>")["cells"]
    packed = F.regexp_extract(F.get(F.get(cells, F.lit(1))["source"], F.lit(0)), "txt.: .([A-Za-z0-9+/=]*)", 1)
    return books.select("doc_id", packed.alias("packed"), F.size(cells).alias("cells"))


@query("io_presence", "SELECT TRUE AS there, FALSE AS missing, 'orders' AS first, count(*)::BIGINT AS rows FROM orders")
def _(spark, d):
    first = files.first_existing(spark, [f"{d}/none.parquet", f"{d}/orders.parquet", f"{d}/region.parquet"])
    found = [files.exists(spark, f"{d}/{name}") for name in ("region.parquet", "none")]
    name = first.rsplit("/", 1)[1].removesuffix(".parquet")
    return spark.read.parquet(first).agg(F.lit(found[0]).alias("there"), F.lit(found[1]).alias("missing"), F.lit(name).alias("first"), F.count(F.lit(1)).alias("rows"))


# ---- web interfaces, answered from the tables ---------------------------------------------------------

_J = {"format": "json"}


def _nations(spark, d) -> DataFrame:
    return table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))


def _grouped_titles(rows: DataFrame, by: str, value: Column, of: str = "list") -> DataFrame:
    """by, list: what is made of rows, in the order of nations."""
    held = F.array_sort(F.collect_list(F.struct("n_nationkey", value.alias("v"))))
    return rows.groupBy(by).agg(F.transform(held, lambda x: x["v"]).alias(of))


@query("web_pages", "SELECT n_name AS title, '[[' || n_name || ']]' AS wikitext FROM nation WHERE n_nationkey % 5 <> 0")
def _(spark, d):
    rows = table(spark, d, "nation")
    text = F.to_json(F.struct(F.struct(F.struct(F.format_string("[[%s]]", "n_name").alias("*")).alias("wikitext")).alias("parse")))
    known = rows.filter("n_nationkey % 5 <> 0").select(web.asked(action="parse", page=F.col("n_name"), prop="wikitext", **_J).alias("asked"), text.alias("answer"))
    found = web.pages(rows.select(F.col("n_name").alias("title")), web.from_table(known))
    return found.filter("wikitext IS NOT NULL").select("title", "wikitext")


@query("fetched_texts", "SELECT doc_id::VARCHAR AS title, md5(text) AS digest FROM documents WHERE doc_id % 3 <> 0 AND text IS NOT NULL")
def _(spark, d):
    """Every document as a page of its number; a third of them are missing."""
    docs = table(spark, d, "documents")
    text = F.to_json(F.struct(F.struct(F.struct(F.col("text").alias("*")).alias("wikitext")).alias("parse")))
    known = docs.filter("doc_id % 3 <> 0").select(web.asked(action="parse", page=F.col("doc_id"), prop="wikitext", **_J).alias("asked"), text.alias("answer"))
    found = web.pages(docs.select(F.col("doc_id").cast("string").alias("title")), web.from_table(known))
    return found.filter("wikitext IS NOT NULL").select("title", F.md5("wikitext").alias("digest"))


@query(
    "web_links",
    """WITH l AS (SELECT r_name AS title, n_name AS link, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 3)
SELECT title, (row_number() OVER (PARTITION BY title ORDER BY k % 4, k) - 1)::INTEGER AS seq, link FROM l""",
)
def _(spark, d):
    """Expanded links, two pages of further links, then search hits that name the page in brackets."""
    rows, titled = _nations(spark, d), F.struct(F.col("n_name").alias("title"))
    key = F.col("n_nationkey") % 4
    query_ = {"action": "query", "prop": "links", "plnamespace": 0, "pllimit": "max", **_J}
    title = F.col("r_name")

    def answers(part: DataFrame, question: Column, answer: Column) -> DataFrame:
        return part.select(question.alias("asked"), F.to_json(F.struct(answer)).alias("answer"))

    shown = _grouped_titles(rows.filter(key.isin(0, 3)), "r_name", F.struct(F.when(key == 0, 0).otherwise(4).alias("ns"), F.col("n_name").alias("*")))
    first, second, hits = (_grouped_titles(rows.filter(key == k), "r_name", titled) for k in (1, 2, 3))
    page = lambda: F.struct(F.create_map(F.lit("1"), F.struct(F.col("list").alias("links"))).alias("pages")).alias("query")
    every = table(spark, d, "region").select("r_name")
    one = every.join(first, "r_name", "left").select(
        web.asked(titles=title, **query_).alias("asked"),
        F.to_json(F.struct(page(), F.struct(F.lit("2").alias("plcontinue"), F.lit("||").alias("continue")).alias("continue"))).alias("answer"),
    )
    known = answers(shown, web.asked(action="parse", page=title, prop="links", **_J), F.struct(F.col("list").alias("links")).alias("parse")).union(one)
    known = known.union(answers(second, web.asked(titles=title, plcontinue="2", **query_), page()))
    known = known.union(answers(hits, web.asked(action="query", list="search", srsearch=title, srlimit=50, **_J), F.struct(F.col("list").alias("search")).alias("query")))
    found = web.links(every.select(title.alias("title")), web.from_table(known))
    place = sl.placed(found, ["title"], ["step", "page", "pos"], "seq")
    return place.select("title", "seq", "link")


@query("web_prefix", "SELECT r_name AS title, (row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1)::INTEGER AS seq, r_name || '/' || n_name AS page FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    lists = _grouped_titles(_nations(spark, d), "r_name", F.struct(F.concat_ws("/", "r_name", "n_name").alias("title")))
    question = web.asked(action="query", list="prefixsearch", pssearch=F.concat("r_name", F.lit("/")), pslimit=60, **_J)
    known = lists.select(question.alias("asked"), F.to_json(F.struct(F.struct(F.col("list").alias("prefixsearch")).alias("query"))).alias("answer"))
    return web.prefixed(table(spark, d, "region").select(F.col("r_name").alias("title")), web.from_table(known))


@query(
    "web_books",
    """SELECT q AS query, title FROM (SELECT left(r_name, 2) AS q, n_name AS title, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
QUALIFY row_number() OVER (PARTITION BY q ORDER BY contains(title, q) DESC, n_nationkey) = 1""",
)
def _(spark, d):
    """Of each query's books the first whose title contains the query, else the first; a query is a region's first two letters."""
    rows = _nations(spark, d).withColumn("q", F.left("r_name", F.lit(2)))
    lists = _grouped_titles(rows, "q", F.struct(F.col("n_name").alias("title"), F.col("n_nationkey").cast("string").alias("urn")))
    known = lists.select(web.asked(title=F.col("q")).alias("asked"), F.to_json(F.struct(F.col("list").alias("books"))).alias("answer"))
    return sl.best_titles(web.books(lists.select(F.col("q").alias("query")), web.from_table(known))).select("query", "title")


@query("web_passages", "SELECT 'n' || n_regionkey AS urn, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def _(spark, d):
    """A work's tree by level, with values that are no text left out, and the passages of each node joined."""
    rows = table(spark, d, "nation").withColumn("urn", F.concat(F.lit("n"), "n_regionkey"))
    texts = _grouped_titles(rows, "urn", F.to_json(F.array("n_name")))
    mixed = F.concat_ws(",5,", F.transform("list", lambda t: F.substring(t, F.lit(2), F.length(t) - 2)))  # a number behind each text
    known = texts.select(web.asked(urn=F.col("urn")).alias("asked"), F.concat(F.lit('{"fulltext":['), mixed, F.lit(',5]}')).alias("answer"))
    children = rows.agg(F.sort_array(F.collect_set("urn")).alias("c"))
    top = F.concat(F.lit('{"subsections":["root",'), F.concat_ws(",", F.transform("c", lambda u: F.to_json(F.struct(u.alias("urn"))))), F.lit("]}"))
    known = known.union(children.select(web.asked(urn="root").alias("asked"), top.alias("answer")))
    _, passages = web.tree(spark.range(1).select(F.lit("root").alias("root")), web.from_table(known))
    return sg.joined_passages(passages.withColumnRenamed("passage", "text"), ["urn"], "pos", "text").select("urn", "text")


# ---- selection, segmentation and scores that no other query holds ------------------------------------------


@query("length_band", "SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE length(text) BETWEEN 100 AND 2000")
def _(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").filter(sl.length_band(n, 100, 2000)).select("doc_id", long(n).alias("n"))


@query(
    "lookup_last_wins",
    """WITH m AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(priority, 'none') AS priority FROM customer LEFT JOIN m ON c_custkey = o_custkey""",
)
def _(spark, d):
    meta = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("priority"), "o_orderkey")
    return sl.lookup(table(spark, d, "customer").select("c_custkey"), meta, "c_custkey", {"priority": "none"}, "o_orderkey").select("c_custkey", "priority")


@query(
    "truthy_years",
    f"""WITH {scored_sql()}, z AS (SELECT CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN 0 ELSE year END AS year, w, n FROM scored)
SELECT year, count(*)::BIGINT AS n FROM z WHERE year IS NOT NULL AND year <> 0 GROUP BY year""",
)
def _(spark, d):
    year = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 7 == 1, 0).otherwise(F.col("year"))
    return analyses.curve(scored(spark, d).withColumn("year", year)).select("year", "n")


_DATED = f"""WITH {_SECTIONS}, y AS (SELECT *, min(year) OVER (PARTITION BY doc_id) AS least FROM sec), b AS (
  SELECT *, min("offset") FILTER (year = least) OVER (PARTITION BY doc_id) AS begin FROM y)
SELECT doc_id, "offset", year, md5(body) AS digest FROM b WHERE "offset" >= begin AND year BETWEEN 1600 AND 7950"""


@query("dated_within", _DATED)
def _(spark, d):
    """Page to dated section: cut, years, front matter, then the bounds."""
    kept = sg.dated_within(table(spark, d, "documents"), "doc_id", "text", 1600, 7950, header=_HEADER, numerals=_NUMERALS, digits="0123456789")
    return kept.select("doc_id", long("offset").alias("offset"), "year", F.md5("text").alias("digest"))


_ALL = Sql("m", "u", SIGNAL, "s")


@query(
    "entry_counts",
    f"""WITH {UNITS}, {_ALL.ctes} SELECT doc_id, entry_id, n::INTEGER AS n FROM ("""
    + " UNION ALL ".join(f"SELECT doc_id, '{e.id}' AS entry_id, {_ALL.of(e.id)} AS n FROM m" for e in SIGNAL.entries)
    + ") WHERE n > 0",
)
def _(spark, d):
    """The fold's map of counts by entry."""
    hits = mt.fold(tx.normalise(F.col("text"), KEEP), SIGNAL)
    return units(spark, d).select("doc_id", F.explode(mt.counts(hits)).alias("entry_id", "n"))


def _first_hits(sql: Sql) -> str:
    """Entries in the order of their first form that hit, joined."""
    first = ", ".join(f"CASE WHEN {sql.tag}_h{i} > 0 THEN {{'k': {i}, 'e': '{e.id}'}} END" for i, _, e in sql.lexicon.ordered())
    return f"""(SELECT string_agg(e, ';' ORDER BY k) FROM (SELECT x.e AS e, min(x.k) AS k FROM (SELECT unnest([{first}]) AS x) WHERE x IS NOT NULL GROUP BY 1))"""


_H = Sql("m", "u", SIGNAL.keep(0.8), "s")


@query(
    "yearly_rows",
    f"""WITH {scored_sql()} SELECT s.source AS author, s.year, s.n::INTEGER AS n_chars, printf('%.3f', coalesce(100 * s.w / nullif(s.n, 0), 0)) AS loyalist_density100,
  printf('%.3f', coalesce(100.0::DOUBLE * s.ct / nullif(s.n, 0), 0)) AS control_density100, coalesce({_first_hits(_H)}, '') AS loyalist_entries
FROM scored s JOIN m USING (doc_id)""",
)
def _(spark, d):
    return analyses.yearly(scored(spark, d), "source")


@query(
    "label_groups",
    """SELECT (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT source AS s FROM documents GROUP BY source HAVING arg_max(lang, doc_id) = 'en')) AS "group",
  (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT source AS s FROM documents GROUP BY source HAVING arg_max(lang, doc_id) IN ('de', 'fr'))) AS others""",
)
def _(spark, d):
    """Authors of two label sets, sorted and distinct."""
    authors = table(spark, d, "documents").groupBy("source").agg(F.max_by("lang", "doc_id").alias("label"))
    groups = analyses.label_groups(authors, "source", {"group": {"en"}, "others": {"de", "fr"}})
    return groups.select(*[F.array_join(c, ",").alias(c) for c in groups.columns])


@query("offset_range", f"""WITH {_SECTIONS} SELECT doc_id, min("offset") AS first, max("offset") AS last, min(year) AS low, max(year) AS high FROM sec GROUP BY doc_id""")
def _(spark, d):
    sections = sg.dated_sections(table(spark, d, "documents"), "doc_id", "text", _HEADER, _NUMERALS, "0123456789")
    return sections.groupBy("doc_id").agg(
        long(F.min("offset")).alias("first"), long(F.max("offset")).alias("last"), F.min("year").alias("low"), F.max("year").alias("high")
    )


@query("null_statistics", "SELECT round(avg(o_totalprice), 6) AS null_mean, round(stddev_pop(o_totalprice), 6) AS null_std, round(avg((o_totalprice >= 100000)::INTEGER), 6) AS p FROM orders")
def _(spark, d):
    """Mean, population deviation and reached share of replicates, which prices stand for here."""
    out = probe.null_statistics(table(spark, d, "orders").select(F.col("o_totalprice").alias("accuracy")), F.lit(100000))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(
    "interval_verdict",
    """WITH q AS (SELECT o_orderstatus AS status, quantile_cont(o_totalprice - 150000, 0.025) AS lo, quantile_cont(o_totalprice - 400000, 0.975) AS hi FROM orders GROUP BY ALL)
SELECT status, CASE WHEN lo <= 0 AND hi >= 0 THEN 'AGREE' ELSE 'differ' END AS verdict FROM q""",
)
def _(spark, d):
    price = F.col("o_totalprice")
    q = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.percentile(price - 150000, F.lit(0.025)).alias("lo"), F.percentile(price - 400000, F.lit(0.975)).alias("hi")
    )
    return q.select("status", dn.verdict(F.col("lo"), F.col("hi")).alias("verdict"))


def _codes():
    """An encoder whose token vectors are a character's code and its square, of at most 64 characters."""
    import numpy as np

    def run(texts: list[str]):
        codes = np.zeros((len(texts), 64))
        mask = np.zeros((len(texts), 64))
        for i, t in enumerate(texts):
            own = [ord(c) for c in t[:64]]
            codes[i, : len(own)], mask[i, : len(own)] = own, 1
        return np.stack([codes, codes**2], 2), mask

    return run


@query(
    "embed_texts",
    """WITH c AS (SELECT doc_id, list_transform(string_split(left(coalesce(text, ''), 64), ''), lambda x: unicode(x)) AS c FROM documents)
SELECT doc_id, round(coalesce(list_avg(list_filter(c, lambda x: x > 0)), 0), 6) AS first, round(coalesce(list_avg(list_transform(list_filter(c, lambda x: x > 0), lambda x: x * x)), 0), 6) AS second FROM c""",
)
def _(spark, d):
    """Mean pooling of token vectors under the mask."""
    out = probe.embed(table(spark, d, "documents").select("doc_id", "text"), "text", lambda: _codes())
    return out.select("doc_id", r6(F.col("embedding")[0]).alias("first"), r6(F.col("embedding")[1]).alias("second"))


@query(
    "probe_folds",
    """WITH r AS (SELECT (label < 5)::INTEGER AS y, row_number() OVER (PARTITION BY label < 5 ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label < 5) AS size FROM embeddings)
SELECT (k * 5 // size)::INTEGER AS fold, y, count(*)::BIGINT AS n FROM r GROUP BY ALL""",
)
def _(spark, d):
    """The probe's stratified folds."""
    rows = table(spark, d, "embeddings").withColumn("y", F.when(F.col("label") < 5, 1).otherwise(0))
    return probe.with_folds(rows, "y", "vec_id").groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"))


@query(
    "probe_subgroups",
    f"""WITH {UNITS}, l AS (SELECT year, CASE WHEN s > c THEN 1 WHEN s < c THEN 0 END AS y FROM (
  SELECT CASE WHEN doc_id % 11 = 0 THEN -1 ELSE year END AS year, {_contains(SIGNAL)} AS s, {_contains(CONTROL)} AS c FROM u))
SELECT e.era, count(*)::BIGINT AS n, sum(y)::BIGINT AS positives, count(*) > 30 AND count(DISTINCT y) > 1 AS fit
FROM l JOIN (VALUES ('rupture', 1894, 9999), ('mid', 1700, 1860)) e(era, low, high) ON year BETWEEN low AND high WHERE y IS NOT NULL GROUP BY era""",
)
def _(spark, d):
    """Weakly labelled rows by era, and whether a probe of it is worth fitting."""
    label = probe.weak_label(F.col("text"), [f for _, f, _ in SIGNAL.ordered()], [f for _, f, _ in CONTROL.ordered()])
    rows = units(spark, d).withColumn("year", F.when(F.col("doc_id") % 11 != 0, F.col("year"))).withColumn("y", label)
    return probe.subgroups(rows, "year", "y", [("rupture", 1894, None), ("mid", 1700, 1860)]).withColumn("positives", long("positives"))


_B = 100


def _poisson_sql(name: str, where: str, stratum: str) -> str:
    reached, chance, parts = 0.0, math.exp(-1), []
    for k in range(13):
        reached += chance
        chance /= k + 1
        parts.append(f"(u >= {int(reached * (1 << 32))})::INTEGER")
    return f"""{name} AS (SELECT rep, coalesce(100.0::DOUBLE * sum(t * w) / nullif(sum(t * n), 0), 0) AS d FROM (
  SELECT rep, w, n, {" + ".join(parts)} AS t FROM (
    SELECT rep, w, n, ('0x' || substr(md5('42|{stratum}|' || rep || '|' || doc_id), 1, 8))::BIGINT AS u FROM scored, range({_B}) r(rep) WHERE {where})) GROUP BY rep)"""


@query(
    "bootstrap_poisson",
    f"""WITH {scored_sql()}, {_poisson_sql("a", _MID, "a")}, {_poisson_sql("b", _RUP, "b")}, d AS (SELECT b.d - a.d AS x FROM a JOIN b USING (rep))
SELECT round((SELECT 100.0::DOUBLE * sum(w) / sum(n) FROM scored WHERE {_RUP}) - (SELECT 100.0::DOUBLE * sum(w) / sum(n) FROM scored WHERE {_MID}), 6) AS point,
  round(quantile_cont(x, 0.025), 6) AS lo, round(quantile_cont(x, 0.975), 6) AS hi, round(2 * least(avg((x <= 0)::INTEGER), avg((x >= 0)::INTEGER)), 6) AS p FROM d""",
)
def _(spark, d):
    s = scored(spark, d).select("doc_id", "year", "signal_weighted", "n_chars")
    out = inference.bootstrap_difference(s.filter(_MID), s.filter(_RUP), ["doc_id"], "signal_weighted", "n_chars", _B, poisson=True)
    return out.select(*[r6(c).alias(c) for c in out.columns])


# ---- streams ------------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, d: str, build) -> DataFrame:
    """What a stream over the documents has written when it has read all of them."""
    path, source = new_path(spark), f"{d}/documents.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source if not source.endswith(".parquet") else f"{source}*")
    writer = build(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("stream_scores", f"WITH {scored_sql()} SELECT doc_id, n::BIGINT AS n_chars, t::BIGINT AS tokens FROM scored")
def _(spark, d):
    out = _streamed(spark, d, lambda s: score_stream(s, "text", SIGNAL, CONTROL, 0.8, keep=KEEP).select("doc_id", "n_chars", "signal_tokens"))
    return out.select("doc_id", long("n_chars").alias("n_chars"), long("signal_tokens").alias("tokens"))


@query(
    "windowed_density",
    f"""WITH {scored_sql()} SELECT (doc_id // 10)::BIGINT AS slot, count(*)::BIGINT AS units, round(coalesce(100 * sum(w) / nullif(sum(n), 0), 0), 6) AS signal,
  round(coalesce(100.0::DOUBLE * sum(ct) / nullif(sum(n), 0), 0), 6) AS control FROM scored GROUP BY 1""",
)
def _(spark, d):
    timed = scored(spark, d).withColumn("ts", F.timestamp_seconds(F.col("doc_id") * 60))
    out = windowed_density(timed, "ts", "10 minutes", "1 hour")
    slot = F.floor(F.unix_timestamp("window.start") / 600)
    return out.select(long(slot).alias("slot"), "units", r6("signal_density").alias("signal"), r6("control_density").alias("control"))


_UPSERTS = """SELECT conv_id, arg_max(turn, turn) AS turn, arg_max(role, turn) AS role, min(turn) AS place FROM conversations GROUP BY conv_id"""


@query("upsert_stream", _UPSERTS)
def _(spark, d):
    """Turns in the order of a hash, so that most come late, in a batch for each file."""
    path = new_path(spark)
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    turns.repartition(4, F.xxhash64("conv_id", "turn", "role")).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    changed = upserts.upserted(stream, ["conv_id"], "turn")
    upserts.versions(changed, f"{path}/out", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return upserts.latest(spark, f"{path}/out", ["conv_id"]).select("conv_id", "turn", "role", "place")


@query(
    "windowed_stream",
    f"""WITH {scored_sql()} SELECT (doc_id // 10)::BIGINT AS slot, count(*)::BIGINT AS units, round(coalesce(100 * sum(w) / nullif(sum(n), 0), 0), 6) AS signal,
  round(coalesce(100.0::DOUBLE * sum(ct) / nullif(sum(n), 0), 0), 6) AS control FROM scored GROUP BY 1""",
)
def _(spark, d):
    """Windows of a stream of texts, each time one changes; the newest version of each is what the batch says."""
    path, source = new_path(spark), f"{d}/documents.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source}*")
    scores = score_stream(stream, "text", SIGNAL, CONTROL, 0.8, keep=KEEP).withColumn("ts", F.timestamp_seconds(F.col("doc_id") * 60))
    changed = windowed_density(scores, "ts", "10 minutes", "3650 days")
    upserts.versions(changed, f"{path}/out", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    out = upserts.latest(spark, f"{path}/out", ["window"])
    slot = F.floor(F.unix_timestamp("window.start") / 600)
    return out.select(long(slot).alias("slot"), "units", r6("signal_density").alias("signal"), r6("control_density").alias("control"))
