"""Web interfaces as tables of questions and answers.

A question is a query string, an answer a JSON text. Who answers is a function from a table of questions to a table of answers: `from_table`
looks them up in any table by an equi-join, `from_web` asks an address from the executors. What the answers say is read by Spark's own JSON
functions, and what comes in pages or levels is asked for in rounds, whole rounds at a time. Titles are rows of a table, as many as there are. A
question that failed keeps its reason in `failed`; it is told apart from an empty answer.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stanzaflow.sources.files import exists
from stanzaflow.sources.scratch import materialise, new_path

Ask = Callable[[DataFrame], DataFrame]


def asked(**params: Column | str | int) -> Column:
    """A question's text: parameters by name, encoded."""
    parts = []
    for name in sorted(params):
        value = params[name] if isinstance(params[name], Column) else F.lit(str(params[name]))
        parts.append(F.concat(F.lit(f"{name}="), F.url_encode(value.cast("string"))))
    return F.concat_ws("&", *parts)


def from_table(answers: DataFrame) -> Ask:
    """Answers (asked, answer) of a table; a question that isn't there has the answer {}."""
    once = answers.groupBy("asked").agg(F.first("answer").alias("answer"))

    def ask(questions: DataFrame) -> DataFrame:
        found = questions.join(once, "asked", "left")
        return found.withColumn("answer", F.coalesce("answer", F.lit("{}"))).withColumn("failed", F.lit(None).cast("string"))

    return ask


def from_web(address: str, tries: int = 3, pause: float = 2.0, timeout: float = 30.0) -> Ask:
    """Answers of an address, asked for by the executors: so many tries, then {} and the reason. What the server refuses (4xx) isn't tried again."""

    def one(question: str) -> tuple[str, str | None]:
        why = None
        for attempt in range(tries):
            try:
                with urllib.request.urlopen(f"{address}?{question}", timeout=timeout) as answer:
                    text = answer.read().decode()
                json.loads(text)
                return text, None
            except urllib.error.HTTPError as e:
                why = f"HTTP {e.code}"
                if e.code < 500:
                    break
            except (OSError, ValueError) as e:
                why = f"{type(e).__name__}: {e}"
            if attempt + 1 < tries:
                time.sleep(pause)
        return "{}", why

    def ask(questions: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [one(q) for q in batch.column(batch.schema.get_field_index("asked")).to_pylist()]
                more = [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "answer", "failed"])

        shape = questions.withColumn("answer", F.lit("")).withColumn("failed", F.lit("")).schema
        for name in ("answer", "failed"):
            shape[name].nullable = True
        return materialise(questions.mapInArrow(run, shape))  # asked once, whatever reads it

    return ask


def pages(titles: DataFrame, ask: Ask) -> DataFrame:
    """title, wikitext, failed: wikitext is null where there is no page."""
    found = ask(titles.select("title", asked(action="parse", page=F.col("title"), prop="wikitext", format="json").alias("asked")))
    text = F.from_json("answer", "parse struct<wikitext: map<string,string>>")["parse"]["wikitext"]
    return found.select("title", F.try_element_at(text, F.lit("*")).alias("wikitext"), "failed")


def listed(titles: DataFrame, ask: Ask, max_pages: int = 20, prefix: str = "", path: str | None = None) -> DataFrame:
    """title, page, pos, link: links that an index lists, through at most max_pages answers each; all titles' next pages in one round.

    With a path, each round's links and continuation tokens are kept there, and a run that was stopped goes on behind the last whole round.
    """
    query = {"action": "query", "prop": "links", "plnamespace": 0, "pllimit": "max", "format": "json"}
    kind = "query struct<pages: map<string,struct<links: array<struct<title: string>>>>>, `continue` struct<plcontinue: string>"
    spark, named, nothing = titles.sparkSession, F.concat(F.lit(prefix), "title"), F.array().cast("array<struct<title:string>>")
    rest, out = titles.select("title", asked(titles=named, **query).alias("asked")), None
    for page in range(max_pages):
        kept = f"{path}/page={page}" if path else new_path(spark)
        if not (path and exists(spark, f"{kept}/_SUCCESS")):
            answer = ask(rest).select("title", F.from_json("answer", kind).alias("a"))
            each = F.flatten(F.transform(F.map_values("a.query.pages"), lambda p: F.coalesce(p["links"], nothing)))
            round_ = answer.select("title", F.transform(each, lambda x: x["title"]).alias("links"), F.col("a.continue.plcontinue").alias("token"))
            round_.write.mode("overwrite").parquet(kept)
        found = spark.read.schema("title string, links array<string>, token string").parquet(kept)
        own = found.select("title", F.lit(page).alias("page"), F.posexplode("links").alias("pos", "link"))
        out = own if out is None else out.union(own)
        rest = found.filter("token IS NOT NULL").select("title", asked(titles=named, plcontinue=F.col("token"), **query).alias("asked"))
        if rest.isEmpty():
            break
    return out


def links(titles: DataFrame, ask: Ask, max_pages: int = 20, hits: int = 50, prefix: str = "") -> DataFrame:
    """title, step, page, pos, link: links that a page shows (0), that its index lists (1), and finds that name it in brackets (2); repeats stay.

    A page's own name has the prefix, what a search looks for hasn't.
    """
    shown = ask(titles.select("title", asked(action="parse", page=F.concat(F.lit(prefix), "title"), prop="links", format="json").alias("asked")))
    shown = shown.select("title", F.filter(F.from_json("answer", "parse struct<links: array<struct<ns: int, `*`: string>>>")["parse"]["links"], lambda x: x["ns"] == 0).alias("l"))
    shown = shown.select("title", F.lit(0).alias("step"), F.lit(0).alias("page"), F.posexplode("l").alias("pos", "l")).select("title", "step", "page", "pos", F.col("l.`*`").alias("link"))
    index = listed(titles, ask, max_pages, prefix).select("title", F.lit(1).alias("step"), "page", "pos", "link")
    found = ask(titles.select("title", asked(action="query", list="search", srsearch=F.col("title"), srlimit=hits, format="json").alias("asked")))
    found = found.select("title", F.posexplode(F.from_json("answer", "query struct<search: array<struct<title: string>>>")["query"]["search"]).alias("pos", "l"))
    found = found.select("title", F.lit(2).alias("step"), F.lit(0).alias("page"), "pos", F.col("l.title").alias("link"))
    brackets = [F.contains("link", F.concat(F.lit(a), "title", F.lit(b))) for a, b in (("（", "）"), ("(", ")"))]
    return shown.union(index).union(found.filter(brackets[0] | brackets[1]))


def prefixed(titles: DataFrame, ask: Ask, limit: int = 60, tries: int = 4) -> DataFrame:
    """title, seq, page: sub-pages by prefix search; titles without an answer are asked again, `tries` times in all."""
    question = asked(action="query", list="prefixsearch", pssearch=F.concat("title", F.lit("/")), pslimit=limit, format="json")
    rest, out = titles.select("title", question.alias("asked")), None
    for _ in range(tries):
        kind = "query struct<prefixsearch: array<struct<title: string>>>"
        found = materialise(ask(rest).select("title", "asked", F.from_json("answer", kind)["query"]["prefixsearch"].alias("l")))
        own = found.select("title", F.posexplode("l").alias("seq", "p")).select("title", "seq", F.col("p.title").alias("page"))
        out = own if out is None else out.union(own)
        rest = found.filter("l IS NULL OR size(l) = 0").select("title", "asked")
        if rest.isEmpty():
            break
    return out


def books(queries: DataFrame, ask: Ask) -> DataFrame:
    """query, pos, title, urn of the books that each query finds."""
    found = ask(queries.select("query", asked(title=F.col("query")).alias("asked")))
    each = found.select("query", F.posexplode(F.from_json("answer", "books array<struct<title: string, urn: string>>")["books"]).alias("pos", "b"))
    return each.select("query", "pos", F.coalesce("b.title", F.lit("")).alias("title"), F.col("b.urn").alias("urn"))


def tree(roots: DataFrame, ask: Ask, most_children: int = 200) -> tuple[DataFrame, DataFrame]:
    """Of works (root) the edges (root, urn, parent, pos) and passages (root, urn, pos, passage), level by level.

    Passages that aren't texts are left out. A node that is its own child isn't followed, and no node is asked for twice; so a cycle ends. Of a node
    at most `most_children` children count.
    """
    strings = lambda path: F.variant_get("v", path, "array<variant>")
    level = materialise(roots.select("root", F.col("root").alias("urn")).distinct())
    seen, edges, passages = level, None, None
    while not level.isEmpty():
        found = materialise(ask(level.withColumn("asked", asked(urn=F.col("urn")))).select("root", "urn", F.col("answer")))
        v = found.select("root", "urn", F.try_parse_json("answer").alias("v"))
        texts = None
        for i, name in enumerate(("fulltext", "text")):
            held = v.filter(F.schema_of_variant(F.variant_get("v", f"$.{name}", "variant")).startswith("ARRAY"))
            own = held.select("root", "urn", F.lit(i).alias("part"), F.posexplode(strings(f"$.{name}")).alias("pos", "p"))
            own = own.filter(F.schema_of_variant("p") == "STRING").select("root", "urn", "part", "pos", F.variant_get("p", "$", "string").alias("passage"))
            texts = own if texts is None else texts.union(own)
        children = [F.when(F.schema_of_variant(F.variant_get("v", f"$.{n}", "variant")).startswith("ARRAY"), strings(f"$.{n}")) for n in ("subsections", "chapters")]
        some = F.when(F.size(children[0]) > 0, children[0]).otherwise(children[1])
        kids = v.select("root", F.col("urn").alias("parent"), F.posexplode(F.slice(some, 1, most_children)).alias("pos", "c"))
        name = F.when(F.schema_of_variant("c") == "STRING", F.variant_get("c", "$", "string")).otherwise(F.try_variant_get("c", "$.urn", "string"))
        kids = materialise(kids.select("root", name.alias("urn"), "parent", "pos").filter("urn IS NOT NULL AND urn <> '' AND urn <> parent"))
        edges, passages = (kids, texts) if edges is None else (edges.union(kids), passages.union(texts))
        level = materialise(kids.select("root", "urn").distinct().join(seen, ["root", "urn"], "left_anti"))
        seen = seen.union(level)
    if edges is None:
        empty = roots.sparkSession.createDataFrame
        return empty([], "root string, urn string, parent string, pos int"), empty([], "root string, urn string, part int, pos int, passage string")
    return edges, passages
