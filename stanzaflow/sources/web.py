"""Sources over paginated web interfaces, as Python data sources.

A reader asks a transport for JSON. The transport is a class path in the options, so that executors can make
their own; `FileTransport` answers from files and needs no network, `HttpTransport` asks an address. Failures
are retried and end as an empty answer, which gives no rows, or, with `failures` set to `raise`, as an error. `answers` is the same over
tables of titles, and keeps what failed.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class HttpTransport:
    def __init__(self, options: dict) -> None:
        self.base = options["address"]
        self.tries, self.pause = int(options.get("tries", 3)), float(options.get("pause", 2))
        self.strict = options.get("failures") == "raise"

    def get(self, params: dict) -> dict:
        why: Exception | None = None
        for _ in range(self.tries):
            try:
                with urllib.request.urlopen(f"{self.base}?{urllib.parse.urlencode(params)}", timeout=30) as answer:
                    return json.load(answer)
            except (OSError, ValueError) as e:
                why = e
                time.sleep(self.pause)
        if self.strict:
            raise RuntimeError(f"no answer to {params}") from why
        return {}


class FileTransport:
    """Answers from a JSON object in `answers`: the sorted parameters, as a query string, to the answer."""

    def __init__(self, options: dict) -> None:
        self.answers = json.loads(options["answers"])

    def get(self, params: dict) -> dict:
        return self.answers.get(urllib.parse.urlencode(sorted(params.items())), {})


def _transport(options: dict):
    module, _, name = options.get("transport", f"{__name__}.HttpTransport").rpartition(".")
    return getattr(importlib.import_module(module), name)(options)


class Item(InputPartition):
    pass


class _Reader(DataSourceReader):
    """A partition for each title asked for."""

    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.titles = json.loads(options["titles"])

    def partitions(self) -> list[Item]:
        return [Item((i, t)) for i, t in enumerate(self.titles)]


class _Pages(_Reader):
    def read(self, partition: Item) -> Iterator[tuple]:
        _, title = partition.value
        answer = _transport(self.options).get({"action": "parse", "page": title, "prop": "wikitext", "format": "json"})
        if "parse" in answer:
            yield title, answer["parse"]["wikitext"]["*"]
        elif self.options.get("required") == "true":
            raise RuntimeError(f"no page {title}")


class _Shown(_Reader):
    """Links of the main namespace that a page shows."""

    def read(self, partition: Item) -> Iterator[tuple]:
        _, title = partition.value
        page = self.options.get("prefix", "") + title
        answer = _transport(self.options).get({"action": "parse", "page": page, "prop": "links", "format": "json"})
        shown = answer.get("parse", {}).get("links", [])
        yield from ((title, pos, x["*"]) for pos, x in enumerate(x for x in shown if x.get("ns") == 0))


class _Listed(_Reader):
    """Links that a page's index lists, through at most `max_pages` answers."""

    def answers(self, title: str) -> Iterator[dict]:
        query = {"action": "query", "prop": "links", "titles": title, "plnamespace": 0, "pllimit": "max", "format": "json"}
        ask, place = _transport(self.options).get, None
        for _ in range(int(self.options.get("max_pages", 20))):
            answer = ask(query if place is None else {**query, "plcontinue": place})
            yield answer
            place = answer.get("continue", {}).get("plcontinue")
            if place is None:
                return

    def read(self, partition: Item) -> Iterator[tuple]:
        _, title = partition.value
        pages = (page for answer in self.answers(self.options.get("prefix", "") + title) for page in answer.get("query", {}).get("pages", {}).values())
        yield from ((title, pos, x["title"]) for pos, x in enumerate(x for page in pages for x in page.get("links", [])))


class _Found(_Reader):
    """Titles that a search finds."""

    def read(self, partition: Item) -> Iterator[tuple]:
        _, title = partition.value
        answer = _transport(self.options).get({"action": "query", "list": "search", "srsearch": title, "srlimit": int(self.options.get("hits", 50)), "format": "json"})
        yield from ((title, pos, x["title"]) for pos, x in enumerate(answer.get("query", {}).get("search", [])))


class _Prefixed(_Reader):
    """Sub-pages by prefix search; the first non-empty answer of some tries, at most `limit`."""

    def read(self, partition: Item) -> Iterator[tuple]:
        _, title = partition.value
        ask = _transport(self.options).get
        limit = int(self.options.get("limit", 60))
        for _ in range(int(self.options.get("asks", 4))):
            answer = ask({"action": "query", "list": "prefixsearch", "pssearch": f"{title}/", "pslimit": limit, "format": "json"})
            pages = answer.get("query", {}).get("prefixsearch", [])
            if pages:
                for seq, page in enumerate(pages):
                    yield title, seq, page["title"]
                return


class _Books(_Reader):
    def read(self, partition: Item) -> Iterator[tuple]:
        _, title = partition.value
        for pos, book in enumerate(_transport(self.options).get({"title": title}).get("books", [])):
            yield title, pos, book.get("title", ""), book.get("urn")


class _Tree(_Reader):
    """Edges and passages of a work: level by level from each root, at most `most_children` of a node; a node that is
    its own child isn't followed."""

    def read(self, partition: Item) -> Iterator[tuple]:
        _, root = partition.value
        ask, queue, seen = _transport(self.options).get, [root], {root}
        most = int(self.options.get("most_children", 200))
        for urn in queue:
            answer = ask({"urn": urn})
            for key in ("fulltext", "text"):
                if isinstance(answer.get(key), list):
                    for pos, passage in enumerate(answer[key]):
                        if isinstance(passage, str):
                            yield root, urn, None, pos, passage
            children = answer.get("subsections") or answer.get("chapters") or []
            for pos, child in enumerate(children[:most] if isinstance(children, list) else []):
                child = child if isinstance(child, str) else child.get("urn")
                if child and child != urn:
                    yield root, child, urn, pos, None
                    if child not in seen:
                        seen.add(child)
                        queue.append(child)


def _source(kind: str, columns: str, reader: type) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return reader(self.options)

    return Source


SOURCES = [
    _source("wiki_pages", "title string, wikitext string", _Pages),
    _source("wiki_shown", "title string, pos int, link string", _Shown),
    _source("wiki_listed", "title string, pos int, link string", _Listed),
    _source("wiki_found", "title string, pos int, link string", _Found),
    _source("wiki_prefix", "title string, seq int, page string", _Prefixed),
    _source("text_books", "query string, pos int, title string, urn string", _Books),
    _source("text_tree", "root string, urn string, parent string, pos int, passage string", _Tree),
]


def read(spark: SparkSession, kind: str, titles: list[str], **options: str) -> DataFrame:
    """Rows of one of SOURCES for some titles."""
    for source in SOURCES:
        spark.dataSource.register(source)
    return spark.read.format(kind).options(titles=json.dumps(titles), **options).load()


def links(spark: SparkSession, titles: list[str], **options: str) -> DataFrame:
    """title, seq, link of pages: shown links, then listed ones, then finds that name the page in brackets; repeats stay."""
    finds = read(spark, "wiki_found", titles, **options)
    named = finds.filter(F.contains("link", F.concat(F.lit("（"), "title", F.lit("）"))) | F.contains("link", F.concat(F.lit("("), "title", F.lit(")"))))
    parts = [read(spark, "wiki_shown", titles, **options), read(spark, "wiki_listed", titles, **options), named]
    every = parts[0].withColumn("step", F.lit(0))
    for step, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("step", F.lit(step)))
    seq = F.row_number().over(Window.partitionBy("title").orderBy("step", "pos")) - 1
    return every.select("title", seq.alias("seq"), "link")
