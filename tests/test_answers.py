"""Questions and answers as tables, from a table and from a server."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from stanzaflow.operators import selecting as sl
from stanzaflow.sources import answers as web, sinks

J = {"format": "json"}
MORE = {"action": "query", "prop": "links", "titles": "作者:甲 乙", "plnamespace": 0, "pllimit": "max", **J}


def ask_text(**params):
    return urllib.parse.urlencode(sorted(params.items()))


ANSWERS = {
    ask_text(action="parse", page="p q", prop="wikitext", **J): {"parse": {"wikitext": {"*": "text"}}},
    ask_text(action="parse", page="作者:甲 乙", prop="links", **J): {"parse": {"links": [{"ns": 0, "*": "a"}, {"ns": 4, "*": "no"}, {"ns": 0, "*": "z"}]}},
    ask_text(**MORE): {"query": {"pages": {"1": {"links": [{"title": "b"}]}, "2": {}}}, "continue": {"plcontinue": "c|1"}},
    ask_text(**MORE, plcontinue="c|1"): {"query": {"pages": {"1": {"links": [{"title": "a"}]}}}},
    ask_text(action="query", list="search", srsearch="甲 乙", srlimit=50, **J): {"query": {"search": [{"title": "d（甲 乙）"}, {"title": "e"}]}},
    ask_text(action="query", list="prefixsearch", pssearch="g/", pslimit=60, **J): {"query": {"prefixsearch": [{"title": "g/1"}, {"title": "g/2"}]}},
    ask_text(title="t"): {"books": [{"title": "a t", "urn": "u"}, {"urn": "w"}]},
    ask_text(urn="u"): {"fulltext": ["one", 5, None, {"x": 1}, "5"], "subsections": ["u", {"urn": "v"}, "w", 7]},
    ask_text(urn="v"): {"text": ["two"], "chapters": ["u", "w"], "subsections": []},
    ask_text(urn="w"): {"fulltext": "not a list"},
}


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        tried: dict = {}

        def do_GET(self):
            question = self.path.partition("?")[2]
            key = urllib.parse.urlencode(sorted(urllib.parse.parse_qsl(question)))
            self.tried[key] = self.tried.get(key, 0) + 1
            page = dict(urllib.parse.parse_qsl(question)).get("page", "")
            if page == "refused" or (page == "late" and self.tried[key] < 2):
                self.send_response(404 if page == "refused" else 503)
                self.end_headers()
                return
            body = "{broken" if page == "broken" else json.dumps({"parse": {"wikitext": {"*": "late"}}} if page == "late" else ANSWERS.get(key, {}))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/api", Handler.tried
    http.shutdown()


@pytest.fixture(params=["table", "server"])
def ask(request, spark, server):
    if request.param == "server":
        return web.from_web(server[0], pause=0.01)
    return web.from_table(spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in ANSWERS.items()], "asked string, answer string"))


def titles(spark, *names, column="title"):
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def test_all_interfaces(spark, ask):
    assert sorted((r.title, r.wikitext) for r in web.pages(titles(spark, "p q", "missing"), ask).collect()) == [("missing", None), ("p q", "text")]
    rows = web.links(titles(spark, "甲 乙", "nobody"), ask, prefix="作者:").orderBy("title", "step", "page", "pos").collect()
    assert [r.link for r in rows] == ["a", "z", "b", "a", "d（甲 乙）"]
    assert sorted((r.title, r.seq, r.page) for r in web.prefixed(titles(spark, "g", "h"), ask).collect()) == [("g", 0, "g/1"), ("g", 1, "g/2")]
    found = web.books(titles(spark, "t", "x", column="query"), ask)
    assert sorted((r.pos, r.title, r.urn) for r in found.collect()) == [(0, "a t", "u"), (1, "", "w")]
    assert sl.best_titles(found).first().urn == "u"
    edges, passages = web.tree(titles(spark, "u", "u", column="root"), ask)
    assert sorted((r.urn, r.parent, r.pos) for r in edges.collect()) == [("u", "v", 0), ("v", "u", 1), ("w", "u", 2), ("w", "v", 1)]
    assert sorted((r.urn, r.pos, r.passage) for r in passages.collect()) == [("u", 0, "one"), ("u", 4, "5"), ("v", 0, "two")]
    walk = sl.tree_walk(edges.select("urn", "parent", "pos"), "u").orderBy("path").collect()
    assert [r.urn for r in walk] == ["u", "v", "w", "w"]
    few, _ = web.tree(titles(spark, "u", column="root"), ask, most_children=2)
    assert {r.urn for r in few.collect() if r.parent == "u"} == {"v"}


def test_failures_are_told_apart_from_empty_answers(spark, server):
    address, tried = server
    out = {r.title: r for r in web.pages(titles(spark, "p q", "missing", "refused", "late", "broken"), web.from_web(address, pause=0.01)).collect()}
    assert out["p q"].failed is None and out["missing"].failed is None and out["missing"].wikitext is None
    assert out["refused"].failed == "HTTP 404" and out["late"].wikitext == "late" and out["late"].failed is None
    assert "JSONDecodeError" in out["broken"].failed
    assert tried[ask_text(action="parse", page="refused", prop="wikitext", **J)] == 1 and tried[ask_text(action="parse", page="broken", prop="wikitext", **J)] == 3


def test_at_most_so_many_pages(spark):
    more = {"query": {"pages": {"1": {"links": [{"title": "b"}]}}}, "continue": {"plcontinue": "again"}}
    rows = [(ask_text(**MORE), json.dumps(more)), (ask_text(**MORE, plcontinue="again"), json.dumps(more))]
    ask = web.from_table(spark.createDataFrame(rows, "asked string, answer string"))
    assert web.listed(titles(spark, "甲 乙"), ask, 4, "作者:").count() == 4
    assert web.listed(titles(spark, "甲 乙").limit(0), ask).count() == 0 and web.tree(titles(spark, column="root"), ask)[0].count() == 0


def test_a_notebook_for_each_row_restores_its_blobs(spark):
    data = "größe " * 40
    df = spark.createDataFrame([(1, data), (2, "")], "i int, t string")
    blobs = F.array(F.struct(F.lit("a.txt").alias("name"), F.col("t").cast("binary").alias("data")))
    for r in df.select("i", "t", sinks.notebooks(F.concat(F.lit("No "), "i"), ["print('x')"], blobs).alias("book")).collect():
        book = json.loads(r.book)
        assert book["nbformat"] == 4 and [c["cell_type"] for c in book["cells"]] == ["markdown", "code", "code"] and book["cells"][0]["source"] == [f"# No {r.i}"]
        names = {}
        exec("".join(book["cells"][1]["source"]).replace("pathlib.Path(name).write_bytes(base64.b64decode(data))", "names[name] = base64.b64decode(data)"), {"names": names})
        assert names == {"a.txt": r.t.encode()}


def test_a_stopped_listing_goes_on_behind_its_last_round(spark, tmp_path):
    page = lambda i: {"query": {"pages": {"1": {"links": [{"title": f"l{i}"}]}}}} | ({"continue": {"plcontinue": str(i + 1)}} if i < 4 else {})
    rows = [(ask_text(**MORE, **({"plcontinue": str(i)} if i else {})), json.dumps(page(i))) for i in range(5)]
    table, asked_for = web.from_table(spark.createDataFrame(rows, "asked string, answer string")), []

    def ask(questions):
        asked_for.append(1)
        if len(asked_for) == 3:
            raise ConnectionError("stopped")
        return table(questions)

    run = lambda: web.listed(titles(spark, "甲 乙"), ask, prefix="作者:", path=f"{tmp_path}/rounds")
    with pytest.raises(ConnectionError):
        run()
    assert sorted((r.page, r.link) for r in run().collect()) == [(i, f"l{i}") for i in range(5)]
    assert len(asked_for) == 6  # five answers and the one that failed
