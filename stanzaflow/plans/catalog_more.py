"""More of the catalog: segmentation, selection, inference and the probe."""

from __future__ import annotations

from pyspark.sql import functions as F

from stanzaflow.functions import numeric, text as tx
from stanzaflow.operators import inference, matching as mt, probe, segmenting as sg, selecting as sl
from stanzaflow.plans.catalog import _MID, _RUP, long, query, r6, scored, table
from stanzaflow.plans.sample import CONTROL, SIGNAL, density, scored as scored_sql
from stanzaflow.sources.scratch import materialise

# ---- cleaning and segmentation ------------------------------------------------------------------------

_TEMPLATES = "regexp_replace({}, '\\{{\\{{[^{{}}]*\\}}\\}}', '', 'g')"


def _cleaned(column: str) -> str:
    out = f"regexp_replace({column}, '\\{{\\{{header.*?\\}}\\}}', '', 'gs')"
    for _ in range(3):
        out = _TEMPLATES.format(out)
    out = f"regexp_replace({out}, '\\[\\[(?:[^\\]|]*\\|)?([^\\]]*)\\]\\]', '\\1', 'g')"
    return f"regexp_replace(regexp_replace({out}, '</?[^>]+>', chr(10), 'g'), '（按[^）]*）', '', 'g')"


_MARKUP = "'{{header|a}}{{x{{y}}}}[[a|' || page_id || ']] [[b]]' || html || '（按note）'"


@query("markup_clean", f"SELECT page_id, length(c)::BIGINT AS n, md5(c) AS digest FROM (SELECT page_id, {_cleaned(_MARKUP)} AS c FROM pages)")
def _(spark, d):
    raw = F.concat(F.lit("{{header|a}}{{x{{y}}}}[[a|"), F.col("page_id").cast("string"), F.lit("]] [[b]]"), F.col("html"), F.lit("（按note）"))
    clean = tx.clean_markup(raw)
    return table(spark, d, "pages").select("page_id", long(F.length(clean)).alias("n"), F.md5(clean).alias("digest"))


@query(
    "translate_script",
    "SELECT doc_id, md5(replace(replace(translate(replace(replace(text, 'thing', chr(57344)), 'the', chr(57345)), 'aeiou', 'AEIOU'), chr(57344), 'THING'), chr(57345), 'THE')) AS digest FROM documents",
)
def _(spark, d):
    phrases = spark.createDataFrame([("the", "THE"), ("thing", "THING")], "form string, becomes string")
    out = mt.convert_script(table(spark, d, "documents"), "doc_id", "text", "aeiou", "AEIOU", phrases)
    return out.select("doc_id", F.md5("text").alias("digest"))


def _occurrences_sql(pattern: str, groups: int) -> str:
    """CTE occ: doc_id, seq, start, stop, g0.. of matches by splitting, as the engine does, in the other engine."""
    gs = ", ".join(f"unnest(list_append(regexp_extract_all(text, '{pattern}', {g}), NULL)) AS g{g}" for g in range(groups + 1))
    return f"""p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '{pattern}')) AS gap, {gs},
    unnest(range(0, len(regexp_split_to_array(text, '{pattern}')))) AS seq FROM documents),
occ AS (SELECT doc_id, seq, {", ".join(f"g{g}" for g in range(groups + 1))}, stop - length(g0) AS start, stop FROM (
    SELECT *, (sum(length(gap) + coalesce(length(g0), 0)) OVER (PARTITION BY doc_id ORDER BY seq))::BIGINT AS stop FROM p) WHERE g0 IS NOT NULL)"""


_QUOTE = "Th([^.\\n]+)\\."


@query(
    "quoted_spans",
    f"""WITH {_occurrences_sql(_QUOTE, 1)}
SELECT doc_id, start AS "offset", g1 AS text, n FROM (SELECT *, length(regexp_replace(g1, '[^A-Za-z]', '', 'g'))::BIGINT AS n FROM occ) WHERE n >= 12""",
)
def _(spark, d):
    spans = sg.quoted_spans(table(spark, d, "documents"), ["doc_id"], "text", _QUOTE, "A-Za-z", 12)
    return spans.select("doc_id", long("offset").alias("offset"), "text", long("n_chars").alias("n"))


_MARKS = [("the", 1700), ("then", 1720), ("was", 1894), ("der", 1600), ("que", 1800)]


@query(
    "asof_marker",
    f"""WITH q AS (SELECT doc_id, start FROM (WITH {_occurrences_sql(_QUOTE, 1)} SELECT * FROM occ)),
m AS (SELECT doc_id, start AS pos, g0 AS marker FROM (WITH {_occurrences_sql("the|then|was|der|que", 0)} SELECT * FROM occ)),
y(marker, year) AS (VALUES {", ".join(f"('{m}', {y})" for m, y in _MARKS)})
SELECT q.doc_id, q.start AS "offset", m.marker, y.year FROM q ASOF LEFT JOIN m ON q.doc_id = m.doc_id AND q.start >= m.pos LEFT JOIN y ON m.marker = y.marker""",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    quotes = sg.quoted_spans(docs, ["doc_id"], "text", _QUOTE, "A-Za-z", 0).select("doc_id", F.col("offset").alias("pos"))
    marks = sg.marker_scan(docs, ["doc_id"], "text", _MARKS)
    dated = sg.asof_backward(materialise(quotes), materialise(marks), ["doc_id"], "pos", ["marker", "year"])
    return dated.select("doc_id", long("pos").alias("offset"), "marker", "year")


@query(
    "asof_events",
    """WITH p AS (SELECT user_id, ts, event_id, event_type, value FROM events WHERE event_type = 'purchase'), m AS (
  SELECT user_id, ts, max(event_id) AS marker FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT p.event_id, m.marker FROM p ASOF LEFT JOIN m ON p.user_id = m.user_id AND p.ts >= m.ts""",
)
def _(spark, d):
    events = table(spark, d, "events")
    marks = events.filter("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("marker"))
    left = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return sg.asof_backward(left, marks, ["user_id"], "ts", ["marker"]).select("event_id", "marker")


_HEADER = "([A-Z][a-z]*) ([theaoinrsd]{4})[ ,.]"
_NUMERALS = "theaoinrsd"
_SECTIONS = f"""{_occurrences_sql(_HEADER, 2)}, sec AS (
  SELECT occ.doc_id, stop AS "offset", g1, translate(g2, '{_NUMERALS}', '0123456789')::INTEGER AS year,
    substr(text, stop + 1, coalesce(lead(start) OVER (PARTITION BY occ.doc_id ORDER BY start), length(text)) - stop) AS body
  FROM occ JOIN documents USING (doc_id))"""


def _sections(spark, d):
    return sg.dated_sections(table(spark, d, "documents"), "doc_id", "text", _HEADER, _NUMERALS, "0123456789")


@query("numeral_year", f"WITH {_SECTIONS} SELECT doc_id, \"offset\", year FROM sec")
def _(spark, d):
    return _sections(spark, d).select("doc_id", long("offset").alias("offset"), "year")


@query("section_split", f"WITH {_SECTIONS} SELECT doc_id, \"offset\", g1 AS head, year, md5(body) AS digest FROM sec")
def _(spark, d):
    return _sections(spark, d).select("doc_id", long("offset").alias("offset"), F.col("ganzhi").alias("head"), "year", F.md5("text").alias("digest"))


@query(
    "front_matter_cut",
    f"""WITH {_SECTIONS}, y AS (SELECT *, min(year) OVER (PARTITION BY doc_id) AS least FROM sec), b AS (
  SELECT *, min("offset") FILTER (year = least) OVER (PARTITION BY doc_id) AS begin FROM y)
SELECT doc_id, "offset", year FROM b WHERE "offset" >= begin""",
)
def _(spark, d):
    return sg.cut_front_matter(_sections(spark, d), "doc_id").select("doc_id", long("offset").alias("offset"), "year")


_ENDS, _LENGTHS = "[.,\\n]+", (6, 9, 12)
_RUNS = f"""c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY raw) - 1 AS pos, clause, length(regexp_replace(clause, '[^A-Za-z]', '', 'g')) AS n
  FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '{_ENDS}')) AS clause, unnest(range(0, len(regexp_split_to_array(text, '{_ENDS}')))) AS raw FROM documents)
  WHERE regexp_matches(clause, '\\S')),
i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, n ORDER BY pos) AS island FROM c),
runs AS (SELECT doc_id, min(pos) AS start, n, count(*) AS lines, string_agg(clause, '' ORDER BY pos) AS text FROM i WHERE n IN {_LENGTHS} GROUP BY doc_id, n, island)"""


def _runs(spark, d):
    lines = sg.clauses(table(spark, d, "documents"), ["doc_id"], "text", _ENDS, "A-Za-z")
    return sg.equal_runs(lines, ["doc_id"], _LENGTHS)


@query("clause_runs", f"WITH {_RUNS} SELECT doc_id, start::BIGINT AS start, n::BIGINT AS n, lines::BIGINT AS lines FROM runs")
def _(spark, d):
    return _runs(spark, d).select("doc_id", long("start").alias("start"), long("n").alias("n"), long("lines").alias("lines"))


@query("run_concat", f"WITH {_RUNS} SELECT doc_id, start::BIGINT AS start, text FROM runs WHERE lines BETWEEN 2 AND 24")
def _(spark, d):
    return _runs(spark, d).filter("lines BETWEEN 2 AND 24").select("doc_id", long("start").alias("start"), "text")


@query(
    "prose_gate",
    f"""WITH {_RUNS} SELECT doc_id, start::BIGINT AS start, lines::BIGINT AS lines FROM runs
WHERE lines BETWEEN 2 AND 24 AND (length(text) - length(translate(text, 'wmbz', ''))) / lines <= 0.2""",
)
def _(spark, d):
    kept = sg.verses(table(spark, d, "documents"), ["doc_id"], "text", _LENGTHS, 2, 24, "wmbz", 0.2, _ENDS, "A-Za-z")
    return kept.select("doc_id", long("start").alias("start"), long("lines").alias("lines"))


# ---- selection ----------------------------------------------------------------------------------------


@query(
    "upsert_last_wins",
    """SELECT conv_id, arg_max(turn, turn) AS turn, arg_max(role, turn) AS role, min(turn) AS place FROM conversations GROUP BY conv_id""",
)
def _(spark, d):
    return sl.last_wins(table(spark, d, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role", "place")


@query(
    "upsert_merge",
    """WITH a AS (SELECT conv_id, turn, role, 0 AS new FROM conversations WHERE turn < 2 UNION ALL SELECT conv_id, turn, role || '!', 1 FROM conversations WHERE turn >= 2)
SELECT conv_id, arg_max(turn, new * 1000000 + turn) AS turn, arg_max(role, new * 1000000 + turn) AS role FROM a GROUP BY conv_id""",
)
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    new = rows.filter("turn >= 2").withColumn("role", F.concat("role", F.lit("!")))
    return sl.upsert(rows.filter("turn < 2"), new, ["conv_id"], "turn").select("conv_id", "turn", "role")


@query("ordered_distinct", "SELECT source, min(doc_id) AS first FROM documents WHERE source NOT LIKE 'src1%' GROUP BY source")
def _(spark, d):
    return sl.ordered_distinct(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", ("src1",)).withColumnRenamed("doc_id", "first")


@query(
    "meta_left_join",
    "SELECT c_custkey, coalesce(n_name, 'unknown') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey",
)
def _(spark, d):
    meta = table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return sl.lookup(table(spark, d, "customer").select("c_custkey", "c_nationkey"), meta, "c_nationkey", {"nation": "unknown"}).select("c_custkey", "nation")


@query(
    "top_n_per_parent",
    "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= 3",
)
def _(spark, d):
    return sl.first_of_parent(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query(
    "tree_walk",
    """WITH RECURSIVE e AS (
  SELECT 'r' || r_regionkey AS urn, 'world' AS parent, r_regionkey AS pos FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation UNION ALL SELECT 'r0', 'r0', 9),
w AS (SELECT 'world' AS urn, '' AS path, 0 AS depth UNION ALL
  SELECT e.urn, w.path || '/' || lpad(e.pos::VARCHAR, 6, '0'), w.depth + 1 FROM w JOIN e ON e.parent = w.urn AND e.urn <> e.parent)
SELECT urn, path, depth FROM w""",
)
def _(spark, d):
    regions = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("urn"), F.lit("world").alias("parent"), F.col("r_regionkey").alias("pos"))
    nations = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("urn"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").alias("pos"))
    loop = spark.range(1).select(F.lit("r0").alias("urn"), F.lit("r0").alias("parent"), F.lit(9).alias("pos"))
    return sl.tree_walk(regions.union(nations).union(loop), "world")


# ---- inference and the probe --------------------------------------------------------------------------


@query(
    "changepoint",
    f"""WITH {scored_sql()}, y AS (SELECT year, {density("w")} AS v FROM scored GROUP BY year), r AS (
  SELECT year, v, row_number() OVER (ORDER BY year) AS k, count(*) OVER () AS n FROM y), s AS (
  SELECT a.year, a.k, (SELECT var_pop(v) * count(*) FROM r WHERE k <= a.k) + (SELECT var_pop(v) * count(*) FROM r WHERE k > a.k) AS sse FROM r a WHERE k >= 2 AND n - k >= 2)
SELECT year AS changepoint, round(sse, 6) AS sse FROM s ORDER BY s.sse, year LIMIT 1""",
)
def _(spark, d):
    by_year = scored(spark, d).groupBy("year").agg(numeric.pooled("signal_weighted", "n_chars").alias("v"))
    return inference.changepoint(by_year, "year", "v").select("changepoint", r6("sse").alias("sse"))


def _replicates_sql(name: str, rows: str, order: str, b: int, stratum: str, num: str = "w") -> str:
    return f"""{name}_r AS (SELECT {num} AS num, n, row_number() OVER (ORDER BY {order}) - 1 AS idx, count(*) OVER () AS size FROM {rows}),
{name} AS (SELECT rep, {density("num")} AS d FROM (
  SELECT rep, (('0x' || substr(md5('42|{stratum}|' || rep || '|' || draw), 1, 8))::BIGINT) % size AS idx
  FROM (SELECT max(size) AS size FROM {name}_r), range({b}) t(rep), (SELECT idx AS draw FROM {name}_r))
  JOIN {name}_r USING (idx) GROUP BY rep)"""


def _boot_sql(a: str, b: str) -> str:
    return f"""d AS (SELECT b.d - a.d AS x FROM a JOIN b USING (rep))
SELECT round((SELECT {density("num")} FROM b_r) - (SELECT {density("num")} FROM a_r), 6) AS point, round(quantile_cont(x, 0.025), 6) AS lo,
  round(quantile_cont(x, 0.975), 6) AS hi, round(2 * least(avg((x <= 0)::INTEGER), avg((x >= 0)::INTEGER)), 6) AS p FROM d"""


@query(
    "bootstrap_iid",
    f"""WITH {scored_sql()}, mid AS (SELECT * FROM scored WHERE {_MID}), rup AS (SELECT * FROM scored WHERE {_RUP}),
{_replicates_sql("a", "mid", "doc_id", 200, "a")}, {_replicates_sql("b", "rup", "doc_id", 200, "b")}, {_boot_sql("a", "b")}""",
)
def _(spark, d):
    s = scored(spark, d).select("doc_id", "year", "signal_weighted", "n_chars")
    out = inference.bootstrap_difference(s.filter(_MID), s.filter(_RUP), ["doc_id"], "signal_weighted", "n_chars", 200)
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(
    "bootstrap_cluster",
    f"""WITH {scored_sql()}, mid AS (SELECT source, sum(w) AS w, sum(n) AS n FROM scored WHERE {_MID} GROUP BY source),
rup AS (SELECT source, sum(w) AS w, sum(n) AS n FROM scored WHERE {_RUP} GROUP BY source),
{_replicates_sql("a", "mid", "source", 1000, "a")}, {_replicates_sql("b", "rup", "source", 1000, "b")}, {_boot_sql("a", "b")}""",
)
def _(spark, d):
    s = scored(spark, d).select("source", "year", "signal_weighted", "n_chars")
    a, b = (inference.clusters(s.filter(era), "source", "signal_weighted", "n_chars") for era in (_MID, _RUP))
    out = inference.bootstrap_difference(a, b, ["source"], "signal_weighted", "n_chars", 1000)
    return out.select(*[r6(c).alias(c) for c in out.columns])


_PD = "coalesce(100.0::DOUBLE * sum(w) FILTER ({0}) / nullif(sum(n) FILTER ({0}), 0), 0)"


@query(
    "permutation_label",
    f"""WITH {scored_sql()}, l AS (SELECT doc_id, w, n, quality = 1 AS mine, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM scored JOIN labels USING (doc_id)),
o AS (SELECT {_PD.format("mine")} - {_PD.format("NOT mine")} AS observed, count(*) FILTER (mine) AS size FROM l),
s AS (SELECT rep, w, n, row_number() OVER (PARTITION BY rep ORDER BY md5('42|' || rep || '|' || idx), idx) AS place FROM l, range(100) t(rep)),
t AS (SELECT rep, {_PD.format("place <= size")} - {_PD.format("place > size")} AS stat FROM s, o GROUP BY rep)
SELECT round(any_value(observed), 6) AS observed, round((count(*) FILTER (stat >= observed - 1e-12) + 1) / 101, 6) AS p FROM t, o""",
)
def _(spark, d):
    labels = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("mine"))
    s = scored(spark, d).join(labels, "doc_id").select("doc_id", "mine", "signal_weighted", "n_chars")
    out = inference.permutation_p(s, ["doc_id"], "mine", "signal_weighted", "n_chars", 100, md5=True)
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(
    "percentile_ci",
    "SELECT o_orderstatus AS status, round(quantile_cont(o_totalprice, 0.025), 6) AS lo, round(quantile_cont(o_totalprice, 0.975), 6) AS hi FROM orders GROUP BY ALL",
)
def _(spark, d):
    p = [r6(F.percentile("o_totalprice", F.lit(q))).alias(n) for n, q in (("lo", 0.025), ("hi", 0.975))]
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(*p)


def _contains(lexicon) -> str:
    return " + ".join(f"contains(coalesce(text, ''), '{f}')::INTEGER" for _, f, _ in lexicon.ordered())


@query(
    "probe_label",
    f"SELECT doc_id, (s > c)::INTEGER AS label FROM (SELECT doc_id, {_contains(SIGNAL)} AS s, {_contains(CONTROL)} AS c FROM documents) WHERE s <> c",
)
def _(spark, d):
    label = probe.weak_label(F.col("text"), [f for _, f, _ in SIGNAL.ordered()], [f for _, f, _ in CONTROL.ordered()])
    return table(spark, d, "documents").select("doc_id", label.alias("label")).filter("label IS NOT NULL")


@query(
    "silhouette",
    """WITH p AS (SELECT a.vec_id, a.label, b.label AS other, avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS m
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY ALL), s AS (
  SELECT vec_id, max(m) FILTER (label = other) AS own, min(m) FILTER (label <> other) AS near FROM p GROUP BY vec_id)
SELECT round(avg(coalesce((near - own) / nullif(greatest(near, own), 0), 0)), 6) AS silhouette FROM s""",
)
def _(spark, d):
    return probe.silhouette(table(spark, d, "embeddings"), "vec_id", "embedding", "label").select(r6("silhouette").alias("silhouette"))


@query("logistic_probe")
def _(spark, d):
    """Accuracy by fold; the fitted model has no SQL form."""
    rows = table(spark, d, "embeddings").withColumn("y", F.when(F.col("label") < 5, 1).otherwise(0))
    return probe.cross_validated_accuracy(rows, "embedding", "y", "vec_id")
