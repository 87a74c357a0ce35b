"""Queries of the exact resampling by shards and of the ordered scans, with SQL that makes the same draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from stanzaflow.functions import draws
from stanzaflow.operators import inference, lexicon as lx, matching as mt, probe, probing, scans, segmenting
from stanzaflow.plans.catalog import _MID, _RUP, long, query, r6, scored, scored_sql, table
from stanzaflow.plans.catalog import SQL
from stanzaflow.plans.catalog_more import _PD, _boot_sql
from stanzaflow.plans.sample import KEEP, SIGNAL, density, units
from stanzaflow.functions.text import normalise


def mixed_sql(x: str) -> str:
    """The mixer of 32-bit numbers."""
    step = f"(xor(a >> 16, a) * {int(draws.FACTOR)}) & 4294967295"
    return f"list_transform([list_reduce([({x})::BIGINT, 1, 1], lambda a, b: {step})], lambda y: xor(y >> 16, y))[1]"


def _split_sql(name: str, rows: str, b: int, shard_rows: int, seed: int = 42, deepest: int = 6) -> str:
    """CTEs of a resample by shards of rows (doc_id, w, n): the binomials as sums of their probabilities."""
    start = int(draws.base(seed, name))
    out = f"""{name}_r AS MATERIALIZED (SELECT w AS num, n, doc_id::VARCHAR AS name, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT AS hash FROM {rows}),
{name}_n AS MATERIALIZED (SELECT count(*) AS size, CASE WHEN count(*) <= {shard_rows} THEN 0 ELSE ceil(log2(ceil(count(*) / {shard_rows}::DOUBLE)))::BIGINT END AS bits FROM {name}_r),
{name}_c AS MATERIALIZED (SELECT level, hash >> (32 - level) AS node, count(*) AS c FROM {name}_r, {name}_n, range({deepest + 1}) t(level) WHERE level <= bits GROUP BY ALL),
{name}_h AS MATERIALIZED (SELECT rep, {mixed_sql(f"xor({start}, rep)")} AS h FROM range({b}) t(rep)),
{name}_0 AS (SELECT rep, h, 0 AS node, size AS k FROM {name}_h, {name}_n)"""
    for level in range(deepest):
        u = mixed_sql(f"xor(l.h, {1 << level} + l.node)")
        out += f""",
{name}_u{level} AS MATERIALIZED (SELECT l.rep, l.h, l.node, k, coalesce(f.c, 0) / t.c::DOUBLE AS p, {u} / 4294967296::DOUBLE AS u
  FROM {name}_{level} l JOIN {name}_c t ON t.level = {level} AND t.node = l.node LEFT JOIN {name}_c f ON f.level = {level + 1} AND f.node = 2 * l.node),
{name}_x{level} AS (SELECT rep, h, node, k, CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN k ELSE least(k, count(*) FILTER (cdf <= u)) END AS x FROM (
  SELECT *, sum(CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE exp(lgamma(k + 1) - lgamma(j + 1) - lgamma(k - j + 1) + j * ln(CASE WHEN p <= 0 THEN 1 ELSE p END) + (k - j) * ln(CASE WHEN p >= 1 THEN 1 ELSE 1 - p END)) END)
    OVER (PARTITION BY rep, node ORDER BY j) AS cdf FROM (SELECT *, unnest(range(k + 1)) AS j FROM {name}_u{level})) GROUP BY rep, h, node, k, p, u),
{name}_{level + 1} AS (
  SELECT rep, h, 2 * node + side AS node, CASE side WHEN 0 THEN x ELSE k - x END AS k FROM {name}_x{level}, {name}_n, range(2) s(side) WHERE {level} < bits
  UNION ALL SELECT l.* FROM {name}_{level} l, {name}_n WHERE {level} >= bits)"""
    draw = mixed_sql("xor(g, d)")
    return f"""{out},
{name}_s AS MATERIALIZED (SELECT *, hash >> (32 - bits) AS shard, row_number() OVER (PARTITION BY hash >> (32 - bits) ORDER BY name, num, n) - 1 AS i,
  count(*) OVER (PARTITION BY hash >> (32 - bits)) AS m FROM {name}_r, {name}_n),
{name} AS (SELECT rep, {density("num")} AS d FROM (
  SELECT rep, node AS shard, ({draw} * m) >> 32 AS i FROM (
    SELECT rep, node, m, {mixed_sql("xor(h, (1::BIGINT << bits) + node)")} AS g, unnest(range(k)) AS d
    FROM {name}_{deepest} JOIN (SELECT DISTINCT shard, m, bits FROM {name}_s) ON shard = node))
  JOIN {name}_s USING (shard, i) GROUP BY rep)"""


def _split(name: str, b: int, shard_rows: int) -> None:
    @query(
        name,
        f"""WITH {scored_sql()}, mid AS (SELECT * FROM scored WHERE {_MID}), rup AS (SELECT * FROM scored WHERE {_RUP}),
{_split_sql("a", "mid", b, shard_rows)}, {_split_sql("b", "rup", b, shard_rows)}, {_boot_sql("a", "b")}""",
    )
    def _(spark, d):
        s = scored(spark, d).select("doc_id", "year", "signal_weighted", "n_chars")
        out = inference.bootstrap_difference(
            s.filter(_MID), s.filter(_RUP), ["doc_id"], "signal_weighted", "n_chars", b, split=True, shard_rows=shard_rows
        )
        return out.select(*[r6(c).alias(c) for c in out.columns])


_split("bootstrap_split", 200, 40)
_split("bootstrap_split_10000", 10_000, inference.SHARD_ROWS)


@query(
    "permutation_10000",
    f"""WITH {scored_sql()}, l AS (SELECT doc_id, w, n, quality = 1 AS mine, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM scored JOIN labels USING (doc_id)),
o AS (SELECT {_PD.format("mine")} - {_PD.format("NOT mine")} AS observed, count(*) FILTER (mine) AS size FROM l),
h AS (SELECT rep, {mixed_sql(f"xor({int(draws.base(42, 'permutation'))}, rep)")} AS h FROM range(10000) t(rep)),
s AS (SELECT rep, w, n, row_number() OVER (PARTITION BY rep ORDER BY {mixed_sql("xor(h, idx)")}) AS place FROM l, h),
t AS (SELECT rep, {_PD.format("place <= size")} - {_PD.format("place > size")} AS stat FROM s, o GROUP BY rep)
SELECT round(any_value(observed), 6) AS observed, round((count(*) FILTER (stat >= observed - 1e-12) + 1) / 10001, 6) AS p FROM t, o""",
)
def _(spark, d):
    labels = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("mine"))
    s = scored(spark, d).join(labels, "doc_id").select("doc_id", "mine", "signal_weighted", "n_chars")
    out = inference.permutation_p(s, ["doc_id"], "mine", "signal_weighted", "n_chars", 10_000)
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(
    "ranked_events",
    "SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS place, count(*) OVER (PARTITION BY user_id)::BIGINT AS size FROM events",
)
def _(spark, d):
    return scans.ranked(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "place", "size").select("event_id", "place", "size")


@query(
    "ranked_lines",
    """SELECT l_orderkey, l_linenumber, (row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1)::BIGINT AS place FROM lineitem""",
)
def _(spark, d):
    order = ["l_extendedprice", "l_orderkey", "l_linenumber"]
    return scans.numbered(table(spark, d, "lineitem").select(*order), order, "place").select(
        "l_orderkey", "l_linenumber", long("place").alias("place")
    )


@query(
    "asof_one_volume",
    """WITH m AS (SELECT ts, max(event_id) AS marker FROM events WHERE event_type = 'purchase' GROUP BY ts)
SELECT e.event_id, m.marker FROM events e ASOF LEFT JOIN m ON e.ts >= m.ts""",
)
def _(spark, d):
    """All events as one volume: the key that holds everything is cut like any other."""
    events = table(spark, d, "events").withColumn("volume", F.lit(1))
    marks = events.filter("event_type = 'purchase'").select("volume", "ts", F.col("event_id").alias("marker"))
    return segmenting.asof_backward(events.select("event_id", "volume", "ts"), marks, ["volume"], "ts", ["marker"]).select("event_id", "marker")


def _probe_sql(b: int, steps: int, rate: float, ridge: float = 0.01, where: str = "label IS NOT NULL") -> str:
    """CTEs of probes in plain gradient steps: acc (rep, k, n, hits), rep 0 with the given labels."""
    out = f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, (label < 5)::INTEGER AS y, list_append(embedding::DOUBLE[], 1::DOUBLE) AS x FROM embeddings WHERE {where}),
h AS MATERIALIZED (SELECT rep, {mixed_sql(f"xor({int(draws.base(42, 'permutation'))}, rep - 1)")} AS h FROM range(1, {b + 1}) t(rep)),
y AS MATERIALIZED (SELECT 0 AS rep, idx, y FROM v UNION ALL SELECT rep, idx,
    (row_number() OVER (PARTITION BY rep ORDER BY {mixed_sql("xor(h, idx)")}) <= (SELECT sum(y) FROM v))::INTEGER FROM v, h),
r AS MATERIALIZED (SELECT rep, idx, y, x, (row_number() OVER (PARTITION BY rep, y ORDER BY idx) - 1) * 5 // count(*) OVER (PARTITION BY rep, y) AS fold
  FROM (SELECT y.rep, y.idx, y.y, v.x FROM y JOIN v USING (idx))),
w0 AS (SELECT rep, k, list_transform(range(65), lambda i: 0::DOUBLE) AS w FROM (SELECT DISTINCT rep FROM r), range(5) t(k))"""
    for i in range(steps):
        out += f""",
e{i} AS MATERIALIZED (SELECT w.rep, k, x, 1 / (1 + exp(-list_dot_product(w, x))) - y AS e FROM w{i} w JOIN r ON r.rep = w.rep AND fold <> k),
g{i} AS (SELECT rep, k, j, sum(e * g) / count(*) AS g FROM (SELECT rep, k, e, unnest(x) AS g, unnest(range(1, 66)) AS j FROM e{i}) GROUP BY rep, k, j),
w{i + 1} AS MATERIALIZED (SELECT rep, k, list(w[j] - {rate} * (g + CASE WHEN j < 65 THEN {ridge} * w[j] ELSE 0 END) ORDER BY j) AS w FROM g{i} JOIN w{i} USING (rep, k) GROUP BY rep, k)"""
    return f"""{out},
acc AS (SELECT w.rep, k, count(*)::BIGINT AS n, avg(((list_dot_product(w, x) > 0)::INTEGER = y)::INTEGER) AS accuracy FROM w{steps} w JOIN r ON r.rep = w.rep AND fold = k GROUP BY w.rep, k)"""


def _binary(spark, d):
    rows = table(spark, d, "embeddings").filter("label IS NOT NULL")
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), (F.col("label") < 5).cast("int").alias("y"))


@query("probe_accuracy", f"WITH {_probe_sql(0, 10, 2.0)} SELECT k::INTEGER AS fold, n, round(accuracy, 6) AS accuracy FROM acc")
def _(spark, d):
    out = probing.probe_accuracy(_binary(spark, d), "embedding", "y", "vec_id", steps=10, rate=2.0)
    return out.select("fold", "n", r6("accuracy").alias("accuracy"))


@query(
    "probe_null",
    f"""WITH {_probe_sql(20, 6, 2.0)}, m AS (SELECT rep, avg(accuracy) AS a FROM acc GROUP BY rep), o AS (SELECT a AS accuracy FROM m WHERE rep = 0)
SELECT round(any_value(accuracy), 6) AS accuracy, round(avg(a), 6) AS null_mean, round(stddev_pop(a), 6) AS null_std, round(avg((a >= accuracy - 1e-12)::INTEGER), 6) AS p FROM m, o WHERE rep > 0""",
)
def _(spark, d):
    out = probing.probe_null(_binary(spark, d), "embedding", "y", "vec_id", 20, steps=6, rate=2.0)
    return out.select(*[r6(c).alias(c) for c in out.columns])


_HALVES = [("early", None, 249), ("late", 250, None), ("none", 10**9, None)]


@query(
    "subgroup_accuracy",
    " UNION ALL ".join(
        f"SELECT '{era}' AS era, sum(n)::BIGINT AS n, round(avg(accuracy), 6) AS accuracy FROM (WITH {_probe_sql(0, 6, 2.0, where=where)} SELECT * FROM acc)"
        for era, where in (("early", "label IS NOT NULL AND vec_id <= 249"), ("late", "label IS NOT NULL AND vec_id >= 250"))
    ),
)
def _(spark, d):
    """A probe in each half of the vectors; an era without rows has none."""
    fit = lambda df, vector, label, order: probing.probe_accuracy(df, vector, label, order, steps=6, rate=2.0)
    out = probe.subgroup_accuracy(_binary(spark, d), "embedding", "y", "vec_id", "vec_id", _HALVES, fit)
    return out.select("era", "n", r6("accuracy").alias("accuracy"))


@query("match_automaton", SQL["match_positions"])
def _(spark, d):
    """The automaton's accepted positions, counted by entry, are those of the fold and the join."""
    plain = units(spark, d).select("doc_id", normalise(F.col("text"), KEEP).alias("plain"))
    found = mt.match_positions(plain, "doc_id", "plain", lx.form_table(lx.table(spark, SIGNAL)))
    return found.groupBy("doc_id", "entry_id").agg(F.count(F.lit(1)).alias("tokens"))
