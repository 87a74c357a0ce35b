"""The engine's queries over the driver's tables, each with DuckDB SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stanzaflow.functions import numeric, text as tx
from stanzaflow.operators import density as dn, inference, lexicon as lx, matching as mt, selecting as sl
from stanzaflow.plans import analyses
from stanzaflow.plans.sample import CONTROL, KEEP, SETTINGS, SIGNAL, UNITS, Sql, density, scored as scored_sql, units
from stanzaflow.sources.files import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def scored(spark: SparkSession, d: str, least: float = 0.8, **kw) -> DataFrame:
    return mt.with_dual_score(units(spark, d), "text", SIGNAL, CONTROL, least, keep=KEEP, **kw)


# ---- matching -----------------------------------------------------------------------------------------


@query(
    "normalize_text",
    f"""SELECT doc_id, length(s)::BIGINT AS n_chars, md5(s) AS digest
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^{KEEP}]', '', 'g') AS s FROM documents)""",
)
def _(spark, d):
    plain = tx.normalise(F.col("text"), KEEP)
    return table(spark, d, "documents").select("doc_id", long(F.length(plain)).alias("n_chars"), F.md5(plain).alias("digest"))


@query(
    "lexicon_ordered",
    """WITH f AS (SELECT p_brand, p_name, dense_rank() OVER (ORDER BY p_brand) AS ep, p_partkey AS fp, (p_size % 10 + 1) / 10.0::DOUBLE AS s FROM part)
SELECT row_number() OVER (ORDER BY length(p_name) DESC, ep, fp)::BIGINT AS ord, p_name AS form, p_brand AS entry_id, left(p_brand, 7) AS category,
  max(s) OVER (PARTITION BY p_brand) AS specificity FROM f""",
)
def _(spark, d):
    """The parts of each brand as an entry's forms."""
    forms = F.array_sort(F.collect_list(F.struct("p_partkey", "p_name")))
    entries = table(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(
        F.transform(forms, lambda f: f["p_name"]).alias("forms"), F.max((F.col("p_size") % 10 + 1) / F.lit(10.0)).alias("specificity")
    )
    entries = sl.placed(entries.withColumn("category", F.substring("id", 1, 7)), [], ["id"], "entry_pos")
    return lx.form_table(entries).select(long("ord").alias("ord"), "form", "entry_id", "category", "specificity")


@query("match_tokens", f"WITH {scored_sql()} SELECT doc_id, n::BIGINT AS n_chars, t::BIGINT AS tokens FROM scored")
def _(spark, d):
    return scored(spark, d).select("doc_id", long("n_chars").alias("n_chars"), long("signal_tokens").alias("tokens"))


@query("match_presence", f"WITH {scored_sql(least=0.0)} SELECT doc_id, round(w, 6) AS weighted, round(coalesce(100 * w / nullif(n, 0), 0), 6) AS density FROM scored")
def _(spark, d):
    return scored(spark, d, 0.0).select("doc_id", r6("signal_weighted").alias("weighted"), r6("signal_density100").alias("density"))


@query(
    "dual_score",
    f"""WITH {scored_sql()} SELECT doc_id, n::BIGINT AS n_chars, round(w, 6) AS signal_weighted, t::BIGINT AS signal_tokens,
  round(coalesce(100 * w / nullif(n, 0), 0), 6) AS signal_density100, round(cw, 6) AS control_weighted, ct::BIGINT AS control_tokens,
  round(coalesce(100.0::DOUBLE * ct / nullif(n, 0), 0), 6) AS control_density100 FROM scored""",
)
def _(spark, d):
    s = scored(spark, d)
    return s.select(
        "doc_id", long("n_chars").alias("n_chars"), r6("signal_weighted").alias("signal_weighted"), long("signal_tokens").alias("signal_tokens"),
        r6("signal_density100").alias("signal_density100"), r6("control_weighted").alias("control_weighted"),
        long("control_tokens").alias("control_tokens"), r6("control_density100").alias("control_density100"),
    )


_FORMS = [f for _, f, _ in SIGNAL.ordered()]


@query(
    "contains_count",
    "SELECT doc_id, (" + " + ".join(f"contains(coalesce(text, ''), '{f}')::BIGINT" for f in _FORMS) + ")::BIGINT AS forms FROM documents",
)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", long(mt.contains_count(F.col("text"), _FORMS)).alias("forms"))


_ALL = Sql("m", "u", SIGNAL, "s")


@query(
    "match_positions",
    f"""WITH {UNITS}, {_ALL.ctes}
SELECT doc_id, entry_id, sum(n)::BIGINT AS tokens FROM ("""
    + " UNION ALL ".join(f"SELECT doc_id, '{e.id}' AS entry_id, {_ALL.of(e.id)} AS n FROM m" for e in SIGNAL.entries)
    + ") WHERE n > 0 GROUP BY ALL",
)
def _(spark, d):
    """The join plan: its accepted positions counted by entry equal the fold's."""
    plain = units(spark, d).select("doc_id", tx.normalise(F.col("text"), KEEP).alias("plain"))
    found = mt.match_by_grams(plain, "doc_id", "plain", lx.form_table(lx.table(spark, SIGNAL)))
    return found.groupBy("doc_id", "entry_id").agg(F.count(F.lit(1)).alias("tokens"))


# ---- densities ----------------------------------------------------------------------------------------

_MID, _RUP = "year BETWEEN 1700 AND 1860", "year >= 1894"
_HIGH = SIGNAL.keep(0.8)
_H = Sql("m", "u", _HIGH, "s")


@query(
    "category_density",
    f"""WITH {UNITS}, {_H.ctes}, c AS ("""
    + " UNION ALL ".join(f"SELECT year, s_n1 AS n, '{c}' AS category, {_H.weight(c)} AS w FROM m" for c in _HIGH.categories())
    + f"""), e AS (SELECT c.*, CASE WHEN {_MID} THEN 'mid' WHEN {_RUP} THEN 'rupture' END AS era FROM c)
SELECT category, era, round({density("w")}, 6) AS density FROM e WHERE era IS NOT NULL GROUP BY ALL""",
)
def _(spark, d):
    eras = dn.era_table(spark, [("mid", 1700, 1860), ("rupture", 1894, None)])
    cells = dn.category_values(dn.in_eras(units(spark, d), "year", eras), "text", _HIGH, KEEP)
    return cells.groupBy("category", "era").agg(r6(numeric.pooled("value", "n_chars")).alias("density"))


def _settings_sql(names: list[str]) -> tuple[str, str]:
    """CTEs and a union of (config, year, n, value)."""
    ctes, parts = [UNITS], []
    for i, (name, least, exclude, mode) in enumerate(SETTINGS):
        if name in names:
            s = Sql(f"m{i}", "u", SIGNAL.keep(least, exclude), f"s{i}")
            ctes.append(s.ctes)
            parts.append(f"SELECT '{name}' AS config, year, {s.n} AS n, {s.tokens if mode == 'tokens' else s.weight()}::DOUBLE AS v FROM m{i}")
    return ",\n".join(ctes), " UNION ALL ".join(parts)


_ABLATED = ["high presence", "minus exile", "minus loyalty", "minus both"]
_A = _settings_sql(_ABLATED)
_R = _settings_sql([s[0] for s in SETTINGS])


def _era_density(where: str, num: str = "v") -> str:
    return f"coalesce(100.0::DOUBLE * sum({num}) FILTER ({where}) / nullif(sum(n) FILTER ({where}), 0), 0)"


@query(
    "ablation_pivot",
    f"""WITH {_A[0]}, c AS ({_A[1]})
SELECT config, round({_era_density("year <= 1683")}, 6) AS founding, round({_era_density(_MID)}, 6) AS mid, round({_era_density(_RUP)}, 6) AS rupture
FROM c GROUP BY config""",
)
def _(spark, d):
    configs = [s for s in SETTINGS if s[0] in _ABLATED]
    era_rows = dn.in_eras(units(spark, d), "year", dn.era_table(spark, dn.ERAS["ablation"]))
    cells = dn.scored_by_configs(era_rows, "text", SIGNAL, configs, KEEP)
    return cells.groupBy("config").pivot("era", ["founding", "mid", "rupture"]).agg(r6(numeric.pooled("value", "n_chars")))


@query(
    "detector_robustness",
    f"""WITH {_R[0]}, c AS ({_R[1]}), x AS (
  SELECT config, {_era_density(_MID)} AS mid, {_era_density(_RUP)} AS rupture FROM c GROUP BY config)
SELECT config, round(mid, 6) AS mid, round(rupture, 6) AS rupture, round(rupture - mid, 6) AS diff,
  CASE WHEN mid <> 0 AND rupture <> 0 THEN round(rupture / mid, 6) ELSE 'NaN'::DOUBLE END AS ratio FROM x""",
)
def _(spark, d):
    cells = dn.scored_by_configs(units(spark, d), "text", SIGNAL, SETTINGS, KEEP)
    eras = [(n, a, b) for n, a, b in dn.ERAS["ablation"] if n != "founding"]
    by = cells.groupBy("config").agg(*dn.era_columns(eras, "year", "value", "n_chars"))
    out = dn.difference_and_ratio(by, "mid_density", "rupture_density")
    return out.select("config", r6("mid_density").alias("mid"), r6("rupture_density").alias("rupture"), r6("diff").alias("diff"), r6("ratio").alias("ratio"))


def _by(column: str) -> str:
    return f"""WITH {scored_sql()} SELECT {column}, count(*)::BIGINT AS n, round({density("w")}, 6) AS signal, round({density("ct")}, 6) AS control
FROM scored GROUP BY {column}"""


def _grouped(s: DataFrame, column: str) -> DataFrame:
    return s.groupBy(column).agg(
        F.count(F.lit(1)).alias("n"), r6(numeric.pooled("signal_weighted", "n_chars")).alias("signal"), r6(numeric.pooled("control_tokens", "n_chars")).alias("control")
    )


@query("pooled_by_lang", _by("lang"))
def pooled_by_lang(spark, d):
    return _grouped(scored(spark, d), "lang")


@query("pooled_by_source", _by("source"))
def _(spark, d):
    return _grouped(scored(spark, d), "source")


@query("yearly_curve", _by("year"))
def _(spark, d):
    c = analyses.curve(scored(spark, d))
    return c.select("year", "n", r6("signal").alias("signal"), r6("control").alias("control"))


_LABEL = "CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' ELSE 'unknown' END"


@query(
    "author_label_density",
    f"""WITH {scored_sql()}, l AS (SELECT scored.*, {_LABEL} AS label FROM scored LEFT JOIN labels USING (doc_id))
SELECT source, arg_max(label, doc_id) AS label, count(*)::BIGINT AS n_units, round({density("w")}, 6) AS density FROM l GROUP BY source""",
)
def _(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("label"))
    joined = sl.lookup(scored(spark, d), labels, "doc_id", {"label": "unknown"})
    authors = joined.groupBy("source").agg(
        F.max_by("label", "doc_id").alias("label"), F.count(F.lit(1)).alias("n_units"), r6(numeric.pooled("signal_weighted", "n_chars")).alias("density")
    )
    return authors


_ERA3 = [("pre", "year BETWEEN 1600 AND 1894"), ("rupture", "year BETWEEN 1895 AND 1900"), ("post", "year BETWEEN 1901 AND 1950")]


@query("era_filter_agg", f"WITH {scored_sql()} SELECT " + ", ".join(f"round({_era_density(w, 'w')}, 6) AS {n}_density" for n, w in _ERA3) + " FROM scored")
def _(spark, d):
    out = scored(spark, d).agg(*dn.era_columns(dn.ERAS["trajectory"], "year", "signal_weighted", "n_chars"))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(
    "era_range_join",
    f"""WITH {scored_sql()}, e(era, low, high) AS (VALUES ('founding', -9999, 1683), ('mid', 1700, 1860), ('pre', -9999, 1893), ('rupture', 1894, 9999))
SELECT era, count(*)::BIGINT AS n, round({density("w")}, 6) AS signal, round({density("ct")}, 6) AS control
FROM scored JOIN e ON year BETWEEN low AND high GROUP BY era""",
)
def _(spark, d):
    return _grouped(dn.in_eras(scored(spark, d), "year", dn.era_table(spark, dn.ERAS["anthology"])), "era")


@query("min_length_filter", f"WITH {scored_sql()} SELECT least, count(*)::BIGINT AS n, sum(n)::BIGINT AS chars FROM scored JOIN (VALUES (16), (20), (80)) t(least) ON n >= least GROUP BY least")
def _(spark, d):
    lengths = units(spark, d).select(F.length(tx.normalise(F.col("text"), KEEP)).alias("n"))
    kept = [lengths.filter(sl.length_band(F.col("n"), k)).agg(F.lit(k).alias("least"), F.count(F.lit(1)).alias("n"), F.sum(long("n")).alias("chars")) for k in (16, 20, 80)]
    return kept[0].union(kept[1]).union(kept[2])


@query(
    "crosssource_summary",
    f"""WITH {scored_sql()}, t AS (
  SELECT 'independent' AS source, n, w, ct FROM scored WHERE n >= 16 AND lang = 'de'
  UNION ALL SELECT 'anthology_mid', n, w, ct FROM scored WHERE n >= 16 AND lang = 'en' AND {_MID}
  UNION ALL SELECT 'anthology_rupture', n, w, ct FROM scored WHERE n >= 16 AND lang = 'en' AND {_RUP})
SELECT source, count(*)::BIGINT AS n, round({density("w")}, 6) AS signal, round({density("ct")}, 6) AS control FROM t GROUP BY source""",
)
def _(spark, d):
    s = analyses.score(units(spark, d), "text", SIGNAL, CONTROL, 0.8, 16, KEEP)
    en = s.filter("lang = 'en'")
    out = analyses.crosssource({"independent": s.filter("lang = 'de'"), "anthology_mid": en.filter(_MID), "anthology_rupture": en.filter(_RUP)})
    return out.select("source", "n", r6("signal").alias("signal"), r6("control").alias("control"))


@query(
    "did_contrast",
    f"""WITH {scored_sql()}, x AS (SELECT {_era_density(_RUP, "w")} - {_era_density(_MID, "w")} AS s, {_era_density(_RUP, "ct")} - {_era_density(_MID, "ct")} AS c FROM scored)
SELECT round(s, 6) AS signal_diff, round(c, 6) AS control_diff, round(s - c, 6) AS did FROM x""",
)
def _(spark, d):
    era = F.when(F.expr(_MID), "mid").when(F.expr(_RUP), "rupture")
    out = inference.contrast(scored(spark, d).withColumn("era", era), "era", "mid", "rupture", "signal_weighted", "control_tokens", "n_chars")
    return out.select(*[r6(c).alias(c) for c in out.columns])
