"""Parameters for the driver's tables, whose texts have no ideographs: a Latin alphabet and small lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stanzaflow.operators.lexicon import Entry, Lexicon
from stanzaflow.sources.files import spread

KEEP = "A-Za-z"
SIGNAL = Lexicon(
    (
        Entry("gather", ("thering", "ther"), "fall", 1.0),
        Entry("nation", ("nation", "tion"), "loyalty", 0.9),
        Entry("andthe", ("andthe", "the"), "diction", 0.5),
        Entry("ingof", ("ingof", "ing"), "fall", 0.8),
        Entry("verde", ("verde", "ver"), "exile", 0.85),
        Entry("lich", ("lich", "einge"), "exile", 0.8),
    )
)
CONTROL = Lexicon(
    (
        Entry("and", ("andof", "and"), "season"),
        Entry("que", ("quede", "que"), "plant"),
        Entry("ment", ("mentde", "ment"), "wind"),
        Entry("ado", ("asado", "ado"), "moon"),
    )
)
#: name, least specificity, excluded categories, mode.
SETTINGS = [
    ("high presence", 0.8, (), "weighted"),
    ("full presence", 0.0, (), "weighted"),
    ("full tokens", 0.0, (), "tokens"),
    ("minus exile", 0.8, ("exile",), "weighted"),
    ("minus loyalty", 0.8, ("loyalty",), "weighted"),
    ("minus both", 0.8, ("exile", "loyalty"), "weighted"),
]
YEAR = "1600 + (doc_id * 37) % 351"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a year made of doc_id."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("year", F.expr(f"CAST({YEAR} AS INT)"))


def _chain(name: str, source: str, text: str, lexicon: Lexicon, tag: str) -> str:
    """SQL that matches by nested replacement: CTEs name_0 .. name with a column of hits for each form."""
    forms = lexicon.ordered()
    parts = [f"{name}_0 AS (SELECT *, regexp_replace(coalesce({text}, ''), '[^{KEEP}]', '', 'g') AS {tag}_s0 FROM {source})"]
    for i, form, _ in forms:
        here = name if i == len(forms) else f"{name}_{i}"
        s = f"{tag}_s{i - 1}"
        parts.append(
            f"{here} AS (SELECT * EXCLUDE ({s}), length({s}) AS {tag}_n{i}, (length({s}) - length(replace({s}, '{form}', ''))) // {len(form)} AS {tag}_h{i},"
            f" replace({s}, '{form}', '{'#' * len(form)}') AS {tag}_s{i} FROM {name}_{i - 1})"
        )
    return ",\n".join(parts)


class Sql:
    """Expressions over the columns of a chain."""

    def __init__(self, name: str, source: str, lexicon: Lexicon, tag: str, text: str = "text") -> None:
        self.ctes = _chain(name, source, text, lexicon, tag)
        self.lexicon, self.tag, self.n = lexicon, tag, f"{tag}_n1"

    def of(self, entry: str) -> str:
        return "(" + " + ".join(f"{self.tag}_h{i}" for i, _, e in self.lexicon.ordered() if e.id == entry) + ")"

    @property
    def tokens(self) -> str:
        return "(" + " + ".join(f"{self.tag}_h{i}" for i, _, _ in self.lexicon.ordered()) + ")"

    def weight(self, category: str | None = None) -> str:
        parts = [f"CASE WHEN {self.of(e.id)} > 0 THEN {e.specificity}::DOUBLE ELSE 0 END" for e in self.lexicon.entries if category in (None, e.category)]
        return "(" + (" + ".join(parts) or "0::DOUBLE") + ")"


UNITS = f"u AS (SELECT *, ({YEAR})::INTEGER AS year FROM documents)"


def scored(lexicon: Lexicon = SIGNAL, least: float = 0.8, exclude: tuple = ()) -> str:
    """CTEs up to `scored`: units with n, w, t (signal, filtered) and cw, ct (control)."""
    s, c = Sql("m", "u", lexicon.keep(least, exclude), "s"), Sql("k", "m", CONTROL, "c")
    return (
        f"{UNITS},\n{s.ctes},\n{c.ctes},\n"
        f"scored AS (SELECT doc_id, lang, source, year, s_n1 AS n, {s.weight()} AS w, {s.tokens} AS t, {c.weight()} AS cw, {c.tokens} AS ct FROM k)"
    )


def density(num: str, den: str = "n") -> str:
    """A pooled density in SQL, 0 without characters."""
    return f"coalesce(100.0::DOUBLE * sum({num}) / nullif(sum({den}), 0), 0)"
