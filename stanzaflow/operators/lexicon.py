"""Lexicons: entries with forms, in the order in which matching tries them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from stanzaflow import schemas
from stanzaflow.operators.scans import ranked


@dataclass(frozen=True)
class Entry:
    id: str
    forms: tuple[str, ...]
    category: str
    specificity: float = 1.0


@dataclass(frozen=True)
class Lexicon:
    """Entries in file order. Small by nature: it becomes part of a plan."""

    entries: tuple[Entry, ...]

    def keep(self, min_specificity: float = 0.0, exclude: Iterable[str] = ()) -> Lexicon:
        """What a filtered match uses: filters act before matching, so that shorter forms may surface."""
        out = set(exclude)
        return Lexicon(tuple(e for e in self.entries if e.specificity >= min_specificity and e.category not in out))

    def ordered(self) -> list[tuple[int, str, Entry]]:
        """(place, form, entry): longer forms first, ties in file order."""
        forms = [(form, e) for e in self.entries for form in e.forms]
        return [(i + 1, f, e) for i, (f, e) in enumerate(sorted(forms, key=lambda x: -len(x[0])))]

    def categories(self) -> list[str]:
        return sorted({e.category for e in self.entries})


def entries_table(document: DataFrame) -> DataFrame:
    """entry_pos and an entry's fields, from a lexicon document."""
    return document.select(F.posexplode("entries").alias("entry_pos", "e")).select("entry_pos", "e.*")


def form_table(entries: DataFrame) -> DataFrame:
    """The ordered forms of entries (entry_pos, id, forms, category, specificity); specificity defaults to 1."""
    forms = entries.select(
        "entry_pos", F.posexplode("forms").alias("form_pos", "form"), F.col("id").alias("entry_id"), "category",
        F.coalesce("specificity", F.lit(1.0)).alias("specificity"),
    )
    forms = forms.withColumn("form_len", F.length("form")).withColumn("_shorter", -F.length("form"))
    placed = ranked(forms, [], ["_shorter", "entry_pos", "form_pos"], "ord").withColumn("ord", F.col("ord").cast("int") + 1)
    return placed.select("ord", "form", "form_len", "entry_id", "category", "specificity")


def load(spark: SparkSession, path: str) -> Lexicon:
    """A lexicon document (one JSON object) from any path that Spark reads."""
    document = spark.read.schema(schemas.LEXICON).option("multiLine", True).json(path)
    rows = entries_table(document).orderBy("entry_pos").collect()
    return Lexicon(tuple(Entry(r.id, tuple(r.forms), r.category, 1.0 if r.specificity is None else r.specificity) for r in rows))


def table(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    """The entries of a lexicon as a table for form_table."""
    rows = [(i, e.id, list(e.forms), e.category, e.specificity) for i, e in enumerate(lexicon.entries)]
    return spark.createDataFrame(rows, "entry_pos int, id string, forms array<string>, category string, specificity double")
