"""The analyses end to end: scored units in, tables out. Sources, lexicons, eras and thresholds are arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stanzaflow.functions.numeric import pooled, truthy
from stanzaflow.functions.text import IDEOGRAPHS, fixed, normalise
from stanzaflow.operators import density, inference
from stanzaflow.operators.lexicon import Lexicon
from stanzaflow.operators.matching import with_dual_score


def score(df: DataFrame, text: str, signal: Lexicon, control: Lexicon, least: float = 0.8, min_chars: int = 0, keep: str = IDEOGRAPHS, **kw) -> DataFrame:
    """Scored units of at least min_chars; the length is tested before matching, which gives the same rows."""
    long_enough = df.filter(F.length(normalise(F.col(text), keep)) >= min_chars) if min_chars else df
    return with_dual_score(long_enough, text, signal, control, least, keep=keep, **kw)


def trajectory(scored: DataFrame, eras: list = density.ERAS["trajectory"]) -> dict[str, DataFrame]:
    """Within-author: era densities, the rupture's bootstrap against all before, the changepoint of the yearly series."""
    by_year = scored.groupBy("year").agg(pooled("signal_weighted", "n_chars").alias("density"), F.sum("n_chars").alias("n_chars"))
    name, low, high = eras[1]
    before, during = scored.filter(F.col("year") < low), scored.filter(F.col("year").between(low, high))
    return {
        "eras": scored.agg(*density.era_columns(eras, "year", "signal_weighted", "n_chars")),
        "control": scored.agg(*density.era_columns(eras, "year", "control_tokens", "n_chars")),
        "bootstrap": inference.bootstrap_difference(before, during, ["year", "n_chars"], "signal_weighted", "n_chars", split=True),
        "changepoint": inference.changepoint(by_year, "year", "density"),
        "yearly": by_year.orderBy("year"),
    }


def curve(scored: DataFrame, year: str = "year") -> DataFrame:
    """n, signal and control density by year, in order, of units with a year that is neither null nor 0."""
    known = scored.filter(truthy(F.col(year)))
    return known.groupBy(year).agg(
        F.count(F.lit(1)).alias("n"), pooled("signal_weighted", "n_chars").alias("signal"), pooled("control_tokens", "n_chars").alias("control")
    ).orderBy(year)


def yearly(scored: DataFrame, author: str = "author", year: str = "year") -> DataFrame:
    """The lines of a file of schemas.YEARLY by year: densities of each unit as text with three decimals, its signal
    entries in first-hit order joined by `;`."""
    return scored.select(
        F.col(author).alias("author"), F.col(year).alias("year"), "n_chars", fixed(F.col("signal_density100")).alias("loyalist_density100"),
        fixed(F.col("control_density100")).alias("control_density100"), F.array_join("signal_entries", ";").alias("loyalist_entries"),
    ).orderBy("year")


def crosssource(sources: dict[str, DataFrame]) -> DataFrame:
    """n, signal and control density of each named source."""
    tagged = [df.select(F.lit(name).alias("source"), "n_chars", "signal_weighted", "control_tokens") for name, df in sources.items()]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    return union.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), pooled("signal_weighted", "n_chars").alias("signal"), pooled("control_tokens", "n_chars").alias("control")
    )


def equivalence(a: DataFrame, b: DataFrame, order: list[str], replicas: int = 10_000, seed: int = 42) -> DataFrame:
    """Bootstrap of two baselines' difference, and whether its interval holds 0."""
    boot = inference.bootstrap_difference(a, b, order, "signal_weighted", "n_chars", replicas, seed, split=True)
    return boot.withColumn("verdict", density.verdict(F.col("lo"), F.col("hi")))


def label_groups(authors: DataFrame, author: str, groups: dict[str, set[str]]) -> DataFrame:
    """One row: for each named set of labels the authors that have one, sorted and distinct. Authors are a few."""
    return authors.agg(*[F.sort_array(F.collect_set(F.when(F.col("label").isin(sorted(g)), F.col(author)))).alias(n) for n, g in groups.items()])


def validation(scored: DataFrame, author: str, label: str, seq: str, group: set[str], others: set[str], replicas: int = 10_000) -> dict[str, DataFrame]:
    """Authors' densities with their last label; the difference of two label groups with a permutation p."""
    authors = scored.groupBy(author).agg(
        F.max_by(label, seq).alias("label"), F.count(F.lit(1)).alias("n_units"), pooled("signal_weighted", "n_chars").alias("density")
    )
    both = scored.filter(F.col(label).isin(sorted(group | others))).withColumn("_group", F.col(label).isin(sorted(group)))
    return {
        "authors": authors,
        "groups": label_groups(authors, author, {"group": group, "others": others}),
        "permutation": inference.permutation_p(both, [seq], "_group", "signal_weighted", "n_chars", replicas),
    }
