"""Eras, configurations and pooled densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stanzaflow.functions.numeric import pooled
from stanzaflow.functions.text import normalise
from stanzaflow.operators.lexicon import Lexicon
from stanzaflow.operators.matching import fold, raw_tokens, weighted_presence

#: Era bounds by analysis, inclusive; they overlap, leave gaps and disagree on purpose.
ERAS = {
    "trajectory": [("pre", 1600, 1894), ("rupture", 1895, 1900), ("post", 1901, 1950)],
    "anthology": [("founding", None, 1683), ("mid", 1700, 1860), ("pre", None, 1893), ("rupture", 1894, None)],
    "ablation": [("founding", None, 1683), ("mid", 1700, 1860), ("rupture", 1894, None)],
    "crosssource": [("mid", 1700, 1860), ("rupture", 1894, None), ("single_rupture", 1895, 1900), ("single_post", 1901, None)],
}

#: Intervals that are broadcast, at most.
BROADCAST_INTERVALS = 10_000


def era_table(spark: SparkSession, eras: list[tuple[str, int | None, int | None]]) -> DataFrame:
    """era, low, high with open ends filled."""
    return spark.createDataFrame([(n, -(1 << 31) if a is None else a, (1 << 31) - 1 if b is None else b) for n, a, b in eras], "era string, low long, high long")


def in_eras(df: DataFrame, year: str, eras: DataFrame) -> DataFrame:
    """df once for each era that holds its year, bounds inclusive."""
    return in_intervals(df, year, eras)


def in_intervals(df: DataFrame, point: str, intervals: DataFrame, broadcast_rows: int = BROADCAST_INTERVALS) -> DataFrame:
    """df once for each interval (low, high, ..: whole numbers, inclusive) that holds its point, with the interval's other columns.

    A few intervals, which are counted, are broadcast. More meet the points by equality of bins: an interval lies in one or two bins of the least
    power of two that is as long as itself, and a point looks into one bin of each of those sizes that are in use, at most 64.
    """
    few = intervals.limit(broadcast_rows + 1).count() <= broadcast_rows
    if few:
        return df.join(F.broadcast(intervals), F.col(point).between(F.col("low"), F.col("high"))).drop("low", "high")
    level = F.least(F.lit(62), F.ceil(F.log2(F.col("high").cast("double") - F.col("low").cast("double") + 1)).cast("int"))
    right = intervals.filter("low <= high").withColumn("_level", level)
    levels = [r[0] for r in right.select("_level").distinct().collect()]  # at most 63 numbers
    shift = lambda x: F.call_function("shiftright", F.col(x).cast("long"), F.col("_level"))
    right = right.withColumn("_bin", F.explode(F.sequence(shift("low"), shift("high"))))
    left = df.filter(F.col(point).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>"))).withColumn("_bin", shift(point))
    met = left.join(right, ["_level", "_bin"]).filter(F.col(point).between(F.col("low"), F.col("high")))
    return met.drop("_level", "_bin", "low", "high")


def era_columns(eras: list[tuple[str, int | None, int | None]], year: str, num: str, den: str) -> list[Column]:
    """A pooled density for each era as one aggregation without a join."""

    def inside(low: int | None, high: int | None) -> Column:
        test = F.col(year).isNotNull()
        if low is not None:
            test &= F.col(year) >= low
        return test & (F.col(year) <= high) if high is not None else test

    return [pooled(F.when(inside(a, b), F.col(num)), F.when(inside(a, b), F.col(den))).alias(f"{n}_density") for n, a, b in eras]


def scored_by_configs(df: DataFrame, text: str, lexicon: Lexicon, configs: list[tuple[str, float, tuple[str, ...], str]], keep: str) -> DataFrame:
    """df with n_chars and an exploded (config, value) for each (name, least specificity, excluded categories, mode).

    Filters act before matching, so that configurations match anew unless they keep the same entries, all in one narrow
    stage; mode is 'weighted' or 'tokens'.
    """
    plain = df.withColumn("_plain", normalise(F.col(text), keep))
    kept = list(dict.fromkeys(lexicon.keep(least, exclude) for _, least, exclude, _ in configs))
    for i, used in enumerate(kept):
        plain = plain.withColumn(f"_hits{i}", fold(F.col("_plain"), used))
    cells = []
    for name, least, exclude, mode in configs:
        used = lexicon.keep(least, exclude)
        hits = F.col(f"_hits{kept.index(used)}")
        value = raw_tokens(hits).cast("double") if mode == "tokens" else weighted_presence(hits, used)
        cells.append(F.struct(F.lit(name).alias("config"), value.alias("value")))
    out = plain.withColumn("n_chars", F.length("_plain")).withColumn("_cell", F.explode(F.array(*cells)))
    return out.select(*_others(df, "config"), "n_chars", "_cell.config", "_cell.value")


def category_values(df: DataFrame, text: str, lexicon: Lexicon, keep: str) -> DataFrame:
    """df with n_chars and an exploded (category, value): one match with all entries, weights by category after."""
    plain = df.withColumn("_plain", normalise(F.col(text), keep)).withColumn("_hits", fold(F.col("_plain"), lexicon))
    cells = [F.struct(F.lit(c).alias("category"), weighted_presence(F.col("_hits"), lexicon, c).alias("value")) for c in lexicon.categories()]
    out = plain.withColumn("n_chars", F.length("_plain")).withColumn("_cell", F.explode(F.array(*cells)))
    return out.select(*_others(df, "category"), "n_chars", "_cell.category", "_cell.value")


def _others(df: DataFrame, name: str) -> list[str]:
    """Columns of df that the result doesn't bring anew."""
    return [c for c in df.columns if c not in ("n_chars", name, "value")]


def difference_and_ratio(df: DataFrame, low: str, high: str) -> DataFrame:
    """df with diff, and ratio, which is NaN where either side is 0."""
    ratio = F.when((F.col(low) != 0) & (F.col(high) != 0), F.try_divide(high, low)).otherwise(F.lit(float("nan")))
    return df.withColumn("diff", F.col(high) - F.col(low)).withColumn("ratio", ratio)


def verdict(low: Column, high: Column) -> Column:
    """AGREE if an interval holds 0."""
    return F.when((low <= 0) & (high >= 0), "AGREE").otherwise("differ")
