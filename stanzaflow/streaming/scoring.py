"""The scorer on streams: matching is a narrow, stateless projection, so the batch function serves as it is."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from stanzaflow.functions.numeric import ratio100
from stanzaflow.operators.lexicon import Lexicon
from stanzaflow.operators.matching import with_dual_score


def score_stream(stream: DataFrame, text: str, signal: Lexicon, control: Lexicon, min_specificity: float = 0.0, exclude: Iterable[str] = (), **kw: str) -> DataFrame:
    """A stream with the columns of with_dual_score."""
    return with_dual_score(stream, text, signal, control, min_specificity, exclude, **kw)


def windowed_density(scored: DataFrame, time: str, every: str, late: str) -> DataFrame:
    """Pooled densities by event-time window: a sum pair of state each, dropped once the watermark has passed."""
    windows = scored.withWatermark(time, late).groupBy(F.window(time, every).alias("window"))
    sums = windows.agg(F.sum("signal_weighted").alias("w"), F.sum("control_tokens").alias("t"), F.sum("n_chars").alias("n"), F.count(F.lit(1)).alias("units"))
    return sums.select("window", "units", ratio100(F.col("w"), F.col("n")).alias("signal_density"), ratio100(F.col("t"), F.col("n")).alias("control_density"))
