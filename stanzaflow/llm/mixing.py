"""Operator 8, mixing sources to target weights by Sainte-Laguë apportionment.

The budget is cut into blocks of equally many tokens, BLOCK or, where a source's target is only a few of these,
fewer. Blocks go to sources, and within a source to its
shards, by highest quotients votes / (2 seats + 1), so that quotas are whole numbers. A shard's documents,
in an order given by the seed, form a token stream; of its blocks the quota is chosen evenly from a seeded
offset. A quota above the number of blocks takes every block once and chooses the rest anew, which is how
words repeat. A source's shards are as many as its size asks for: a hot source is dealt over many tasks.

Defined results: null or empty text has size 0 and is taken 0 times; a null source is a source of its own,
last in order; repeated rows are documents of their own, those that share a doc_id included; no rows give
no rows. Only named columns are read. A target of 0 takes nothing.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from stanzaflow.llm.scratch import materialise

WEIGHTS = (5.0, 2.0, 1.0)
#: Tokens in a block at most, blocks that the smallest target should have, and tokens that a shard should hold.
BLOCK, LEAST_BLOCKS, SHARD = 16, 16, 1 << 18
#: Shards that a source is dealt over at most, and sources that are broadcast at most (some 50 bytes each).
MOST_SHARDS, BROADCAST_SOURCES = 1 << 16, 100_000


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def apportion(votes: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Laguë: each seat goes to the highest votes / (2 seats held + 1), ties to the earlier place.

    A divisor slightly too large is found by bisection, which settles all but a few seats at once; the
    rest go by a heap of quotients.
    """
    votes = np.asarray(votes, float)
    held = np.zeros(len(votes), np.int64)
    if seats <= 0 or votes.sum() <= 0:
        return held
    low, high = 0.0, seats / votes.sum() + len(votes) / votes[votes > 0].min()
    for _ in range(200):
        mid = (low + high) / 2
        if np.floor(votes * mid + 0.5).sum() <= seats:
            low = mid
        else:
            high = mid
    # One less than the rounded share: a quotient that ties with the divisor's is dealt in order below.
    held = np.maximum(np.floor(votes * low + 0.5).astype(np.int64) - 1, 0)
    queue = [(-v / (2 * h + 1), i) for i, (v, h) in enumerate(zip(votes, held, strict=True)) if v > 0]
    heapq.heapify(queue)
    for _ in range(int(seats - held.sum())):
        _, i = queue[0]
        held[i] += 1
        heapq.heapreplace(queue, (-votes[i] / (2 * held[i] + 1), i))
    return held


def apportion_within(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by apportion, of which none holds more than its most: what is over goes to the others, as far as there is room."""
    held, open_ = np.zeros(len(votes), np.int64), np.asarray(votes) > 0
    while open_.any() and seats > held.sum():
        dealt = apportion(np.where(open_, votes, 0), seats - held[~open_].sum())
        over = open_ & (dealt > most)
        held[open_] = np.minimum(dealt, most)[open_]
        if not over.any():
            break
        open_ &= ~over
    return held


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, target. Sources by code point, null last, weigh as weights repeat. Targets are the
    water level times the weight, stopped at cap times the size. One row for each source is windowed."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    filled = Window.orderBy("ratio", "place")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    table = F.array(*[F.lit(float(w)) for w in weights])
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = totals.withColumn("place", F.row_number().over(by_name) - 1)
    placed = placed.withColumn("weight", F.get(table, F.col("place") % len(weights)))
    placed = placed.withColumn("limit", cap * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    budget = share * F.sum("source_size").over(every)
    level = (budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # In order of ratio, the first source that the level does not fill ends the filling.
    levelled = placed.withColumn("level", level)
    open_ = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(every)
    levelled = levelled.withColumn("final", open_["level"])
    target = F.when(F.col("final").isNull(), F.col("limit")).otherwise(
        F.least(F.col("limit"), F.col("final") * F.col("weight"))
    )
    return levelled.select("source", "place", "source_size", target.alias("target"))


def draw(*parts: Column) -> Column:
    """60 bits of an MD5 of parts, nulls left out: the same in another engine."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def block_size(targets: DataFrame) -> int:
    """BLOCK, or less where the smallest target would have few blocks; never under one token."""
    least = targets.filter("target > 0").agg(F.min("target")).first()[0]
    return BLOCK if least is None else max(1, min(BLOCK, int(least // LEAST_BLOCKS)))


def mix(sizes: DataFrame, targets: DataFrame, key: str, seed: int = 0, block: int | None = None, shard: int = SHARD) -> DataFrame:
    """sizes (key, source, size) with source_size, target and taken, the words that the mix takes."""
    block = block or block_size(targets)
    targets = targets.withColumnRenamed("source", "_of")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    n_shards = F.least(F.ceil(F.col("source_size") / F.lit(float(shard))), F.lit(MOST_SHARDS))
    placed = sizes.join(targets, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    placed = placed.withColumn("shard", draw(F.lit(seed), F.col(key)) % F.greatest(n_shards, F.lit(1)))

    def seats_of_sources(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        rows["seats"] = apportion(rows["target"].to_numpy(), round(rows["target"].sum() / block))
        return rows[["place", "seats"]]

    def seats_of_shards(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        size = rows["shard_size"].to_numpy()
        # A block is taken twice at most.
        rows["quota"] = apportion_within(size, int(rows["seats"].iloc[0]), 2 * np.maximum(-(-size // block), 1))
        return rows[["place", "shard", "shard_size", "quota"]]

    # A constant key gathers a row for each source; a source's key gathers a row for each of its shards.
    together = targets.select("place", "target", F.lit(0).alias("all"))
    seats = together.groupBy("all").applyInPandas(seats_of_sources, "place int, seats long")
    shards = placed.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"))
    quotas = shards.join(seats, "place").groupBy("place").applyInPandas(
        seats_of_shards, "place int, shard long, shard_size long, quota long"
    )
    stream = Window.partitionBy("place", "shard").orderBy(draw(F.lit(seed + 1), F.col(key)), key, "size")
    placed = placed.withColumn("finish", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(quotas, ["place", "shard"])
    length = F.lit(block).cast("long")
    blocks = F.greatest(F.ceil(F.col("shard_size") / F.lit(float(block))), F.lit(1))
    quota = F.col("quota")
    offset = draw(F.lit(seed + 2), F.col("place"), F.col("shard")) % blocks

    def div(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    def first(n: Column) -> Column:
        """How many of the stream's first n blocks are taken, repeats counted; all of them: the quota."""
        return div(n * quota + offset, blocks)

    def words(upto: Column) -> Column:
        """Words taken from the stream's first upto words."""
        n = F.least(div(upto, length), blocks - 1)
        return length * first(n) + (first(n + 1) - first(n)) * (upto - n * length)

    taken = words(F.col("finish")) - words(F.col("finish") - F.col("size"))
    return placed.withColumn("taken", taken).select(*sizes.columns, "source_size", "target", "taken")


def op8(documents: DataFrame, seed: int = 0) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken."""
    sizes = materialise(documents.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    mixed = mix(sizes, materialise(source_targets(sizes)), "doc_id", seed)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
