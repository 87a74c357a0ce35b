"""Resampling and segmentation inference as relational plans.

Draws are hashes of (seed, stratum, replicate, draw): they don't depend on partitioning, and another engine
can repeat them. Exact resamples come in two ways: by number (rows are numbered from 0 and draws are joined), or split, where the
draws of each replicate are dealt to shards of rows by hashed binomials and made inside them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stanzaflow.functions import draws
from stanzaflow.functions.numeric import hashed_draw, pooled, ratio100
from stanzaflow.operators.scans import ranked
from stanzaflow.sources.scratch import materialise

#: Rows of a shard that draws are dealt to, about; bits that number shards, at most; draws made at once in a task.
SHARD_ROWS, SHARD_BITS, DRAWS = 2048, 16, 1 << 17
#: Copies of rows of a shard that are told apart by an array of places; beyond, by searching.
SPREAD = 1 << 22
#: Draws of a block of shards that one call makes, at most, if it has several shards; replicates dealt to blocks together.
BLOCK_DRAWS, DEALT = 1 << 24, 64
#: Bins that a replicate's hashes are counted in, in one pass; replicates whose counts are merged together; bits of a hash.
BINS, TOGETHER, HASH_BITS = 64, 128, 62


def clusters(df: DataFrame, cluster: str, num: str, den: str) -> DataFrame:
    """num, den summed by cluster: drawing clusters with all their rows is drawing these sums. Null is a cluster."""
    return df.groupBy(cluster).agg(F.sum(num).alias(num), F.sum(den).alias(den))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _idx from 0 and the row count _size."""
    return ranked(df, [], order, "_idx", "_size")


def replicates(df: DataFrame, order: list[str], num: str, den: str, stratum: str, b: int, seed: int) -> DataFrame:
    """rep, density: pooled densities of b resamples with replacement, as many draws as rows."""
    rows = numbered(df.select(*dict.fromkeys([*order, num, den])), order)
    spark = df.sparkSession
    n = rows.agg(F.max("_size")).first()[0] or 0
    draws = spark.range(b * n).select(F.floor(F.col("id") / max(n, 1)).alias("rep"), (F.col("id") % max(n, 1)).alias("draw"))
    draws = draws.withColumn("_idx", hashed_draw(F.lit(max(n, 1)), F.lit(seed), F.lit(stratum), F.col("rep"), F.col("draw")))
    return draws.join(rows, "_idx").groupBy("rep").agg(pooled(num, den).alias("density"))


def split_replicates(df: DataFrame, key: list[str], num: str, den: str, stratum: str, b: int, seed: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """rep, density, draws: b exact resamples with replacement, as many draws as rows, without b rows for each row.

    Rows lie in 2^bits shards by the hash of their key. A replicate's n draws go down the tree of shards: at a node
    with k draws the left half gets Binomial(k, its share of the rows), by a hash of (replicate, node). The upper levels, down to blocks
    of neighbouring shards, are walked once for each replicate. A block takes its draws down to its shards, makes them by hashes of
    (replicate, shard, draw) and hands on one sum by replicate, so that a path isn't walked anew for each shard. Rows with the same key and values are one row with a count, so that copies don't fill a shard. The driver sees one count a shard.
    """
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key])), 1, 8), 16, 10).cast("long")
    # The key's own string orders the rows of a shard, so that any split of the table gives the same draws.
    name = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    rows = df.select(hashed.alias("hash"), name.alias("name"), F.col(num).cast("double").alias("num"), F.col(den).cast("double").alias("den"))
    rows = materialise(rows.groupBy("hash", "name", "num", "den").agg(F.count(F.lit(1)).alias("times")))
    n = rows.agg(F.sum("times")).first()[0] or 0
    bits = min(SHARD_BITS, max(0, -(-n // shard_rows) - 1).bit_length())
    sharded = rows.withColumn("shard", F.shiftright("hash", 32 - bits))
    levels = [np.zeros(1 << bits, np.int64)]
    for r in sharded.groupBy("shard").agg(F.sum("times").alias("n")).collect():  # at most 2^SHARD_BITS rows
        levels[0][r.shard] = r.n
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(1))
    levels.reverse()
    start = draws.base(seed, stratum)

    # A block: 2^fine neighbouring shards, below one node of the level `top`.
    fine = max(i for i in range(bits + 1) if i == 0 or (b << i <= DRAWS and b * n >> (bits - i) <= BLOCK_DRAWS))
    top = bits - fine

    def halved(k: np.ndarray, reps: np.ndarray, level: int, node: int) -> np.ndarray:
        """Draws (node, replicate) of neighbouring nodes from `node` on, dealt to their halves."""
        nodes = node + np.arange(len(k))
        share = levels[level + 1][2 * nodes] / np.maximum(levels[level][nodes], 1)
        left = draws.binomial(k, share[:, None], draws.drawn(start, reps[None], (1 << level) + nodes[:, None]) / 2.0**32)
        return np.stack([left, k - left], 1).reshape(-1, len(reps))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in batch.column(0).to_pylist()):
            reps = np.arange(part * DEALT, min(b, (part + 1) * DEALT))
            k = np.full((1, len(reps)), n)
            for level in range(top):
                k = halved(k, reps, level, 0)
            packed = pa.array([x.tobytes() for x in k], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(k))), pa.array(np.full(len(k), part)), packed], ["block", "part", "k"])

    def resample(table: pa.Table, dealt: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"rep": pa.array([], pa.int64()), "num": pa.array([], pa.float64()), "den": pa.array([], pa.float64()), "draws": pa.array([], pa.int64())})
        block, reps = table["block"][0].as_py(), np.arange(b)
        k = np.frombuffer(b"".join(dealt.sort_by("part")["k"].to_pylist()), np.int64)[None]
        for level in range(top, bits):
            k = halved(k, reps, level, block << (level - top))
        table = table.sort_by([("shard", "ascending"), ("name", "ascending"), ("num", "ascending"), ("den", "ascending")])
        nums, dens = (np.nan_to_num(table[c].fill_null(0).to_numpy(), nan=np.nan) for c in ("num", "den"))
        times, sums = table["times"].to_numpy(), np.zeros((2, b))
        shards, begin = np.unique(table["shard"].to_numpy(), return_index=True)
        for shard, lo, hi in zip(shards.tolist(), begin.tolist(), [*begin[1:].tolist(), len(table)], strict=True):
            drawn_sums(sums, shard, k[shard - (block << fine)], [nums[lo:hi], dens[lo:hi]], times[lo:hi])
        return pa.table({"rep": reps, "num": sums[0], "den": sums[1], "draws": k.sum(0)})

    def drawn_sums(sums: np.ndarray, shard: int, k: np.ndarray, values: list[np.ndarray], times: np.ndarray) -> None:
        """Adds to sums what a shard's draws, k by replicate, hold of each of the values."""
        upto = np.cumsum(times)
        spread = upto[-1] <= SPREAD
        if spread:
            values = [np.repeat(v, times) for v in values]
        begun = draws.drawn(start, np.arange(b), (1 << bits) + shard).astype(np.uint32)
        first = 0
        while first < b:  # replicates with together some DRAWS draws
            last = max(first + 1, int(np.searchsorted(np.cumsum(k[first:]), DRAWS, side="right")) + first)
            own = k[first:last]
            at = np.cumsum(own) - own
            draw = np.arange(own.sum(), dtype=np.uint32) - np.repeat(at.astype(np.uint32), own)
            draw ^= np.repeat(begun[first:last], own)  # as draws.drawn(start, rep, (1 << bits) + shard, draw)
            row = draws.places(draws.mixed32(draw).astype(np.uint64), int(upto[-1]))
            row = row if spread else np.searchsorted(upto, row, side="right")
            for total, value in zip(sums, values, strict=True):
                if len(row):
                    total[first:last][own > 0] += np.add.reduceat(value[row], at[own > 0])
            first = last

    blocks = sharded.withColumn("block", F.shiftright("shard", fine)).groupBy("block")
    dealt = df.sparkSession.range(-(-b // DEALT)).mapInArrow(deal, "block long, part long, k binary")
    parts = blocks.cogroup(dealt.groupBy("block")).applyInArrow(resample, "rep long, num double, den double, draws long")
    return parts.groupBy("rep").agg(pooled("num", "den").alias("density"), F.sum("draws").alias("draws"))


def poisson_replicates(df: DataFrame, key: list[str], num: str, den: str, stratum: str, b: int, seed: int) -> DataFrame:
    """rep, density of b resamples in which each row counts a hashed Poisson(1) number of times.

    For corpora: rows need no numbers and nothing is joined; sums of all replicates are taken where the rows are, and
    b rows of each task are shuffled. key names a row.
    """
    rows = df.select(*key, num, den, F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("rep"))
    parts = [F.lit(seed), F.lit(stratum), F.col("rep"), *[F.col(k) for k in key]]
    share, times, chance = hashed_draw(F.lit(1 << 32), *parts), F.lit(0), math.exp(-1)
    reached = 0.0
    for k in range(13):  # P(13 or more) is below 2^-32
        reached += chance
        chance /= k + 1
        times = times + (share >= int(reached * (1 << 32))).cast("int")
    rows = rows.withColumn("_times", times)
    return rows.groupBy("rep").agg(pooled(F.col("_times") * F.col(num), F.col("_times") * F.col(den)).alias("density"))


def bootstrap_difference(
    a: DataFrame, b: DataFrame, order: list[str], num: str, den: str, replicas: int = 10_000, seed: int = 42, poisson: bool = False,
    split: bool = False, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """point, lo, hi, p of density(b) - density(a): percentile interval; the two-sided p may exceed 1 or be 0.

    By number, exact draws number the rows (order) and make replicas x rows of them: for analysis units. Split, they are
    as exact and made inside shards of rows: for tables of any size. With poisson, rows count a random number of times, which is not exact. For
    the last two, order names a row. No row where either side is empty.
    """
    a, b = (materialise(side.select(*dict.fromkeys([*order, num, den]))) for side in (a, b))  # a few columns, read several times
    if split:
        resampled = lambda *args: split_replicates(*args, shard_rows=shard_rows).drop("draws")
    else:
        resampled = poisson_replicates if poisson else replicates
    diffs = resampled(a, order, num, den, "a", replicas, seed).withColumnRenamed("density", "low").join(
        resampled(b, order, num, den, "b", replicas, seed).withColumnRenamed("density", "high"), "rep"
    )
    d = F.col("high") - F.col("low")
    stats = diffs.agg(
        F.percentile(d, F.lit(0.025)).alias("lo"), F.percentile(d, F.lit(0.975)).alias("hi"),
        (2 * F.least(F.avg((d <= 0).cast("double")), F.avg((d >= 0).cast("double")))).alias("p"),
    )
    point = b.agg(pooled(num, den).alias("_b")).crossJoin(a.agg(pooled(num, den).alias("_a")))  # one row each
    return stats.crossJoin(point).filter("lo IS NOT NULL").select((F.col("_b") - F.col("_a")).alias("point"), "lo", "hi", "p")


def permutation_p(df: DataFrame, order: list[str], group: str, num: str, den: str, b: int = 10_000, seed: int = 42, md5: bool = False) -> DataFrame:
    """observed, p (one-sided, (count + 1) / (b + 1)) of density(group) - density(rest) under shuffled labels.

    A shuffle gives the group's labels to the rows with the least hashes of (seed, replicate, row number). Nothing is sorted: the
    size-th least hash of each replicate is found by counting hashes in bins and counting again inside the bin that holds it. A null label is no label, a null number adds nothing.
    """
    rows = materialise(df.select(*dict.fromkeys([*order, group, num, den])).filter(F.col(group).isNotNull()))
    rows = numbered(rows, order).select("_idx", F.col(group).alias("mine"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(a) for c, a in ((num, "num"), (den, "den"))])
    rows = materialise(rows)
    sums = [F.sum(F.when(of, F.col(c))) for of in (F.col("mine"), ~F.col("mine")) for c in ("num", "den")]
    n, size, *whole = rows.agg(F.count(F.lit(1)), F.count_if("mine"), *[F.coalesce(s, F.lit(0.0)) for s in sums]).first()
    observed = _density(*whole[:2]) - _density(*whole[2:])
    num_, den_, _ = selected_sums(rows, n, size, b, seed, md5)
    stat = _density(num_, den_) - _density(whole[0] + whole[2] - num_, whole[1] + whole[3] - den_)
    # Sums taken in another order may differ in the last bits: equal statistics count as reached.
    reached = int((stat >= observed - 1e-12).sum())
    return df.sparkSession.createDataFrame([(float(observed), (reached + 1) / (b + 1))], "observed double, p double")


def _density(num: np.ndarray | float, den: np.ndarray | float) -> np.ndarray | float:
    num, den = np.asarray(num, float), np.asarray(den, float)
    return np.where(den == 0, 0.0, 100 * num / np.where(den == 0, 1, den))


def hashes(seed: int, reps: np.ndarray, idx: np.ndarray, md5: bool) -> np.ndarray:
    """A hash of HASH_BITS bits for each replicate and row."""
    if md5:
        one = lambda r, i: int(hashlib.md5(f"{seed}|{r}|{i}".encode()).hexdigest()[:15], 16) << 2
        return np.array([[one(r, i) for i in idx.tolist()] for r in reps.tolist()], np.uint64).reshape(len(reps), len(idx))
    return draws.drawn(draws.base(seed, "permutation"), reps[:, None], idx[None]) << np.uint64(HASH_BITS - 32)  # different for different rows


def selected_sums(rows: DataFrame, n: int, size: int, b: int, seed: int, md5: bool = False, bins: int = BINS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of b replicates the sums of num and den over the `size` rows (_idx, num, den) with the least hashes, and a bound above just these.

    A replicate holds a range that its bound lies in, first one around the expected quantile. A pass counts each replicate's hashes in
    bins of its range, in arrays whose size is bounded by b and not by the rows; bins merge by addition, and the bin with the bound is the
    next range. The few numbers of each replicate that a pass needs go through the driver.
    """
    top = 1 << HASH_BITS
    low, high = np.zeros(b, np.int64), np.full(b, top, np.int64)
    need, num, den = np.full(b, size, np.int64), np.zeros(b), np.zeros(b)
    if 0 < size < n:
        middle, wide = top * (size / n), top * (12 * math.sqrt(size * (n - size) / n) + 12) / n
        low[:], high[:] = max(0, int(middle - wide)), min(top, int(middle + wide))
    open_ = np.arange(b) if 0 < size < n else np.arange(0)
    if size >= n:
        num[:], den[:] = rows.agg(F.coalesce(F.sum("num"), F.lit(0.0)), F.coalesce(F.sum("den"), F.lit(0.0))).first()
    bound = np.full(b, top if size >= n else 0, np.int64)
    fresh = np.ones(b, bool)  # nothing below the range has been added yet
    while len(open_):
        found = _merged(rows, open_, low, high, seed, md5, bins)
        again = []
        for rep, (count, nums, dens) in found:
            # Bin 0 holds what is below the range; after the first pass that has been added before.
            if not fresh[rep]:
                count[0] = nums[0] = dens[0] = 0
            upto = np.cumsum(count)
            if count[0] > need[rep] or upto[-1] < need[rep]:  # the range missed the bound: take all
                low[rep], high[rep] = 0, top
                again.append(rep)
                continue
            at = int(np.searchsorted(upto, need[rep]))
            width = -(-(int(high[rep]) - int(low[rep])) // bins)
            last = at + 1 if upto[at] == need[rep] or width == 1 else at  # a whole bin, or one hash shared by rows
            num[rep] += nums[:last].sum()
            den[rep] += dens[:last].sum()
            bound[rep] = int(low[rep]) + at * width
            if last == at:
                need[rep] -= upto[at] - count[at]
                low[rep], high[rep] = int(low[rep]) + (at - 1) * width, min(int(high[rep]), int(low[rep]) + at * width)
                fresh[rep] = False
                again.append(rep)
        open_ = np.array(sorted(again), np.int64)
    return num, den, bound


def _merged(rows: DataFrame, open_: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int, md5: bool, bins: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each open replicate the counts and sums of num and den below its range (place 0) and in the bins of it."""
    shared = rows.sparkSession.sparkContext.broadcast((open_, low[open_], high[open_]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, lows, highs = shared.value
        width = (-(-(highs - lows) // bins)).astype(np.uint64)
        held = np.zeros((3, len(reps), bins + 1))
        begun = draws.drawn(draws.base(seed, "permutation"), reps).astype(np.uint32)
        shift = np.uint64(HASH_BITS - 32)
        # A hash of 32 bits, shifted, lies below a bound if it is below the bound's own upper bits, rounded up.
        least, upper = (np.array([-(-int(x) >> int(shift)) for x in bound], np.int64) for bound in (lows, highs))
        for batch in batches:
            idx, num, den = (c.to_numpy() for c in batch.columns)
            step = max(1, DRAWS // max(1, len(idx)))
            short = not md5 and len(idx) and int(idx.max()) >> 32 == 0 and int(least.max()) >> 32 == 0 and int(upper.min()) > 0
            weights = np.stack([np.ones(len(idx)), num, den], 1)
            for lo in range(0, len(reps), step):
                own = slice(lo, lo + step)
                if short:
                    hashed = draws.mixed32(begun[own, None] ^ idx[None].astype(np.uint32))
                    below = hashed < least[own, None].astype(np.uint32)
                    r, c = np.nonzero((hashed <= (upper[own, None] - 1).astype(np.uint32)) & ~below)
                    inside = hashed[r, c].astype(np.uint64) << shift
                else:
                    hashed = hashes(seed, reps[own], idx, md5)
                    below = hashed < lows[own, None].astype(np.uint64)
                    r, c = np.nonzero((hashed < highs[own, None].astype(np.uint64)) & ~below)
                    inside = hashed[r, c]
                held[:, own, 0] += (below.astype(float) @ weights).T
                place = ((inside - lows[own].astype(np.uint64)[r]) // width[own][r]).astype(np.int64) + 1
                cell, cells = r * (bins + 1) + place, hashed.shape[0] * (bins + 1)
                for total, weight in zip(held, (None, num[c], den[c]), strict=True):
                    total[own] += np.bincount(cell, weight, cells).reshape(-1, bins + 1)
        for lo in range(0, len(reps), TOGETHER):
            part = held[:, lo : lo + TOGETHER]
            yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([part.tobytes()], pa.binary())], ["block", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf.block[:1], "sums": [sum(np.frombuffer(s) for s in pdf.sums).tobytes()]})

    merged = rows.select("_idx", "num", "den").mapInArrow(count, "block long, sums binary").groupBy("block").applyInPandas(add, "block long, sums binary")
    for r in merged.toLocalIterator():  # one block of replicates at a time
        sums = np.frombuffer(r.sums).reshape(3, -1, bins + 1).copy()
        for i in range(sums.shape[1]):
            yield int(open_[r.block + i]), sums[:, i]


def changepoint(df: DataFrame, order: str, value: str, least: int = 2) -> DataFrame:
    """The last point of the left segment of the best split in two by squared error, and that error.

    No row under five points. A series by year is short; prefix sums give every split's error in one pass.
    """
    w = Window.orderBy("_at")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(F.lit(1))
    x = F.col("_x")
    s = df.select(F.col(order).alias("_at"), F.col(value).alias("_x")).select(
        "_at", F.row_number().over(w).alias("k"), F.sum(x).over(upto).alias("s"), F.sum(x * x).over(upto).alias("q"),
        F.sum(x).over(every).alias("all_s"), F.sum(x * x).over(every).alias("all_q"), F.count(F.lit(1)).over(every).alias("n"),
    )
    left = F.col("q") - F.col("s") * F.col("s") / F.col("k")
    rest = F.col("all_s") - F.col("s")
    right = (F.col("all_q") - F.col("q")) - rest * rest / F.nullif(F.col("n") - F.col("k"), F.lit(0))
    splits = s.filter((F.col("n") >= 5) & (F.col("k") >= least) & (F.col("n") - F.col("k") >= least))
    return splits.withColumn("sse", left + right).orderBy("sse", "_at").limit(1).select(F.col("_at").alias("changepoint"), "sse")


def contrast(df: DataFrame, group: str, base: str, other: str, num: str, control: str, den: str) -> DataFrame:
    """Densities of two groups for signal and control, their differences, and the difference in differences."""

    def density(name: str, column: str):
        return ratio100(F.sum(F.when(F.col(group) == name, F.col(column))), F.sum(F.when(F.col(group) == name, F.col(den))))

    out = df.agg(
        (density(other, num) - density(base, num)).alias("signal_diff"), (density(other, control) - density(base, control)).alias("control_diff")
    )
    return out.withColumn("did", F.col("signal_diff") - F.col("control_diff"))
