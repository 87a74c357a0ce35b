"""Ordered scans of tables whose keys may be of any size: ranks and carried values without a task that holds a key.

Rows are cut by sampled bounds over (key, position), so that each cut has about the same number of rows and a hot key is spread over
many. Inside a cut a window does the work. What a cut hands on to the next one of its key is a summary row; only keys in
which a bound lies have several cuts, so that there are at most two summary rows for each bound, whatever the table. An
exclusive scan over these gives each cut what came before it. Bounds are drawn once, when the plan is made; everything else depends on the
rows alone, so that a task that runs again gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType, TimestampType

from stanzaflow.sources.scratch import materialise

#: Rows of the sample for each cut, and the most cuts.
SAMPLED, CUTS = 32, 4096


class Cuts:
    """A table's rows with their cut, by bounds over some columns of which the first are a key."""

    def __init__(self, df: DataFrame, by: list[str], order: list[str], cuts: int | None = None) -> None:
        spark = df.sparkSession
        n = min(CUTS, cuts or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.by, columns = by, list(dict.fromkeys([*by, *order]))
        keys = df.select(*[_comparable(df, c).alias(c) for c in columns])
        one = F.xxhash64(*columns, F.monotonically_increasing_id())
        picked = keys.withColumn("_h", one).orderBy("_h").limit(SAMPLED * n).drop("_h").orderBy(*columns).collect()  # SAMPLED for each cut
        bounds = _once([tuple(picked[i * len(picked) // n]) for i in range(1, n) if picked])
        shape = StructType([StructField(f.name, f.dataType) for f in keys.schema.fields])
        held = spark.createDataFrame([(bounds,)], StructType([StructField("_bounds", ArrayType(shape))]))
        own = StructType([StructField(f"_span{i}", f.dataType) for i, f in enumerate(shape.fields[: len(by)])])
        self.spanning = spark.createDataFrame(_once([b[: len(by)] for b in bounds]), own) if by else None
        place = _place(F.struct(*[_comparable(df, c).alias(c) for c in columns]), len(bounds))
        self.rows = df.crossJoin(F.broadcast(held)).withColumn("_cut", place).drop("_bounds")  # one row

    def window(self) -> Window:
        return Window.partitionBy("_cut", *self.by)

    def summaries(self, **totals: Column) -> DataFrame:
        """_cut, key, _before: for each cut of a key with several, the totals of its earlier cuts in order; _all: of all its cuts."""
        rows = self.rows
        if self.by:
            rows = rows.join(F.broadcast(self.spanning), [_comparable(rows, c).eqNullSafe(F.col(f"_span{i}")) for i, c in enumerate(self.by)], "left_semi")
        parts = rows.groupBy("_cut", *self.by).agg(*[c.alias(name) for name, c in totals.items()])
        lists = parts.groupBy(*self.by).agg(F.array_sort(F.collect_list(F.struct("_cut", *totals))).alias("_all"))
        each = lists.select(*self.by, "_all", F.posexplode("_all").alias("_pos", "_own"))
        return each.select(*self.by, "_own._cut", F.slice("_all", F.lit(1), F.col("_pos")).alias("_before"), "_all")

    def joined(self, rows: DataFrame, summaries: DataFrame) -> DataFrame:
        """rows with their cut's summaries, where it has any; there are a few for each bound."""
        right = summaries.select(*[F.col(c).alias(f"_of_{c}") for c in ("_cut", *self.by)], "_before", "_all")
        same = [rows[c].eqNullSafe(right[f"_of_{c}"]) for c in ("_cut", *self.by)]
        return rows.join(F.broadcast(right), same, "left").drop(*[f"_of_{c}" for c in ("_cut", *self.by)])


def _once(sorted_keys: list[tuple]) -> list[tuple]:
    return [k for i, k in enumerate(sorted_keys) if not i or k != sorted_keys[i - 1]]


def _comparable(df: DataFrame, c: str) -> Column:
    """A column as bounds hold it: moments as numbers, which the driver's time zone can't bend."""
    return F.unix_micros(c) if isinstance(df.schema[c].dataType, TimestampType) else df[c]


def _place(key: Column, n: int) -> Column:
    """How many of n sorted bounds a key has reached, by bisection."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))]) if n else F.array().cast("array<int>")
    reached = lambda at, step: (at + step <= n) & (F.get(F.col("_bounds"), at + step - 1) <= key)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(reached(at, step), at + step).otherwise(at))


def ranked(df: DataFrame, by: list[str], order: list[str], rank: str = "_rank", size: str | None = None, cuts: int | None = None) -> DataFrame:
    """df with each row's rank from 0 in its key by order (null first), and the key's number of rows.

    The order should tell rows of a key apart; rows that it doesn't are numbered as they come. No key: one rank over all.
    """
    dealt = Cuts(df, by, order, cuts)
    rows = dealt.rows.withColumn(rank, F.row_number().over(dealt.window().orderBy(*order)).cast("long") - 1)
    if size:
        rows = rows.withColumn(size, F.count(F.lit(1)).over(dealt.window()))
    out = dealt.joined(rows, dealt.summaries(_n=F.count(F.lit(1))))
    total = lambda parts: F.aggregate(parts, F.lit(0).cast("long"), lambda t, p: t + p["_n"])
    out = out.withColumn(rank, F.col(rank) + F.coalesce(total(F.col("_before")), F.lit(0)))
    if size:
        out = out.withColumn(size, F.coalesce(total(F.col("_all")), F.col(size)))
    return out.drop("_cut", "_before", "_all")


def numbered(df: DataFrame, order: list[str], rank: str = "_rank", size: str | None = None, cuts: int | None = None) -> DataFrame:
    """df with each row's rank over all from 0, as `ranked` without a key gives it, for large tables.

    Spark's own ranges of rows are sorted and numbered, written once to the shared folder, and moved by the sizes of the ranges before them: no bounds
    are searched row by row, and there is no window. All columns of df are written.
    """
    spark = df.sparkSession
    n = min(CUTS, cuts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The upper 31 bits of such an id are the range, the lower 33 the place in it.
    ranges = materialise(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    first, total = [], 0
    for r in ranges.groupBy(F.shiftright("_at", 33).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # at most CUTS rows
        first.append((r.part, total))
        total += r.n
    begins = spark.createDataFrame(first, "_part int, _first long")
    out = ranges.join(F.broadcast(begins), F.shiftright("_at", 33).cast("int") == F.col("_part"), "left")
    out = out.withColumn(rank, F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1))
    return (out.withColumn(size, F.lit(total).cast("long")) if size else out).drop("_at", "_part", "_first")


def carried(df: DataFrame, by: list[str], order: list[str], value: str, within: list[str | Column] | None = None, cuts: int | None = None) -> DataFrame:
    """df with `value` filled by the last one of its key that isn't null, at or before the row.

    Cuts are made by `order`; rows of equal order lie in one cut and come there as `within` says, then by value.
    """
    dealt = Cuts(df, by, order, cuts)
    inside = [*order, *(within or []), value]
    upto = dealt.window().orderBy(*inside).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.rows.withColumn("_filled", F.last(value, ignorenulls=True).over(upto))
    at = F.when(F.col(value).isNotNull(), F.struct(*inside))
    out = dealt.joined(rows, dealt.summaries(_tail=F.max_by(value, at)))
    known = F.filter("_before", lambda p: p["_tail"].isNotNull())
    earlier = F.try_element_at(known, F.lit(-1))["_tail"]
    return out.withColumn(value, F.coalesce("_filled", earlier)).drop("_filled", "_cut", "_before", "_all")
