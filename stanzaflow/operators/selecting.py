"""Keyed selection: last or first of a key, upserts, lookups with defaults, first rows of a parent, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stanzaflow.operators.scans import ranked
from stanzaflow.sources.scratch import materialise

#: Titles outside the main namespace begin with these.
OTHER_NAMESPACES = ("作者:", "Author:", "Category:", "分類:")


def last_wins(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row of each key, with `place`: the order in which keys first came. Aggregated where the rows are, so that a hot key is no burden."""
    last = F.max_by(F.struct(*df.columns), seq).alias("_last")
    return df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in key]).agg(last, F.min(seq).alias("place")).select("_last.*", "place")


def upsert(old: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """old with new laid over it by key: new rows replace, places stay with the first comer."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = F.struct("_new", seq)
    merged = last_wins(both.withColumn("_seq", order), key, "_seq")
    return merged.drop("_new", "_seq")


def ordered_distinct(df: DataFrame, value: str, seq: str, prefixes: tuple[str, ...] = OTHER_NAMESPACES) -> DataFrame:
    """First occurrences of values in order, without those that begin with a prefix."""
    for p in prefixes:
        df = df.filter(~F.col(value).startswith(p))
    return df.groupBy(value).agg(F.min(seq).alias(seq))


def lookup(df: DataFrame, table: DataFrame, key: str, defaults: dict[str, object], seq: str | None = None) -> DataFrame:
    """df with a table's columns by key, defaults where the key or the value is missing.

    Of rows that repeat a key the last by seq counts; without seq, the greatest by all columns. The table is reference
    data; adaptive execution broadcasts it if it is small when it has been read.
    """
    value = F.struct(*[c for c in table.columns if c not in (key, seq)])
    once = table.groupBy(key).agg(F.max_by(value, F.col(seq) if seq else value).alias("_v")).select(key, "_v.*")
    joined = df.join(once, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def first_of_parent(df: DataFrame, parent: list[str], seq: list[str], n: int) -> DataFrame:
    """The first n rows of each parent in source order."""
    rank = F.row_number().over(Window.partitionBy(*parent).orderBy(*seq))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def placed(df: DataFrame, parent: list[str], seq: list[str], name: str) -> DataFrame:
    """df with each row's place, from 0, in its parent."""
    return ranked(df, parent, seq, name).withColumn(name, F.col(name).cast("int"))


def best_title(books: DataFrame, query: str, pos: str = "pos") -> DataFrame:
    """The first book whose title contains the query, else the first book, else none."""
    return best_titles(books.withColumn("query", F.lit(query)), pos)


def best_titles(books: DataFrame, pos: str = "pos") -> DataFrame:
    """For each query of books (query, title, ..): the first book whose title contains it, else its first book."""
    by = Window.partitionBy("query").orderBy(F.coalesce(F.contains("title", F.col("query")), F.lit(False)).desc(), pos)
    return books.withColumn("_rank", F.row_number().over(by)).filter("_rank = 1").drop("_rank")


def tree_walk(edges: DataFrame, root: str, paths: bool = True) -> DataFrame:
    """urn, path, depth of all nodes below a root, depth first by path; edges (urn, parent, pos).

    A node with several parents comes once for each way to it. No way visits a node twice: a child that lies on the way to its parent is
    not followed (see tree_cycles). Ways are doubled in each round, so that a tree of any depth takes some log2(depth) rounds. Without
    paths, which are as long as a node is deep, path is empty. Places from a million on are written longer, behind the others.
    """
    ways, _ = _ways(edges, root, paths)
    top = edges.sparkSession.createDataFrame([(root, "", 0)], "urn string, path string, depth int")
    return top.unionByName(ways.select(F.col("urn").cast("string"), "path", "depth"))


def tree_cycles(edges: DataFrame, root: str) -> DataFrame:
    """urn, parent of the edges below a root that are not followed, as their child lies on the way to their parent."""
    ways, _ = _ways(edges, root, False, True)
    at = ways.select(F.col("urn").alias("parent"), F.array_append("seen", F.lit(root)).alias("seen"))
    top = edges.sparkSession.createDataFrame([(root, [root])], "parent string, seen array<string>")
    return edges.join(at.unionByName(top), "parent").filter(F.array_contains("seen", F.col("urn"))).select("urn", "parent").distinct()


def _ways(edges: DataFrame, root: str, paths: bool, seen: bool = False) -> tuple[DataFrame, bool]:
    """urn, path, depth, seen (its nodes) of all ways from a root, and whether nodes had to be remembered.

    With one parent each, a way can't meet itself on the way up to a root without a parent; nodes are then remembered only if asked for.
    """
    e = edges.filter((F.col("urn") != F.col("parent")) & (F.col("urn") != root))
    many = seen or not e.groupBy("urn").agg(F.countDistinct("parent", "pos").alias("n")).filter("n > 1").isEmpty()
    pos = F.when(F.col("pos") < 1_000_000, F.lpad(F.col("pos").cast("string"), 6, "0")).otherwise(F.concat(F.lit("~"), F.lpad(F.col("pos").cast("string"), 19, "0")))
    nodes = F.array(F.col("urn")) if many else F.array().cast("array<string>")
    open_ = e.select("urn", F.col("parent").alias("top"), (F.concat(F.lit("/"), pos) if paths else F.lit("")).alias("path"), F.lit(1).alias("depth"), nodes.alias("seen"))
    done, open_ = materialise(open_.filter(F.col("top") == root)), materialise(open_.filter(F.col("top") != root))
    length, most = 1, e.select("urn").distinct().count()
    while length <= most and not open_.isEmpty():

        def joined(upper: DataFrame, lower: DataFrame = open_) -> DataFrame:
            above = upper.select(F.col("urn").alias("top"), F.col("top").alias("_top"), F.col("path").alias("_path"), F.col("depth").alias("_depth"), F.col("seen").alias("_seen"))
            both = lower.join(above, "top")
            both = both.filter(~F.arrays_overlap("seen", "_seen")) if many else both
            return both.select("urn", F.col("_top").alias("top"), F.concat("_path", "path").alias("path"), (F.col("depth") + F.col("_depth")).alias("depth"), F.concat("_seen", "seen").alias("seen"))

        done, open_ = materialise(done.union(joined(done))), materialise(joined(open_))
        length *= 2
    return done, many


def length_band(n: Column, low: int | None = None, high: int | None = None) -> Column:
    """low <= n <= high, either end open; the bounds differ by analysis."""
    keep = F.lit(True)
    if low is not None:
        keep &= n >= low
    if high is not None:
        keep &= n <= high
    return keep
