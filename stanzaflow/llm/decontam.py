"""Operator 6, benchmark decontamination by size-partitioned MinHash containment, in DataFrame functions alone.

A text's set holds the 64-bit hashes of its five-word shingles (lower case). A test item's sketch is the
smallest hashes of its set. Items are partitioned by set size, and a partition's sketch size follows from its
largest sets: of u shingles, u - ceil(s u) + 1 minima. A document that contains the share s of an item can
lack fewer shingles than that, so that it holds at least one of the minima: the candidate search, an equi-join
of document shingles with the minima, loses nothing however long the document is. Candidates are then
verified on the full sets. Long documents pay for their own shingles only; no pairs of documents are made.

Defined results: null, empty and blank texts have no shingles, are contained in nothing and contain nothing;
under five words the whole sequence is the only shingle. Rows with a null id are left out on either side.
Rows that repeat an id are one text holding the shingles of all. No rows on either side give no rows. Only
the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stanzaflow.llm.scratch import materialise

WORDS, PERCENT = 5, 80
#: Rows of some 20 bytes that are broadcast at most; beyond, a shuffled join does the same.
BROADCAST_ROWS = 1_000_000


def shingles(text: Column) -> Column:
    """The shingle hashes of a text, in order, with repeats."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def slide(hashes: Column) -> Column:
        runs = F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, WORDS)]))
        return F.slice(runs, 1, F.greatest(F.size(hashes) - (WORDS - 1), F.least(F.size(hashes), F.lit(1))))

    # A list of one names the word hashes, so that they are made once.
    return F.get(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), slide), F.lit(0))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_sets(items: DataFrame) -> DataFrame:
    """item_id, hash, n_item, minimum (whether the hash is in the sketch) of items (item_id, text)."""
    rows = items.filter("item_id IS NOT NULL").select("item_id", F.explode(shingles(F.col("text"))).alias("hash")).distinct()
    by_item = Window.partitionBy("item_id")
    # The partition of sizes [2^p, 2^(p+1)): its largest set has 2^(p+1) - 1 shingles.
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n_item")) + 1) - 1
    kept = largest - F.ceil(largest * PERCENT / 100) + 1
    rows = rows.withColumn("n_item", F.count(F.lit(1)).over(by_item))
    rows = rows.withColumn("place", F.row_number().over(by_item.orderBy("hash")))
    return rows.select("item_id", "hash", "n_item", (F.col("place") <= kept).alias("minimum"))


def contained(documents: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: items of whose shingles a document holds `percent` or more.

    documents: doc_id, text; items: item_id, text.
    """
    sets = materialise(item_sets(items))
    able = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    minima = _few(sets.filter("minimum").select("item_id", "hash"))
    hashed = able.select("doc_id", F.explode(shingles(F.col("text"))).alias("hash"))
    candidates = materialise(hashed.join(minima, "hash").select("doc_id", "item_id").distinct())
    which = _few(materialise(candidates.select("doc_id").distinct()))
    again = able.join(which, "doc_id", "left_semi")
    again = again.select("doc_id", F.explode(F.array_distinct(shingles(F.col("text")))).alias("hash"))
    # An id that is repeated must count a shingle once.
    shared = again.join(_few(sets.select("item_id", "hash", "n_item")), "hash").distinct()
    shared = shared.groupBy("doc_id", "item_id").agg(F.first("n_item").alias("n_item"), F.count(F.lit(1)).alias("n_shared"))
    found = shared.join(candidates, ["doc_id", "item_id"]).filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def op6(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The benchmark items that each document contains by 80 % or more."""
    return contained(documents.select("doc_id", "text"), benchmark.select("item_id", "text"))
