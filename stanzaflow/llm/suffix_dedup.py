"""Operator 5, repeated passages by a sparse suffix array.

Of all suffixes of all texts, only those at content-selected positions are kept: the minimisers, which begin
with the least hash of GRAM words among the GAP + 1 positions of some stretch. Equal stretches select equal
positions, so that any passage of `least` words that occurs twice has, in both places, a kept suffix within
GAP words of its beginning, followed by least - GAP words of the passage: its head.

1. Heads are counted by hash; suffixes whose head occurs in one document end there. The others are kept with the GAP words
   behind the head and the GAP words before it.
2. The suffixes are sorted by head and the words behind it: range-partitioned by head, in suffix order inside. Neighbours are compared word by
   word: the length that they share behind the head, as in a suffix array, bounds the intervals of suffixes that share r words, for every r.
3. Matches extend to the left: suffixes of an interval that also share the f words before the head, f + r reaching `least` words with the
   head, hold the same passage. All f from 0 to GAP are looked at, not the nearest neighbour alone, so that no partner is missed.
4. A head of over BLOCK suffixes is split: either r or f is over GAP / 2, so that its suffixes are sorted in smaller blocks of a head
   with half the words behind it, and in blocks of a head with half the words before it. What is over BLOCK even there shares 42 words or more with all its
   block: its extensions to `least` words are sorted themselves, by hash and document, so that even one very frequent passage spreads over
   tasks. Rows of a hash that another document also has are matches. The first and the last hash of a task may go on in others: their rows
   are judged by the smallest and largest key of the hash over all tasks.
5. Matches that overlap or touch are merged into a document's repeated passages, of all its words that lie in `least` words that another
   document holds. The smallest key that shares some of them is named (of two documents, for each the other).

Words are compared by 32 bits of hash around a head of 64 bits, so that a neighbour seems to share a word more once in four billion comparisons.

Defined results: null and empty texts, and those under `least` words, have no passages. Rows with a null key
are left out. Rows that repeat a key are one document, whose passages don't match each other. Only the named
columns are read; texts of any length are read whole; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stanzaflow.llm.grouped import binary_rows, matrix, whole_groups
from stanzaflow.llm.scratch import integer_key, materialise
from stanzaflow.llm.words import U64, mix, runs, slices, sliding_min, text_bytes, word_hashes

LEAST, GRAM, GAP = 50, 8, 17
#: Keys of 8 bytes that are broadcast at most; beyond, a shuffled join does the same.
BROADCAST_KEYS = 2_000_000
#: Suffixes that are compared in one block, and parts that a block's suffixes are told apart in when blocks are marked.
BLOCK, SALTS = 1024, 16
#: Words that a half of what lies around a head has, and the extensions to the left (a bit each) that are found by the words behind it.
HALF = GAP // 2 + 1
BEHIND = (1 << HALF) - 1
_RUNS = "key long, pos int, last int, other long"
_SUFFIX = "head long, hot boolean, mask int, left binary, right binary, key long, pos int"


def selected(words: np.ndarray, offsets: np.ndarray, gram: int = GRAM, gap: int = GAP) -> np.ndarray:
    """Word positions that hold the least hash of gram words among some gap + 1 neighbours in their row."""
    out = []
    for a, b in zip(offsets, offsets[1:], strict=False):
        if b - a >= gram + gap:
            hashed = runs(words[a:b], gram)
            least = sliding_min(hashed, gap + 1)
            # A hash is least somewhere if it equals the greatest of the minima around it.
            edge = np.zeros(gap, U64)
            most = ~sliding_min(~np.concatenate([edge, least, edge]), gap + 1)
            out.append(np.flatnonzero(hashed == most) + a)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _heads(batch: pa.RecordBatch, text: int, least: int) -> Iterator[tuple]:
    """For slices of a batch: first row, words, word offsets, kept positions with their rows and head hashes."""
    data, offsets = text_bytes(batch.column(text))
    head = least - GAP
    for a, b in slices(offsets):
        words, at = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        kept = selected(words, at)
        row = np.searchsorted(at, kept, "right") - 1
        whole = kept + head <= at[row + 1]
        kept, row = kept[whole], row[whole]
        hashed = runs(words, head)[kept] if len(kept) else np.zeros(0, U64)
        yield a, words, at, kept, row, hashed


def _around(words: np.ndarray, at: np.ndarray, kept: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of kept positions: the words before the head, nearest first, and behind it, and for each f whether the passage that begins f words before
    lies in the row and has its least hash here (a bit each)."""
    short = (mix(words, 71) >> U64(32)).astype(">u4")

    def taken(place: np.ndarray) -> np.ndarray:
        inside = (place >= at[row, None]) & (place < at[row + 1, None])
        return np.where(inside, short[np.clip(place, 0, len(short) - 1)], 0).astype(">u4")

    left = taken(kept[:, None] - 1 - np.arange(GAP)[None])
    right = taken(kept[:, None] + least - GAP + np.arange(GAP)[None])
    hashed = runs(words, GRAM)
    lowest = sliding_min(hashed, GAP + 1)
    start = kept[:, None] - np.arange(GAP + 1)[None]
    whole = (start >= at[row, None]) & (start + least <= at[row + 1, None])
    first = whole & (lowest[np.clip(start, 0, len(lowest) - 1)] == hashed[kept, None])
    return left, right, (first << np.arange(GAP + 1)[None]).sum(1).astype(np.int32)


def _chained(words: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, .. words of each row of a matrix."""
    out = np.zeros((len(words), words.shape[1] + 1), U64)
    for i in range(words.shape[1]):
        out[:, i + 1] = mix(out[:, i] ^ words[:, i].astype(U64), i + 1)
    return out


def _context(column: pa.Array) -> np.ndarray:
    return matrix(column, 4 * GAP).view(">u4")


def _joined(key: np.ndarray, pos: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    """Places of passages as runs of equal or neighbouring places: key, pos (the first), last, other (the least)."""
    order = np.lexsort((pos, key))
    key, pos, other = key[order], pos[order], other[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (pos[1:] > pos[:-1] + 1)
    start = np.flatnonzero(new)
    last = pos[np.append(start[1:], len(key)) - 1]
    columns = [pa.array(key[start]), pa.array(pos[start].astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(np.minimum.reduceat(other, start))]
    return pa.RecordBatch.from_arrays(columns, ["key", "pos", "last", "other"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes (block, f from..to, mask, left, right, key, pos) the passages that other keys hold: key, pos, last, other."""
    for t, starts in whole_groups(batches, ["block"]):
        low, high, mask, key, pos = (t.column(i).to_numpy() for i in (1, 2, 3, 6, 7))
        left, right = _chained(_context(t.column(4))), _context(t.column(5))
        shared = np.zeros(len(key), np.int64)  # words behind the head that a suffix shares with the one before it in the array
        shared[1:] = np.minimum.accumulate(right[1:] == right[:-1], 1).sum(1)
        shared[starts[:-1]] = -1
        found = [[], [], []]
        for f in range(GAP + 1):
            interval = np.cumsum(shared < GAP - f)
            rows = np.flatnonzero((mask >> f & 1 == 1) & (low <= f) & (f <= high))
            if not len(rows):
                continue
            rows = rows[np.lexsort((key[rows], left[rows, f], interval[rows]))]
            new = np.ones(len(rows), bool)
            new[1:] = (interval[rows][1:] != interval[rows][:-1]) | (left[rows, f][1:] != left[rows, f][:-1])
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(rows)))
            least, most = np.repeat(key[rows[begin]], size), np.repeat(key[rows[np.append(begin[1:], len(rows)) - 1]], size)
            own = least < most
            rows, least, most = rows[own], least[own], most[own]
            for held, more in zip(found, (key[rows], pos[rows] - f, np.where(key[rows] == least, most, least)), strict=True):
                held.append(more)
        if sum(map(len, found[0])):
            yield _joined(*(np.concatenate(x) for x in found))


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All extensions to `least` words of suffixes (head, f from..to, mask, left, right, key, pos), by 96 bits of hash."""
    for batch in batches:
        head, low, high, mask, key, pos = (batch.column(i).to_numpy() for i in (0, 1, 2, 3, 6, 7))
        left, right = _chained(_context(batch.column(4))), _chained(_context(batch.column(5)))
        for f in range(GAP + 1):
            rows = np.flatnonzero((mask >> f & 1 == 1) & (low <= f) & (f <= high))
            around = left[rows, f] * U64(0x9E3779B97F4A7C15) + right[rows, GAP - f]
            hashed = mix(head[rows].view(U64) ^ mix(around, 5), f)
            more = (mix(head[rows].view(U64) + mix(around, 6), f) >> U64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashed.view(np.int64)), pa.array(more.view(np.int32)), pa.array(key[rows]), pa.array((pos[rows] - f).astype(np.int32))],
                ["hash", "more", "key", "pos"],
            )


def _blocks(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The suffixes in blocks of bounded size, and those of heads whose halves are hot as well."""
    columns = ["low", "high", "mask", "left", "right", "key", "pos"]
    narrow = rows.filter("NOT hot").withColumn("block", F.col("head")).withColumn("low", F.lit(0)).withColumn("high", F.lit(GAP))
    half = 4 * HALF
    sides = [
        F.struct(F.xxhash64("head", F.lit(0), F.substring("right", 1, half)).alias("block"), F.lit(0).alias("low"), F.lit(HALF - 1).alias("high")),
        F.struct(F.xxhash64("head", F.lit(1), F.substring("left", 1, half)).alias("block"), F.lit(HALF).alias("low"), F.lit(GAP).alias("high")),
    ]
    used = [F.col("mask").bitwiseAND(BEHIND) != 0, F.col("mask").bitwiseAND(~BEHIND) != 0]
    wide = rows.filter("hot").withColumn("s", F.explode(F.array(*[F.when(u, s) for u, s in zip(used, sides, strict=True)]))).filter("s IS NOT NULL")
    wide = wide.select("head", "s.*", *columns[2:])
    large = materialise(wide.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("block"))
    # A large block's suffixes are found by its number and a salt, so that no task holds one whole.
    salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("large", F.lit(True))
    wide = wide.withColumn("salt", F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS)).cast("int"))
    wide = materialise(wide.join(salted, ["block", "salt"], "left").drop("salt"))
    fine = narrow.select("block", *columns).union(wide.filter("large IS NULL").select("block", *columns))
    return fine, wide.filter("large").select("head", *columns)


def repeated_passages(df: DataFrame, key: str, text: str, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """key, start, end (words, end exclusive), other: maximal passages of `least` words that other keys hold."""
    docs = df.select(integer_key(df, key).alias("key"), F.col(text).alias("text"))
    docs = docs.filter(F.col("key").isNotNull() & (F.length("text") >= 2 * least - 1))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            for a, _, at, kept, row, hashed in _heads(batch, 1, least):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashed.view(np.int64)), pa.array(key[a + row]), pa.array((kept - at[row]).astype(np.int32))],
                    ["head", "key", "pos"],
                )

    kept = docs.mapInArrow(heads, "head long, key long, pos int")
    shared = kept.groupBy("head").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    shared = materialise(shared.select("head", (F.col("n") > block).cast("int").alias("hot")))
    # A place is twice its position, and one more where its head is hot.
    places = materialise(kept.join(shared, "head").groupBy("key").agg(F.collect_set(2 * F.col("pos") + F.col("hot")).alias("places")))
    which = places.select("key")
    narrow = F.broadcast(which) if which.count() <= BROADCAST_KEYS else which
    met = docs.join(narrow, "key", "left_semi").join(places, "key").select("key", "places", "text")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, places = batch.column(0).to_numpy(), batch.column(1)
            for a, words, at, kept, row, hashed in _heads(batch, 2, least):
                place = 2 * (kept - at[row])
                keep, hot = np.zeros(len(kept), bool), np.zeros(len(kept), bool)
                for r in np.unique(row):
                    mine, held = slice(*np.searchsorted(row, [r, r + 1])), places[a + int(r)].values.to_numpy()
                    hot[mine] = np.isin(place[mine] + 1, held)
                    keep[mine] = hot[mine] | np.isin(place[mine], held)
                if not keep.any():
                    continue
                kept, row, hashed, hot, place = kept[keep], row[keep], hashed[keep], hot[keep], place[keep]
                left, right, mask = _around(words, at, kept, row, least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashed.view(np.int64)), pa.array(hot), pa.array(mask), binary_rows(left), binary_rows(right), pa.array(key[a + row]),
                     pa.array((place // 2).astype(np.int32))],
                    ["head", "hot", "mask", "left", "right", "key", "pos"],
                )

    rows = materialise(met.mapInArrow(suffixes, _SUFFIX).filter("mask <> 0"))
    fine, hot = _blocks(rows, block)
    order = ["block", "right", "key"]
    near = fine.repartitionByRange("block").sortWithinPartitions(*order).mapInArrow(_compared, _RUNS)
    array = hot.mapInArrow(_extended, "hash long, more int, key long, pos int").repartitionByRange("hash", "more", "key")
    found = array.sortWithinPartitions("hash", "more", "key").mapInArrow(_shared, "key long, pos int, other long, hash long, more int")
    found = materialise(found)
    edges = found.filter("other IS NULL").drop("other")
    ends = edges.groupBy("hash", "more").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high")
    ends = ends.toPandas()  # two rows at most for each task of the sort

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edge = batch.filter(batch.column("other").is_null()).to_pandas().drop(columns="other")
            edge = edge.astype({"hash": "int64", "more": "int32"}).merge(ends, on=["hash", "more"])
            other = np.where(edge["key"] == edge["low"], edge["high"], edge["low"])
            sure = batch.filter(batch.column("other").is_valid())
            yield pa.RecordBatch.from_arrays([sure.column(c) for c in ("key", "pos", "pos", "other")], ["key", "pos", "last", "other"])
            yield pa.RecordBatch.from_arrays([pa.array(edge["key"]), pa.array(edge["pos"]), pa.array(edge["pos"]), pa.array(other)], ["key", "pos", "last", "other"])

    spans = found.mapInArrow(name, _RUNS).union(near)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in whole_groups(batches, ["key"]):
            key, pos, last, other = (c.to_numpy() for c in t.columns)
            number = np.cumsum(np.append(0, key[1:] != key[:-1])) << 32
            reached = np.maximum.accumulate(number + last)  # the last place of this key so far
            new = np.ones(len(key), bool)
            new[1:] = number[1:] + pos[1:] > reached[:-1] + least
            start = np.flatnonzero(new)
            end = reached[np.append(start[1:], len(key)) - 1] - number[start] + least
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[start]), pa.array(pos[start]), pa.array(end.astype(np.int32)), pa.array(np.minimum.reduceat(other, start))],
                ["key", "start", "end", "other"],
            )

    spans = spans.repartition("key").sortWithinPartitions("key", "pos")
    return spans.mapInArrow(merge, "key long, start int, end int, other long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's sorted windows, those that another key has, with its name; all of the first and last hash, without."""
    held, first = None, True
    for group in whole_groups(batches, ["hash", "more"]):
        if held is not None:
            yield _judge(*held, first, False)
            first = False
        held = group
    if held is not None:
        yield _judge(*held, first, True)


def _judge(t: pa.RecordBatch, at: np.ndarray, first: bool, last: bool) -> pa.RecordBatch:
    key, size = t.column(2).to_numpy(), np.diff(at)
    low, high = np.repeat(key[at[:-1]], size), np.repeat(key[at[1:] - 1], size)
    edge = np.zeros(len(key), bool)
    if first:
        edge[: at[1]] = True
    if last:
        edge[at[-2] :] = True
    keep = np.flatnonzero(edge | (low < high))
    t, edge = t.take(pa.array(keep)), edge[keep]
    other = np.where(key == low, high, low)[keep]
    hidden = [pa.array(t.column(c).to_numpy(), mask=~edge) for c in (0, 1)]
    return pa.RecordBatch.from_arrays([t.column(2), t.column(3), pa.array(other, mask=edge), *hidden], ["key", "pos", "other", "hash", "more"])


def op5(documents: DataFrame) -> DataFrame:
    """doc_id, start, end, other_id of passages of 50 words or more that occur in other documents."""
    found = repeated_passages(documents, "doc_id", "text")
    return found.withColumnsRenamed({"key": "doc_id", "other": "other_id"})
