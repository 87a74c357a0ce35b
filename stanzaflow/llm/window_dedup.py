"""Operator 2, substring dedup: a count-min prefilter before exact grouping of word windows.

A window is `width` consecutive words of one document; a word goes if some window that covers it also
starts in a document with a smaller key. All windows are hashed, but only those that can be repeated are
shuffled:

1. Each window is counted under its anchor, the least hash of its `width / 2`-word runs. Equal windows have
   equal anchors, and neighbouring windows mostly share theirs, so that a sketch holds some 7 % of the
   windows' number. Partitions build count-min sketches with one increment for each anchor and document;
   merged by cell, a count never falls short of the number of documents that hold a window.
2. A second pass keeps the windows of anchors whose estimate is two or more in every sketch row, and groups
   them exactly by a 96-bit hash. A sketch that is too small lets more windows through; it loses none.

Of texts that are equal as a whole, only the one with the smallest key is windowed: the others lose all of
their words, if they have a window at all. The sketch's width follows the input up to MOST_CELLS.

Defined results: null text has no words, and neither empty nor short texts have windows: they stay whole.
Rows with a null key neither lose words nor make others lose theirs. Rows that repeat a key with another
text are judged each by its own windows; rows that repeat both are all judged alike. Texts of any length are windowed whole. No rows give no rows. Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stanzaflow.llm.scratch import integer_key, materialise
from stanzaflow.llm.words import U64, mix, runs, slices, sliding_min, text_bytes, within, word_hashes

WIDTH = 50
#: Sketch rows; cells of a row by characters of input; the most and least of them (as powers of two).
DEPTH, CHARS_A_CELL, LEAST_CELLS, MOST_CELLS = 3, 16, 16, 27
#: Cells (a power of two) that one merge step holds, a byte each.
SHARD = 20
#: Keys, of 8 bytes each, that are broadcast at most; beyond, a shuffled join does the same.
BROADCAST_KEYS = 2_000_000


def _anchors(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all windows and their anchors."""
    at, half = within(offsets, width), width // 2
    if not len(at):
        return at, np.zeros(0, U64)
    return at, sliding_min(runs(words, half), width - half + 1)[at]


def _cells(anchors: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(anchors, 11 + row) >> U64(64 - cells)).astype(np.uint32)


def _pack(cells: np.ndarray) -> bytes:
    """Ascending cells as deltas, byte planes apart, compressed."""
    delta = np.diff(cells, prepend=np.uint32(0)).astype("<u4")
    return pa.compress(delta.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, n * 4, codec="zstd"), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, n).T).view("<u4")[:, 0], dtype=np.uint32)


def _batch_slices(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(batch.column(column))
    for a, b in slices(offsets):
        yield a, b, *word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def sketch(docs: DataFrame, cells: int, width: int = WIDTH) -> list[np.ndarray]:
    """For each sketch row a bitmap of the cells with a count of two or more; docs: key, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for _, _, words, offsets in _batch_slices(batch):
                at, anchor = _anchors(words, offsets, width)
                row = np.searchsorted(offsets, at, "right")
                new = np.ones(len(at), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                anchor, row = anchor[new], row[new]
                order = np.lexsort((anchor, row))
                anchor, row = anchor[order], row[order]
                new = np.ones(len(row), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                found.append(anchor[new])
        anchor = np.concatenate(found) if found else np.zeros(0, U64)
        for r in range(DEPTH):
            cell, n = np.unique(_cells(anchor, r, cells), return_counts=True)
            for twice in (False, True):
                mine = cell[(n > 1) == twice]
                cuts = np.searchsorted(mine, np.arange(0, (1 << cells) + 1, 1 << min(SHARD, cells), dtype=np.uint64))
                rows = [(r, s, twice, int(b - a), _pack(mine[a:b] & np.uint32((1 << SHARD) - 1)))
                        for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()))],
                        ["r", "shard", "twice", "n", "cells"],
                    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Piece by piece, so that a shard takes a byte for each cell whatever the number of pieces."""
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for x in batch.to_pylist():
                state = held.setdefault((x["r"], x["shard"]), np.zeros(1 << SHARD, np.uint8))
                cell = _unpack(x["cells"], x["n"])
                state[cell] = np.minimum(state[cell] + (2 if x["twice"] else 1), 2)
        for (r, s), state in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([r], pa.int32()), pa.array([s], pa.int32()), pa.array([np.packbits(state > 1).tobytes()])],
                ["r", "shard", "bits"],
            )

    pieces = docs.mapInArrow(count, "r int, shard int, twice boolean, n int, cells binary")
    shards = 1 << max(0, cells - SHARD)
    merged = pieces.repartition(DEPTH * shards, "r", "shard").mapInArrow(merge, "r int, shard int, bits binary")
    size = 1 << max(SHARD, cells)
    bitmaps = [np.zeros(size // 8, np.uint8) for _ in range(DEPTH)]
    for x in merged.toLocalIterator():  # DEPTH x 2^MOST_CELLS bits at most
        at = x.shard * (1 << SHARD) // 8
        bitmaps[x.r][at : at + (1 << SHARD) // 8] = np.frombuffer(x.bits, np.uint8)
    return bitmaps


def repeated_windows(docs: DataFrame, bitmaps: list[np.ndarray], cells: int, width: int = WIDTH) -> DataFrame:
    """k1, k2, key, twin, pos of the windows that the sketch doesn't rule out; docs: key, text, twin."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, twin = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            for a, _, words, offsets in _batch_slices(batch):
                at, anchor = _anchors(words, offsets, width)
                if not len(at):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                some = anchor[starts]
                keep = np.ones(len(some), bool)
                for r, bits in enumerate(shared.value):
                    cell = _cells(some, r, cells)
                    keep &= (bits[cell >> np.uint32(3)] >> (7 - (cell & np.uint32(7))).astype(np.uint8) & 1) == 1
                at = at[np.repeat(keep, np.diff(np.append(starts, len(anchor))))]
                row = np.searchsorted(offsets, at, "right") - 1
                k1, k2 = runs(words, width)[at], runs(mix(words, 21), width)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1.view(np.int64)), pa.array((k2 >> U64(32)).astype(np.uint32).view(np.int32)),
                     pa.array(key[a + row]), pa.array(twin[a + row]), pa.array((at - offsets[row]).astype(np.int32))],
                    ["k1", "k2", "key", "twin", "pos"],
                )

    return docs.mapInArrow(emit, "k1 long, k2 int, key long, twin long, pos int")


def _remove(width: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns key, text, hits (window positions, or null) and copy -> key, n_words, n_removed, kept."""
        for batch in batches:
            out = []
            for key, text, hits, copy in zip(*[c for c in batch.columns], strict=True):
                words = (text.as_py() or "").encode().split()  # bytes split at 0x20 and 0x09-0x0D alone
                n = len(words)
                if copy.as_py() and n >= width:
                    words = []
                elif (hits := hits.values) is not None and len(hits):
                    edge = np.zeros(n + 1, np.int32)
                    at = hits.to_numpy(zero_copy_only=False)
                    at = at[at + width <= n]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
                    words = [w for w, gone in zip(words, np.cumsum(edge) > 0, strict=False) if not gone]
                out.append((key.as_py(), n, n - len(words), b" ".join(words).decode()))
            columns = zip(*out) if out else [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "n_words", "n_removed", "kept"]
            )

    return remove


def _maybe_broadcast(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _with_twin(rows: DataFrame, several: DataFrame) -> DataFrame:
    """rows (key, text) with digest and twin; several: keys of more texts than one, with the least digest."""
    rows = rows.withColumn("digest", F.unhex(F.md5("text"))).join(several, "key", "left")
    return rows.withColumn("twin", F.when(F.col("digest") > F.col("least"), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))).drop("least")


def remove_repeats(df: DataFrame, key: str, text: str, width: int = WIDTH, most_cells: int = MOST_CELLS) -> DataFrame:
    """key, n_words, n_removed, kept (the remaining words, joined by one space) for each row of df."""
    rows = df.select(integer_key(df, key).alias("key"), F.col(text).alias("text"))
    able = rows.filter(F.col("key").isNotNull() & (F.length("text") >= 2 * width - 1))
    digests = able.select("key", F.unhex(F.md5("text")).alias("digest"), F.length("text").alias("chars"))
    # A key of several texts tells them apart by twin, which is 0 for all others and for its text of the least digest.
    several = digests.groupBy("key").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).filter("least < most")
    several = _maybe_broadcast(materialise(several.select("key", "least")))
    groups = materialise(
        digests.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.sum("chars").alias("chars"))
    )
    chars = groups.agg(F.sum("chars")).first()[0] or 0
    cells = min(most_cells, max(LEAST_CELLS, int(chars / CHARS_A_CELL).bit_length()))
    # Read twice; broadcast, copies of one text don't meet in a task.
    repeated = _maybe_broadcast(materialise(groups.filter(F.col("first") < F.col("last")).select("digest", "first")))
    copies = materialise(
        digests.join(repeated, "digest").filter(F.col("key") > F.col("first")).select("key", "digest").distinct()
    )
    small = _maybe_broadcast(copies)
    own = _with_twin(able, several).join(small, ["key", "digest"], "left_anti").select("key", "text", "twin")

    bitmaps = sketch(own, cells, width)
    windows = repeated_windows(own, bitmaps, cells, width)
    # Map-side minima first; then a join that adaptive execution can split where a window is very frequent.
    exact = windows.groupBy("k1", "k2").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    exact = materialise(exact.filter(F.col("first") < F.col("last")).drop("last"))
    hits = windows.join(exact, ["k1", "k2"]).filter(F.col("key") > F.col("first"))
    hits = materialise(hits.groupBy("key", "twin").agg(F.collect_list("pos").alias("hits")))
    none = F.lit(None).cast("array<int>")
    flagged = _with_twin(rows, several).join(small.withColumn("copy", F.lit(True)), ["key", "digest"], "left")
    flagged = flagged.select("key", "twin", "text", F.coalesce("copy", F.lit(False)).alias("copy"))
    # Only documents that lose some words meet their hits; the others stay where they are.
    which = hits.select("key", "twin")
    if which.count() <= BROADCAST_KEYS:
        which = F.broadcast(which)
        rest = flagged.join(which, ["key", "twin"], "left_anti").select("key", "text", none.alias("hits"), "copy")
        met = flagged.join(which, ["key", "twin"], "left_semi").join(hits, ["key", "twin"]).select("key", "text", "hits", "copy")
        flagged = rest.unionByName(met)
    else:
        flagged = flagged.join(hits, ["key", "twin"], "left").select("key", "text", "hits", "copy")
    return flagged.mapInArrow(_remove(width), "key long, n_words long, n_removed long, kept string")


def op2(documents: DataFrame) -> DataFrame:
    """Counts and the digest of what is left of each document."""
    done = remove_repeats(documents, "doc_id", "text")
    return done.select(F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
