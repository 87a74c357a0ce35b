"""Operator 11, best-fit packing of documents into sequences by hierarchical residual packing.

A document's tokens end with an end token; only what is longer than a sequence is cut, into full pieces and a rest. Each task
packs the pieces that it cuts, in bounded runs, by best fit: longest first, each into the fullest sequence that still takes
it. Sequences that are nearly full are done. The others go up a tree: the residuals of many runs meet in nodes of bounded size, where
each is one item of another best-fit round, and what is nearly full then is done. Where a node's items don't come to the least
possible number of sequences, its pieces are packed anew one by one and the better result stands. Rounds end when one node has held all residuals, or when one more round would gain
less than one sequence in a hundred. No node, task or run holds more than a bounded number of pieces, and the driver sees counts alone.

Defined results: a null text is empty, and an empty text is the end token alone. Rows without a key, and repeated rows, are
documents each. Keys may be of any type and only come back. An empty table gives no rows. Texts are whole, of any length. Extra columns
aren't read. Places in sequences are gapless from 0; which sequence a piece is in depends on how the table is split into tasks, not on lost executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from stanzaflow.llm.scratch import bounded_batches, materialise
from stanzaflow.llm.tokens import encoder

#: Tokens of a sequence, and the end token.
CAPACITY, END = 4096, 1
#: Pieces that meet in one run or node of the tree, on average.
NODE = 1 << 14
#: A sequence that lacks at most this share of its capacity is nearly full.
NEARLY = 1 / 512
#: Bytes of a tokenizer's description, at most: it is broadcast.
DESCRIPTION = 64 << 20


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item its bin, from 0, and its place there: longest first, each into the fullest bin that takes it."""
    order = np.argsort(-sizes, kind="stable")
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room that they have left
    some, n = 0, 0  # a bit for each room that some bin has
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = some >> size << size
        if fits:
            left = (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                some ^= 1 << left
        else:
            b, left, n = n, capacity, n + 1
        bins[i], places[i] = b, capacity - left
        if size < left:
            room[left - size].append(b)
            some |= 1 << (left - size)
    return bins, places


def merge(bins: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """New bins, from 0, and offsets of pieces whose bins are the items of a best-fit round, or the pieces where those do better."""
    names, own = np.unique(bins, return_inverse=True)
    fill = np.bincount(own, lengths, len(names)).astype(np.int64)
    outer, place = best_fit(fill, capacity)
    least = -(-int(lengths.sum()) // capacity)
    if outer.max(initial=-1) + 1 > least:
        single = best_fit(lengths, capacity)
        if single[0].max(initial=-1) < outer.max(initial=-1):
            return single
    return outer[own], place[own] + offsets


def _full(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    fill = np.bincount(bins, lengths)
    return (fill >= capacity - int(capacity * NEARLY))[bins]


def _cut(ids: np.ndarray, at: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Row, number, start, length and ids' bytes of all pieces of documents whose ids lie one after the other."""
    size = np.diff(at)
    n = -(-size // capacity)
    row = np.repeat(np.arange(len(size)), n)
    number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = number * capacity
    length = np.minimum(size[row] - start, capacity)
    return row, number, start, length, at[row] + start


def pieces(df: DataFrame, key: str, text: str, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, node: int = NODE) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and ids), with the sequence (bin) and offset that its task gave each, and whether that one is done."""
    spark = bounded_batches(df.sparkSession)
    described = Path(tokenizer).read_text(encoding="utf-8")
    if len(described) > DESCRIPTION:
        raise ValueError(f"the tokenizer's description has over {DESCRIPTION} characters")
    shared = spark.sparkContext.broadcast(described)
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *T.StructType.fromDDL(
        "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", bin long, offset long, done boolean").fields])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(shared.value).encode, TaskContext.get().partitionId() << 33
        held: list[pa.Table] = []
        made = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            table = pa.concat_tables(held).combine_chunks()
            held.clear()
            lengths = table["length"].to_numpy()
            bins, offsets = best_fit(lengths, capacity)
            for name, column in (("bin", pa.array(bins + task + made)), ("offset", pa.array(offsets)), ("done", pa.array(_full(bins, lengths, capacity)))):
                table = table.append_column(name, column)
            made += int(bins.max()) + 1
            yield from table.to_batches()

        for batch in batches:
            ids, at = encode(batch.column(1))
            rows = np.arange(len(at) - 1)
            ids, at = np.insert(ids, at[1:], end).astype("<u4"), at + np.concatenate([rows, [len(rows)]])
            row, number, start, length, first = _cut(ids, at, capacity)
            parts = [ids[a : a + n].tobytes() for a, n in zip(first.tolist(), length.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length),
                       pa.array([zlib.crc32(p) for p in parts], pa.int64())]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(parts, pa.binary())], [*names, "ids"]
            whole = pa.Table.from_arrays(columns, names)
            for lo in range(0, len(whole), node):
                held.append(whole.slice(lo, node))
                if sum(map(len, held)) >= node:
                    yield from flush()
        if held and sum(map(len, held)):
            yield from flush()

    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(pack, schema)


def _round(rest: DataFrame, number: int, nodes: int, capacity: int) -> DataFrame:
    """One round of the tree: bins meet in nodes and are the items there."""

    def node(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bin", "ascending"), ("offset", "ascending")])
        lengths, own = table["length"].to_numpy(), table["node"][0].as_py()
        bins, offsets = merge(table["bin"].to_numpy(), table["offset"].to_numpy(), lengths, capacity)
        done = _full(bins, lengths, capacity)
        new = {"bin": pa.array(bins + (number << 56) + (own << 33)), "offset": pa.array(offsets), "done": pa.array(done)}
        return pa.Table.from_arrays([*[table[c] for c in kept], *new.values()], [*kept, *new])

    kept = [c for c in rest.columns if c not in ("bin", "offset", "done")]
    placed = rest.select(*kept, "bin", "offset", "done", F.pmod(F.xxhash64("bin", F.lit(number)), F.lit(nodes)).cast("long").alias("node"))
    return placed.groupBy("node").applyInArrow(node, rest.schema)


def pack(df: DataFrame, key: str, text: str, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, node: int = NODE) -> DataFrame:
    """All pieces with sequence_id and offset."""
    table = materialise(pieces(df, key, text, tokenizer, capacity, end, with_ids, node))
    finished, number, before = [], 1, None
    while True:
        rest = table.filter("NOT done")
        n = rest.agg(F.count("*").alias("pieces"), F.countDistinct("bin").alias("bins"), F.sum("length").alias("tokens")).first()
        nodes = -(-n.pieces // node)
        best = n.bins <= -(-(n.tokens or 0) // capacity)
        if best or (before is not None and (before[0] <= 1 or n.bins > 0.99 * before[1])):
            break
        finished.append(table.filter("done"))
        table, before, number = materialise(_round(rest, number, nodes, capacity)), (nodes, n.bins), number + 1
    for part in finished:
        table = table.unionByName(part)
    return table.drop("done").withColumnRenamed("bin", "sequence_id")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids (array of int) and parts (key, piece, offset, length) of each sequence, from pack(..., with_ids=True)."""
    part = F.struct("offset", "key", "piece", "length", "ids")
    held = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(part)).alias("parts"))  # a sequence has a bounded length

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(2)
            whole = [np.frombuffer(b"".join(p["ids"] for p in row.as_py()), "<u4").astype(np.int32) for row in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole, pa.list_(pa.int32())), batch.column(3)], ["sequence_id", "length", "ids", "parts"])

    slim = F.transform("parts", lambda p: F.struct(p["key"].alias("key"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length")))
    held = held.select("sequence_id", "length", "parts", slim.alias("slim"))
    kind = held.schema["slim"].dataType
    return held.mapInArrow(ids, T.StructType([*T.StructType.fromDDL("sequence_id long, length long, ids array<int>").fields, T.StructField("parts", kind)]))


def op11(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 4,096 tokens."""
    packed = pack(documents, "doc_id", "text", tokenizer).withColumnRenamed("key", "doc_id")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
