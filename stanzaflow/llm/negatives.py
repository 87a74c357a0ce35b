"""Operator 13, hard negatives by blocked dense matrix products.

Anchors are packed into blocks of a proven number of bytes. Each block is broadcast and meets all candidates, which are dealt
evenly over tasks and come in batches: float64 products, exact below 2^53. A first pass keeps for each anchor, in each task, the best rows of
the anchor's label; these short lists are merged into its positives. A second pass broadcasts a block with its positives' scores and keeps, for
each of them, the best rows of other labels whose scores lie in the positive's window. What a task hands on is bounded by the block, whatever the
candidates; hot labels and repeated vectors are rows like others, as nothing is grouped by them.

Defined results: rows without an id, a label or a vector, or with a null or non-finite component, or an empty vector, take no part. Vectors
meet only vectors of their length. An anchor never meets rows of its own id. Repeated rows are candidates each, and an
anchor that is repeated with the same label and vector is one anchor; with different ones it is several. A positive with a negative score has an
empty window. Finite components of any size take part, and scores that leave 64 bits are ordered rightly but shown as the end of that range. An
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from stanzaflow.llm.dense import Best, by_length, from_bytes, score_blocks
from stanzaflow.llm.scratch import integer_key, materialise

#: Bytes of a block of anchors, at most (an anchor longer than that is a block of its own), and candidates of a task, at most some.
BLOCK_BYTES, TASK_ROWS = 8 << 20, 1 << 18
_HELD = "block long, ids array<long>, labels array<long>, vectors array<array<double>>"


def usable(df: DataFrame, key: str, label: Column, vector: str) -> DataFrame:
    """id, label, v (doubles) of the rows that take part."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    rows = df.filter(F.col(key).isNotNull() & label.isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0))
    return rows.select(integer_key(df, key).alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))


def anchor_blocks(anchors: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each block of anchors, of at most block_bytes of vectors."""
    size = anchors.agg(F.sum(8 * F.size("v") + 16)).first()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(8 * batch.column(2).value_lengths().to_numpy() + 16)
            lo = 0
            while lo < batch.num_rows:
                room = (ends[lo - 1] if lo else 0) + block_bytes
                hi = max(lo + 1, int(np.searchsorted(ends, room, side="right")))
                part = batch.slice(lo, hi - lo)
                lists = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), pa.concat_arrays([c])) for c in part.columns]
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), *lists], ["block", "ids", "labels", "vectors"])
                lo = hi

    blocks = anchors.repartition(max(1, -(-size // (block_bytes // 2)))).mapInArrow(pack, _HELD)
    return materialise(blocks.withColumn("block", F.monotonically_increasing_id()))


class _Anchors:
    """A block of anchors by length of vector."""

    def __init__(self, held: Row) -> None:
        self.ids, self.labels = np.array(held.ids, np.int64), np.array(held.labels, np.int64)
        lengths = np.array([len(v) for v in held.vectors])
        self.of = {}
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            self.of[n] = own, np.array([held.vectors[i] for i in own.tolist()], float)

    def met(self, batches: Iterator[pa.RecordBatch], factor: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Anchors, candidates' ids, scores, whether labels are the same, whether ids differ: in slices that cover all pairs of equal lengths."""
        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for own, rows in by_length(batch.column(2)):
                anchors, vectors = self.of.get(rows.shape[1], (np.zeros(0, np.int64), np.zeros((0, rows.shape[1]))))
                for q, d, scores in score_blocks(vectors, rows, factor):
                    a, c = anchors[q], own[d]
                    yield a, ids[c], scores, self.labels[a][:, None] == labels[c][None], self.ids[a][:, None] != ids[c][None]


def _each_block(spark: SparkSession, blocks: DataFrame, solve: Callable[[Row], DataFrame]) -> DataFrame:
    """The union over blocks of what solve() makes of one, each written before the next is fetched."""
    out = None
    for name in [r.block for r in blocks.select("block").orderBy("block").collect()]:  # one number for each 8 MB of anchors
        part = materialise(solve(blocks.filter(F.col("block") == name).first()))  # of bounded size
        out = part if out is None else out.union(part)
    return out


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         factor: int = 256, block_bytes: int = BLOCK_BYTES, task_rows: int = TASK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows and anchors as usable() makes them.

    A negative's score lies within low to high per cent of the positive's.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    blocks = anchor_blocks(anchors.distinct(), block_bytes)
    if blocks.isEmpty():
        return spark.createDataFrame([], schema)
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // task_rows))
    dealt = rows.repartition(tasks)

    def best_positives(held: Row) -> DataFrame:
        shared = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _Anchors(shared.value)
            best = Best(len(block.ids), positives)
            for a, ids, scores, same, other in block.met(batches, factor):
                best.add(a, ids, scores, same & other)
            row, ids, score, wide = best.found()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(row), shared.value.block)), pa.array(row), pa.array(ids), pa.array(score), pa.array(wide, pa.binary())],
                ["block", "anchor", "id", "score", "wide"],
            )

        local = dealt.mapInArrow(run, "block long, anchor long, id long, score long, wide binary")
        order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.desc("wide"), "id")
        return local.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)

    chosen = _each_block(spark, blocks, best_positives)

    def best_negatives(held: Row) -> DataFrame:
        own = chosen.filter(F.col("block") == held.block).collect()  # `positives` rows for each anchor of a block
        shared = spark.sparkContext.broadcast((held, own))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, own = shared.value
            block = _Anchors(held)
            n = len(block.ids)
            windows = np.empty((2, n, positives), object)
            windows[0], windows[1] = 1, 0
            who = {(r.anchor, r.place - 1): r for r in own}
            for (a, j), r in who.items():
                exact = from_bytes(r.score, r.wide)
                windows[:, a, j] = -(-low * exact // 100), high * exact // 100
            bounded = np.clip(windows, -(1 << 63) + 2, (1 << 63) - 1).astype(np.int64)
            best = Best(n * positives, negatives)
            for a, ids, scores, same, other in block.met(batches, factor):
                least, most = windows[:, a] if scores.dtype == object else bounded[:, a]
                allowed = ~same & other
                for j in range(positives):
                    best.add(a * positives + j, ids, scores, allowed & (scores >= least[:, j, None]) & (scores <= most[:, j, None]))
            row, ids, score, wide = best.found()
            whose = [who[divmod(r, positives)] for r in row.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), pa.array(block.ids[row // positives]), pa.array([w.id for w in whose], pa.int64()), pa.array(ids),
                 pa.array([w.score for w in whose], pa.int64()), pa.array(score), pa.array(wide, pa.binary())],
                ["pair", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score", "wide"],
            )

        local = dealt.mapInArrow(run, "pair long, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long, wide binary")
        order = Window.partitionBy("pair").orderBy(F.desc("negative_score"), F.desc("wide"), "negative_id")
        ranked = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
        return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

    return _each_block(spark, blocks, best_negatives)


def op13(embeddings: DataFrame) -> DataFrame:
    """Hard negatives for each row whose vec_id is divisible by 100; where it is divisible by 7, the label is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = usable(embeddings, "vec_id", label, "embedding")
    return mine(rows, rows.filter(F.col("id") % 100 == 0))
