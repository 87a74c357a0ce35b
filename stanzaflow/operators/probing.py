"""Logistic probes by the hundred: the folds of many labellings fitted together, in a fixed number of passes over the table.

Rows are numbered in order and packed into blocks. A labelling gives 1 to the rows with the least hashes, as many as there were: every task knows
its rows' labels from the labelling's bound, and their folds from counts of earlier blocks, so that nothing is joined or shuffled. All models step
together: a pass multiplies a block with the weights of all models, and what a task hands on is one gradient for each model, merged by addition. The
Hessian's bound, a quarter of the rows' second moments, is the same for all models and scales their steps; a fixed number of steps makes fits repeatable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stanzaflow.operators.inference import hashes, selected_sums
from stanzaflow.operators.scans import ranked
from stanzaflow.sources.scratch import materialise

#: Rows of a block, models whose sums are merged together, scores made at once.
BLOCK, TOGETHER, SCORES = 8192, 64, 1 << 20


@dataclass
class Blocks:
    """Rows of two labels in order, `block` of them packed together: block, y, x (all vectors one after the other); n rows, `ones` of label 1, vectors of `size`."""

    table: DataFrame
    n: int
    ones: int
    size: int
    block: int

    @classmethod
    def of(cls, df: DataFrame, vector: str, label: str, order: str, block: int = BLOCK) -> Blocks:
        """Rows whose label is null take no part; the order names a row."""
        rows = df.filter(F.col(label).isNotNull()).select(F.col(order).alias("_o"), F.col(label).cast("int").alias("y"), F.col(vector).cast("array<double>").alias("x"))
        rows = ranked(rows, [], ["_o"], "_idx").withColumn("block", F.floor(F.col("_idx") / block).cast("long"))
        packed = F.array_sort(F.collect_list(F.struct("_idx", "y", "x")))  # of `block` rows
        held = rows.groupBy("block").agg(packed.alias("r"))
        held = materialise(held.select("block", F.col("r.y").alias("y"), F.flatten("r.x").alias("x")))
        y = F.aggregate("y", F.lit(0).cast("long"), lambda t, v: t + v)
        n, ones, wide = held.agg(F.sum(F.size("y")), F.sum(y), F.max(F.size("x") / F.size("y"))).first()
        return cls(held, n or 0, ones or 0, int(wide or 0), block)


def _unpacked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, labels and vectors, with a 1 for the intercept, of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            y = batch.column(1)[i].values.to_numpy(zero_copy_only=False)
            x = batch.column(2)[i].values.to_numpy(zero_copy_only=False).reshape(len(y), size)
            yield batch.column(0)[i].as_py(), y, np.concatenate([x, np.ones((len(y), 1))], 1)


def _merged(blocks: Blocks, sums: Callable[[Iterator[pa.RecordBatch]], np.ndarray], width: int) -> np.ndarray:
    """The sum over tasks of arrays of `width` columns that each task makes of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sums(batches)
        for lo in range(0, len(own), TOGETHER):
            yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([own[lo : lo + TOGETHER].tobytes()], pa.binary())], ["part", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": pdf.part[:1], "sums": [sum(np.frombuffer(s) for s in pdf.sums).tobytes()]})

    merged = blocks.table.mapInArrow(run, "part long, sums binary").groupBy("part").applyInPandas(add, "part long, sums binary")
    rows = sorted(merged.collect(), key=lambda r: r.part)  # one array of the models' size
    return np.concatenate([np.frombuffer(r.sums).reshape(-1, width) for r in rows]) if rows else np.zeros((0, width))


def fitted(blocks: Blocks, labellings: int, folds: int = 5, ridge: float = 0.01, steps: int = 12, rate: float | None = None, seed: int = 42) -> np.ndarray:
    """Rows held out and rows right, for each labelling and fold: labellings x folds x 2. Labelling 0 is the given one, the others are shuffles.

    Folds are stratified and unshuffled: equal parts of each label in order. The loss is the mean logistic loss and ridge / 2 times the squared
    weights but for the intercept. Steps start from 0; with a rate they are plain gradient steps.
    """
    n, ones, size, wide, block = blocks.n, blocks.ones, blocks.size, blocks.size + 1, blocks.block
    models, spark = labellings * folds, blocks.table.sparkSession
    bounds = np.zeros(labellings, np.int64)
    if labellings > 1:
        numbers = blocks.table.select(F.explode(F.sequence(F.lit(0), F.size("y") - 1)).alias("i"), "block")
        rows = numbers.select((F.col("block") * block + F.col("i")).alias("_idx"), F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
        bounds[1:] = selected_sums(rows, n, ones, labellings - 1, seed)[2]

    def labels(number: int, y: np.ndarray) -> np.ndarray:
        """rows x labellings."""
        idx = np.arange(len(y)) + number * block
        drawn = hashes(seed, np.arange(labellings - 1), idx, False) if labellings > 1 else np.zeros((0, len(y)), np.uint64)
        return np.concatenate([y[:, None] == 1, (drawn < bounds[1:, None].astype(np.uint64)).T], 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, y, _ in _unpacked(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([labels(number, y).sum(0)], pa.list_(pa.int64()))], ["block", "ones"])

    # A number for each labelling and block of rows: what folds of the blocks behind it begin with.
    counts = sorted(blocks.table.mapInArrow(count, "block long, ones array<long>").collect())
    ahead, before = np.zeros(labellings, np.int64), {}
    for r in counts:
        before[r.block] = ahead
        ahead = ahead + np.array(r.ones)
    earlier = spark.sparkContext.broadcast(before)

    def dealt(number: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Labels and folds, rows x labellings."""
        own = labels(number, y)
        place = np.cumsum(own, 0) + earlier.value[number][None]  # ones up to here
        idx = (np.arange(len(y)) + number * block)[:, None]
        fold = np.where(own, (place - 1) * folds // max(1, ones), (idx - place) * folds // max(1, n - ones))
        return own, fold

    def parts(number: int, y: np.ndarray, x: np.ndarray, weights: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        own, fold = dealt(number, y)
        step = max(1, SCORES // models)
        for lo in range(0, len(y), step):
            s = slice(lo, lo + step)
            z = (x[s] @ weights.T).reshape(-1, labellings, folds)
            yield s, z, own[s][:, :, None], fold[s][:, :, None] == np.arange(folds)[None, None]

    scale = None
    if rate is None:
        def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            return sum((x.T @ x for _, _, x in _unpacked(batches, size)), np.zeros((wide, wide)))

        penalty = np.diag([ridge] * size + [1e-9])
        scale = np.linalg.inv(_merged(blocks, moments, wide) / (4 * max(1, n)) + penalty)
    weights = np.zeros((models, wide))
    held = np.bincount(np.arange(ones) * folds // max(1, ones), minlength=folds) + np.bincount(np.arange(n - ones) * folds // max(1, n - ones), minlength=folds)
    trained = np.tile(np.maximum(1, n - held), labellings)
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(weights)

        def gradients(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros((models, wide))
            for number, y, x in _unpacked(batches, size):
                for s, z, own, test in parts(number, y, x, shared.value):
                    out += np.where(test, 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))) - own).reshape(-1, models).T @ x[s]
            return out

        slope = _merged(blocks, gradients, wide) / trained[:, None]
        slope[:, :-1] += ridge * weights[:, :-1]
        weights = weights - (slope * rate if scale is None else slope @ scale)
        shared.unpersist()
    shared = spark.sparkContext.broadcast(weights)

    def right(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((models, 2))
        for number, y, x in _unpacked(batches, size):
            for _, z, own, test in parts(number, y, x, shared.value):
                out += np.stack([test.sum(0).ravel(), (test & ((z > 0) == own)).sum(0).ravel()], 1)
        return out

    return _merged(blocks, right, 2).reshape(labellings, folds, 2)


def probe_accuracy(df: DataFrame, vector: str, label: str, order: str, folds: int = 5, **fit: object) -> DataFrame:
    """fold, n, accuracy of a probe; no row unless two labels and over 30 rows are there."""
    blocks = Blocks.of(df, vector, label, order)
    out = []
    if blocks.n > 30 and 0 < blocks.ones < blocks.n:
        found = fitted(blocks, 1, folds, **fit)[0]
        out = [(k, int(n), float(right / n) if n else 0.0) for k, (n, right) in enumerate(found)]
    return df.sparkSession.createDataFrame(out, "fold int, n long, accuracy double")


def probe_null(df: DataFrame, vector: str, label: str, order: str, b: int = 200, folds: int = 5, **fit: object) -> DataFrame:
    """accuracy, null_mean, null_std (population) and p, the share of shuffles whose accuracy reaches the given labels'; accuracies are means of folds."""
    blocks = Blocks.of(df, vector, label, order)
    out = []
    if blocks.n > 30 and 0 < blocks.ones < blocks.n:
        found = fitted(blocks, b + 1, folds, **fit)
        means = (found[:, :, 1] / np.maximum(found[:, :, 0], 1)).mean(1)
        out = [(float(means[0]), float(means[1:].mean()), float(means[1:].std()), float((means[1:] >= means[0] - 1e-12).mean()))]
    return df.sparkSession.createDataFrame(out, "accuracy double, null_mean double, null_std double, p double")
