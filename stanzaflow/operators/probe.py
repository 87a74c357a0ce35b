"""The embedding probe: weak labels, stratified folds, logistic accuracy, silhouette, shuffled null."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from stanzaflow.operators.density import era_table, in_eras
from stanzaflow.operators.matching import contains_count
from stanzaflow.operators.probing import Blocks, fitted
from stanzaflow.operators.scans import ranked
from stanzaflow.sources.scratch import bounded_batches, materialise

#: Tasks that pack vectors in blocks, at most, and blocks that a task of the product of blocks holds, at most.
PACKERS, HELD = 64, 64


def weak_label(text: Column, signal: Iterable[str], control: Iterable[str]) -> Column:
    """1 if a text contains more signal than control forms, 0 if fewer; null on ties, which are dropped."""
    s, c = contains_count(text, signal), contains_count(text, control)
    return F.when(s > c, 1).when(s < c, 0)


def with_folds(df: DataFrame, label: str, order: str, folds: int = 5) -> DataFrame:
    """df with a stratified, unshuffled fold: equal parts of each label in order."""
    placed = ranked(df, [label], [order], "_place", "_size")
    return placed.withColumn("fold", F.floor(F.col("_place") * folds / F.col("_size")).cast("int")).drop("_place", "_size")


def cross_validated_accuracy(df: DataFrame, vector: str, label: str, order: str, folds: int = 5, ridge: float = 0.01) -> DataFrame:
    """fold, n, accuracy of a logistic regression; no row unless two labels and over 30 rows are there.

    The accuracies, a number for each fold, are taken at once, so that nothing stays in memory behind them.
    """
    rows = with_folds(df.filter(F.col(label).isNotNull()), label, order, folds)
    rows = rows.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>"))).withColumn("_y", F.col(label).cast("double"))
    rows = rows.select("fold", "_x", "_y").persist()
    n, labels = rows.agg(F.count(F.lit(1)), F.countDistinct("_y")).first()
    out = []
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=ridge, predictionCol="_p")
    for k in range(folds if enough(n, labels) else 0):
        fitted = model.fit(rows.filter(F.col("fold") != k))
        right = fitted.transform(rows.filter(F.col("fold") == k)).groupBy("fold")
        out += right.agg(F.count(F.lit(1)), F.avg((F.col("_p") == F.col("_y")).cast("double"))).collect()
    rows.unpersist()
    return df.sparkSession.createDataFrame([tuple(r) for r in out], "fold int, n long, accuracy double")


def enough(n: int | Column, labels: int | Column) -> bool | Column:
    """Whether a probe is worth fitting: two labels and over 30 rows."""
    return (n > 30) & (labels > 1)


def subgroups(df: DataFrame, year: str, label: str, eras: list[tuple[str, int | None, int | None]]) -> DataFrame:
    """era, n, positives, fit (enough rows and labels) of the labelled rows of each era; a null year counts as -1."""
    known = df.filter(F.col(label).isNotNull()).withColumn("_year", F.coalesce(year, F.lit(-1)))
    by_era = in_eras(known, "_year", era_table(df.sparkSession, eras)).groupBy("era")
    sums = by_era.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("positives"), F.countDistinct(label).alias("_labels"))
    return sums.select("era", "n", "positives", enough(F.col("n"), F.col("_labels")).alias("fit"))


def subgroup_accuracy(
    df: DataFrame, vector: str, label: str, order: str, year: str, eras: list[tuple[str, int | None, int | None]],
    probe: Callable[[DataFrame, str, str, str], DataFrame] = cross_validated_accuracy,
) -> DataFrame:
    """era, n, accuracy of a probe fitted in each era that has enough; eras are a few. A null year counts as -1."""
    out = df.sparkSession.createDataFrame([], "era string, n long, accuracy double")
    for era, low, high in eras:
        own = in_eras(df.withColumn("_year", F.coalesce(year, F.lit(-1))), "_year", era_table(df.sparkSession, [(era, low, high)]))
        folds = probe(own, vector, label, order)
        means = folds.agg(F.sum("n").alias("n"), F.avg("accuracy").alias("accuracy")).filter("n IS NOT NULL")
        out = out.union(means.select(F.lit(era), "n", "accuracy"))
    return out


def silhouette(df: DataFrame, key: str, vector: str, label: str, block: int = 1024) -> DataFrame:
    """silhouette: the mean Euclidean silhouette, NaN with one label.

    All points meet all: rows are packed in blocks, and blocks meet in a Cartesian product whose tasks hold HELD blocks at most and
    add up each block's distances by label in numpy; only these sums leave a task. Blocks, not rows, are moved, once for each part of the other
    side. The time is quadratic by definition; a single label's points score 0 if they are alone.
    """
    spark = bounded_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("l"), F.col(vector).cast("array<double>").alias("v"))
    n = -(-rows.count() // block)
    packs = rows.repartition(max(1, min(n, PACKERS))).mapInArrow(partial(_packed, block=block), "k array<long>, l array<int>, v binary")
    packs = materialise(packs.withColumn("id", F.monotonically_increasing_id()))
    held = max(1, -(-n // HELD))
    parts = max(1, min(n, -(-3 * spark.sparkContext.defaultParallelism // held)))
    theirs = packs.select(*[F.col(c).alias(f"{c}2") for c in ("k", "l", "v")]).repartition(held)
    met = packs.repartition(parts).join(theirs.hint("shuffle_replicate_nl"))
    by_label = met.mapInArrow(_distances, "k long, l int, other int, n long, d double")
    by_label = by_label.groupBy("k", "l", "other").agg((F.sum("d") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"))
    points = by_label.groupBy("k").agg(
        F.max(F.when(F.col("l") == F.col("other"), F.col("mean"))).alias("own"), F.min(F.when(F.col("l") != F.col("other"), F.col("mean"))).alias("near")
    )
    s = F.coalesce((F.col("near") - F.col("own")) / F.nullif(F.greatest("near", "own"), F.lit(0.0)), F.lit(0.0))
    return points.agg(F.when(F.count("near") == 0, F.lit(float("nan"))).otherwise(F.avg(s)).alias("silhouette"))


def _packed(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, l, v) as one row for each block of them, in label order."""

    def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).sort_by("l")
        if table["v"].null_count or len(set(pc.list_value_length(table["v"]).to_pylist())) != 1:
            raise ValueError("a silhouette takes vectors of one length, none of them null")
        vectors = pc.list_flatten(table["v"]).to_numpy().tobytes()
        lists = [pa.array([table[c].to_pylist()], pa.list_(t)) for c, t in (("k", pa.int64()), ("l", pa.int32()))]
        return pa.RecordBatch.from_arrays([*lists, pa.array([vectors], pa.binary())], ["k", "l", "v"])

    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, block - n))
            batch, n = batch.slice(held[-1].num_rows), n + held[-1].num_rows
            if n == block:
                yield one(held)
                held, n = [], 0
    if held:
        yield one(held)


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pairs of blocks: each row's distances to rows of other keys, counted and summed by label, over all blocks that follow one another with the same id."""

    def side(batch: pa.RecordBatch, i: int, end: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys = batch[f"k{end}"][i].values.to_numpy()
        vectors = np.frombuffer(batch[f"v{end}"][i].as_buffer()).reshape(len(keys), -1)
        return keys, batch[f"l{end}"][i].values.to_numpy(zero_copy_only=False), vectors, (vectors**2).sum(1)

    def summed() -> Iterator[pa.RecordBatch]:
        for other, (n, d) in sums.items():
            labels = pa.array(own, pa.int32(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), labels, pa.array([other] * len(k), pa.int32()), pa.array(n), pa.array(d)], ["k", "l", "other", "n", "d"])

    at, sums = None, {}
    for batch in batches:
        for i, block in enumerate(batch["id"].to_pylist()):
            if block != at:
                yield from summed()
                at, sums = block, {}
                k, own, x, xx = side(batch, i, "")
            k2, labels, y, yy = side(batch, i, "2")
            d = xx[:, None] - 2 * x @ y.T + yy[None]
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            labels, starts, sizes = np.unique(labels, return_index=True, return_counts=True)  # a pack lies in label order, null last
            n = np.repeat(sizes[None], len(k), 0)
            shared = np.flatnonzero(np.isin(k, k2))
            if len(shared):
                same = k[shared, None] == k2[None]
                d[shared] = np.where(same, 0, d[shared])
                n[shared] -= np.add.reduceat(same.astype(np.int64), starts, axis=1)
            d = np.add.reduceat(d, starts, axis=1)
            for j, label in enumerate(labels.tolist()):
                label = None if label != label else int(label)
                was = sums.get(label, (0, 0))
                sums[label] = was[0] + n[:, j], was[1] + d[:, j]
    yield from summed()


def shuffled_null(df: DataFrame, vector: str, label: str, order: str, accuracy: float, b: int = 200, seed: int = 42) -> DataFrame:
    """null_mean, null_std (population), p = share of shuffles whose accuracy reaches the given one. All shuffles are fitted together."""
    blocks = Blocks.of(df, vector, label, order)
    stats = []
    if enough(blocks.n, 1 + (0 < blocks.ones < blocks.n)):
        found = fitted(blocks, b + 1, seed=seed)[1:]
        means = (found[:, :, 1] / np.maximum(found[:, :, 0], 1)).mean(1)
        stats = [(rep, float(mean)) for rep, mean in enumerate(means)]
    return null_statistics(df.sparkSession.createDataFrame(stats, "rep int, accuracy double"), F.lit(accuracy))


def null_statistics(replicates: DataFrame, accuracy: Column) -> DataFrame:
    """null_mean, null_std (population) and p, the share that reaches an accuracy, of replicates (accuracy)."""
    return replicates.agg(
        F.avg("accuracy").alias("null_mean"), F.stddev_pop("accuracy").alias("null_std"), F.avg((F.col("accuracy") >= accuracy).cast("double")).alias("p")
    )


def embed(df: DataFrame, text: str, encoder: Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray]]], batch: int = 16) -> DataFrame:
    """df with `embedding`: the mean of an encoder's token vectors under its mask.

    `encoder` makes, once in each task, a function from texts to (texts x tokens x size, texts x tokens mask).
    """

    def pooled(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = encoder()
        for texts in frames:
            out = []
            for i in range(0, len(texts), batch):
                vectors, mask = run(texts.iloc[i : i + batch].fillna("").tolist())
                weight = np.maximum(mask.sum(1, keepdims=True), 1e-9)
                out.extend(((vectors * mask[:, :, None]).sum(1) / weight).tolist())
            yield pd.Series(out)

    return df.withColumn("embedding", F.pandas_udf(pooled, "array<double>")(F.col(text)))
