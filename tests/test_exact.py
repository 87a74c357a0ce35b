"""Exact resampling in shards, selection instead of sorting, probes fitted together."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stanzaflow.functions import draws
from stanzaflow.operators import inference, probing


@pytest.mark.parametrize(("k", "p"), [(0, 0.3), (1, 0.5), (40, 0.2), (1000, 0.37), (3000, 0.001), (3000, 0.999), (10, 0.0), (10, 1.0)])
def test_binomials_are_the_inverse_of_the_distribution(k, p):
    u = np.random.default_rng(k).random(300)
    weights = [math.comb(k, j) * p**j * (1 - p) ** (k - j) if k < 200 else math.exp(
        math.lgamma(k + 1) - math.lgamma(j + 1) - math.lgamma(k - j + 1) + j * math.log(p) + (k - j) * math.log1p(-p)) for j in range(k + 1)]
    want = np.minimum((np.cumsum(weights)[None] <= u[:, None]).sum(1), k)
    assert (draws.binomial(np.full(300, k), p, u) == want).all()


def test_large_binomials_have_their_moments():
    u = draws.drawn(draws.base(1), np.arange(4000)) / 2.0**32
    x = draws.binomial(np.full(4000, 10**7), 0.3, u)
    assert abs(x.mean() - 3e6) < 5 * math.sqrt(2.1e6 / 4000) and 0.94 < x.std() / math.sqrt(2.1e6) < 1.06


def frame(spark, n, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.random() * 3, rng.randrange(1, 90)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "i long, w double, n int")


def test_split_draws_sum_to_n_and_do_not_depend_on_the_split(spark):
    _, df = frame(spark, 700)
    runs = [inference.split_replicates(d, ["i"], "w", "n", "a", 60, 5, 50).collect() for d in (df, df.repartition(7), df.orderBy(F.desc("w")))]
    assert all(r.draws == 700 for r in runs[0]) and len(runs[0]) == 60
    same = [sorted((r.rep, round(r.density, 9)) for r in run) for run in runs]
    assert same[0] == same[1] == same[2]


def test_split_densities_are_distributed_like_plain_resamples(spark):
    rows, df = frame(spark, 400)
    w, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    pick = np.random.default_rng(1).integers(0, 400, (4000, 400))
    want = 100 * w[pick].sum(1) / n[pick].sum(1)
    for shard_rows in (20, 1000):
        got = np.array([r.density for r in inference.split_replicates(df, ["i"], "w", "n", "a", 4000, 9, shard_rows).collect()])
        assert abs(got.mean() - want.mean()) < 5 * want.std() / math.sqrt(4000) and 0.93 < got.std() / want.std() < 1.07


def test_split_with_copies_nulls_and_no_rows(spark):
    copies = spark.range(500).select(F.lit(1).alias("i"), F.lit(2.0).alias("w"), F.lit(10).alias("n"))
    assert {round(r.density, 9) for r in inference.split_replicates(copies, ["i"], "w", "n", "a", 20, 1, 30).collect()} == {20.0}
    odd = spark.createDataFrame([(None, 1.0, 5), (2, None, 5), (3, 1.0, None)], "i int, w double, n int")
    out = inference.split_replicates(odd, ["i"], "w", "n", "a", 10, 1).collect()
    assert len(out) == 10 and all(r.draws == 3 for r in out)
    assert inference.bootstrap_difference(copies.limit(0), copies, ["i"], "w", "n", 10, split=True).collect() == []


@pytest.mark.parametrize("md5", [False, True])
def test_selection_equals_sorting(spark, md5):
    rows, df = frame(spark, 300)
    for size in (0, 1, 77, 299, 300):
        numbered = df.select(F.col("i").alias("_idx"), F.col("w").alias("num"), F.col("n").cast("double").alias("den"))
        num, den, bound = inference.selected_sums(numbered.repartition(3), 300, size, 30, 4, md5, bins=5)
        hashed = inference.hashes(4, np.arange(30), np.arange(300), md5)
        for rep in range(30):
            own = np.argsort(hashed[rep])[:size]
            assert num[rep] == pytest.approx(sum(rows[i][1] for i in own)) and den[rep] == sum(rows[i][2] for i in own)
            assert (hashed[rep] < bound[rep]).sum() == size


def test_permutation_without_a_sort(spark):
    _, df = frame(spark, 250)
    df = df.withColumn("g", F.col("i") % 3 == 0).withColumn("w", F.col("w") + F.when(F.col("g"), 0.6).otherwise(0.0))
    low, high = (inference.permutation_p(df.withColumn("g", g), ["i"], "g", "w", "n", 400).first() for g in (F.col("g"), ~F.col("g")))
    assert low.p < 0.05 and high.p > 0.9 and low.observed == pytest.approx(-high.observed)
    again = inference.permutation_p(df.repartition(9), ["i"], "g", "w", "n", 400).first()
    assert again == low
    assert inference.permutation_p(df.limit(0), ["i"], "g", "w", "n", 20).first() == (0.0, 1.0)


def plain_fit(x, y, test, steps, ridge=0.01, scale=None):
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        g = x[~test].T @ (1 / (1 + np.exp(-x[~test] @ w)) - y[~test]) / (~test).sum()
        g[:-1] += ridge * w[:-1]
        w -= scale @ g
    return w


def test_probes_fitted_together_equal_fits_one_by_one(spark):
    rng = np.random.default_rng(2)
    n, b = 230, 6
    x = rng.normal(size=(n, 5))
    y = (x[:, 0] + rng.normal(size=n) > 0.4).astype(int)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)] + [(900, [0.0] * 5, None)], "i long, x array<double>, y int").repartition(5)
    blocks = probing.Blocks.of(df, "x", "y", "i", 64)
    got = probing.fitted(blocks, b + 1, 5, steps=8)
    full = np.concatenate([x, np.ones((n, 1))], 1)
    scale = np.linalg.inv(full.T @ full / (4 * n) + np.diag([0.01] * 5 + [1e-9]))
    hashed = inference.hashes(42, np.arange(b), np.arange(n), False)
    for rep in range(b + 1):
        own = y if rep == 0 else np.isin(np.arange(n), np.argsort(hashed[rep - 1])[: y.sum()]).astype(int)
        fold = np.zeros(n, int)
        for label in (0, 1):
            place = np.flatnonzero(own == label)
            fold[place] = np.arange(len(place)) * 5 // len(place)
        for k in range(5):
            w = plain_fit(full, own, fold == k, 8, scale=scale)
            right = ((full[fold == k] @ w > 0) == own[fold == k]).sum()
            assert got[rep, k].tolist() == [(fold == k).sum(), right]
    out = probing.probe_null(df, "x", "y", "i", 20).first()
    assert out.accuracy > out.null_mean + 3 * out.null_std and out.p == 0 and 0.5 < out.null_mean < 0.7
    assert [r.fold for r in probing.probe_accuracy(df, "x", "y", "i").collect()] == list(range(5))
    assert probing.probe_accuracy(df.filter("y = 1"), "x", "y", "i").collect() == [] and probing.probe_null(df.limit(20), "x", "y", "i").collect() == []


def test_short_draws_equal_the_long_ones(spark, monkeypatch):
    """Draws in 32-bit words are those of 64-bit words, and places by an array those by searching."""
    x = np.random.default_rng(3).integers(0, 1 << 32, 5000, dtype=np.uint64)
    assert (draws.mixed32(x.astype(np.uint32)) == draws.mixed(x)).all()
    rows = [(i % 7, float(i % 3), i % 5 + 1) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, num double, den long")
    split = lambda: [tuple(r) for r in inference.split_replicates(df, ["k"], "num", "den", "a", 30, 1, shard_rows=50).orderBy("rep").collect()]
    spread = split()
    monkeypatch.setattr(inference, "SPREAD", 0)
    assert split() == spread
    rows = spark.range(500).selectExpr("id AS _idx", "id % 3 + 0.5D AS num", "id % 5 + 1.0D AS den")
    num, den, _ = inference.selected_sums(rows, 500, 180, 40, 9)
    idx = np.arange(500)
    first = [np.argsort(inference.hashes(9, np.array([r]), idx, False)[0])[:180] for r in range(40)]
    assert num.tolist() == [(i % 3 + 0.5).sum() for i in first] and den.tolist() == [(i % 5 + 1.0).sum() for i in first]


def plain_split(rows, b, shard_rows, seed, stratum):
    """num and den of b replicates of rows (key, num, den) without copies: each shard walks its own path, and draws are made one by one."""
    n, start = len(rows), draws.base(seed, stratum)
    bits = (-(-n // shard_rows) - 1).bit_length()
    hashed = [int(hashlib.md5(str(r[0]).encode()).hexdigest()[:8], 16) for r in rows]
    out = np.zeros((2, b))
    for shard in {h >> (32 - bits) for h in hashed}:
        k = np.full(b, n)
        for level in range(bits):
            node = shard >> (bits - level)
            of, left_of = (sum(h >> (32 - at) == x for h in hashed) for at, x in ((level, node), (level + 1, 2 * node)))
            left = draws.binomial(k, left_of / of, draws.drawn(start, np.arange(b), (1 << level) + node) / 2.0**32)
            k = k - left if shard >> (bits - level - 1) & 1 else left
        own = sorted((r for r, h in zip(rows, hashed) if h >> (32 - bits) == shard), key=lambda r: str(r[0]))
        for rep in range(b):
            for i in draws.places(draws.drawn(start, np.full(k[rep], rep), (1 << bits) + shard, np.arange(k[rep])), len(own)):
                out[:, rep] += own[i][1:]
    return out


def python_rows(plan):
    """Rows that a plan, once run, had back from Python."""
    if "AdaptiveSparkPlan" in plan.nodeName():
        return python_rows(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return python_rows(plan.plan())
    metric, children = plan.metrics().get("pythonNumRowsReceived"), plan.children()
    return (metric.get().value() if metric.isDefined() else 0) + sum(python_rows(children.apply(i)) for i in range(children.size()))


def test_shards_of_a_block_share_their_path(spark):
    rows, df = frame(spark, 900)
    out = inference.split_replicates(df, ["i"], "w", "n", "a", 50, 5, 3)  # 512 shards
    got = {r.rep: r.density for r in out.collect()}
    num, den = plain_split(rows, 50, 3, 5, "a")
    assert [got[rep] for rep in range(50)] == pytest.approx((100 * num / den).tolist())
    assert python_rows(out._jdf.queryExecution().executedPlan()) < 1000  # not 50 for each shard


def test_blocks_of_one_shard_or_several_make_the_same_draws(spark, monkeypatch):
    _, df = frame(spark, 300)
    runs = []
    for most in (1, 70 * 40, 1 << 24):  # 300 rows in 32 shards: blocks of 1, 4 and 32
        monkeypatch.setattr(inference, "BLOCK_DRAWS", most)
        runs.append([(r.rep, round(r.density, 9), r.draws) for r in inference.split_replicates(df, ["i"], "w", "n", "a", 70, 5, 10).orderBy("rep").collect()])
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 70 and all(r[2] == 300 for r in runs[0])


def test_binomials_with_a_share_each():
    k, p = np.array([[0, 7], [400, 90000], [50, 50]]), np.array([[0.3], [0.001], [1.0]])
    u = draws.drawn(draws.base(7), np.arange(6)).reshape(3, 2) / 2.0**32
    got = draws.binomial(k, p, u)
    assert got.shape == (3, 2) and [[int(draws.binomial(k[i, j : j + 1], p[i, 0], u[i, j : j + 1])[0]) for j in range(2)] for i in range(3)] == got.tolist()
