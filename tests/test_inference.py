import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stanzaflow.operators import density, inference, probe
from stanzaflow.plans import analyses


def test_changepoint_and_short_series(spark):
    rng = random.Random(1)
    rows = [(1900 + i, (1.0 if i < 7 else 3.0) + rng.random() * 0.1) for i in range(15)]
    df = spark.createDataFrame(rows, "y int, v double")
    v = np.array([x for _, x in rows])
    sse = {k: v[:k].var() * k + v[k:].var() * (15 - k) for k in range(2, 14)}
    got = inference.changepoint(df, "y", "v").first()
    assert got.changepoint == 1906 == 1899 + min(sse, key=sse.get) and got.sse == pytest.approx(min(sse.values()))
    assert inference.changepoint(df.limit(4), "y", "v").collect() == []


def groups(spark):
    rng = random.Random(2)
    rows = [(i, i % 2 == 0, rng.random() + (i % 2) * 0.5, 50.0 + i % 7, i % 9) for i in range(80)]
    return spark.createDataFrame(rows, "i int, g boolean, w double, n double, c int")


def test_bootstrap_against_numpy(spark):
    df = groups(spark)
    a, b = df.filter("g"), df.filter("not g")
    got = inference.bootstrap_difference(a, b, ["i"], "w", "n", 600).first()
    x, y = (np.array([(r.w, r.n) for r in s.collect()]) for s in (a, b))
    rng = np.random.default_rng(0)
    pool = lambda z: 100 * z[:, 0].sum() / z[:, 1].sum()
    d = [pool(y[rng.integers(0, 40, 40)]) - pool(x[rng.integers(0, 40, 40)]) for _ in range(4000)]
    assert got.point == pytest.approx(pool(y) - pool(x))
    assert got.lo == pytest.approx(np.percentile(d, 2.5), abs=0.06) and got.hi == pytest.approx(np.percentile(d, 97.5), abs=0.06)
    again = inference.bootstrap_difference(a.repartition(5), b.repartition(3), ["i"], "w", "n", 600).first()
    assert (again.lo, again.hi, again.p) == pytest.approx((got.lo, got.hi, got.p))
    assert inference.bootstrap_difference(a.limit(0), b, ["i"], "w", "n", 10).collect() == []


def test_clusters_keep_sums(spark):
    df = groups(spark)
    assert inference.clusters(df, "c", "w", "n").agg(F.sum("w")).first()[0] == pytest.approx(df.agg(F.sum("w")).first()[0])


def test_permutation(spark):
    df = groups(spark)
    low = inference.permutation_p(df.withColumn("g", ~F.col("g")), ["i"], "g", "w", "n", 200).first()
    high = inference.permutation_p(df, ["i"], "g", "w", "n", 200).first()
    assert low.observed == pytest.approx(-high.observed) and low.p <= 0.02 and high.p > 0.9


def test_eras_overlap_and_leave_gaps(spark):
    df = spark.createDataFrame([(1650,), (1690,), (1800,), (1895,), (None,)], "year int")
    got = density.in_eras(df, "year", density.era_table(spark, density.ERAS["anthology"])).collect()
    assert sorted((r.year, r.era) for r in got) == [(1650, "founding"), (1650, "pre"), (1690, "pre"), (1800, "mid"), (1800, "pre"), (1895, "rupture")]
    rows = spark.createDataFrame([(0.0, 2.0), (1.0, 3.0)], "a double, b double")
    ratios = [r.ratio for r in density.difference_and_ratio(rows, "a", "b").collect()]
    assert np.isnan(ratios[0]) and ratios[1] == 3.0


def test_probe(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) + (i % 2) * 3).tolist(), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y int")
    folds = probe.cross_validated_accuracy(df, "v", "y", "id").collect()
    assert [r.n for r in folds] == [12] * 5 and np.mean([r.accuracy for r in folds]) > 0.95
    assert probe.cross_validated_accuracy(df.limit(20), "v", "y", "id").collect() == []
    x, y = np.array([v for _, v, _ in rows]), np.array([k for _, _, k in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(60):
        own, near = d[i][(y == y[i]) & (np.arange(60) != i)].mean(), d[i][y != y[i]].mean()
        s.append((near - own) / max(near, own))
    assert probe.silhouette(df, "id", "v", "y", block=16).first()[0] == pytest.approx(np.mean(s))
    assert np.isnan(probe.silhouette(df.filter("y = 1"), "id", "v", "y").first()[0])
    null = probe.shuffled_null(df, "v", "y", "id", 0.99, b=2).first()
    assert null.p == 0.0 and 0.2 < null.null_mean < 0.8


def test_embedding_is_a_masked_mean(spark):
    def encoder():
        def run(texts):
            size = max(map(len, texts))
            v = np.array([[[float(ord(c)), 1.0] for c in t.ljust(size)] for t in texts])
            return v, np.array([[1.0] * len(t) + [0.0] * (size - len(t)) for t in texts])

        return run

    got = probe.embed(spark.createDataFrame([("ac",), ("b",)], "t string"), "t", encoder).collect()
    assert [r.embedding for r in got] == [[98.0, 1.0], [98.0, 1.0]]


#: A published yearly series (year, characters, weighted presence, control tokens) and its results.
SERIES = [
    (1884, 857, 0.85, 0), (1885, 537, 0.0, 2), (1886, 1270, 0.0, 7), (1887, 2826, 7.25, 6), (1889, 626, 0.0, 2), (1890, 495, 0.0, 3),
    (1891, 793, 0.0, 1), (1894, 523, 0.0, 0), (1895, 2842, 3.6, 3), (1896, 1750, 0.8, 3), (1897, 2388, 1.0, 9), (1899, 948, 3.6, 4),
    (1900, 1027, 2.7, 2), (1901, 2598, 0.8, 6), (1903, 2754, 0.8, 4), (1905, 776, 0.85, 3), (1907, 720, 2.8, 2), (1909, 3609, 3.55, 6),
    (1910, 2387, 0.0, 2), (1911, 2209, 0.85, 5), (1912, 8379, 5.4, 22), (1913, 5675, 6.35, 10), (1914, 2198, 1.65, 4), (1915, 2346, 5.45, 10),
    (1916, 7837, 10.95, 26), (1917, 20625, 10.0, 32),
]
SIGNAL_BY_ERA = {"pre": 0.10218241453261007, "rupture": 0.1306532663316583, "post": 0.07961296346980504}
CONTROL_BY_ERA = {"pre": 0.2649173710104705, "rupture": 0.23450586264656617, "post": 0.21251589844316005}


def test_published_series(spark):
    rows = [(year, n, w, 100 * w / n, t) for year, n, w, t in SERIES]
    df = spark.createDataFrame(rows, "year int, n_chars int, signal_weighted double, signal_density100 double, control_tokens int")
    found = analyses.trajectory(df)
    for table, want in (("eras", SIGNAL_BY_ERA), ("control", CONTROL_BY_ERA)):
        got = found[table].first().asDict()
        assert got == {f"{era}_density": pytest.approx(x, rel=1e-12) for era, x in want.items()}
    assert found["changepoint"].first().changepoint == 1897
    boot = inference.bootstrap_difference(df.filter("year <= 1894"), df.filter("year BETWEEN 1895 AND 1900"), ["year"], "signal_weighted", "n_chars", 2000).first()
    assert boot.point == pytest.approx(0.028470851799048236) and abs(boot.lo + 0.0856) < 0.01 and abs(boot.hi - 0.2026) < 0.01 and abs(boot.p - 0.565) < 0.06
    loose = inference.bootstrap_difference(df.filter("year <= 1894"), df.filter("year BETWEEN 1895 AND 1900"), ["year"], "signal_weighted", "n_chars", 2000, poisson=True).first()
    assert loose.point == boot.point and abs(loose.lo - boot.lo) < 0.03 and abs(loose.hi - boot.hi) < 0.05
