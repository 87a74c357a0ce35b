import math
from fractions import Fraction

import numpy as np
import pytest

from stanzaflow.llm import knn

SCHEMA = "vec_id long, embedding array<float>, label int, id int, cell string, v string"


def plain(rows, k=10, every=100, number=lambda x: float(np.float32(x))):
    good = []
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(1024 * Fraction(number(x))) for x in v]))
    out = set()
    for q, a in good:
        if q % every == 0:
            scored = [(-sum(x * y for x, y in zip(a, b)), d) for d, b in good if d != q and len(a) == len(b)]
            out |= {(q, n + 1, d, max(-(2**63), min(2**63 - 1, -s))) for n, (s, d) in enumerate(sorted(scored)[:k])}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 0, 1, "c", "v") for i, v in rows], SCHEMA)
    data = knn.usable(df, "vec_id", "embedding")
    got = knn.top_k(data, data.filter("id % 100 = 0").distinct(), **kw).collect()
    assert len(got) == len(set(map(tuple, got)))
    return set(map(tuple, got))


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 12))
    rows = [(i, (centre[i % 6] + rng.normal(size=12) * 0.2).tolist()) for i in range(900)]
    want = plain(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, pivots=5, data_block=64, query_block=2) == want


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []),
            (100, [1.0, 2.0, 3.0]), (7, [0.0, 0.0]), (8, [0.0, 0.0]), (9, [-1.0, 0.5]), (200, None)]
    rows += [(300 + i, [1.0, 2.0]) for i in range(25)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == set() and run(spark, [(1, [1.0])]) == set()


@pytest.mark.parametrize("copies", [2, 15])
def test_a_query_id_of_several_rows(spark, copies):
    rows = [(0, [10.0, 0.0])] * copies + [(1 + i, [10.0, 0.0]) for i in range(9)]
    rows += [(20 + i, [-10.0, 0.1 * i]) for i in range(30)]
    want = plain(rows)
    assert len(want) == 10 and run(spark, rows, pivots=2) == want


def test_large_components_stay_exact():
    a = np.array([[2.0**40, 3.0], [1.0, 1.0]])
    assert knn.products(a, a).tolist() == [[2**100 + 9 * 2**20, 2**60 + 3 * 2**20], [2**60 + 3 * 2**20, 2 * 2**20]]
    b = np.array([[2.0**18 + 1, 2.0**18 - 1]])
    assert knn.products(b, b).tolist() == [[2**20 * ((2**18 + 1) ** 2 + (2**18 - 1) ** 2)]]
    assert knn.products(np.array([[1.7e308]]), np.array([[-1.7e308]]))[0, 0] == -((int(1.7e308) * 1024) ** 2)


def test_finite_components_of_any_size_take_part(spark):
    rows = [(0, [1e14, 1.0]), (100, [-3.0, 0.5]), (200, [1.7e308, 0.0]), (1, [1e14, 0.0]), (2, [1e300, 2.0]), (3, [1.6e308, 2.0]), (4, [-1e200, 7.0]),
            (5, [9e15, 1.0]), (6, [0.25, -0.5]), (7, [1.0, 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [0.0, 0.0]), (10, [5e-324, -5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = set(map(tuple, knn.op10(df).collect()))
    assert got == plain(rows, number=float) and len(got) == 30


def test_clustered_data_prune(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 24))
    rows = [(i, (centre[i % 40] + rng.normal(size=24) * 0.1).tolist()) for i in range(4000)]
    df = spark.createDataFrame([(i, v, 0, 1, "c", "v") for i, v in rows], SCHEMA)
    data = knn.usable(df, "vec_id", "embedding")
    _, sent, sizes = knn.replicated(data, data.filter("id % 100 = 0"), 10)
    assert sent.count() < 0.2 * 40 * len(sizes)
    assert run(spark, rows) == plain(rows)
