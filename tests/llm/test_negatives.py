import math
import random
import time
from fractions import Fraction

import numpy as np
import pytest

from stanzaflow.llm import dense, knn, negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id int, block int, v string"


def plain(rows):
    good = []
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * Fraction(x)) for x in v)))
    out = []
    for a, label, q in sorted({r for r in good if r[0] % 100 == 0}):
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), d, other) for d, other, v in good if d != a and len(v) == len(q))
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:10]
            clip = lambda s: max(-(2**63), min(2**63 - 1, s))
            out += [(a, p, n + 1, d, clip(-ps), clip(-s)) for n, (s, d, _) in enumerate(fit)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "v") for i, v, label in rows], SCHEMA)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=12).tolist(), int(rng.integers(0, 4))) for i in range(1200)]
    df = frame(spark, rows)
    want = plain(rows)
    assert len(want) > 300 and sorted(map(tuple, negatives.op13(df).collect())) == want
    label = (df.label + 1) % 10
    use = negatives.usable(df, "vec_id", negatives.F.when(df.vec_id % 7 == 0, label).otherwise(df.label), "embedding")
    small = negatives.mine(use, use.filter("id % 100 = 0"), block_bytes=400, task_rows=50)
    assert sorted(map(tuple, small.collect())) == want


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 2), (5, [], 1), (6, [1.0, 1.0], None),
            (None, [1.0, 1.0], 1), (100, [1.0, 2.0, 3.0], 2), (8, [1.0, 2.0, 2.5], 3), (9, [1.0, 2.0, 1.0], 2), (10, [0.5, 1.0], 3), (11, [0.0, 0.0], 2), (200, [0.0, 0.0], 2)]
    rows += [(300 + i, [1.0, 2.0], 1 + i % 2) for i in range(40)]  # ties, and labels that move
    rows += [(500 + i, [0.6, 1.1], 4) for i in range(30)] + [(100, [1.0, 2.0, 3.0], 2), (400, [1.0, 0.0], 1), (400, [0.0, 1.0], 2)]
    rows += [(600, [-1.0, -1.0], 9), (601, [1.0, 1.0], 9)]
    assert sorted(map(tuple, negatives.op13(frame(spark, rows)).collect())) == plain(rows)
    assert negatives.op13(frame(spark, [])).collect() == [] and negatives.op13(frame(spark, rows[1:8])).collect() == []


def test_finite_components_of_any_size(spark):
    rng = random.Random(4)
    sizes = [1.0, 1e5, 3e7, 1e13, 1e16, 1e300]
    rows = [(i if i % 9 else i * 100, [rng.choice(sizes) * rng.uniform(-1, 1.5), rng.choice(sizes) * rng.uniform(0, 1)], i % 2) for i in range(1, 160)]
    rows += [(700, [1e16, 1.0], 1), (701, [1e16, 2.0], 2), (702, [5e15, 0.25], 3)]
    got = sorted(map(tuple, negatives.op13(frame(spark, rows)).collect()))
    assert got == plain(rows) and len(got) > 100


@pytest.mark.parametrize("sizes", [[1.0], [1.0, 1e6], [1.0, 1e8, 1e12, 1e200]])
def test_blocks_cover_all_pairs_once(sizes):
    rng = np.random.default_rng(1)
    q, d = (rng.normal(size=(n, 5)) * rng.choice(sizes, (n, 1)) for n in (70, 300))
    got = np.full((70, 300), None, object)
    for i, j, s in dense.score_blocks(q, d, 256):
        assert (got[np.ix_(i, j)] == None).all()  # noqa: E711
        got[np.ix_(i, j)] = s
    assert (got == dense.whole(q, 256) @ dense.whole(d, 256).T).all()


def test_one_huge_query_costs_little():
    """Of 2,000 queries against 8,192 vectors one with 1e300: within twice the time, and most scores stay in 64 bits."""
    rng = np.random.default_rng(2)
    q, d = rng.normal(size=(2000, 64)), rng.normal(size=(8192, 64))

    def seconds(rows):
        began = time.process_time()
        wide = sum(s.size for _, _, s in dense.score_blocks(rows, d, knn.FACTOR) if s.dtype == object)
        return time.process_time() - began, wide

    seconds(q)
    tame, none = seconds(q)
    q[7, 3] = 1e300
    huge, some = seconds(q)
    assert none == 0 and some == 8192 and huge < 2 * tame + 0.5
