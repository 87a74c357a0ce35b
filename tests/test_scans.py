import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stanzaflow.operators import scans, segmenting as sg


@pytest.mark.parametrize("cuts", [1, 2, 7, 64])
def test_ranks_and_sizes_by_key_and_over_all(spark, cuts):
    rng = random.Random(cuts)
    rows = [(rng.choice(["hot"] * 6 + ["b", "c", None]), rng.choice([None, *range(40)]), i, dt.datetime(2024, 10, 27, 0, 30) + dt.timedelta(minutes=7 * (i % 50))) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, i long, t timestamp").repartition(6)
    by = lambda r: (r.v is not None, r.v or 0, r.i)  # noqa: E731  null comes first
    got = scans.ranked(df, ["k"], ["v", "i"], "place", "size", cuts).collect()
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in got if r.k == k), key=by)
        want |= {r.i: (n, len(own)) for n, r in enumerate(own)}
    assert len(got) == 500 and {r.i: (r.place, r["size"]) for r in got} == want
    everywhere = scans.ranked(df, [], ["t", "i"], "place", cuts=cuts).collect()
    assert [r.i for r in sorted(everywhere, key=lambda r: r.place)] == [r.i for r in sorted(everywhere, key=lambda r: (r.t, r.i))]
    assert sorted(r.place for r in everywhere) == list(range(500))
    by_time = scans.ranked(df, ["t"], ["i"], "place", "size", cuts).collect()
    assert all(r["size"] == 10 for r in by_time)


def test_a_hot_key_is_cut_and_few_rows_are_handed_on(spark):
    df = spark.range(20_000).select(F.lit("one").alias("k"), (F.col("id") * 7919 % 20_011).alias("at"), "id")
    dealt = scans.Cuts(df, ["k"], ["at"], 16)
    sizes = [r["count"] for r in dealt.rows.groupBy("_cut").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 20_000 / 16
    assert dealt.summaries(_n=F.count(F.lit(1))).count() == 16
    plan = scans.ranked(df, [], ["at"], cuts=16)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number" in plan and "[_cut#" in plan


@pytest.mark.parametrize("cuts", [1, 3, 50])
def test_asof_against_the_plain_rule(spark, cuts):
    rng = random.Random(cuts)
    key = lambda: rng.choice(["v1"] * 8 + ["v2", "v3", None])
    left = [(key(), rng.randrange(300), i) for i in range(400)]
    right = [(key(), rng.randrange(300), rng.choice([None, *range(9)])) for _ in range(60)]
    got = sg.asof_backward(
        spark.createDataFrame(left, "v string, p int, i long").repartition(5), spark.createDataFrame(right, "v string, p int, y int"), ["v"], "p", ["y"], cuts
    )
    want = {}
    for v, p, i in left:
        before = [(q, y is not None, y or 0) for w, q, y in right if w == v and q <= p]
        best = max(before, default=None)
        want[i] = best[2] if best and best[1] else None
    assert {r.i: r.y for r in got.collect()} == want


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, p int, y int")
    assert scans.ranked(df, ["k"], ["p"], size="n").collect() == []
    assert sg.asof_backward(df.select("k", "p"), df, ["k"], "p", ["y"]).collect() == []
    one = spark.createDataFrame([("a", 1)], "k string, p int")
    assert [tuple(r) for r in sg.asof_backward(one, df, ["k"], "p", ["y"]).collect()] == [("a", 1, None)]


def test_rows_are_numbered_without_a_search_of_bounds(spark):
    """Spark's ranges place the rows: no bounds are searched row by row, and nothing is shuffled after they are written."""
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 5 > 0 THEN id % 7 END AS x", "timestamp_seconds(id % 11) AS t")
    out = scans.numbered(df, ["x", "t", "id"], "place", "size", 8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_bounds" not in plan and "Exchange hashpartitioning" not in plan and "Window" not in plan
    got = [r.id for r in out.orderBy("place").collect()]
    assert got == [r.id for r in df.orderBy("x", "t", "id").collect()]
    assert [tuple(r) for r in out.selectExpr("min(place)", "max(place)", "min(size)", "max(size)").collect()] == [(0, 2999, 3000, 3000)]
    assert scans.numbered(df.limit(0), ["id"], "place", "size").collect() == []
