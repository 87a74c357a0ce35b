import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from stanzaflow.llm import mixing
from stanzaflow.llm.mixing import apportion


def by_quotients(votes, seats):
    held = [0] * len(votes)
    for _ in range(seats if sum(votes) > 0 else 0):
        held[max(range(len(votes)), key=lambda i: (votes[i] / (2 * held[i] + 1), -i))] += 1
    return held


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 500), max_size=8), st.integers(0, 60))
def test_apportion_equals_seat_by_seat(votes, seats):
    assert apportion(np.array(votes), seats).tolist() == by_quotients(votes, seats)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 20)), max_size=8), st.integers(0, 90))
def test_seats_within_limits(rows, seats):
    votes, most = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    got = mixing.apportion_within(votes, seats, most)
    assert (got <= most).all() and (got[votes == 0] == 0).all()
    assert got.sum() == min(seats, most[votes > 0].sum())


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
        open_ -= over


SCHEMA = "doc_id long, text string, source string, size int, target string, place string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "x", "y") for i, t, s in rows], SCHEMA)


def test_targets_takes_and_reruns(spark):
    rows = [(i, " ".join(["w"] * (i * 37 % 400)), f"s{i % 5 if i % 3 else 0}") for i in range(600)]
    rows += [(1000 + i, " a\tb c ", None) for i in range(30)]
    got = [r.asDict() for r in mixing.op8(docs(spark, rows)).collect()]
    assert len(got) == len(rows)
    size = {i: len(__import__("re").findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    total = {}
    for i, _, s in rows:
        total[s] = total.get(s, 0) + size[i]
    want = plain_targets(total)
    source = {i: s for i, _, s in rows}
    took = {}
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s])
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        took[s] = took.get(s, 0) + r["taken"]
    for s, t in want.items():
        assert abs(took[s] - t) <= 0.01 * t + 2 * mixing.BLOCK
    again = {r.doc_id: r.taken for r in mixing.op8(docs(spark, rows[::-1]).repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_shards_split_a_source(spark):
    rows = [(i, " ".join(["w"] * 100), "hot" if i % 3 else "b") for i in range(300)]
    sizes = docs(spark, rows).select("doc_id", "source", mixing.n_words(mixing.F.col("text")).alias("size"))
    targets = mixing.source_targets(sizes)
    got = mixing.mix(sizes, targets, "doc_id", shard=1000).groupBy("source", "target").agg({"taken": "sum"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["target"]) <= 25 * mixing.BLOCK


def test_tiny_sources_come_near_their_targets(spark):
    rows = [(i, "w " * 300, "big") for i in range(200)] + [(500 + i, "a b c", f"tiny{i}") for i in range(6)]
    got = mixing.op8(docs(spark, rows)).collect()
    for r in got:
        if r["doc_id"] >= 500:
            assert abs(r.taken - r.target) <= 1 and r.taken <= 6
    assert abs(sum(r.taken for r in got) - 1.5 * sum(r["size"] for r in got)) < 0.001 * 60000


def test_nulls_empties_ties_and_no_rows(spark):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", None), (None, "x y z " * 40, "a"), (None, "x y z " * 40, "a")]
    got = mixing.op8(docs(spark, rows)).collect()
    assert sorted((r["size"] for r in got)) == [0, 0, 0, 120, 120]
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert mixing.op8(docs(spark, [])).collect() == []
    assert [r.taken for r in mixing.op8(docs(spark, [(1, None, None)])).collect()] == [0]
