"""Trees of any depth, many intervals, lexicons of thousands of forms, numbers of any size."""

import random

import pytest
from pyspark.sql import functions as F

from stanzaflow.functions.text import fixed
from stanzaflow.operators import automaton, density, lexicon as lx, matching as mt, selecting as sl
from tests.test_matching import plain, random_lexicon

EDGES = "urn string, parent string, pos long"


def test_a_chain_of_ten_thousand(spark):
    edges = spark.range(10_000).select(F.concat(F.lit("n"), F.col("id") + 1).alias("urn"), F.concat(F.lit("n"), "id").alias("parent"), F.lit(0).alias("pos"))
    out = sl.tree_walk(edges, "n0", paths=False)
    assert out.count() == 10_001 and out.agg(F.countDistinct("depth"), F.max("depth")).first() == (10_001, 10_000)
    assert out.filter("urn = 'n' || depth").count() == 10_001


def test_deep_paths_sort_depth_first(spark):
    edges = [(f"n{i + 1}", f"n{i}", 1) for i in range(150)] + [(f"leaf{i}", f"n{i}", 0) for i in range(0, 150, 10)] + [("big", "n0", 2_000_000)]
    rows = sl.tree_walk(spark.createDataFrame(edges, EDGES), "n0").orderBy("path").collect()
    assert rows[0].urn == "n0" and rows[1].urn == "leaf0" and rows[-1].urn == "big"
    assert {r.urn: r.depth for r in rows} == {"n0": 0, "big": 1} | {f"n{i}": i for i in range(1, 151)} | {f"leaf{i}": i + 1 for i in range(0, 150, 10)}


def test_cycles_are_cut_and_reported(spark):
    edges = [("a", "r", 0), ("b", "a", 0), ("a", "b", 0), ("c", "b", 1), ("r", "c", 5), ("c", "c", 9), ("x", "y", 0), ("y", "x", 0), ("d", "a", 2), ("c", "d", 0)]
    df = spark.createDataFrame(edges, EDGES)
    got = sorted((r.path, r.urn) for r in sl.tree_walk(df, "r").collect())
    p = lambda *s: "".join(f"/{x:06d}" for x in s)
    assert got == sorted([("", "r"), (p(0), "a"), (p(0, 0), "b"), (p(0, 0, 1), "c"), (p(0, 2), "d"), (p(0, 2, 0), "c")])
    assert sorted(map(tuple, sl.tree_cycles(df, "r").collect())) == [("a", "b"), ("c", "c"), ("r", "c")]
    two = spark.createDataFrame([("a", "b", 0), ("b", "a", 0)], EDGES)
    assert [r.urn for r in sl.tree_walk(two, "a").orderBy("path").collect()] == ["a", "b"]
    assert [r.urn for r in sl.tree_walk(two, "none").collect()] == ["none"]


def test_many_intervals_meet_points_by_bins(spark):
    rng = random.Random(3)
    spans = [(i, a, a + rng.choice([0, 1, 5, 300, 4000])) for i, a in enumerate(rng.randrange(-5000, 5000) for _ in range(900))]
    spans += [(1000, -(1 << 31), (1 << 31) - 1), (1001, 10, 5), (1002, -(1 << 62), 1 << 62), (1003, 7, 7)]
    points = [(i, rng.randrange(-6000, 6000)) for i in range(300)] + [(900, None), (901, 7)]
    df = spark.createDataFrame(points, "i long, year long")
    intervals = spark.createDataFrame(spans, "era long, low long, high long")
    want = sorted((i, era) for i, y in points if y is not None for era, a, b in spans if a <= y <= b)
    for most in (10, 10_000):
        out = density.in_intervals(df, "year", intervals, most)
        assert sorted((r.i, r.era) for r in out.collect()) == want and out.columns == ["i", "year", "era"]
    assert density.in_intervals(df, "year", intervals.limit(0), 10).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_the_automaton_equals_the_plain_rule(spark, seed):
    rng = random.Random(seed)
    lexicon = random_lexicon(rng)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(200)] + [(900, "abcab" * 400), (901, None), (902, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    forms = lx.form_table(lx.table(spark, lexicon))
    got = {}
    for r in mt.match_positions(df, "id", "t", forms).collect():
        got.setdefault(r.id, []).append((r.entry_id, r.pos))
    assert all(sorted(got.get(i, [])) == sorted(plain(t or "", lexicon)) for i, t in rows)
    hits = {r.id: [(h.entry_id, h.pos) for h in r.hits] for r in automaton.with_hits(df, "t", forms).collect()}
    assert all(hits[i] == plain(t or "", lexicon) for i, t in rows)  # in form order, left to right


def test_ten_thousand_forms_and_wide_characters(spark):
    rng = random.Random(8)
    forms = sorted({"".join(rng.choice("abcdefgh𠀀國山") for _ in range(rng.randrange(2, 7))) for _ in range(10_000)}, key=lambda f: rng.random())
    lexicon = lx.Lexicon(tuple(lx.Entry(f"e{i}", (f,), "c") for i, f in enumerate(forms)))
    rows = [(i, "".join(rng.choice("abcdefgh𠀀國山x") for _ in range(120))) for i in range(25)]
    df = spark.createDataFrame(rows, "id long, t string")
    table = lx.form_table(lx.table(spark, lexicon))
    got = {(r.id, r.entry_id, r.pos) for r in mt.match_positions(df, "id", "t", table).collect()}
    assert got == {(i, e, at) for i, t in rows for e, at in plain(t, lexicon)} and len(got) > 500
    assert got == {(r.id, r.entry_id, r.pos) for r in mt.match_by_grams(df, "id", "t", table).collect()}


def test_conversion_with_and_without_a_broadcast(spark, monkeypatch):
    rows = [(1, "thing the theft 𠀀國"), (2, None), (3, ""), (4, "athe國國山"), (5, "plain")]
    df = spark.createDataFrame(rows, "k long, t string")
    phrases = spark.createDataFrame([("the", "THE"), ("thing", "T-ing"), ("the", "Z"), ("國山", "S"), ("", "never")], "form string, becomes string")
    want = {1: "T-ing THE THEft 𠀀K", 2: None, 3: "", 4: "xTHEKS", 5: "plxin"}
    run = lambda: {r.k: r.t for r in mt.convert_script(df, "k", "t", "a國n", "xKn", phrases).collect()}
    assert run() == want
    monkeypatch.setattr(automaton, "BROADCAST_CHARS", 3)
    assert run() == want


@pytest.mark.parametrize("places", [0, 1, 3])
def test_fixed_decimals_of_any_size(spark, places):
    rng = random.Random(places)
    xs = [0.0, -0.0, 1e6, 1e9, 123456789.0625, -0.0625, 0.5, 1.5, 2.5, -2.5, 0.0005, 0.0015, 999999.9995, 1e15 + 0.5, 2.0**52 + 0.5, 2.0**53, 1e17, 9e17, float("nan"), float("inf"), -float("inf"), 5e-324, 0.9999999]
    xs += [rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 15) for _ in range(300)] + [rng.randrange(10**7) / 16 for _ in range(100)]
    got = spark.createDataFrame([(x,) for x in [*xs, None]], "x double").select("x", fixed(F.col("x"), places).alias("f")).collect()
    assert [r.f for r in got] == [f"{x:.{places}f}" for x in xs] + [None]


def test_texts_go_to_python_in_bounded_batches(spark):
    """Whatever a session was set to: without it a batch held 10,000 texts."""
    from stanzaflow.operators import matching, tables
    from stanzaflow.sources.scratch import BATCH_BYTES

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.createDataFrame([(1, "ab")], "id long, t string")
    pairs = spark.createDataFrame([("a", "b")], "form string, becomes string")
    for use in (lambda: matching.convert_script(df, "id", "t", "a", "b", pairs), lambda: tables.register(spark)):
        spark.conf.unset(name)
        use()
        assert int(spark.conf.get(name)) == BATCH_BYTES


def test_silhouette_moves_blocks_and_not_rows_for_each_block(spark, monkeypatch):
    import numpy as np
    from stanzaflow.operators import probe

    monkeypatch.setattr(probe, "HELD", 8)
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: sum(store.executorList(True).apply(i).totalShuffleWrite() for i in range(store.executorList(True).size()))
    moved = []
    for n in (400, 1600):
        v, labels = np.random.default_rng(n).normal(size=(n, 16)), [i % 3 for i in range(n)]
        d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
        of = [np.array(labels) == x for x in range(3)]
        own = np.array([d[i, of[x]].sum() / (of[x].sum() - 1) for i, x in enumerate(labels)])
        near = np.array([min(d[i, of[y]].mean() for y in range(3) if y != x) for i, x in enumerate(labels)])
        before = shuffled()
        got = probe.silhouette(spark.createDataFrame([(i, v[i].tolist(), labels[i]) for i in range(n)], "k long, v array<double>, l int"), "k", "v", "l", block=20)
        assert got.first()[0] == pytest.approx(((near - own) / np.maximum(near, own)).mean())
        moved.append(shuffled() - before)
    assert moved[1] < 9 * moved[0]  # 16 times and more, if each block had its own copy of each row
