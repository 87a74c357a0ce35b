import random
import re

import numpy as np
import pytest

from stanzaflow.llm.suffix_dedup import op5, repeated_passages, selected
from stanzaflow.llm.words import mix


def covered(rows, least):
    """Words of each key that lie in windows which other keys hold."""
    words = {}
    for i, t in rows:
        if i is not None:
            words[i] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    holders = {}
    for i, w in words.items():
        for p in range(len(w) - least + 1):
            holders.setdefault(tuple(w[p : p + least]), set()).add(i)
    out = {}
    for i, w in words.items():
        got = set()
        for p in range(len(w) - least + 1):
            if holders[tuple(w[p : p + least])] != {i}:
                got |= set(range(p, p + least))
        if got:
            out[i] = got
    return out


def corpus(seed):
    rng = random.Random(seed)
    v = [f"w{i}ß" for i in range(500)]
    shared = [[rng.choice(v) for _ in range(rng.choice([49, 50, 51, 60, 180, 400]))] for _ in range(9)]
    rows = []
    for i in range(90):
        words = []
        for _ in range(rng.randrange(5)):
            words += [rng.choice(v) for _ in range(rng.randrange(60))]
            if rng.random() < 0.6:
                part = rng.choice(shared)
                cut = rng.randrange(len(part) // 2 + 1) if rng.random() < 0.3 else 0
                words += part[cut:]
        rows.append((i, rng.choice([" ", "\n"]).join(words)))
    rows += [(100 + i, rows[i][1]) for i in range(0, 90, 9)]
    rows += [(300, "x " * 400), (301, "x " * 90), (302, "y z " * 80), (303, None), (304, ""), (None, rows[1][1]), (305, "q " * 300)]
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, pos int, left binary")
    got = repeated_passages(df, "doc_id", "text", **kw).collect()
    out = {}
    for r in got:
        span = set(range(r.start, r.end))
        assert not span & out.setdefault(r.key, set())
        out[r.key] |= span
    return out, got


@pytest.mark.parametrize("seed", [0, 1])
def test_coverage_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got, spans = run(spark, rows)
    assert got == covered(rows, 50)
    words = {i: re.findall(r"\S+", t or "") for i, t in rows}
    for r in spans:
        assert r.other != r.key and r.end - r.start >= 50
        assert not {*zip(*[words[r.key][r.start : r.end][k:] for k in range(5)])}.isdisjoint(zip(*[words[r.other][k:] for k in range(5)]))


def surrounded(lines, docs, left, right, seed=5):
    """Documents of their own words around one of some 40-word lines between one of the lead-ins and one of the tails."""
    rng = random.Random(seed)

    def words(n):
        return [f"v{rng.randrange(4000)}" for _ in range(n)]

    hot, leads, tails = [words(40) for _ in range(lines)], [words(5) for _ in range(left)], [words(5) for _ in range(right)]
    rows = []
    for i in range(docs):
        own = [f"own{i}x{j}" for j in range(80)]
        rows.append((i, " ".join([*own[:40], *rng.choice(leads), *hot[i % lines], *rng.choice(tails), *own[40:]])))
    return rows


def test_hot_passage_with_recurring_surroundings(spark):
    rows = surrounded(lines=6, docs=1200, left=12, right=12)
    want = covered(rows, 50)
    assert len(want) > 300
    assert run(spark, rows)[0] == want


@pytest.mark.parametrize("tasks", [1, 23])
def test_any_number_of_tasks_gives_the_same(spark, tasks):
    """Pairs that agree on the left of a hot passage and differ on its right."""
    rows = surrounded(lines=1, docs=400, left=1, right=400)
    words = [t.split(" ") for _, t in rows]
    rows = [(i, " ".join([*words[i - i % 2][:85], *words[i][90:]])) for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got, spans = run(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == covered(rows, 50) and len(got) == 400
    assert all(r.other == r.key ^ 1 for r in spans)


def test_every_stretch_selects_a_position():
    rng = np.random.default_rng(1)
    words = mix(rng.integers(0, 9, 4000).astype(np.uint64))
    kept = selected(words, np.array([0, 10, 4000]))
    assert np.diff(kept).max() <= 18 and kept.min() <= 27 and 4000 - kept.max() <= 25 + 18


def test_nothing(spark):
    assert run(spark, [])[1] == [] == run(spark, [(1, None), (2, "")])[1]
    assert run(spark, [(1, "a b " * 60)])[1] == []
    assert op5(spark.createDataFrame([], "doc_id long, text string")).columns == ["doc_id", "start", "end", "other_id"]


@pytest.mark.parametrize("block", [1, 6, 60])
def test_blocks_of_any_size_give_the_same(spark, block):
    """Blocks by head, by head and half of what lies around it, and by whole passages."""
    rows = corpus(3) + [(1000 + i, t) for i, t in surrounded(lines=2, docs=150, left=4, right=4)]
    got, spans = run(spark, rows, block=block)
    assert got == covered(rows, 50)
    want = run(spark, rows)[1]
    assert sorted(map(tuple, spans)) == sorted(map(tuple, want))
