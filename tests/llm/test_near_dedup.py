import random
import re

import numpy as np
import pytest

from stanzaflow.llm import near_dedup
from stanzaflow.llm.components import components
from stanzaflow.llm.near_dedup import HASHES, _forest, estimate, lowest_estimate, minima, near_duplicates, op3, packed
from stanzaflow.llm.words import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain(rows, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, set()).add(shingles(t))
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    keys = sorted(sets)
    for x, a in enumerate(keys):
        for b in keys[:x]:
            if any(p and q and 100 * len(p & q) >= percent * len(p | q) for p in sets[a] for q in sets[b]):
                r, s = sorted((root(a), root(b)))
                up[s] = r
    return sorted(
        ((i, len(shingles(t)), None if i is None else root(i), i is None or root(i) == i) for i, t in rows), key=str
    )


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"W{i}ü" for i in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 60, 120, 200]))]
        for _ in range(rng.choice([1, 3, 25])):
            words = list(base)
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(3)] = [rng.choice(vocabulary)]
            rows.append((rng.randrange(10**6), " ".join(words)))
            if rng.random() < 0.2:
                rows.append((rng.randrange(10**6), "\n".join(words).lower()))
    rows += [(-5, None), (-4, ""), (-3, " \t"), (-2, "a b"), (-1, "A  b"), (7, "a b c"), (None, "a b"), (None, "a b")]
    return rows + rows[:3]


def run(spark, rows, percent=80, **kw):
    df = spark.createDataFrame([(i, t, 1, "n", 2) for i, t in rows], "doc_id long, text string, n int, sig string, key int")
    return sorted(map(tuple, near_duplicates(df, "doc_id", "text", percent, **kw).collect()), key=str)


@pytest.mark.parametrize(("percent", "kw"), [(85, {}), (80, {"hot": 2, "block": 4000})])
def test_against_brute_force(spark, percent, kw):
    rows = corpus(percent)
    assert run(spark, rows, percent, **kw) == plain(rows, percent)


def test_a_key_of_several_texts_links_their_classes(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (7, a), (7, b), (9, b), (9, c), (5, c), (8, "other words")]
    got = run(spark, rows)
    assert got == plain(rows, 80) and {r[2] for r in got} == {3, 8}
    twice = [(7, a), (7, b), (7, b), (8, f"{b} more")]
    assert run(spark, twice) == plain(twice, 80)


def test_large_families(spark, monkeypatch):
    """A family of several blocks: copies of its least document, others that hang on copies or on each other, and boilerplate."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 16)
    monkeypatch.setattr(near_dedup, "STAR", 4)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(200)]

    def changed(words, n, tag):
        out = list(words)
        for at in rng.sample(range(0, len(out), 6), n):
            out[at] = f"{tag}{at}"
        return out

    rows = [(i, " ".join(changed(base, i % 3, f"x{i}"))) for i in range(1, 60)]
    second = changed(base, 6, "s")
    third = changed(second, 6, "t")
    rows += [(100 + i, " ".join(changed(second, i % 2, f"y{i}"))) for i in range(30)]
    rows += [(200 + i, " ".join(changed(third, i % 2, f"z{i}"))) for i in range(30)]
    rows += [(300 + i, " ".join([*base[:120], *(f"u{i}_{k}" for k in range(80))])) for i in range(40)]
    want = plain(rows, 80)
    assert len({r[2] for r in want}) > 30
    assert run(spark, rows, hot=4) == want and run(spark, rows, hot=4, block=20000) == want


def test_no_rows_and_lone_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, "x y z")]) == [(3, 1, 3, True)]
    assert op3(spark.createDataFrame([(1, None)], "doc_id long, text string")).columns[0] == "doc_id"


def test_estimates_lie_near_the_similarity():
    x = mix(np.arange(3000, dtype=np.uint64), 9)
    for s in (0.3, 0.6, 0.85):
        n = int(1000 * (1 - s) / (1 + s))
        a, b = np.sort(x[:1000]), np.sort(x[n : 1000 + n])
        sig = packed(minima(np.concatenate([a, b]), np.array([0, 1000, 2000])))
        assert sig.shape[1] * 8 == HASHES * 2
        assert abs(estimate(sig[:1], sig[1:])[0] - s) < 0.17
    assert 0.6 < lowest_estimate(85) < 0.7


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(0)
    base = rng.integers(1, 2**63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k:], rng.integers(1, 2**63, k, dtype=np.uint64)])) for k in (0, 4, 8, 30, 5)]
    sig = np.zeros((5, 35), np.uint8)
    linked = [(u, v) for u in range(5) for v in range(u) if 100 * len(np.intersect1d(sets[u], sets[v])) >= 85 * len(np.union1d(sets[u], sets[v]))]
    got = _forest(sets, sig, 85, 0.6)
    assert len(got) == 3 and all((max(e), min(e)) in linked for e in got)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    up = {i: i for e in edges for i in e if e[0] != e[1]}
    for _ in up:
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == up
