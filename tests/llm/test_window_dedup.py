import hashlib
import random
import re

import pytest

from stanzaflow.llm import window_dedup
from stanzaflow.llm.window_dedup import _pack, _unpack, op2, remove_repeats, sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, width=50):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - width + 1):
            if i is not None:
                k = tuple(w[p : p + width])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - width + 1):
            if i is not None and first[tuple(w[p : p + width])] < i:
                gone |= set(range(p, p + width))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(60)] + ["a", "b"]
    shared = [[rng.choice(vocabulary) for _ in range(rng.choice([30, 49, 50, 51, 90]))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(5)):
            words += [rng.choice(vocabulary) for _ in range(rng.randrange(80))]
            if rng.random() < 0.6:
                words += rng.choice(shared)
        rows.append((i * 3, rng.choice([" ", "  ", "\t", "\n"]).join(words)))
    rows += [(1000 + i, rows[i][1]) for i in range(0, n, 5)]
    rows += [(2000, "x " * 300), (2001, "x " * 120), (2002, "y z " * 70), (2003, None), (2004, ""), (None, shared[4] and " ".join(shared[4] * 2))]
    return rows + rows[4:6]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "h", "c", 1) for i, t in rows], "doc_id long, text string, hits string, copy string, key int")
    return sorted(map(tuple, remove_repeats(df, "doc_id", "text", **kw).collect()), key=str)


def test_against_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == plain(rows)


def test_a_tiny_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(window_dedup, "LEAST_CELLS", 4)
    monkeypatch.setattr(window_dedup, "BROADCAST_KEYS", -1)
    rows = corpus(1)
    assert run(spark, rows, most_cells=4) == plain(rows)


def test_sketch_tells_single_windows_apart(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(str(rng.random()) for _ in range(100))) for i in range(40)]
    bitmaps = sketch(spark.createDataFrame(rows, "key long, text string"), 20)
    assert sum(int(__import__("numpy").unpackbits(b).sum()) for b in bitmaps) < 10


def test_packing():
    import numpy as np

    cells = np.array([0, 5, 6, 1 << 19, (1 << 32) - 1], np.uint32)
    assert _unpack(_pack(cells), 5).tolist() == cells.tolist()


def test_a_key_of_several_texts(spark):
    rng = random.Random(8)
    t, u, v = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(120)) for _ in range(3))
    rows = [(1, t), (2, f"{t} a b c d e"), (2, u), (2, u), (3, u), (3, f"x {v} {u}"), (3, v)]
    want = plain(rows)
    assert run(spark, rows) == want and [n for i, _, n, _ in want if i == 2] == [0, 0, 120]


def test_keys_must_be_integers(spark):
    with pytest.raises(TypeError):
        op2(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (1, "")], [(None, "a b")]])
def test_nothing_to_do(spark, rows):
    assert run(spark, rows) == plain(rows)


def test_query_digest(spark):
    rows = [(1, "a  b\tc"), (2, None)]
    got = {r.doc_id: r for r in op2(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept_sha256 == hashlib.sha256(b"a b c").hexdigest()
    assert (got[2].n_words, got[2].n_removed, got[2].kept_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())
