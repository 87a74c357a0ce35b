import random
import re

import numpy as np
import pyarrow as pa

from stanzaflow.llm import words as w


def texts(n=60):
    rng = random.Random(7)
    pieces = ["the", "The", "é", "𠀀x", " ", "  ", "\n", "\t", "a", "b" * 30, " ", "　"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(n)] + ["", " ", None, "solo"]


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def hashes(rows, lower=False):
    data, offsets = w.text_bytes(pa.array(rows))
    out = []
    for a, b in w.slices(offsets, 100):
        h, at = w.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)
        out += [h[x:y].tolist() for x, y in zip(at, at[1:])]
    return out


def check(rows):
    got = hashes(rows)
    assert [len(g) for g in got] == [len(split(t)) for t in rows]
    names = {}
    for g, t in zip(got, rows):
        for h, word in zip(g, split(t)):
            assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)
    return got


def test_words_and_hashes():
    check(texts())
    a, b = hashes(["The tHE É"], lower=True)[0][:2]
    assert a == b


def test_long_rows_in_short_slices(monkeypatch):
    rows = [*texts(), " ".join(t for t in texts() if t), "y" * 500]
    want = check(rows)
    monkeypatch.setattr(w, "SLICE_BYTES", 64)
    assert hashes(rows) == want


def test_runs_in_parts(monkeypatch):
    x = w.mix(np.arange(1000, dtype=np.uint64))
    want = w.runs(x, 7)
    assert want[5] == w.runs(x[5:12], 7)[0]
    monkeypatch.setattr(w, "RUN_WORDS", 10)
    assert (w.runs(x, 7) == want).all() and len(w.runs(x[:6], 7)) == 0


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 1000, 300).astype(np.uint64)
    for k in (1, 2, 3, 18, 26, 300):
        assert w.sliding_min(x, k).tolist() == [x[i : i + k].min() for i in range(300 - k + 1)]


def test_sliced_columns_and_nulls():
    column = pa.array(["x", "ab cd", None, "e"]).slice(1)
    data, offsets = w.text_bytes(column)
    assert bytes(data) == b"ab cde" and offsets.tolist() == [0, 5, 5, 6]


def test_shingle_sets():
    data, offsets = w.text_bytes(pa.array(["a b c d e f a b c d e", "a b", None, "a b c d e"]))
    s, at = w.shingle_sets(*w.word_hashes(data, offsets))
    assert np.diff(at).tolist() == [6, 1, 0, 1] and s[at[3]] in s[: at[1]]
