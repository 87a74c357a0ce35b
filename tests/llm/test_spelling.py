import random
import re
import zlib
from collections import Counter

import pytest

from stanzaflow.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, short int, key string"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rows):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return out


def plain(words):
    form, out = {}, {}
    for w, n in words.items():
        close = [(-words[v], v) for v in words if near(w, v)]
        best = min(close, default=(0, None))
        form[w] = best[1] if -best[0] >= 5 * n else None
        out[w] = (n, len(close), -best[0] if form[w] else None)
    rows = set()
    for w, (n, k, fn) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, k, fn))
    return rows


def test_whole_query_against_brute_force(spark):
    rng = random.Random(1)
    base = ["garden", "Gardener", "straße", "ÉLÈVES", "fenêtre", "window", "walking", "×÷abcd", "ab"]
    rows = []
    for i in range(500):
        words = []
        for _ in range(rng.randrange(30)):
            w = rng.choice(base[: 1 + rng.randrange(len(base))])
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", "é", w[at] * 2]) + w[at + 1 :]
            words.append(w)
        rows.append((rng.choice([i, 7]), rng.choice([" ", "-", "1"]).join(words)))
    rows += [(None, "garden window garden"), (None, None), (9, ""), (10, None)]
    df = spark.createDataFrame([(k, t, "w", 1, 2, "k") for k, t in rows], SCHEMA)
    want = plain({w: n for w, n in words_of(rows).items() if len(w) >= 6 and n >= 5})
    got = spelling.op12(df).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == want and any(r.form for r in got)
    assert spelling.op12(df.limit(0)).collect() == []


@pytest.mark.parametrize(("letters", "block"), [("ab", 3), ("abé", 8), ("abcdefgh", 1000)])
def test_pairs_once_whatever_the_blocks(spark, letters, block):
    rng = random.Random(block)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(400)}
    words |= {"x" * 3 + w for w in list(words)[:150]} | {w + "yyyy" for w in list(words)[:150]}
    counts = {w: rng.randrange(1, 50) for w in words}
    got = spelling.near_words(spark.createDataFrame(sorted(counts.items()), "word string, n long"), block).collect()
    want = {(a, b, counts[b]) for a in words for b in words if near(a, b)}
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_one_hot_prefix_and_long_words(spark):
    rng = random.Random(5)
    words = {"common" + "".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(1500)}
    long = "z" * 3000
    words |= {long, long + "z", long[:1500] + "y" + long[1501:], "q" + long, long[:100] + "k" + long[100:], "a" * 70, "a" * 71, "a" * 35 + "b" + "a" * 34}
    counts = dict.fromkeys(words, 5)
    got = {tuple(r[:2]) for r in spelling.near_words(spark.createDataFrame(sorted(counts.items()), "word string, n long"), 64).collect()}
    short = {w for w in words if len(w) < 20}
    letters = "abcdefghij"
    want = {(w, v) for w in short for i in range(6, 10) for c in letters if (v := w[:i] + c + w[i + 1 :]) in short and v != w}
    want |= {(a, b) for a in words - short for b in words - short if near(a, b)}
    assert got == want


def test_chains_of_forms(spark):
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb", "bbbbbb"]
    counts = {w: 5 * 5**i for i, w in enumerate(chain)} | {"tiedxx": 5, "tiedax": 25, "tiedbx": 25, "lonely": 9, "almost": 24, "almosu": 5}
    got = spelling.variants(spark.createDataFrame(sorted(counts.items()), "word string, n long")).collect()
    assert set(map(tuple, got)) == plain(counts)
    assert {r.root for r in got if r.word in chain} == {"bbbbbb"}
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).collect() == []
