import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from stanzaflow.llm import quality
from stanzaflow.llm.quality import BASE, BITS, ORDER, F, discounts, gram_counts, log_probabilities, op7, quality as judge

WORDS = "the thing and other ones stand there with rather more of it, than before. Été 2024 слово 漢字 😀".split()


def symbol(c):
    if c in " \t\n\v\f\r":
        return 0
    c = "0" if c in "0123456789" else c
    return ord(c) if ord(c) < 3072 else 3072 + ord(c) % 1024


def grams(text):
    code = [0] * (ORDER - 1) + [symbol(c) for c in text]
    return [tuple(code[i : i + ORDER]) for i in range(len(code) - ORDER + 1)]


def held(i):
    return zlib.crc32(f"held out {i}".encode()) % 5 == 0


class Plain:
    """The model by its definition, a probability at a time."""

    def __init__(self, texts):
        self.counts = {ORDER: Counter(g for t in texts for g in grams(t))}
        for k in range(ORDER - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d = {k: discounts([sum(n == j for n in c.values()) for j in range(1, 5)]) for k, c in self.counts.items()}

    def p(self, g):
        if not g:
            return 1 / BASE
        c = self.counts[len(g)]
        after = {x: n for x, n in c.items() if x[:-1] == g[:-1]}
        if not after:
            return self.p(g[1:])
        off = {x: self.d[len(g)][min(n, 3) - 1] for x, n in after.items()}
        total = sum(after.values())
        return max(after.get(g, 0) - off.get(g, 0), 0) / total + sum(off.values()) / total * self.p(g[1:])

    def perplexity(self, text):
        gs = grams(text)
        return math.exp(-sum(math.log(self.p(g)) for g in gs) / len(gs))


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 12))) for _ in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"head": 40, "shard_grams": 64, "task_bytes": 500}])
def test_model_and_perplexity_equal_the_definition(spark, sizes, monkeypatch):
    if sizes:
        monkeypatch.setattr(quality, "CHUNK_BYTES", 200)
        monkeypatch.setattr(quality, "HELD_GRAMS", 50)
    good, other = texts(40, 1), ["zq zq!! 77", "the other", "É", "\t漢 ж"]
    rows = [(i, "en", t, 1.0) for i, t in enumerate(good + other)] + [(90, None, None, 0.0), (91, "en", "", 0.0), (5, "en", good[5], 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, perplexity double")
    labels = [(i, 1) for i in range(40)]
    trusted = spark.createDataFrame([(i,) for i, _ in labels], "key long")
    got = judge(docs.select(F.col("doc_id").alias("key"), "lang", "text"), trusted, **sizes).collect()
    assert len(got) == len(rows)
    plain = Plain([t for i, t in enumerate(good) if not held(i)] + [t for i, t in enumerate(good) if i == 5 and not held(i)])
    by_key = {r.key: r for r in got}
    for i, t in enumerate(good + other):
        assert by_key[i].perplexity == pytest.approx(plain.perplexity(t), rel=1e-4)
    assert by_key[90].perplexity is None and not by_key[90].keep and not by_key[91].keep
    bar = sorted(by_key[i].perplexity for i in range(40) if held(i))
    assert by_key[0].threshold == bar[-1] == by_key[90].threshold
    assert all(r.keep == (r.perplexity is not None and r.perplexity <= r.threshold) for r in got)


def test_probabilities_sum_to_one(spark):
    counts = gram_counts(spark.createDataFrame([(t,) for t in texts(30, 2)], "text string"))
    context = 0
    for c in "the ":
        context = context << BITS | symbol(c)
    wanted = spark.range(BASE).select((F.lit(context) * BASE + F.col("id")).alias("gram"), F.lit(1).alias("n"))
    assert np.isclose(sum(math.exp(r.logp) for r in log_probabilities(counts, wanted).collect()), 1, atol=1e-4)


def test_counts_grow_with_the_text(spark):
    few, many = (gram_counts(spark.createDataFrame([(t,) for t in texts(n, 6)], "text string")).count() for n in (20, 200))
    assert many > few


def test_thresholds_by_language(spark):
    rows = [(i, "a" if i % 2 else None, t) for i, t in enumerate(texts(60, 3))] + [(99, "b", "the")]
    labels = [(i, 1) for i in range(60)] + [(None, 1), (41, 0), (0, 1), (42, None)]
    got = op7(spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    bars = {r.lang: r.threshold for r in got}
    assert len(bars) == 3 and bars["b"] == max(bars.values())


def test_nothing_trusted_and_nothing_at_all(spark):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    got = op7(spark.createDataFrame([(1, "x", "ab"), (1, "x", "ab")], "doc_id long, lang string, text string"), labels).collect()
    assert [r.keep for r in got] == [True, True] and got[0].perplexity == pytest.approx(quality.BASE)
    assert op7(spark.createDataFrame([], "doc_id long, lang string, text string"), labels).collect() == []
