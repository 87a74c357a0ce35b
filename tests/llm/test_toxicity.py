import random
import zlib

import numpy as np
import pytest

from stanzaflow.llm.toxicity import _CODE, _LETTERS, CharModel, N, _BYTE_CODE, lattice, op4, suspects, trigram_counts
from stanzaflow.llm.words import text_bytes, word_bounds

BAD = ["idiot", "stupid", "loser", "trash"]
GOOD = [a + b for a in ("re", "th", "on", "ing", "an", "er") for b in ("and", "er", "ion", "ly", "ed", "st")]


def disguise(word, rng):
    how = rng.randrange(4)
    if how == 0:
        return word.translate(str.maketrans("iosetal", "10537@|"))
    if how == 1:
        return " ".join(word)
    if how == 2:
        at = rng.randrange(len(word))
        return word[:at] + word[at] * 3 + word[at:]
    return ".".join(word)


def corpus(n=600, hidden=0.0, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(GOOD) for _ in range(rng.randrange(5, 120))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(2):
                w = rng.choice(BAD)
                words.insert(rng.randrange(len(words)), disguise(w, rng) if rng.random() < hidden else w)
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def chars(spark):
    docs, _ = corpus()
    return CharModel(trigram_counts(spark.createDataFrame([(t,) for _, t in docs], "text string")))


def test_counts_equal_a_plain_count(spark):
    texts = ["ab ba", None, "", "Abé", "a" * 5]
    want = np.zeros((N, N, N))
    for t in texts:
        if t is not None:
            code = [0] + [int(_BYTE_CODE[b]) for b in t.encode()] + [0, 0]
            for x in zip(code, code[1:], code[2:]):
                want[x] += 1
    got = trigram_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    want[0, 0, 0] = got[0, 0, 0] = 0
    assert got[1:, 1:].tolist() == want[1:, 1:].tolist()


def test_decoding_restores_words(chars):
    for seen, want in [("1d10t", "idiot"), ("l0s3r", "loser"), ("tr@5h", "trash"), ("i d i o t", "idiot"),
                       ("s.t.u.p.i.d", "stupid"), ("stuuuupid", "stupid"), ("7r45h", "trash"), ("5 7 u p 1 d", "stupid")]:
        assert chars.restore(seen) == want


def test_decoding_a_long_run_is_linear(chars):
    assert len(chars.restore("a " * 30_000)) > 0


def enumerated(model, token):
    """The best score over all paths of the lattice, one by one."""
    best, arcs = {}, list(lattice(token.lower()))

    def walk(i, a, b, score, out):
        if i == len(arcs):
            score += model.logp[a][b][0] if b else 0.0
            best[out.strip()] = max(score, best.get(out.strip(), -1e9))
            return
        for x, channel in arcs[i]:
            if x < 0 or (x == 0 and b == 0):
                walk(i + 1, a, b, score + channel, out)
            else:
                walk(i + 1, b, x, score + channel + model.logp[a][b][x], out + (" " if x == 0 else _LETTERS[x - 1]))

    walk(0, 0, 0, 0.0, "")
    return best


def test_decoding_equals_an_enumeration_of_the_lattice(chars):
    rng = random.Random(4)
    tokens = ["1d10t", "st.u.p1d", "looo5er", "a||b", "-_-", "$$", "x", ""]
    tokens += ["".join(rng.choice("abeiostl014@!|.-_* z") for _ in range(rng.randrange(1, 10))) for _ in range(60)]
    for token in tokens:
        scores = enumerated(chars, token)
        assert scores[chars._decode(token.lower())] == pytest.approx(max(scores.values()), abs=1e-9), token
    assert len(_CODE) == 26


def found_in(*texts):
    data, at = text_bytes(__import__("pyarrow").array(list(texts)))
    start, end = word_bounds(data, at)
    row = np.searchsorted(at, start, "right") - 1
    out = {}
    for a, b, mild in zip(*suspects(data, start, end, row), strict=True):
        out[b" ".join(data[s:e].tobytes() for s, e in zip(start[a:b], end[a:b])).decode()] = bool(mild)
    return out


def test_suspects():
    assert found_in("the 1d10t is a b", "i d i o t x$$$ ok!! aaab 12 2024") == {"1d10t": False, "aaab": False, "i d i o t": False, "x$$$": False}
    assert found_in("s c u m. or", "(s c u m), yes", "a b", "1 2 3 4") == {"s c u m.": False, "(s c u m),": False}
    assert found_in("idio+ a$$ stuupid stu-pid plain 3.14") == {"idio+": False, "a$$": False, "stuupid": True, "stu-pid": True}
    assert found_in("é é é ü", "") == {} == found_in("")


def test_tokens_of_any_length_are_decoded(chars):
    long = [f"st{'u' * 200}pid", "y.o.u._.a.r.e._.a._.s.t.u.p.i.d._.i.d.i.o.t._.a.n.d._.l.o.s.e.r", "a.b_c@d3" * 20_000]
    assert set(found_in(*[f"x {t} y" for t in long[:2]])) == set(long[:2])
    assert chars.restore(long[0]) == "stupid"
    assert all(w in chars.restore(long[1]).replace(" ", "") for w in ("stupid", "idiot", "loser"))
    assert len(chars.restore(long[2])) > 20_000


def accuracy(spark, hidden):
    docs, labels = corpus(hidden=hidden, seed=3)
    truth = dict(labels)
    got = op4(
        spark.createDataFrame([(i, t, "x", 0.0) for i, t in docs], "doc_id long, text string, label string, score double"),
        spark.createDataFrame([(i, y, 0) for i, y in labels] + [(None, 1, 0), (5000, None, 0)], "doc_id long, toxic int, quality int"),
    ).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out]
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_held_out_accuracy(spark):
    assert accuracy(spark, 0.0) > 0.97


def test_held_out_accuracy_on_disguised_words(spark):
    assert accuracy(spark, 0.8) > 0.9


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, toxic int, quality int")
    docs = [(1, None), (1, None), (None, "x"), (4, "")]
    got = op4(spark.createDataFrame(docs, "doc_id long, text string"), labels.limit(0)).collect()
    assert len(got) == 4 and {(round(r.score, 9), r.predicted) for r in got} == {(0.1, 0)}
    assert op4(spark.createDataFrame([], "doc_id long, text string"), labels).collect() == []
    assert len(op4(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()) == 4
