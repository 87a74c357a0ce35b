import random
import re

from stanzaflow.llm import decontam
from stanzaflow.llm.decontam import contained, item_sets, op6


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(docs, items, percent=80):
    out = set()
    for d, t in docs:
        if d is not None:
            held = set().union(*(shingles(x) for i, x in docs if i == d))
            for i, q in items:
                s = shingles(q)
                if i is not None and s and 100 * len(s & held) >= percent * len(s):
                    out.add((d, i, len(s), len(s & held), len(s & held) / len(s)))
    return out


def corpus(seed=0):
    rng = random.Random(seed)
    v = [f"w{i}É" for i in range(300)]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([2, 5, 6, 14, 36, 70])))) for i in range(25)]
    docs = []
    for d in range(80):
        words = [rng.choice(v) for _ in range(rng.choice([0, 30, 400]))]
        if rng.random() < 0.7:
            part = items[rng.randrange(25)][1].upper().split()
            for _ in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = "x"
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((d, rng.choice([" ", "\n", "  "]).join(words)))
    docs += [(200, items[0][1]), (None, items[1][1]), (201, None), (202, ""), (3, docs[3][1]), (4, items[5][1])]
    return docs, [*items, (90, None), (91, " "), (None, "a b c d e"), items[2]]


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, hash int, n_item int")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = op6(d, q).select("doc_id", "item_id", "n_item", "n_shared", "containment").collect()
    assert len(got) == len(set(got))
    return set(map(tuple, got))


def test_against_brute_force(spark):
    docs, items = corpus()
    assert run(spark, docs, items) == plain(docs, items)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", -1)
    docs, items = corpus(1)
    assert run(spark, docs, items) == plain(docs, items)


def test_nothing(spark):
    assert run(spark, [], [(1, "a b c d e")]) == set() == run(spark, [(1, "a b c d e")], [])


def test_sketches_leave_no_room_for_a_miss(spark):
    items = [(n, " ".join(f"t{n}x{i}" for i in range(n + 4))) for n in range(1, 140)]
    rows = item_sets(spark.createDataFrame(items, "item_id long, text string")).collect()
    for n, _ in items:
        held = sum(r.minimum for r in rows if r.item_id == n)
        assert min(n, held) >= n - -(-80 * n // 100) + 1
    assert contained(spark.createDataFrame(items, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 139
