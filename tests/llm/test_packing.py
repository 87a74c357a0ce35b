import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from stanzaflow.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODER = tokens.Encoder(open(PATH, encoding="utf-8").read())
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True
SCHEMA = "doc_id long, text string, lang string, piece int, bin long, key string, node int"


def ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 1]


def checked(rows, got, capacity=4096):
    """That pieces hold all ids of all rows and fill sequences without gaps; how many sequences, and the fewest that could be."""
    want = defaultdict(list)
    for key, text in rows:
        own = ids(text)
        for i in range(0, len(own), capacity):
            part = own[i : i + capacity]
            want[key, i // capacity, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())].append(1)
    assert sorted((str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)) == sorted(str(k) for k, v in want.items() for _ in v)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), -(-sum(r.length for r in got) // capacity)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_all_tokens_in_nearly_the_fewest_sequences(spark, parts):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["word", "Other", "naïve,", "x1", "don't"]) for _ in range(int(rng.lognormvariate(4.5, 1.4))))) for i in range(900)]
    rows += [(1000, "long " * 30000), (1001, ""), (1002, None), (None, "no key"), (None, None), (5, "again"), (5, "again")]
    rows += [(2000 + i, "copy of a text") for i in range(400)]
    df = spark.createDataFrame([(k, t, "l", 3, 4, "k", 5) for k, t in rows], SCHEMA).repartition(parts)
    n, least = checked(rows, packing.op11(df, PATH).collect())
    assert n <= least + 1


def test_items_that_cannot_share_and_small_nodes(spark):
    rows = [(i, "word " * n) for i, n in enumerate([2500] * 40 + [1200] * 40 + [300] * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = packing.pack(df, "doc_id", "text", PATH, node=16).withColumnRenamed("key", "doc_id").collect()
    n, least = checked(rows, got)
    assert n <= least * 1.1


def test_no_rows_and_sequences_with_ids(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert packing.op11(df, PATH).collect() == []
    rows = [(f"d{i}", "some words, and more " * (i % 90)) for i in range(300)]
    packed = packing.pack(spark.createDataFrame(rows, df.schema), "doc_id", "text", PATH, capacity=512, with_ids=True)
    out = packing.sequences(packed).collect()
    texts = dict(rows)
    for r in out:
        assert r.length == len(r.ids) <= 512
        for p in r.parts:
            want = ids(texts[p.key])[p.piece * 512 :][:512]
            assert r.ids[p.offset : p.offset + p.length] == want
    assert sum(r.length for r in out) == sum(len(ids(t)) for t in texts.values())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aZéß'’sS t\n\r\x0b\x1c\x85\xa0.,-_12²ⅧİΣς̸́<|endoftext>"))), max_size=6))
def test_ids_equal_the_tokenizers_own(texts):
    flat, at = ENCODER.encode(pa.array(texts, pa.string()))
    assert [flat[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [ids(t)[:-1] for t in texts]


def test_long_texts_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 50)
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé12'. \n") for _ in range(rng.randrange(400))) for _ in range(60)] + ["a" * 500, None, "<|endoftext|> x"]
    own = tokens.Encoder(open(PATH, encoding="utf-8").read())
    flat, at = own.encode(pa.array(texts))
    assert own.separable and [flat[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [ids(t)[:-1] for t in texts]


def test_a_tokenizer_that_keeps_white_space_gets_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = tokens.Encoder(open(path, encoding="utf-8").read())
    plain = Tokenizer.from_file(path)
    texts = ["two  spaces and\n\nlines", "", "x " * 50]
    flat, at = own.encode(pa.array(texts))
    assert not own.separable and [flat[at[i] : at[i + 1]].tolist() for i in range(3)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    described = json.load(open(PATH, encoding="utf-8")) | {"normalizer": {"type": "NFKC"}}
    assert not tokens._separable(described)


def test_best_fit():
    bins, places = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and places.tolist() == [0, 0, 6, 5, 8]
    assert packing.best_fit(np.zeros(0, np.int64), 10)[0].tolist() == []
