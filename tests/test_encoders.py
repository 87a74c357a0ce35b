import numpy as np
import pytest

from stanzaflow.operators import probe
from stanzaflow.operators.encoders import onnx_encoder

VOCABULARY = {"[PAD]": 0, "[UNK]": 1, "春": 2, "江": 3, "潮": 4}
WEIGHTS = np.array([[9, 9], [1, 0], [0, 2], [3, -1], [0.5, 0.25]], np.float32)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    """A protobuf message of (number, int | bytes | str)."""
    out = b""
    for number, value in fields:
        data = value.encode() if isinstance(value, str) else value
        out += varint(number << 3) + varint(data) if isinstance(data, int) else varint(number << 3 | 2) + varint(len(data)) + data
    return out


def value(name, kind, *shape):
    dims = [(1, message((2, d)) if isinstance(d, str) else message((1, d))) for d in shape]
    return message((1, name), (2, message((1, message((1, kind), (2, message(*dims)))))))


def model(extra=()):
    """Token vectors looked up in a table: one Gather."""
    table = message((1, WEIGHTS.shape[0]), (1, WEIGHTS.shape[1]), (2, 1), (8, "table"), (9, WEIGHTS.tobytes()))
    gather = message((1, "table"), (1, "input_ids"), (2, "last_hidden_state"), (4, "Gather"))
    inputs = [(11, value(n, 7, "b", "t")) for n in ("input_ids", "attention_mask", *extra)]
    graph = message((1, gather), (2, "g"), (5, table), *inputs, (12, value("last_hidden_state", 1, "b", "t", WEIGHTS.shape[1])))
    return message((1, 8), (7, graph), (8, message((1, ""), (2, 13))))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    from tokenizers import Tokenizer, models, pre_tokenizers

    at = tmp_path_factory.mktemp("encoder")
    tok = Tokenizer(models.WordLevel(VOCABULARY, "[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Split("", "isolated")
    tok.save(f"{at}/tok.json")
    (at / "model.onnx").write_bytes(model())
    (at / "odd.onnx").write_bytes(model(["pixel_values"]))
    return at


TEXTS = [(1, "春江"), (2, "潮"), (3, None), (4, ""), (5, "春春潮江X"), (6, "江" * 500), (1, "春江")]


def plain(text, most):
    ids = [VOCABULARY.get(c, 1) for c in (text or "")][:most]
    return [round(float(x), 6) for x in (WEIGHTS[ids].astype(float).mean(0) if ids else np.zeros(2))]


@pytest.mark.parametrize("batch", [1, 3, 16])
def test_means_of_token_vectors(spark, files, batch):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(2)
    out = probe.embed(df, "text", onnx_encoder(f"{files}/model.onnx", f"{files}/tok.json", 128), batch)
    got = sorted((r.doc_id, [round(x, 6) for x in r.embedding]) for r in out.collect())
    assert got == sorted((i, plain(t, 128)) for i, t in TEXTS)


def test_files_sent_to_executors_and_a_short_limit(spark, files):
    for name in ("model.onnx", "tok.json"):
        spark.sparkContext.addFile(f"{files}/{name}")
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    out = probe.embed(df, "text", onnx_encoder("model.onnx", "tok.json", 2)).filter("doc_id = 5").first()
    assert [round(x, 6) for x in out.embedding] == plain("春春潮江X", 2)


def test_empty_tables_and_a_model_that_asks_for_more(spark, files):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    good, odd = (onnx_encoder(f"{files}/{m}.onnx", f"{files}/tok.json") for m in ("model", "odd"))
    assert probe.embed(df.limit(0), "text", good).count() == 0
    with pytest.raises(Exception, match="pixel_values"):
        probe.embed(df, "text", odd).collect()


def test_from_texts_to_the_probe(spark, files):
    texts = [(i, ("春" if i % 2 else "江") * (1 + i % 5) + "潮" * (i % 3), i % 2) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string, y int")
    out = probe.embed(df, "text", onnx_encoder(f"{files}/model.onnx", f"{files}/tok.json"))
    folds = probe.cross_validated_accuracy(out, "embedding", "y", "doc_id").collect()
    assert min(r.accuracy for r in folds) > 0.95
