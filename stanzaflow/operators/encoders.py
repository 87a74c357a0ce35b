"""Encoders for operators.probe.embed: pretrained models by path, no network.

The model is an ONNX file, the tokenizer its JSON description. A path that isn't absolute is looked up among the
files that the session sent to its executors (SparkContext.addFile), so that neither needs to lie on a shared folder.
A task loads both once.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark import SparkFiles


def _path(name: str) -> str:
    return name if os.path.isabs(name) else SparkFiles.get(name)


def onnx_encoder(
    model: str, tokenizer: str, max_length: int = 128, output: str = "last_hidden_state", pad_token: str = "[PAD]", threads: int = 1
) -> Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray]]]:
    """An encoder for embed(): token vectors and mask of a batch that is padded to its longest text, each cut at max_length tokens.

    Inputs are given by the names that the model asks for (input_ids, attention_mask, token_type_ids); another name is an
    error. The output is taken by name, or is the first one where no output has that name. A task uses `threads`
    cores. The cut at max_length is the model's own limit, not one of this library: it is what position vectors were trained for.
    """

    def load():
        import onnxruntime
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(_path(tokenizer))
        tok.enable_truncation(max_length)
        tok.enable_padding(pad_id=tok.token_to_id(pad_token) or 0, pad_token=pad_token)
        settings = onnxruntime.SessionOptions()
        settings.intra_op_num_threads = settings.inter_op_num_threads = threads
        session = onnxruntime.InferenceSession(_path(model), settings, providers=["CPUExecutionProvider"])
        names = [o.name for o in session.get_outputs()]
        wanted = output if output in names else names[0]
        asked = {i.name: np.int32 if i.type == "tensor(int32)" else np.int64 for i in session.get_inputs()}
        parts = {"input_ids": "ids", "attention_mask": "attention_mask", "token_type_ids": "type_ids"}
        if not asked.keys() <= parts.keys():
            raise ValueError(f"the model asks for {sorted(asked.keys() - parts.keys())}, which a tokenizer doesn't give")

        def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            encoded = tok.encode_batch(texts)
            mask = np.array([e.attention_mask for e in encoded], np.int64)
            if not mask.size:  # nothing but empty texts, and a tokenizer that adds no marks of its own
                encoded = tok.encode_batch([*texts, pad_token])[:-1]
                mask = np.array([e.attention_mask for e in encoded], np.int64)
            given = {name: np.array([getattr(e, parts[name]) for e in encoded], kind) for name, kind in asked.items()}
            return session.run([wanted], given)[0].astype(np.float64), mask.astype(np.float64)

        return run

    return load
