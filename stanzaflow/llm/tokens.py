"""Token ids of texts by a public tokenizer, with what was encoded before remembered.

A tokenizer that drops white space and never joins characters across it gives a text the ids of its chunks between white
space, one after the other; and where it cuts after each run of letters and each digit, an ASCII chunk has the ids of its
pieces. Such a tokenizer (its own description says so) meets each distinct chunk once for each worker and fill of the memory; any
other encodes whole texts.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from stanzaflow.llm.words import IS_SPACE, text_bytes, word_bounds

#: Chunks and pieces remembered by a worker (some 100 bytes each, together), and the longest that is.
REMEMBERED, LONGEST = 1 << 19, 64
#: Bytes of a text looked at in one go; the cut is at white space.
SLICE_BYTES = 2 << 20
#: The pattern of words of the tokenizers whose chunks and pieces are taken apart, and the normalisers that keep them apart.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = {"NFC", "Replace", "Lowercase"}

_PIECE = re.compile(rb"[^a-z0-9]*(?:[a-z]+|[0-9])|[^a-z0-9]+")
#: A chunk with other characters: all to its last ASCII letter or digit, and the ASCII signs after that; or the whole.
_TAIL = re.compile(rb"(?s).*[a-z0-9](?=[!-/:-@\[-`{-~]+\Z)|.+")


def _separable(described: dict) -> bool:
    normal = described.get("normalizer") or {}
    steps = normal.get("normalizers", [normal] if normal else [])
    before = (described.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    first = before[0]
    kept = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
    lower = {"type": "Lowercase"} in steps
    spaces = all(s["type"] in NORMALISERS and (s["type"] != "Replace" or (s["pattern"], s["content"]) == ({"Regex": r"\s+"}, " ")) for s in steps)
    return first == kept and [b["type"] for b in before[1:]] == ["ByteLevel"] and spaces and lower and described.get("post_processor") is None


class Encoder:
    """Ids, as little-endian unsigned 32-bit integers, of UTF-8 texts. Strings of special tokens in a text are ordinary text."""

    def __init__(self, description: str) -> None:
        self.tokenizer = Tokenizer.from_str(description)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.separable = _separable(json.loads(description))
        self.chunks: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def _ask(self, parts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)
        return [array("I", f.ids).tobytes() for f in found]

    def _learn(self, missing: list[bytes]) -> list[bytes]:
        """The ids of chunks, by their pieces; those that aren't long are remembered."""
        cut = [(_PIECE if c.isascii() else _TAIL).findall(c.lower()) for c in missing]
        new = set(chain.from_iterable(cut)).difference(self.pieces)
        letters, other = [], []
        for p in new:
            (letters if p.isalpha() and len(p) <= LONGEST else other).append(p)  # of bytes: ASCII letters alone
        for p in letters:  # one word, as it is
            self.pieces[p] = array("I", [t.id for t in self.model.tokenize(p.decode())]).tobytes()
        self.pieces.update(zip(other, self._ask(other), strict=True))
        get = self.pieces.__getitem__
        out = [b"".join(map(get, own)) for own in cut]
        self.chunks.update((c, ids) for c, ids in zip(missing, out, strict=True) if len(c) <= LONGEST)
        for p in other:
            if len(p) > LONGEST:
                del self.pieces[p]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts (null: empty), one text after the other, and the n + 1 offsets into them."""
        data, at = text_bytes(texts)
        parts, counts = [np.zeros(0, "<u4")], np.zeros(len(texts), np.int64)
        if not self.separable:
            for row in range(len(texts)):
                parts += [np.frombuffer(b, "<u4") for b in self._ask([data[at[row] : at[row + 1]].tobytes()])]
                counts[row] = len(parts[-1])
        else:
            for lo, hi in _slices(data, at):
                edges = np.concatenate([[lo], at[(at > lo) & (at < hi)], [hi]])
                starts, ends = word_bounds(data[lo:hi], edges - lo)
                if len(starts):
                    ids, each = self._chunks(data[lo:hi], starts, ends)
                    parts.append(ids)
                    row = np.searchsorted(at, starts + lo, side="right") - 1
                    counts += np.bincount(row, each, len(counts)).astype(np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])

    def _chunks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks of a slice, and how many each has."""
        if len(self.chunks) > REMEMBERED:
            self.chunks.clear()
        if len(self.pieces) > 2 * REMEMBERED:
            self.pieces.clear()
        packed = data[~IS_SPACE[data]]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        found = list(map(self.chunks.get, distinct))
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(missing, self._learn([distinct[i] for i in missing]), strict=True):
            found[i] = ids
        flat, size = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = words.indices.to_numpy()
        each, first = size[which], (np.cumsum(size) - size)[which]
        return flat[np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())], each


def _slices(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of the texts' bytes, at a text's end or at white space."""
    lo = 0
    while lo < len(data):
        hi = min(lo + SLICE_BYTES, len(data))
        end = int(at[np.searchsorted(at, hi)])
        while hi < end and not IS_SPACE[data[hi]]:
            hi += 1
        yield lo, hi
        lo = hi


@lru_cache(maxsize=2)
def encoder(description: str) -> Encoder:
    """The encoder of this worker for a tokenizer's JSON; what it remembers outlives a task."""
    return Encoder(description)
