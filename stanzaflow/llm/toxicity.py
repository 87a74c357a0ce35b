"""Operator 4, toxicity behind a noisy channel.

Writers hide words as leetspeak, spaced letters and repeated letters. A suspect token of any length becomes a
lattice: each character stands for itself or for the letters that it may replace, separators may be dropped
and runs of one letter shortened. Viterbi decoding finds the path with the best sum of channel and
language-model scores; the model is an interpolated character trigram model, counted over all documents. Suspect
are words with a sign or digit beside a letter, a doubled letter or a mark between letters, and three or more single
letters in a row (marks around them aside). Where ordinary words look alike, as with doubled letters and hyphens, a
restored word that differs comes beside the token; else it takes its place. A logistic regression over word
beginnings scores the result. Its features are
chosen, and its weights fitted, on labelled rows: at most TRAIN_ROWS of them, those with the smallest hashes.

Defined results: null and empty texts have no words and get the score of a text without any known word. Rows
without a label, or with a null one, take no part in training; where all labels are equal, or none are
there, the score is the share of label 1, smoothed by one row of UNKNOWN: without labels nothing is called toxic. Texts and tokens of any length are scored whole. Repeated rows are scored each; no
rows give no rows; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stanzaflow.llm.scratch import integer_key, materialise
from stanzaflow.llm.words import U64, prefix_hashes, slices, text_bytes, word_bounds

#: Labelled rows that the classifier is fitted on, at most.
TRAIN_ROWS = 8192
#: Hash buckets of features (a power of two), features chosen, documents that a feature must occur in.
BUCKETS, FEATURES, LEAST_DOCS = 18, 256, 5
#: Bytes of a word's beginning that make a feature.
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
#: The score where nothing is known.
UNKNOWN = 0.1
#: Decoded tokens that a worker remembers.
REMEMBERED = 1 << 14

#: Fixed values of the channel: what a character may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
}
SEPARATORS = " .-_*"
#: Log-probabilities of the channel: a letter as itself, a replaced letter, a symbol that stands for nothing,
#: a dropped separator, a letter dropped from a run: the second of it (most doubled letters are meant), a sign, a further one.
AS_ITSELF, REPLACED, NOTHING, DROPPED, HALVED, SHORTENED = -0.05, -1.0, -6.0, -0.5, -2.5, -0.7
#: Letters of a word that paths are remembered for together; longer tokens are decoded without being remembered.
LONGEST_REMEMBERED = 64

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CODE = {c: i + 1 for i, c in enumerate(_LETTERS)}
N = 27  # 0 is a word's edge, and any other character
_BYTE_CODE = np.zeros(256, np.int32)
for _c, _i in _CODE.items():
    _BYTE_CODE[[ord(_c), ord(_c.upper())]] = _i
_IS_LETTER = _BYTE_CODE > 0
_IS_LEET = np.zeros(256, bool)
_IS_LEET[[ord(c) for c in STANDS_FOR]] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[[ord(c) for c in ".-_*"]] = True
#: Signs that don't end a sentence.
_IS_INNER = _IS_LEET & ~_IS_DIGIT
_IS_INNER[ord("!")] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Character trigrams of all texts; docs: text. The result has 27^3 cells whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in slices(offsets):
                # An edge before each text: two rows never meet in a trigram.
                code = np.insert(_BYTE_CODE[data[offsets[a] : offsets[b]]], offsets[a:b] - offsets[a], 0)
                code = np.concatenate([[0], code, [0, 0]])
                total += np.bincount((code[:-2] * N + code[1:-1]) * N + code[2:], minlength=N**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    summed = docs.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(N**3)
    for row in summed.collect():  # at most 27^3 rows
        out[row.cell] = row.n
    return out.reshape(N, N, N)


@dataclass
class CharModel:
    """Interpolated trigram log-probabilities of letters and word edges."""

    counts: np.ndarray
    logp: list = field(init=False)
    seen: dict = field(init=False)

    def __post_init__(self) -> None:
        c3 = self.counts + 0.0
        c3[0, 0, 0] = 0  # runs of other characters
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + N)
        p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)
        self.logp = np.log(p3).tolist()
        self.seen: dict[str, str] = {}

    def __getstate__(self) -> np.ndarray:
        return self.counts

    def __setstate__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.__post_init__()

    def restore(self, token: str) -> str:
        """The likeliest writing of a token; words in it are joined by a space."""
        token = token.lower()
        if token not in self.seen:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            if len(token) > LONGEST_REMEMBERED:
                return self._decode(token)
            self.seen[token] = self._decode(token)
        return self.seen[token]

    def _decode(self, token: str) -> str:
        # Paths by the last two letters.
        paths = {(0, 0): (0.0, None)}
        for arcs in lattice(token):
            after: dict = {}
            for (a, b), (score, back) in paths.items():
                for x, channel in arcs:
                    if x < 0:
                        to, s, link = (a, b), score + channel, back
                    elif x == 0 and b == 0:
                        to, s, link = (a, b), score + channel, back
                    else:
                        to, s, link = (b, x), score + channel + self.logp[a][b][x], (x, back)
                    if to not in after or s > after[to][0]:
                        after[to] = (s, link)
            paths = after
        best = max(
            ((s + (self.logp[a][b][0] if b else 0.0), link) for (a, b), (s, link) in paths.items()), key=lambda p: p[0]
        )
        out, link = [], best[1]
        while link:
            out.append(" " if link[0] == 0 else _LETTERS[link[0] - 1])
            link = link[1]
        return "".join(reversed(out)).strip()


def lattice(token: str) -> Iterator[list[tuple[int, float]]]:
    """For each character its arcs: (code of a letter, 0 for none or -1 for dropped, log-probability of the channel)."""
    run, last = 0, ""
    for c in token:
        run, last = run + 1 if c == last else 1, c
        if c in _CODE:
            arcs = [(_CODE[c], AS_ITSELF)]
            if run >= 2:
                arcs.append((-1, HALVED if run == 2 else AS_ITSELF))
        elif c in STANDS_FOR:
            arcs = [(_CODE[x], REPLACED) for x in STANDS_FOR[c]] + [(0, NOTHING)]
            if run >= 2:
                arcs.append((-1, SHORTENED))
        elif c in SEPARATORS:
            arcs = [(-1, DROPPED), (0, AS_ITSELF)]
        else:
            arcs = [(0, AS_ITSELF)]
        yield arcs


def suspects(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of words that look disguised: first word, past the last, and whether ordinary words may look so too."""
    n = len(data)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    letter, digit, sign = _IS_LETTER[data], _IS_DIGIT[data], _IS_LEET[data]
    alnum = letter | digit
    lower, mark = _LOWER[data], _IS_MARK[data]
    # Whether a byte has another, or two others, of its word before it.
    one = np.ones(n, bool)
    one[start] = False
    two = one.copy()
    two[1:] &= one[:-1]
    three = two.copy()
    three[1:] &= two[:-1]
    before = [np.concatenate([np.zeros(k, x.dtype), x])[:n] for x, k in ((letter, 1), (sign, 1), (mark, 1), (alnum, 2), (letter, 2), (mark, 3))]
    letter1, sign1, mark1, alnum2, letter2, mark3 = before
    twice = one & letter & (lower == np.concatenate([lower[:1], lower[:-1]]))
    thrice = twice & np.concatenate([[False], twice[:-1]])
    # A sign before or after a letter (an exclamation mark only before), three equal letters, letters apart by signs.
    sure = one & sign1 & letter | one & letter1 & (digit | _IS_INNER[data]) | thrice | three & alnum & mark1 & alnum2 & mark3
    mild = twice | two & letter & mark1 & letter2
    flags = np.zeros(len(start), np.int8)
    flags[np.searchsorted(start, np.flatnonzero(mild), "right") - 1] = 1
    flags[np.searchsorted(start, np.flatnonzero(sure), "right") - 1] = 2
    # Three or more words of a single character each, marks around it aside, with a letter among them.
    core = alnum | sign
    core[1:] &= ~((data[1:] == 33) & alnum[:-1])
    held = np.concatenate([[0], np.cumsum(core)])
    single = (held[end] - held[start] == 1) & (end - start <= 3)
    letters = np.concatenate([[0], np.cumsum(letter)])
    first = np.ones(len(start), bool)
    first[1:] = (single[1:] != single[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(first)
    past = np.append(begin[1:], len(start))
    spelled = single[begin] & (past - begin >= 3) & (letters[end[past - 1]] > letters[start[begin]])
    begin, past = begin[spelled], past[spelled]
    taken = np.zeros(len(start) + 1, np.int64)
    np.add.at(taken, begin, 1)
    np.add.at(taken, past, -1)
    alone = np.flatnonzero((flags > 0) & (np.cumsum(taken)[:-1] == 0))
    return (
        np.concatenate([begin, alone]), np.concatenate([past, alone + 1]), np.concatenate([np.zeros(len(begin), bool), flags[alone] == 1])
    )


_EDGES = re.compile(r"\A[^A-Za-z0-9@$!|+]+|[^A-Za-z0-9@$|+]+\Z")


def _restored(model: CharModel, data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray):
    """For a slice: which words stay as they are, and by row the restored words."""
    plain, texts, whole = np.ones(len(start), bool), {}, data.tobytes()
    first, past, mild = suspects(data, start, end, row)
    for a, b, unsure, r in zip(first.tolist(), past.tolist(), mild.tolist(), row[first].tolist(), strict=True):
        token = " ".join(whole[start[i] : end[i]].decode("utf-8", "replace") for i in range(a, b))
        inner = _EDGES.sub("", token)
        found = model.restore(inner)
        if unsure:
            if found == inner.lower():
                continue
        else:
            plain[a:b] = False
        texts.setdefault(r, []).append(found)
    return plain, texts


def _features(model: CharModel, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a batch (.., text last): rows from, to, each row's word count, and (row, bucket) of all features."""
    data, offsets = text_bytes(batch.column(batch.num_columns - 1))
    for a, b in slices(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end = word_bounds(part, at)
        row = np.searchsorted(at, start, "right") - 1
        plain, texts = _restored(model, part, start, end, row)
        rows, found = [], []
        words = np.bincount(row, minlength=b - a)
        extra = pa.array([" ".join(x) for x in texts.values()], pa.large_string())
        which = np.array(list(texts), np.int64)
        data2, at2 = text_bytes(extra)
        start2, end2 = word_bounds(data2, at2)
        for d, s, e, r in ((part, start[plain], end[plain], row[plain]), (data2, start2, end2, which[np.searchsorted(at2, start2, "right") - 1] if len(start2) else start2)):
            for length, hashed, ok in prefix_hashes(d, s, e, PREFIXES):
                rows.append(r[ok])
                found.append((hashed >> U64(64 - BUCKETS)).astype(np.int64))
        yield a, b, words, np.concatenate(rows), np.concatenate(found)


@dataclass
class ToxicityModel:
    chars: CharModel
    place: np.ndarray  # of each bucket among the features, or -1
    weights: np.ndarray  # of the features, of the length and of a constant

    def score(self, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(counts, words) @ self.weights, -30, 30)))


def _design(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(counts), np.log1p(words) / 5, np.ones(len(words))])


def _feature_counts(place: np.ndarray, features: int, n: int, row: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    at = place[bucket]
    hit = at >= 0
    return np.bincount(row[hit] * features + at[hit], minlength=n * features).reshape(n, features)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge-penalised logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-4)
        step = np.linalg.solve((x * s[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= 0.8 * step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """A model from docs (key, text) and labels (key, label 0 or 1; a key once)."""
    chars = CharModel(trigram_counts(docs.select("text")))
    labels = labels.filter("key IS NOT NULL AND label IN (0, 1)")
    picked = materialise(labels.orderBy(F.xxhash64("key"), "key").limit(rows))
    sample = materialise(docs.join(F.broadcast(picked), "key").select("label", "text"))  # at most `rows` keys

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many documents of each class a bucket occurs."""
        total = np.zeros((2, 1 << BUCKETS), np.int64)
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, _, row, bucket in _features(chars, batch):
                once = np.unique(row << BUCKETS | bucket)
                of = label[a + (once >> BUCKETS)]
                for c in (0, 1):
                    total[c] += np.bincount(once[of == c] & (1 << BUCKETS) - 1, minlength=1 << BUCKETS)
        at = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["bucket", "n0", "n1"])

    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    place = np.full(1 << BUCKETS, -1, np.int64)
    if not n0 or not n1:
        share = (n1 + UNKNOWN) / (n0 + n1 + 1)
        return ToxicityModel(chars, place, np.array([0.0, np.log(share / (1 - share))]))
    seen = sample.mapInArrow(by_class, "bucket long, n0 long, n1 long").groupBy("bucket").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
    )
    share = (F.col("n0") + F.col("n1")) / (n0 + n1)
    spread = F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1)) + 1e-9
    seen = seen.filter(F.col("n0") + F.col("n1") >= LEAST_DOCS)
    seen = seen.select("bucket", F.abs(F.col("n1") / n1 - F.col("n0") / n0).alias("gap"), spread.alias("spread"))
    best = seen.orderBy(F.desc(F.round(F.col("gap") / F.col("spread"), 6)), "bucket").limit(FEATURES).collect()
    place[[r.bucket for r in best]] = np.arange(len(best))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words, row, bucket in _features(chars, batch):
                counts = _feature_counts(place, len(best), b - a, row, bucket)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(words), pa.array([np.minimum(c, 65535).astype("<u2").tobytes() for c in counts], pa.binary())],
                    ["label", "words", "counts"],
                )

    shaped = sample.mapInArrow(vectors, "label int, words long, counts binary")
    got = sorted(map(tuple, shaped.collect()))  # at most `rows` of FEATURES x 2 bytes
    counts = np.array([np.frombuffer(c, "<u2") for _, _, c in got], float).reshape(len(got), len(best))
    design = _design(counts, np.array([w for _, w, _ in got], float))
    return ToxicityModel(chars, place, fit_logistic(design, np.array([y for y, _, _ in got], float)))


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """key, score of docs (key, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BUCKETS + 27^3 numbers

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        features = len(model.weights) - 2
        for batch in batches:
            for a, b, words, row, bucket in _features(model.chars, batch):
                counts = _feature_counts(model.place, features, b - a, row, bucket)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(model.score(counts, words))], ["key", "score"])

    return docs.mapInArrow(apply, "key long, score double")


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 2 by 4; false for null."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """key, score for each row of docs, trained on the labels of keys that are not held out."""
    rows = docs.select(integer_key(docs, key).alias("key"), F.col(text).alias("text"))
    known = labels.filter(~held_out(F.col(key))).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    known = known.groupBy("key").agg(F.max("label").alias("label"))
    return scored(rows, train(rows, known))


def op4(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    done = toxicity(documents, labels, "doc_id", "text", "toxic")
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return done.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score", predicted.alias("predicted"))
