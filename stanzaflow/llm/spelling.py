"""Operator 12, spelling variants from a forward and a reversed sorted dictionary.

Two words one edit apart, the shorter of n letters, share their first or their last n // 2 letters: one half is intact. Words that may
pair in length therefore meet in blocks of a shared prefix, and in blocks of a shared suffix. A block over a bounded size is subdivided by the
same rule: of what lies between the shared ends, again one half is intact. So a block shrinks until it is small or a single letter is left open, when
its size is bounded by the alphabet (squared). Blocks lie sorted by their ends (the suffix dictionary by reversed ends) in range partitions, which are
scanned block by block; pairs are verified there, and only those one edit apart are handed on. A pair is reported in one block alone: in the one
of the prefix, wherever it shares that.

Defined results: a null text has no words. A null key counts as no digits before the colon. Repeated rows count as often as they occur. Words
are compared by code points, and may be of any length. Ties of a form go to the smallest word in code-point order. A word whose near words
are none, or too rare, has no form and is its own root. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stanzaflow.llm.scratch import materialise

#: What a run is made of, and how runs are disturbed.
RUN, UPPER, LOWER, EVERY = r"[A-Za-zÀ-ÿ]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", 199
#: Words of a block from which on it is subdivided, and parts that a block's words are counted in.
BLOCK, SALTS = 192, 16
#: Words up to this length, and over so many, are compared as one matrix.
MATRIX, FEW = 64, 5


def runs(df: DataFrame, key: str, text: str, every: int = EVERY) -> DataFrame:
    """word, n: distinct runs of letters in lower case (A-Z only), one code point deleted where the hash of key and run says so."""
    word = F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(RUN), F.lit(0))).alias("run")
    found = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), word)
    found = found.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))
    found = found.withColumn("h", F.crc32(F.concat("key", F.lit(":"), F.col("run")).cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _keyed(words: DataFrame) -> DataFrame:
    """Each word for each block that it may pair in: as the shorter or an equal word, and as the longer by one letter."""
    long = F.explode(F.array(F.lit(0), F.lit(1))).alias("long")
    out = words.select("word", "n", F.length("word").alias("size"), long).withColumn("short", F.col("size") - F.col("long"))
    return _halved(out.filter("short >= 1").withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0)).withColumn("below", F.col("short") + 1))


def _halved(rows: DataFrame) -> DataFrame:
    """Rows of blocks (short, lo, hi) in the two blocks that have a half of what is open as well.

    `below` is the bound of a pair's shared prefix, from which on the pair is found in another block.
    """
    half = F.floor((F.col("short") - F.col("lo") - F.col("hi")) / 2).cast("int")
    first = F.struct((F.col("lo") + half).alias("lo"), F.col("hi"), F.col("below"))
    last = F.struct(F.col("lo"), (F.col("hi") + half).alias("hi"), F.least("below", F.col("lo") + half).alias("below"))
    out = rows.withColumn("to", F.explode(F.array(first, last)))
    return out.select("word", "n", "size", "long", "short", "to.lo", "to.hi", "to.below")


def _ends() -> tuple[Column, Column]:
    """What a block shares in front, and what it shares behind, reversed."""
    return F.substring("word", F.lit(1), F.col("lo")), F.reverse(F.substring("word", F.col("size") - F.col("hi") + 1, F.col("hi")))


_BLOCK = ["short", "lo", "hi", "below", "front", "back"]


def _subdivided(rows: DataFrame, block: int) -> list[DataFrame]:
    """The rows of all blocks that are small or have one letter open; larger ones are subdivided until they are.

    A large block's words are found by its number and a salt, so that no task holds one whole.
    """
    front, back = _ends()
    small = []
    while True:
        named = rows.withColumn("name", F.xxhash64("short", "lo", "hi", "below", front, back))
        final = F.col("short") - F.col("lo") - F.col("hi") <= 1
        large = materialise(named.filter(~final).groupBy("name").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > block).select("name"))
        if large.isEmpty():
            return [*small, rows]
        spread = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        named = named.withColumn("salt", F.when(final, -1).otherwise(F.pmod(F.xxhash64("word"), F.lit(SALTS))).cast("int"))
        marked = materialise(named.join(spread.withColumn("large", F.lit(True)), ["name", "salt"], "left").drop("name", "salt"))
        small.append(marked.filter("large IS NULL").drop("large"))
        rows = _halved(marked.filter("large"))


def shared(a: str, b: str) -> int:
    """Length of the common prefix, by bisection."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def one_edit(a: str, b: str) -> int:
    """The length of the common prefix if b is a with one letter replaced or inserted, else -1."""
    p = shared(a, b)
    same = a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]
    return p if same and a != b else -1


def _pairs(words: list[str], long: np.ndarray, short: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of the words of a block that are one edit apart and share fewer than `below` letters in front; i isn't long."""
    few, more = np.flatnonzero(long == 0), np.flatnonzero(long)
    if short > MATRIX or len(words) <= FEW:
        found = [(i, j) for i in few.tolist() for j in range(len(words)) if (long[j] or i < j) and 0 <= one_edit(words[i], words[j]) < below]
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)
    codes = np.zeros((len(words), short + 1), np.int32)
    for i, w in enumerate(words):
        codes[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.int32)
    out = []
    step = max(1, (1 << 20) // (len(words) * (short + 1)))
    for at in range(0, len(few), step):  # a slice against all of the block
        own = few[at : at + step]
        same = codes[own, None, :short] == codes[None, few, :short]
        i, j = np.nonzero(same.sum(2) == short - 1)
        keep = (own[i] < few[j]) & (np.argmin(same[i, j], 1) < below)
        out.append((own[i[keep]], few[j[keep]]))
        if len(more):
            ahead = codes[own, None, :short] == codes[None, more, :short]
            prefix = np.minimum.accumulate(ahead, 2).sum(2)
            behind = codes[own, None, :short] == codes[None, more, 1:]
            suffix = np.minimum.accumulate(behind[:, :, ::-1], 2).sum(2)
            i, j = np.nonzero((prefix + suffix >= short) & (prefix < below))
            out.append((own[i], more[j]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _near(table: pa.Table) -> pa.RecordBatch:
    """The near words of all whole blocks of a table: word, near, n of near, both ways."""
    words, n, name = table["word"].to_pylist(), table["n"].to_numpy(), table["name"].to_numpy()
    long, short, below = (table[c].to_numpy() for c in ("long", "short", "below"))
    starts = np.concatenate([[0], np.flatnonzero(name[1:] != name[:-1]) + 1])
    ends = np.append(starts[1:], len(name))
    able = (ends - starts > 1) & (np.minimum.reduceat(long, starts) == 0)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in zip(starts[able].tolist(), ends[able].tolist(), strict=True):
        i, j = _pairs(words[lo:hi], long[lo:hi], int(short[lo]), int(below[lo]))
        left.append(i + lo)
        right.append(j + lo)
    a, b = np.concatenate(left + right), np.concatenate(right + left)
    own = pa.array(words, pa.string())
    return pa.RecordBatch.from_arrays([own.take(pa.array(a)), own.take(pa.array(b)), pa.array(n[b])], ["word", "near", "n"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words in a partition sorted by block. A block may go on in the next batch."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        name = held["name"].to_numpy()
        cuts = np.flatnonzero(name[1:] != name[:-1])
        if len(cuts):
            yield _near(held.slice(0, cuts[-1] + 1))
            held = held.slice(cuts[-1] + 1)
    if held is not None and len(held):
        yield _near(held)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, near, n (of near) for all pairs of distinct words (word, n) that are one edit apart, both ways."""
    front, back = _ends()
    parts = []
    for rows in _subdivided(_keyed(words), block):
        parts.append(rows.select(*_BLOCK[:4], front.alias("front"), back.alias("back"), "word", "n", "long"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    rows = materialise(rows.withColumn("name", F.xxhash64(*_BLOCK)))
    ordered = rows.repartitionByRange(*_BLOCK).sortWithinPartitions(*_BLOCK, "name", "word")
    return ordered.select("word", "n", "name", "long", "short", "below").mapInArrow(_scan, "word string, near string, n long")


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """word, root of words with a form (word, form): the last form of a chain, by doubling; no chain has over `longest` steps."""
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, longest - 1).bit_length()):
        further = out.select(F.col("word").alias("root"), F.col("root").alias("further"))
        out = materialise(out.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return out


def variants(words: DataFrame, times: int = 5, block: int = BLOCK) -> DataFrame:
    """word, n, form, root, n_near, form_n of distinct words (word, n): the form is the commonest near word, if that is `times` as common."""
    near = near_words(words, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    formed = -F.col("best.less") >= times * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"),
    )
    found = materialise(found)
    forms = found.filter("form IS NOT NULL")
    ends = forms.agg(F.max("form_n"), F.min("n")).first()
    steps = 0
    while ends[0] is not None and ends[1] * times ** (steps + 1) <= ends[0]:  # each step of a chain is to a word so much commoner
        steps += 1
    out = found.join(roots(forms, steps), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(documents: DataFrame, letters: int = 6, least: int = 5) -> DataFrame:
    """Spelling variants among the words of all documents that have six letters and occur five times."""
    words = materialise(runs(documents, "doc_id", "text").filter((F.length("word") >= letters) & (F.col("n") >= least)))
    return variants(words)
