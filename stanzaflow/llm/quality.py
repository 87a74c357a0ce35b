"""Operator 7, quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of characters: n-grams of ORDER symbols, each of BITS bits. Symbols are code points, with
ASCII digits alike; from U+0C00 on 1,024 classes share the code points. What is counted
grows with the trusted text.

1. n-grams of trusted text are counted, and by order the joins of n-grams with the totals and discounts of their
   contexts give discounted probabilities and back-off weights; lower orders count distinct continuations.
2. n-grams of all documents are counted, and joined, order by order and sharded by n-gram, context and suffix, with
   these tables: a log-probability for each different n-gram that any document holds.
3. Documents meet their log-probabilities. The HEAD commonest n-grams are hot keys: of fixed number, they go to the
   documents. All others are joined by shards: a chunk of documents sends each shard, packed, its n-grams with the
   documents and how often, and gets sums by document back. Shards, and replicas of a shard, follow the sizes of the
   model and of what is sent, so that a task holds a bounded part. Texts never move.

A document is kept if its perplexity by character is at most the given quantile of its language's trusted
documents. Every HELD_OUT-th trusted document (by hash) is left out of the counts and gives these quantiles, so that
they are of texts that the model has not seen. Languages without such documents take the quantile of all.

Defined results: null and empty texts have no perplexity and are not kept. A null language is a language.
Without trusted text the model is uniform and every text is kept, as where no trusted document is held out. Texts
are read whole; repeated rows are judged each; no rows give no rows; only the named columns are read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stanzaflow.llm.scratch import integer_key, materialise
from stanzaflow.llm.words import slices, text_bytes

BITS, ORDER, QUANTILE = 12, 5, 0.99
BASE = 1 << BITS
#: One of so many trusted documents gives thresholds instead of counts.
HELD_OUT = 5
#: n-grams that go to the documents; rows of a shard of the others; bytes of packed n-grams that a task should get.
HEAD, SHARD_GRAMS, TASK_BYTES = 1 << 16, 1 << 19, 8 << 20
#: Text bytes in a chunk; different n-grams that a counting task holds before it sends them on.
CHUNK_BYTES, HELD_GRAMS = 2 << 20, 1 << 21
#: Keys of 8 bytes, and languages, that are broadcast at most; beyond, a shuffled join does the same.
BROADCAST_KEYS, BROADCAST_LANGS = 2_000_000, 100_000
#: Keeps the lower orders a weight where counts of counts are odd, as on very small inputs.
LEAST_DISCOUNT = 0.05

#: Symbols of code points under U+0C00: white space is 0, as is a text's edge.
_SYMBOL = np.arange(3072, dtype=np.int64)
_SYMBOL[48:58] = 48
_SYMBOL[[0x20, *range(0x09, 0x0E)]] = 0


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of some rows and the n + 1 offsets of the rows among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    if at[-1] != len(points):  # bytes that are no UTF-8
        rows = [data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le") for a, b in zip(offsets, offsets[1:])]
        points, at = np.frombuffer(b"".join(rows), np.uint32), np.cumsum([0, *[len(r) // 4 for r in rows]])
    return points, at


def _grams(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of a batch (.., text last): rows from, to; the n-gram ending at each character; row offsets."""
    data, offsets = text_bytes(batch.column(batch.num_columns - 1))
    for a, b in slices(offsets, CHUNK_BYTES):
        points, at = _points(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        symbol = np.where(points < 3072, _SYMBOL[np.minimum(points, 3071)], 3072 + (points & 1023).astype(np.int64))
        place = np.arange(len(symbol)) - np.repeat(at[:-1], np.diff(at))
        gram = symbol.copy()
        for back in range(1, ORDER):
            gram[back:] |= np.where(place[back:] >= back, symbol[:-back], 0) << (BITS * back)  # a text's edge is 0
        yield a, b, gram, at


def _summed(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams, n = grams[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.add.reduceat(n, first)


def gram_counts(texts: DataFrame) -> DataFrame:
    """gram, n of all n-grams of texts (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _summed(*(np.concatenate(x) for x in zip(held, *fresh))) if fresh else held

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["gram", "n"])

        for batch in batches:
            for _, _, gram, _ in _grams(batch):
                fresh.append(np.unique(gram, return_counts=True))
                size += len(fresh[-1][0])
                if size > HELD_GRAMS:
                    held, fresh, size = merged(), [], 0
                    if len(held[0]) > HELD_GRAMS:
                        yield out()
                        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        held = merged()
        yield out()

    return texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(times: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's discounts from the numbers of n-grams seen 1, 2, 3 and 4 times; 1/2 where these lack."""
    n1, n2, n3, n4 = times
    if not all(times):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, LEAST_DISCOUNT), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def _low(k: int) -> Column:
    """The last k symbols of a gram."""
    return F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))


def order_tables(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to ORDER: gram, alpha (discounted probability); context, gamma (weight of the lower order)."""
    tables, grams = [], materialise(counts)
    for k in range(ORDER, 0, -1):
        seen = grams.agg(*[F.count_if(F.col("n") == j).alias(f"n{j}") for j in range(1, 5)]).first()
        d1, d2, d3 = discounts(list(seen))
        n = F.col("n")
        shared = grams.withColumn("context", F.shiftright("gram", BITS)).withColumn("off", F.when(n == 1, d1).when(n == 2, d2).otherwise(d3))
        contexts = shared.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("off"))
        alpha = shared.drop("off").join(contexts.drop("off"), "context")
        alpha = alpha.select("gram", ((n - F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)) / F.col("total")).alias("alpha"))
        tables.append((alpha, contexts.select("context", (F.col("off") / F.col("total")).alias("gamma"))))
        if k > 1:
            grams = materialise(grams.groupBy(_low(k - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    return tables[::-1]


def log_probabilities(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, n, logp (of the last symbol after the others) for each of wanted (gram, n), by the model of counts (gram, n)."""
    lower = None
    for k, (alpha, gamma) in enumerate(order_tables(counts), 1):
        need = wanted if k == ORDER else wanted.select(_low(k).alias("gram")).distinct()
        need = need.withColumn("context", F.shiftright("gram", BITS))
        p = need.join(alpha, "gram", "left").join(gamma, "context", "left")
        if lower is None:
            p = p.withColumn("below", F.lit(1 / BASE))
        else:
            p = p.withColumn("suffix", _low(k - 1)).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        # A context never seen leaves all to the lower order.
        kept = [c for c in wanted.columns if c in need.columns]
        p = p.select(*kept, (F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("below")).alias("p"))
        lower = materialise(p)
    return lower.select("gram", "n", F.log("p").cast("float").alias("logp"))


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of integers by byte planes, compressed."""
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpack(blob: bytes, sizes: list[int], types: list[str]) -> list[np.ndarray]:
    widths = [n * np.dtype(t).itemsize for n, t in zip(sizes, types, strict=True)]
    raw, at, out = np.frombuffer(pa.decompress(blob, sum(widths), codec="zstd"), np.uint8), 0, []
    for width, n, t in zip(widths, sizes, types, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + width].reshape(-1, n).T).view(t).reshape(n) if n else np.zeros(0, t))
        at += width
    return out


#: Packed by chunk and shard: steps between ascending n-grams, how many documents each has, these, and how often.
_TYPES = ["<u8", "<u4", "<u4", "<u4"]


#: A prime; n-grams, which aren't negative, are dealt by their remainder.
_PRIME = (1 << 31) - 1


def _shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    return grams % _PRIME % shards


def perplexities(docs: DataFrame, model: DataFrame, head: int = HEAD, shard_grams: int = SHARD_GRAMS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """docs (key, lang, text) without text but with perplexity, null for texts without characters; model as log_probabilities gives it."""
    model = materialise(model)
    hot = model.orderBy(F.desc("n"), "gram").limit(head).toArrow()  # HEAD rows
    order = np.argsort(hot["gram"].to_numpy())
    hot_gram, hot_logp = hot["gram"].to_numpy()[order], hot["logp"].to_numpy()[order].astype(float)
    rest = model.limit(0)
    if len(order) == head:
        n, gram = hot["n"][-1].as_py(), hot["gram"][-1].as_py()
        rest = model.filter((F.col("n") < n) | (F.col("n") == n) & (F.col("gram") > gram))
    shards = max(1, -(-rest.count() // shard_grams))
    shared = docs.sparkSession.sparkContext.broadcast((hot_gram, hot_logp))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, with its sum over hot n-grams; rows of packed others for each chunk and shard."""
        hot_gram, hot_logp = shared.value
        for batch in batches:
            for a, b, gram, at in _grams(batch):
                chunk = int.from_bytes(os.urandom(8), "little") >> 1  # names the rows of this table, which is written once
                row = np.repeat(np.arange(b - a), np.diff(at))
                by = np.argsort(gram, kind="stable")
                gram, row = gram[by], row[by]
                first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
                each, times = gram[first], np.diff(np.append(first, len(gram)))
                place = np.minimum(np.searchsorted(hot_gram, each), max(len(hot_gram) - 1, 0))
                known = hot_gram[place] == each if len(hot_gram) else np.zeros(len(each), bool)
                logp = np.where(known, hot_logp[place], 0.0) if len(hot_gram) else np.zeros(len(each))
                total = np.bincount(row, np.repeat(logp, times), b - a)
                part = batch.slice(a, b - a)
                none = pa.nulls(b - a, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(np.full(b - a, chunk)), pa.array(np.arange(b - a, dtype=np.int32)), pa.array(total), pa.array(np.diff(at)),
                     pa.nulls(b - a, pa.int64()), none, pa.nulls(b - a, pa.list_(pa.int32()))],
                    _FIELDS,
                )
                cold = np.repeat(~known, times)
                gram, row = gram[cold], row[cold]
                shard = _shard_of(gram, shards)
                for s in np.unique(shard):
                    g, r = gram[shard == s], row[shard == s]
                    new = np.concatenate([[True], g[1:] != g[:-1]])
                    pair = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])]))
                    owners = np.diff(np.append(np.flatnonzero(new[pair]), len(pair)))
                    often = np.diff(np.append(pair, len(g)))
                    packed = [np.diff(g[new], prepend=0).astype("<u8"), owners.astype("<u4"), r[pair].astype("<u4"), often.astype("<u4")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([chunk]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.int64()),
                         pa.array([int(s)]), pa.array([_pack(packed)], pa.binary()), pa.array([[len(x) for x in packed]], pa.list_(pa.int32()))],
                        _FIELDS,
                    )

    key = docs.schema["key"].dataType.simpleString()
    if key != "bigint":
        raise TypeError(f"key is of type {key}, not bigint")
    met = materialise(docs.mapInArrow(meet, "key long, lang string, chunk long, row int, total double, n long, shard long, packed binary, sizes array<int>"))
    own, sent = met.filter("shard IS NULL").select("key", "lang", "chunk", "row", "total", "n"), met.filter("shard IS NOT NULL")
    size = sent.agg(F.sum(F.length("packed"))).first()[0] or 0
    replicas = max(1, -(-size // (shards * task_bytes)))
    # The model's shards are packed once; copies of these few rows go to the replicas.
    table = rest.select((F.col("gram") % _PRIME % shards).alias("shard"), "gram", "logp").repartition(4 * shards, "shard")
    table = materialise(table.mapInArrow(_pack_shards, "shard long, packed binary, sizes array<int>"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicas - 1).cast("long")))
    table = table.select("shard", copies.alias("replica"), F.lit(0).alias("late"), F.lit(0).cast("long").alias("chunk"), "packed", "sizes")
    own_replica = F.pmod("chunk", F.lit(replicas)).cast("long").alias("replica")
    asked = sent.select("shard", own_replica, F.lit(1).alias("late"), "chunk", "packed", "sizes")
    by = ["shard", "replica"]
    # More partitions than groups, so that few groups share one.
    dealt = table.union(asked).repartition(4 * shards * replicas, *by).sortWithinPartitions(*by, "late")
    parts = dealt.mapInArrow(_answer, "chunk long, row int, part double")
    parts = parts.groupBy("chunk", "row").agg(F.sum("part").alias("part"))
    whole = own.join(parts, ["chunk", "row"], "left").withColumn("total", F.col("total") + F.coalesce("part", F.lit(0.0)))
    return whole.select("key", "lang", F.when(F.col("n") > 0, F.exp(-F.col("total") / F.col("n"))).alias("perplexity"))


_FIELDS = ["key", "lang", "chunk", "row", "total", "n", "shard", "packed", "sizes"]


def _pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's shards of the model (shard, gram, logp), each packed by ascending n-grams."""
    held = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
    if held:
        shard, gram, logp = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((gram, shard))
        shard, gram, logp = shard[order], gram[order], logp[order]
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(shard)), strict=True):
            packed = [np.diff(gram[a:b], prepend=0).astype("<u8"), logp[a:b].astype("<f4")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[a : a + 1]), pa.array([_pack(packed)], pa.binary()), pa.array([[b - a, b - a]], pa.list_(pa.int32()))], ["shard", "packed", "sizes"]
            )


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packed shards of the model, then packed n-grams, by shard and replica: sums by chunk and row."""
    at, grams, logps = None, np.zeros(0, np.int64), np.zeros(0)
    for batch in batches:
        for shard, replica, late, chunk, packed, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (shard, replica) != at:
                at, grams, logps = (shard, replica), np.zeros(0, np.int64), np.zeros(0)
            if not late:
                step, logps = _unpack(packed, sizes, ["<u8", "<f4"])
                grams = np.cumsum(step).astype(np.int64)
                continue
            step, owners, row, often = _unpack(packed, sizes, _TYPES)
            logp = logps[np.searchsorted(grams, np.cumsum(step).astype(np.int64))].astype(float)  # every n-gram is in the model
            part = np.bincount(row, np.repeat(logp, owners) * often)
            who = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), chunk)), pa.array(who.astype(np.int32)), pa.array(part[who])], ["chunk", "row", "part"])


def held_out(key: Column) -> Column:
    """Whether a trusted document gives thresholds."""
    return F.crc32(F.concat(F.lit("held out "), key.cast("string"))) % HELD_OUT == 0


def quality(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, **sizes: int) -> DataFrame:
    """key, lang, perplexity, threshold, keep of docs (key, lang, text); trusted: key, each once."""
    few = materialise(trusted.select("key"))
    # Trusted text is counted where it stands; its keys are shuffled only if they are many.
    mark = F.broadcast(few) if few.count() <= BROADCAST_KEYS else few
    docs = docs.select("key", "lang", "text")
    counts = gram_counts(docs.join(mark.filter(~held_out(F.col("key"))), "key", "left_semi").select("text"))
    model = log_probabilities(counts, materialise(gram_counts(docs.select("text"))))
    scored = materialise(perplexities(docs, model, **sizes))
    good = scored.join(mark.filter(held_out(F.col("key"))), "key", "left_semi")

    def bar() -> Column:
        return F.percentile_approx("perplexity", quantile, 10_000)

    overall = good.agg(bar()).first()[0]
    by_lang = materialise(good.groupBy("lang").agg(bar().alias("own")).withColumnRenamed("lang", "_lang"))
    by_lang = F.broadcast(by_lang) if by_lang.count() <= BROADCAST_LANGS else by_lang
    found = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    threshold = F.coalesce("own", F.lit(float("inf") if overall is None else overall))
    return found.select(
        "key", "lang", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("keep")
    )


def op7(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Perplexity of each document under a model of those that labels call good, and whether it is kept."""
    docs = documents.select(integer_key(documents, "doc_id").alias("key"), "lang", "text")
    trusted = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(integer_key(labels, "doc_id").alias("key")).distinct()
    return quality(docs, trusted).withColumnRenamed("key", "doc_id")
