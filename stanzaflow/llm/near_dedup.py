"""Operator 3, near-duplicates by b-bit MinHash.

Documents with equal shingle sets form a class, and only its smallest key goes on. Minima of BANDS x ROWS
hashes give band keys; of each minimum the low BITS bits are retained and packed. Documents that share a
band key are candidates: bit counts of the xor of two packed signatures, corrected for the chance that
different minima agree in their low bits, estimate the similarity. Estimates far below the threshold (over
five standard deviations) end there. What is left forms families of candidates; a family's shingle sets
meet in one task, where each link is confirmed on the full sets. In a large family all documents first meet the least,
in parts; what is linked with it is settled, and only the others meet each other and those, in pairs of blocks.

Inside a block no pair is emitted but the links of a spanning forest, and a pair is compared in full only if
its two documents are not yet connected, if the shingles that each shares with anyone allow the similarity,
and if the estimate does. A band key held by very many documents
contributes a star of candidates.

Two documents of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS: one pair in 10^7 is lost
at s = 0.85, fewer above. Sets hold 64-bit hashes of shingles.

Defined results: null, empty and blank texts have 0 shingles and are linked with nothing; under five words
the whole sequence is the only shingle. Rows with a null key are in no component (component_id null) and
are kept. Rows that repeat a key belong to one component, whatever their texts: a key of several sets links
their classes. No rows give no rows; only the named columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stanzaflow.llm.components import components
from stanzaflow.llm.grouped import binary_rows, matrix, whole_groups
from stanzaflow.llm.scratch import integer_key, materialise
from stanzaflow.llm.words import U64, mix, shingle_sets, slices, text_bytes, word_hashes

WORDS, BANDS, ROWS, BITS = 5, 28, 5, 2
HASHES = BANDS * ROWS
#: Band keys with more documents than this contribute a chain instead of estimated pairs.
HOT = 64
#: Bytes of shingle sets, and documents, in a block of a family; parts of a block that meet their family's least document.
BLOCK, BLOCK_DOCS, STAR = 8 << 20, 1024, 16
#: Rows of some 100 bytes that are broadcast at most; beyond, a shuffled join does the same.
BROADCAST_ROWS = 500_000

_SALT = mix(np.arange(1, HASHES + 1, dtype=U64), 31)
_XOR, _TIMES = (_SALT >> U64(32)).astype(np.uint32), _SALT.astype(np.uint32) | np.uint32(1)


def minima(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HASHES minima of each row's set, as a matrix; rows must not be empty."""
    x = (sets >> U64(32)).astype(np.uint32)
    out = np.empty((HASHES, len(offsets) - 1), np.uint32)
    for j in range(HASHES):
        np.minimum.reduceat((x ^ _XOR[j]) * _TIMES[j], offsets[:-1], out=out[j])
    return out.T


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, as bytes."""
    bits = (least[:, :, None] >> np.arange(BITS, dtype=np.uint32)[None, None]) & np.uint32(1)
    return np.packbits(bits.reshape(len(least), -1).astype(np.uint8), axis=1)


_FIELDS = np.packbits(np.tile(np.array([1] + [0] * (BITS - 1), np.uint8), HASHES))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures, row by row."""
    x = a ^ b
    for shift in range(1, BITS):
        x = x | (x << np.uint8(shift))  # fields don't straddle bytes: BITS divides 8
    differ = np.bitwise_count(x & _FIELDS).sum(-1, dtype=np.int64)
    chance = 0.5**BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


def lowest_estimate(percent: int, deviations: float = 5.5) -> float:
    """An estimate that pairs at the threshold reach but for one in many millions."""
    s, chance = percent / 100, 0.5**BITS
    agree = s + (1 - s) * chance
    return s - deviations * float(np.sqrt(agree * (1 - agree) / HASHES)) / (1 - chance)


def _sets(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(batch.column(column))
    for a, b in slices(offsets):
        words = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
        yield a, b, *shingle_sets(*words, WORDS)


def signatures(docs: DataFrame) -> DataFrame:
    """key, n, c1, c2 (the class: a 128-bit hash of the set), bands, sig of docs (key, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets, offsets in _sets(batch):
                n = np.diff(offsets)
                some = np.flatnonzero(n > 0)
                c1, c2 = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                bands = np.zeros((b - a, BANDS), np.int64)
                sig = np.zeros((b - a, HASHES * BITS // 8), np.uint8)
                if len(some):
                    starts = offsets[some]
                    c1[some] = np.add.reduceat(mix(sets, 41), starts).view(np.int64)
                    c2[some] = np.add.reduceat(mix(sets, 42), starts).view(np.int64)
                    least = minima(sets, np.append(starts, len(sets)))
                    sig[some] = packed(least)
                    keys = np.zeros((len(some), BANDS), U64)
                    for r in range(ROWS):
                        keys = mix(keys ^ least[:, r::ROWS].astype(U64), 50 + r)
                    bands[some] = (keys ^ mix(np.arange(BANDS, dtype=U64), 60)[None]).view(np.int64)
                ends = pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(n.astype(np.int64)), pa.array(c1), pa.array(c2),
                     pa.ListArray.from_arrays(ends, pa.array(bands.reshape(-1))), binary_rows(sig)],
                    ["key", "n", "c1", "c2", "bands", "sig"],
                )

    return docs.mapInArrow(sign, "key long, n long, c1 long, c2 long, bands array<long>, sig binary")


def candidate_edges(reps: DataFrame, percent: int, hot: int = HOT) -> DataFrame:
    """a, b of documents that share a band key and may reach the threshold by their estimate.

    For a key held by more than hot documents: each with the smallest of them, unestimated.
    """
    banded = reps.filter("n > 0").select(F.explode("bands").alias("band"), "key")
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("least"))
    shared = materialise(shared.filter("size > 1"))
    members = materialise(banded.join(shared, "band"))
    few = members.filter(F.col("size") <= hot).join(reps.select("key", "sig"), "key").select("band", "key", "sig")
    least = lowest_estimate(percent)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in whole_groups(batches, ["band"]):
            band, key = (t.column(c).to_numpy() for c in ("band", "key"))
            sig = matrix(t.column("sig"), HASHES * BITS // 8)
            for lag in range(1, hot):
                at = np.flatnonzero(band[lag:] == band[:-lag])
                if not len(at):
                    break
                at = at[estimate(sig[at], sig[at + lag]) >= least]
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(key[at + lag])], ["a", "b"])

    # Groups are bounded by hot; what shares a task is up to the number of shuffle partitions.
    near = few.repartition("band").sortWithinPartitions("band", "key").mapInArrow(pairs, "a long, b long")
    star = members.filter(F.col("size") > hot).select(F.col("least").alias("a"), F.col("key").alias("b"))
    return near.union(star)


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small; it should be a written table."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _forest(
    sets: list[np.ndarray], sig: np.ndarray, percent: int, least: float, joined: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Links of a spanning forest of the documents of a block: places in sets. Those that joined marks are connected already."""
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[number] > 1
    number, row = number[shared], row[shared]
    # Shingles that no other document here has are in no intersection.
    held = np.bincount(row, minlength=len(sets))
    ends = np.searchsorted(row, np.arange(len(sets) + 1))
    order = np.argsort(-held / size, kind="stable")
    order = order[100 * held[order] >= percent * size[order]]
    group, mark, links = np.arange(len(sets)), np.zeros(len(times), bool), []
    if joined is not None and joined.any():
        group[joined] = np.flatnonzero(joined)[0]
    for i, u in enumerate(order):
        v = order[i + 1 :]
        most = np.minimum(held[u], held[v])
        v = v[(group[v] != group[u]) & (100 * most >= percent * (size[u] + size[v] - most))]
        if not len(v):
            continue
        v = v[estimate(sig[u][None], sig[v]) >= least]
        if not len(v):
            continue
        mine = number[ends[u] : ends[u + 1]]
        mark[mine] = True
        lengths = held[v]
        flat = np.repeat(ends[v] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        common = np.add.reduceat(mark[number[flat]].astype(np.int64), np.cumsum(lengths) - lengths)
        mark[mine] = False
        for w in v[100 * common >= percent * (size[u] + size[v] - common)]:
            if group[w] != group[u]:
                links.append((int(u), int(w)))
                group[group == group[w]] = group[u]
    return links


def _star(sets: list[np.ndarray], centre: int, percent: int) -> list[tuple[int, int]]:
    """Links of one document with the others."""
    mine, links = sets[centre], []
    for w, other in enumerate(sets):
        if w != centre:
            common = len(np.intersect1d(mine, other, assume_unique=True))
            if 100 * common >= percent * (len(mine) + len(other) - common):
                links.append((centre, w))
    return links


def _with_sets(docs: DataFrame, dealt: DataFrame) -> DataFrame:
    """dealt (key, ..) with the shingle set of each key's text as bytes; docs: key, text."""
    columns = [c for c in dealt.columns if c != "key"]

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sets, offsets in _sets(batch):
                ends = pa.py_buffer((offsets * 8).astype(np.int32))
                binary = pa.Array.from_buffers(pa.binary(), b - a, [None, ends, pa.py_buffer(np.ascontiguousarray(sets))])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], binary], [*part.schema.names[1:], "set"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.select("key", *columns).schema)
    return docs.join(_few(dealt), "key").select("text", "key", *columns).mapInArrow(sets_of, f"{shape}, set binary")


def _confirm(met: DataFrame, percent: int) -> DataFrame:
    """a, b: links inside each group (component, i, j) of met (.., role, key, sig, set).

    role: 0 for any; 1 for those known to be connected with each other; 2 for a centre, which alone is compared.
    """
    by, least = ["component", "i", "j"], lowest_estimate(percent)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, by):
            key, role, raw = t.column("key").to_numpy(), t.column("role").to_numpy(), t.column("set")
            sig = matrix(t.column("sig"), HASHES * BITS // 8)
            found = []
            for a, b in zip(starts, starts[1:], strict=False):
                if b - a > 1:
                    group = [np.frombuffer(raw[k].as_buffer(), np.uint64) for k in range(a, b)]
                    centre = np.flatnonzero(role[a:b] == 2)
                    if len(centre):
                        links = [e for c in centre for e in _star(group, int(c), percent)]
                    else:
                        links = _forest(group, sig[a:b], percent, least, role[a:b] == 1)
                    found += [(key[a + u], key[a + w]) for u, w in links]
            columns = zip(*found) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    rows = met.select(*by, "role", "key", "sig", "set").repartition(*by).sortWithinPartitions(*by)
    return rows.mapInArrow(confirm, "a long, b long")


def confirmed_links(docs: DataFrame, families: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """a, b: links between the documents of a family that connect all that links connect.

    docs: key, text; families: node, component, n, sig. A family of one block meets as a whole. In a larger one, all
    documents are compared with its least, in small parts; those linked with it are the core, which copies mostly are.
    Of the rest, blocks meet each other and the core's blocks.
    """
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    lead = F.max(F.when(F.col("node") == F.col("component"), F.col("n") * 8)).alias("lead")
    size = families.groupBy("component").agg((F.sum("n") * 8).alias("bytes"), F.count(F.lit(1)).alias("docs"), lead)

    def parts(size_: int, docs_: int) -> Column:
        return F.greatest(F.ceil(F.col("bytes") / size_), F.ceil(F.col("docs") / docs_), F.lit(1)).cast("int")

    large = parts(block, BLOCK_DOCS) > 1
    # The least document goes to each part: copies of a long one shall not outweigh the family.
    small = F.least(parts(block // STAR, BLOCK_DOCS // STAR), F.ceil(F.col("bytes") / F.col("lead")).cast("int"))
    size = materialise(size.select("component", large.alias("large"), F.when(large, small).otherwise(1).alias("parts")))
    dealt = families.join(size, "component").withColumnRenamed("node", "key")
    dealt = dealt.withColumn("centre", F.col("large") & (F.col("key") == F.col("component")))
    dealt = materialise(dealt.select("key", "component", "n", "sig", "large", "parts", "centre"))
    sets = _with_sets(docs, dealt.select("key", "component", "sig", "large", "parts", "centre"))
    own = F.array(F.pmod(F.xxhash64("key"), "parts").cast("int"))
    at = F.when(F.col("centre"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)
    met = sets.withColumn("i", F.explode(at)).withColumn("j", F.when(F.col("large"), -1).otherwise(0))
    links = materialise(_confirm(met.withColumn("role", F.when(F.col("centre"), 2).otherwise(0)), percent))

    core = links.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    rest = dealt.filter("large").join(_few(materialise(core)).withColumn("core", F.lit(True)), "key", "left")
    rest = rest.select("key", "component", "n", "sig", F.coalesce("core", "centre").alias("core"))
    size = rest.groupBy("component", "core").agg((F.sum("n") * 8).alias("bytes"), F.count(F.lit(1)).alias("docs"))
    size = size.select("component", "core", "docs", parts(block, BLOCK_DOCS).alias("parts")).groupBy("component").agg(
        *[F.sum(F.when(of, F.col(c))).alias(name) for c, of, name in (
            ("parts", ~F.col("core"), "parts"), ("parts", F.col("core"), "cores"), ("docs", ~F.col("core"), "few"), ("docs", F.col("core"), "many"))]
    ).filter("parts IS NOT NULL")  # families all in their core are done
    # A few others meet a large core in smaller parts, so long as they are not repeated more often than the core is large.
    finer = F.least(F.ceil(F.col("many") / (BLOCK_DOCS // STAR)), F.floor(F.col("many") / F.col("few")))
    size = materialise(size.select("component", "parts", F.greatest("cores", finer.cast("long")).alias("cores")))
    if size.isEmpty():
        return links
    rest = rest.join(size, "component").withColumn("block", F.pmod(F.xxhash64("key"), F.when(F.col("core"), F.col("cores")).otherwise(F.col("parts"))).cast("int"))
    rest = materialise(rest.withColumn("parts", F.col("parts").cast("int")).withColumn("cores", F.coalesce("cores", F.lit(0)).cast("int")))
    sets = _with_sets(docs, rest.select("key", "component", "sig", "core", "block", "parts", "cores"))
    # Of the rest, block i meets block j as (i, j), i < j, or itself where it is the only one; core block j as (i, -1 - j).
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("block")))
    cores = F.when(F.col("cores") > 0, F.transform(F.sequence(F.lit(1), F.col("cores")), lambda j: -j)).otherwise(F.array().cast("array<int>"))
    outer = sets.filter("NOT core").withColumn("other", F.explode(F.concat(others, cores)))
    outer = outer.withColumn("i", F.when(F.col("other") < 0, F.col("block")).otherwise(F.least("block", "other")))
    outer = outer.withColumn("j", F.when(F.col("other") < 0, F.col("other")).otherwise(F.greatest("block", "other")))
    inner = sets.filter("core").withColumn("i", every).withColumn("j", -1 - F.col("block"))
    met = outer.withColumn("role", F.lit(0)).select("component", "i", "j", "role", "key", "sig", "set")
    met = met.unionByName(inner.withColumn("role", F.lit(1)).select(*met.columns))
    return links.union(_confirm(met, percent))


def near_duplicates(df: DataFrame, key: str, text: str, percent: int = 80, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """key, n_shingles, component_id, kept for each row: |A & B| / |A | B| >= percent / 100 links A and B."""
    docs = df.select(integer_key(df, key).alias("key"), F.col(text).alias("text"))
    signed = materialise(signatures(docs))
    able = signed.filter("key IS NOT NULL AND n > 0")
    classes = materialise(able.groupBy("n", "c1", "c2").agg(F.min("key").alias("rep")))
    reps = able.join(classes.withColumnRenamed("rep", "key"), ["key", "n", "c1", "c2"], "left_semi")
    # A key that is repeated with the same text is one document.
    reps = materialise(reps.dropDuplicates(["key", "n", "c1", "c2"]))
    families = components(candidate_edges(reps, percent, hot))
    families = materialise(families.join(reps.select(F.col("key").alias("node"), "n", "sig"), "node"))
    # Texts of a key are found by its sets' hashes, as a key may have several.
    by_key = able.groupBy("key").agg(F.min("c1").alias("low"), F.max("c1").alias("high"), F.min("c2").alias("low2"), F.max("c2").alias("high2"))
    several = _few(materialise(by_key.filter("low < high OR low2 < high2").select("key")))
    twins = able.join(several, "key", "left_semi").join(classes, ["n", "c1", "c2"]).select("key", "rep")
    twins = twins.join(twins.groupBy("key").agg(F.min("rep").alias("least")), "key").select(F.col("least").alias("a"), F.col("rep").alias("b"))
    links = components(confirmed_links(docs, families, percent, block).union(twins))
    lead = classes.join(links.withColumnRenamed("node", "rep"), "rep", "left")
    lead = materialise(lead.select("n", "c1", "c2", F.coalesce("component", "rep").alias("component_id")))
    found = signed.select("key", "n", "c1", "c2").join(lead, ["n", "c1", "c2"], "left")
    own = F.when(F.col("key").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("key")))
    found = found.select("key", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)))


def op3(documents: DataFrame) -> DataFrame:
    """Components of documents that are similar by 85 % or more."""
    return near_duplicates(documents, "doc_id", "text", percent=85).withColumnRenamed("key", "doc_id")
