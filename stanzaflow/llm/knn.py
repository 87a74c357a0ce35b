"""Operator 10, exact top-k by inner product as a Voronoi join.

Vectors belong to the cell of their nearest pivot, and within it to a ring by their distance from the pivot. With u
the pivot's direction, x = a u + y with y at right angles to u, so that q.x = (q.u) a + q'.y, and by the summary of a ring
(its least and greatest a, its greatest |y|) no score in it exceeds max((q.u) a) + |q'| max |y|. A query's k-th best score
over a sample of the rows is sure to be reached. A query is replicated only to the cells of which some ring's upper end
reaches that; each cell, in blocks of bounded size, is solved locally, and the local top-k lists are merged. Bounds carry a
margin for rounding, so that the result is exact: scores are integer sums. On vectors without any structure in many
dimensions no such bound excludes a cell; then all data meet all queries, in blocks.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part, nor does a row
without an id; all others do, however large: rows with components from 2^53 on (scaled) form cells of their own, which
every query meets, and are summed in unbounded integers. The score column stops at 64 bits, the order does not. Vectors
of another length than the pivots' (the commonest length of the sample) form cells by length and meet only queries of that
length. Ties go to the smaller id; repeated rows are candidates each, queries once, and a query never meets rows of its
own id. An empty table gives no rows. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from stanzaflow.llm import dense
from stanzaflow.llm.dense import EXACT, Best, by_length
from stanzaflow.llm.scratch import integer_key, materialise

#: Rows that pivots and sure scores come from, and pivots; these only steer the cost.
SAMPLE, PIVOTS, RINGS = 2048, 48, 4
#: Data and queries that meet in one local solve, at most: some MB of vectors, and scores in slices (see dense).
DATA_BLOCK, QUERY_BLOCK = 8192, 2048
#: Components are multiplied by this and rounded down.
FACTOR = 1024


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (doubles) of the rows that take part."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    rows = df.filter(F.col(key).isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0))
    return rows.select(integer_key(df, key).alias("id"), F.col(vector).cast("array<double>").alias("v"))


def choose_pivots(rows: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """Centres of a sample: spread-out starts, then a few Lloyd steps. Any choice gives right results."""
    centres = [rows[0]]
    near = ((rows - centres[0]) ** 2).sum(1)
    while len(centres) < min(n, len(rows)) and near.max() > 0:
        centres.append(rows[int(near.argmax())])
        near = np.minimum(near, ((rows - centres[-1]) ** 2).sum(1))
    centres = np.array(centres)
    for _ in range(rounds):
        own = _nearest(rows, centres)[0]
        for c in range(len(centres)):
            if (mine := own == c).any():
                centres[c] = rows[mine].mean(0)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)[None]
    cell = far.argmin(1)
    return cell, np.sqrt(((rows - centres[cell]) ** 2).sum(1))


def floors(rows: np.ndarray) -> np.ndarray:
    return dense.floors(rows, FACTOR)


def products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    return dense.products(queries, data, FACTOR)


@dataclass
class Cells:
    """Pivots with the edges of their rings, the sample that they come from, and the cells' summaries once there are any."""

    dim: int
    centres: np.ndarray
    edges: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    rings: dict[int, list[Row]]

    @classmethod
    def of_sample(cls, picked: list[Row], pivots: int) -> Cells:
        tame = [r for r in picked if np.abs(floors(np.array(r.v))).max() < EXACT] or [Row(id=0, v=[0.0])]
        lengths = [len(r.v) for r in tame]
        dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
        mine = [r for r in tame if len(r.v) == dim] if picked else []
        rows = floors(np.array([r.v for r in mine], float).reshape(len(mine), dim))
        centres = choose_pivots(rows, pivots) if len(rows) else np.zeros((1, dim))
        cell, far = _nearest(rows, centres)
        shares = np.arange(1, RINGS) / RINGS
        edges = np.array([np.quantile(far[cell == c], shares) if (cell == c).any() else np.zeros(RINGS - 1) for c in range(len(centres))])
        return cls(dim, centres, edges, np.array([r.id for r in mine], np.int64), rows, {})

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, ring, a and |y| of vectors of one length."""
        n, scaled = rows.shape[1], floors(rows)
        cell, ring = np.full(len(rows), len(self.centres) + n, np.int32), np.zeros(len(rows), np.int32)
        along, across = np.zeros(len(rows)), np.full(len(rows), np.inf)
        tame = np.abs(scaled).max(1, initial=0) < EXACT
        cell[~tame] = -n
        own = np.flatnonzero(tame)
        if n == self.dim:
            cell[own], far = _nearest(scaled[own], self.centres)
            ring[own] = (far[:, None] > self.edges[cell[own]]).sum(1)
            along[own], across[own] = _split(scaled[own], _directions(self.centres)[cell[own]])
        else:
            across[own] = np.sqrt((scaled[own] ** 2).sum(1))
        return cell, ring, along, across

    def wanted(self, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries of one length, and cells that may hold one of their k best."""
        n, scaled = rows.shape[1], floors(rows)
        here = [c for c in self.rings if c == -n or c == len(self.centres) + n or (n == self.dim and 0 <= c < len(self.centres))]
        tame = np.abs(scaled).max(1, initial=0) < EXACT
        scaled = np.where(tame[:, None], scaled, 0.0)
        long = np.sqrt((scaled**2).sum(1))
        sure = np.full(len(rows), -np.inf)
        if n == self.dim and len(self.rows) >= k:
            score = scaled @ self.rows.T
            score[ids[:, None] == self.ids[None]] = -np.inf
            sure = np.partition(score, len(self.ids) - k, 1)[:, len(self.ids) - k]
            sure -= 1e-9 * (1 + long * np.sqrt((self.rows**2).sum(1)).max())
        which, where = [], []
        for c in here:
            most = np.full(len(rows), -np.inf)
            for ring in self.rings[c]:
                if c < 0:
                    most[:] = np.inf
                    continue
                u = _directions(self.centres)[[c]] if c < len(self.centres) else np.zeros((1, n))
                along, across = _split(scaled, u)
                high = np.maximum(along * ring.low, along * ring.high) + across * ring.across
                most = np.maximum(most, high + 1e-9 * (1 + long * (abs(ring.low) + abs(ring.high) + ring.across)))
            own = np.flatnonzero((most >= sure) | ~tame)
            which.append(own)
            where.append(np.full(len(own), c, np.int32))
        return np.concatenate([np.zeros(0, np.int64), *which]), np.concatenate([np.zeros(0, np.int32), *where])


def _directions(centres: np.ndarray) -> np.ndarray:
    long = np.sqrt((centres**2).sum(1, keepdims=True))
    return np.divide(centres, long, out=np.zeros_like(centres), where=long > 0)


def _split(rows: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its part along u and the length of the rest."""
    along = (rows * u).sum(1)
    return along, np.sqrt(((rows - along[:, None] * u) ** 2).sum(1))


def replicated(data: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """Rows of data with their cell; queries once for each cell that they need; rows of each cell. Rows: id, v."""
    cells = Cells.of_sample(data.orderBy(F.xxhash64("id", "v")).limit(sample).collect(), pivots)  # bounded by sample

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(batch.num_rows, t) for t in (np.int32, np.int32, float, float)]
            for own, rows in by_length(batch.column(1)):
                for column, found in zip(out, cells.place(rows), strict=True):
                    column[own] = found
            yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in out], *batch.columns], ["cell", "ring", "along", "across", "id", "v"])

    placed = materialise(data.mapInArrow(assign, "cell int, ring int, along double, across double, id long, v array<double>"))
    rings = placed.groupBy("cell", "ring").agg(
        F.count(F.lit(1)).alias("n"), F.min("along").alias("low"), F.max("along").alias("high"), F.max("across").alias("across")
    )
    sizes: dict[int, int] = {}
    for r in rings.orderBy("cell", "ring").collect():  # RINGS rows for each pivot, and two for each other length
        cells.rings.setdefault(r["cell"], []).append(r)
        sizes[r["cell"]] = sizes.get(r["cell"], 0) + r.n

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for own, rows in by_length(batch.column(1)):
                which, where = cells.wanted(ids[own], rows, k)
                at = pa.array(own[which])
                yield pa.RecordBatch.from_arrays([pa.array(where), batch.column(0).take(at), batch.column(1).take(at)], ["cell", "id", "v"])

    return placed.select("cell", "id", "v"), materialise(queries.mapInArrow(send, "cell int, id long, v array<double>")), sizes


def top_k(data: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, sample: int = SAMPLE,
          data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for queries and data of (id, v) as usable() makes them."""
    placed, sent, sizes = replicated(data, queries, k, pivots, sample)
    blocks = {c: -(-n // data_block) for c, n in sizes.items()}
    asked = {r["cell"]: -(-r["count"] // query_block) for r in sent.groupBy("cell").count().collect()}  # a row a cell
    if not asked:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def many(of: dict[int, int]) -> Column:
        return F.create_map(*[F.lit(x) for pair in of.items() for x in pair])[F.col("cell")].cast("long")

    def part(of: dict[int, int]) -> Column:
        return F.pmod(F.xxhash64("id", "v"), many(of))

    def every(of: dict[int, int]) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), many(of) - 1))

    # A block of data meets a block of queries; a cell that no query asks for goes nowhere.
    left = placed.filter(F.col("cell").isin(list(asked))).select("cell", part(blocks).alias("b"), every(asked).alias("a"), "id", "v")
    right = sent.select("cell", every(blocks).alias("b"), part(asked).alias("a"), "id", "v")

    def solve(key: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        best, asked = Best(len(theirs), k), theirs["id"].to_numpy()
        if len(mine) and len(theirs):
            ids, rows = mine["id"].to_numpy(), np.array(mine["v"].tolist(), float)
            for q, d, score in dense.score_blocks(np.array(theirs["v"].tolist(), float), rows, FACTOR):
                best.add(q, ids[d], score, asked[q][:, None] != ids[d][None])
        row, ids, score, wide = best.found()
        return pd.DataFrame({"query_id": asked[row], "vec_id": ids, "score": score, "wide": pd.Series(wide, dtype=object)})

    local = left.groupBy("cell", "b", "a").cogroup(right.groupBy("cell", "b", "a")).applyInPandas(
        solve, "query_id long, vec_id long, score long, wide binary"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("wide"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op10(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The k best of every other row for each vector whose vec_id is divisible by `every`."""
    data = usable(embeddings, "vec_id", "embedding")
    return top_k(data, data.filter(F.col("id") % every == 0).distinct(), k)
