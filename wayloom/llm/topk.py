"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into segments; with each segment's mean m and deviation s and
its length L, the inner product of two vectors is at most the sum of
L * (m m' + s s') over the segments, and the squared distance at least the sum
of L * ((m - m')^2 + (s - s')^2): the one bound follows from the other with the
norms. Bounds go from coarse to fine; a pair that can't reach the query's
k-th best score so far is dropped, survivors get exact scores.

Queries and rows meet in a grid: rows are packed where they lie, packs are dealt
to lanes, queries to blocks, and one cell of the grid streams a lane's packs
past a block's queries. A cell keeps the k best of each query so far, so every
later pack is pruned by all packs before it, and gives k rows per query at its
end. Blocks are as large as a task can hold, since each of them reads all rows;
lanes are as many as there are tasks to fill. No pair of single rows is emitted.

Cases: vectors that are null or hold null or non-finite components take no
part, nor do those beyond doubles when multiplied; vectors of another length than the query's are no candidates; rows with
the query's own id are no candidates; of rows that repeat a query's id the
smallest vector asks; other repeated rows are candidates each; equal scores go
to the smaller id; components are floor(256 x); rows with components too large for exact doubles are
scored apart, in whole numbers, and scores beyond 64 bits are set to the nearest
64-bit value; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.llm.common import give_back, shuffle_partitions

#: Rows of a pack, queries that a cell holds, queries that meet a pack at once, rows that a lane has at least (each lane gets the queries).
ROWS_PER_PACK, QUERIES_PER_BLOCK, QUERIES_AT_ONCE, ROWS_PER_LANE = 4096, 16_384, 512, 1024
#: Segments of the two levels of bounds.
LEVELS = (4, 16)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows' features: sqrt(L) * mean and sqrt(L) * deviation of every segment; the product of two rows' features bounds theirs."""
    d = x.shape[1]
    cuts = np.linspace(0, d, min(segments, d) + 1).astype(int)
    size = np.diff(cuts).astype(float)
    total = np.add.reduceat(x, cuts[:-1], axis=1)
    square = np.add.reduceat(x * x, cuts[:-1], axis=1)
    mean = total / size
    return np.hstack([mean * np.sqrt(size), np.sqrt(np.maximum(square - size * mean * mean, 0))])


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of rows, set to the nearest 64-bit value."""
    whole = np.array([[int(c) for c in r] for r in q], object).reshape(q.shape) @ np.array([[int(c) for c in r] for r in x], object).reshape(x.shape).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best rows so far of every query of one length: (score, row id), best first."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        # Products of components within this bound add up exactly in doubles.
        self.bound = math.floor(math.sqrt(2**52 / q.shape[1]))
        self.huge = np.abs(q).max(1) > self.bound
        self.stats = [statistics(np.where(self.huge[:, None], 0, q), n) for n in LEVELS]
        self.score: list[np.ndarray] = [np.empty(0, np.int64) for _ in ids]
        self.row: list[np.ndarray] = [np.empty(0, np.int64) for _ in ids]

    def add(self, i: int, rows: np.ndarray, scores: np.ndarray) -> None:
        own = rows != self.ids[i]
        rows, scores = np.concatenate([self.row[i], rows[own]]), np.concatenate([self.score[i], scores[own]])
        best = np.lexsort((rows, -1 - scores))[: self.k]  # -1 - x is the order of -x and holds the least 64-bit value
        self.row[i], self.score[i] = rows[best], scores[best]

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        huge = np.abs(x).max(1) > self.bound
        if huge.any():
            for at in range(0, len(self.ids), QUERIES_AT_ONCE):
                for i, s in enumerate(exact_scores(self.q[at : at + QUERIES_AT_ONCE], x[huge]), at):
                    self.add(i, ids[huge], s)
            ids, x = ids[~huge], x[~huge]
        if not len(ids):
            return
        for i in np.flatnonzero(self.huge):
            self.add(i, ids, exact_scores(self.q[i : i + 1], x)[0])
        stats = [statistics(x, n) for n in LEVELS]
        usual = np.flatnonzero(~self.huge)
        for at in range(0, len(usual), QUERIES_AT_ONCE):
            self._meet(usual[at : at + QUERIES_AT_ONCE], ids, x, stats)

    def _meet(self, some: np.ndarray, ids: np.ndarray, x: np.ndarray, stats: list[np.ndarray]) -> None:
        q = self.q[some]
        slack = 1e-9 * max(float(np.abs(q).max()), 1.0) * max(float(np.abs(x).max()), 1.0) * q.shape[1] + 1e-6
        coarse = self.stats[0][some] @ stats[0].T + slack
        coarse[self.ids[some][:, None] == ids[None, :]] = -np.inf
        least = np.array([self.score[i][-1] if len(self.score[i]) == self.k else -np.inf for i in some], float)
        # A first threshold where none is there: exact scores of the rows with the best coarse bounds.
        m, new = min(4 * self.k, len(ids)), np.flatnonzero(np.isneginf(least))
        if m > self.k and len(new):
            first = np.argpartition(-coarse[new], m - 1, axis=1)[:, :m]
            score = np.einsum("qd,qmd->qm", q[new], x[first])
            score[np.isneginf(np.take_along_axis(coarse[new], first, 1))] = -np.inf
            least[new] = -np.sort(-score, axis=1)[:, self.k - 1]
        fine = self.stats[1][some]
        for j in np.flatnonzero((coarse >= least[:, None]).any(1)):
            alive = np.flatnonzero(coarse[j] >= max(least[j], np.finfo(float).min))
            alive = alive[stats[1][alive] @ fine[j] + slack >= least[j]]
            if len(alive):
                self.add(some[j], ids[alive], (x[alive] @ q[j]).astype(np.int64))

    def rows(self) -> pa.RecordBatch:
        n = [len(r) for r in self.row]
        return pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(self.ids, n), pa.int64()), "vec_id": pa.array(np.concatenate([*self.row, np.empty(0, np.int64)]), pa.int64()), "score": pa.array(np.concatenate([*self.score, np.empty(0, np.int64)]), pa.int64())})


def pack_vectors(df: DataFrame, rows_per_pack: int, block: Column | None = None) -> DataFrame:
    """(dim, ids, comps), and block if given: packs of usable vectors (k, v) of one length (and block), made where the rows lie."""
    src = df.select("k", "v", (F.lit(0) if block is None else block).alias("block"))

    def run(batches):
        held: dict[tuple[int, int], list] = {}

        def emit(key):
            ids, comps = zip(*held.pop(key))
            return pa.RecordBatch.from_pydict({"block": pa.array([key[0]], pa.int32()), "dim": pa.array([key[1]], pa.int32()), "ids": pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), "comps": pa.array([np.stack(comps).astype("<f8").tobytes()], pa.binary())})

        for batch in batches:
            for key, vec, b in zip(*(batch.column(c).to_pylist() for c in ("k", "v", "block"))):
                if key is None or not vec or None in vec:
                    continue
                x = np.floor(256.0 * np.asarray(vec, float))
                if not np.isfinite(x).all():
                    continue
                held.setdefault((b, len(x)), []).append((key, x))
                if len(held[b, len(x)]) >= rows_per_pack:
                    yield emit((b, len(x)))
        for kept in [*held]:
            yield emit(kept)

    out = src.mapInArrow(give_back(run), "block int, dim int, ids binary, comps binary")
    return out if block is not None else out.drop("block")


def top_inner_products(vectors: DataFrame, query_filter: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of every query. query_filter: SQL over the id, named k."""
    if k < 1:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    src = vectors.select(F.col(id_col).cast("long").alias("k"), F.col(vector_col).alias("v"))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    asks = src.where(query_filter).where(usable).groupBy("k").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asks.count() // QUERIES_PER_BLOCK))
    lanes = max(1, min(-(-2 * shuffle_partitions(vectors.sparkSession) // blocks), vectors.count() // ROWS_PER_LANE))
    lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    asked = pack_vectors(asks, ROWS_PER_PACK, F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    asked = asked.withColumns({"lane": lane, "kind": F.lit(0)})
    packs = pack_vectors(src, ROWS_PER_PACK).withColumns({"lane": F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "kind": F.lit(1)})
    cell = (F.col("block") * lanes + F.col("lane")).alias("cell")
    cells = packs.unionByName(asked).select(cell, "kind", "dim", "ids", "comps")

    def run(batches):
        at, best = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                cell, kind, dim, ids, comps = (batch.column(c)[i].as_py() for c in ("cell", "kind", "dim", "ids", "comps"))
                if cell != at:
                    for b in best.values():
                        yield b.rows()
                    at, best, held = cell, {}, {}
                ids, x = np.frombuffer(ids, "<i8"), np.frombuffer(comps, "<f8").reshape(-1, dim)
                if kind == 0:
                    held.setdefault(dim, []).append((ids, x))
                elif dim in held or dim in best:
                    if dim not in best:
                        best[dim] = Best(*map(np.concatenate, zip(*held.pop(dim))), k)
                    best[dim].meet(ids, x)
        for b in best.values():
            yield b.rows()

    # A cell's queries come before its packs; cells are dealt by their number.
    dealt = cells.repartition(lanes * blocks, "cell").sortWithinPartitions("cell", "kind")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    # Each task cuts its rows to k a query before they are shuffled (WindowGroupLimit).
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
