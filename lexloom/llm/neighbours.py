"""Nearest neighbours by collision counting.

Vectors are projected on random lines; for each line the projections are kept in a sorted array. A query looks at a window
around its own projection on every line. The windows widen step by step (virtual rehashing: no array is built anew), and a
vector that lies in the windows of enough lines is verified: its exact distance is computed. A query ends once its k-th
distance is no more than the windows' radius.

The arrays are built once, in blocks of bounded size: vectors lie by their nearest pivot, in cells, and a large cell is
dealt into blocks. A bounded sample gives the pivots, and each query an upper bound of its k-th distance, at which its
windows stop widening. A query goes only to cells that can hold a nearer vector: those whose pivot is no farther than the
cell's own radius and that bound together. So a vector is a row once, and a query once for each block that it reaches; a
block streams its queries past its arrays, and the k nearest of all blocks are merged.

Every vector is indexed; the sample (``SAMPLE`` vectors at most, those of the smallest hashes) only decides where the
blocks lie and where windows may stop.

Defined cases: vectors that are null, zero, or hold a null or a number that is not finite take no part; only vectors of
equal length are compared; rows with the query's own id are not candidates; rows that repeat another id are candidates
each, and rows that repeat a query's id are one query whose nearest come from all of them; ties go to the smaller id; a
query with fewer candidates than k returns all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LINES = 64
#: A window's half-width for radius 1, in standard deviations of a projected distance; a vector within the radius is in a window with probability 0.83.
WIDTH = 1.3595
#: Lines on which a vector must collide to be verified.
THRESHOLD = 42
#: Each widening multiplies the radius by STEP; so many radii, up to the query's bound.
STEP, RADII = 1.3, 8
#: Vectors of a block, vectors of the sample, pivots, queries that widen together.
BLOCK, SAMPLE, PIVOTS, TOGETHER = 4096, 2048, 256, 128
SEED = 20_240_601


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    gap = vectors - query
    return np.sqrt((gap * gap).sum(1))


class Block:
    """The index of one block: projections on every line, sorted, with the vectors' places."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.squares = ids, vectors, (vectors * vectors).sum(1)
        self.lines = np.random.default_rng(SEED).standard_normal((vectors.shape[1], LINES))
        values = np.ascontiguousarray((vectors @ self.lines).T)
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(values, self.order, 1)

    def search(self, queries: np.ndarray, owns: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(query's place, vector's place, distance) of the nearest found of each query, k at most, within its bound."""
        centre = queries @ self.lines
        size = np.sqrt((queries * queries).sum(1))
        whole = size + math.sqrt(self.squares.max())  # no vector is farther than this
        known = bounds < whole
        last = np.where(known, bounds, whole)
        radii = last[:, None] * STEP ** np.arange(1 - RADII, 1.0)
        reach = WIDTH * radii + 1e-9 * (1 + size[:, None])
        low, high = np.empty((LINES, len(queries), RADII), np.int64), np.empty((LINES, len(queries), RADII), np.int64)
        for j in range(LINES):
            low[j] = np.searchsorted(self.sorted[j], centre[:, j, None] - reach, "left")
            high[j] = np.searchsorted(self.sorted[j], centre[:, j, None] + reach, "right")
        out = []
        for q in range(len(queries)):
            places, gaps = self.widen(queries[q], owns[q], radii[q], low[:, q].T.tolist(), high[:, q].T.tolist(), bool(known[q]), k)
            out += zip([q] * len(places), places.tolist(), gaps.tolist(), strict=True)
        return out

    def widen(self, query: np.ndarray, own: int, radii: np.ndarray, low: list, high: list, known: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.ids)
        counts, done = np.zeros(n, np.int64), self.ids == own
        places, gaps = np.zeros(0, np.int64), np.zeros(0)
        square, before = float(query @ query), None
        for s in range(RADII):
            if before is None:
                entered = [self.order[j, a:b] for j, (a, b) in enumerate(zip(low[s], high[s], strict=True)) if a < b]
            else:
                entered = [self.order[j, a:b] for j in range(LINES) for a, b in ((low[s][j], low[before][j]), (high[before][j], high[s][j])) if a < b]
            before = s
            if entered:
                counts += np.bincount(np.concatenate(entered), minlength=n)
            enough = counts >= THRESHOLD
            if s == RADII - 1 and not known:  # no bound is known: the rest is verified
                enough[:] = True
            fresh = np.flatnonzero(enough & ~done)
            if len(fresh):
                done[fresh] = True
                # Far ones are told by the expanded square with room for its rounding, near ones by the measure itself.
                dots = (self.vectors @ query)[fresh] if 8 * len(fresh) > n else self.vectors[fresh] @ query
                rough, room = self.squares[fresh] - 2 * dots + square, 1e-9 * (self.squares[fresh] + square)
                most = gaps[-1] if len(gaps) >= k else math.inf
                if len(fresh) > k:
                    most = min(most, math.sqrt(max(0.0, float(np.partition(rough + room, k - 1)[k - 1]))))
                fresh = fresh[~(rough - room > most * most * (1 + 1e-9))]
                places, gaps = np.concatenate([places, fresh]), np.concatenate([gaps, distances(self.vectors[fresh], query)])
                keep = np.lexsort((self.ids[places], gaps))[:k]
                places, gaps = places[keep], gaps[keep]
            if len(gaps) >= k and gaps[-1] <= radii[s]:
                break
        return places, gaps


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v, dim) of the vectors that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False)))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Places of so many vectors of the sample, each as far as may be from those before."""
    places, near = [0], distances(sample, sample[0])
    while len(places) < count and near.max() > 0:
        places.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[places[-1]]))
    return np.array(places)


def assigned(base: DataFrame, shared) -> DataFrame:
    """(dim, cell, gap, id, v): the nearest pivot and its distance; cell -1 for lengths that the sample doesn't have."""

    def assign(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell, gap = np.full(len(dims), -1, np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                if dim in shared.value:
                    at = np.flatnonzero(dims == dim)
                    own, pivots = matrix(batch.column("v").take(pa.array(at))), shared.value[dim][2]
                    nearest = ((own * own).sum(1)[:, None] - 2 * own @ pivots.T + (pivots * pivots).sum(1)).argmin(1)
                    difference = own - pivots[nearest]
                    cell[at], gap[at] = nearest, np.sqrt((difference * difference).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("dim"), pa.array(cell), pa.array(gap), batch.column("id"), batch.column("v")], names=["dim", "cell", "gap", "id", "v"])

    return base.select("dim", "id", "v").mapInArrow(assign, "dim int, cell int, gap double, id long, v array<double>")


def aimed(queries: DataFrame, shared, radii: dict[tuple[int, int], float], k: int) -> DataFrame:
    """(dim, id, v, bound, cells): each query's upper bound of its k-th distance, from the sample, and the cells it may reach."""

    def aim(batches):
        for batch in batches:
            bounds, cells = [], []
            for dim, own, v in zip(batch.column("dim").to_pylist(), batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if dim not in shared.value:
                    bounds.append(math.inf)
                    cells.append([-1])
                    continue
                ids, sample, pivots = shared.value[dim]
                near = np.sort(distances(sample[ids != own], np.array(v)))
                bounds.append(float(near[k - 1]) if len(near) >= k else math.inf)
                far = distances(pivots, np.array(v))
                cells.append([c for c in range(len(pivots)) if (dim, c) in radii and far[c] - radii[dim, c] <= bounds[-1] + 1e-9 * (1 + far[c])])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("dim", "id", "v")), pa.array(bounds, pa.float64()), pa.array(cells, pa.list_(pa.int32()))], names=["dim", "id", "v", "bound", "cells"])

    return queries.select("dim", "id", "v").mapInArrow(aim, "dim int, id long, v array<double>, bound double, cells array<int>")


def search(vectors: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each id divisible by ``every`` its k nearest among all others."""
    base, sc = usable(vectors, key, column), vectors.sparkSession.sparkContext
    n = base.count()
    sample: dict[int, list] = {}
    for r in base.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(SAMPLE).collect():  # a bounded sample
        sample.setdefault(r["dim"], []).append((r["id"], r["v"]))
    fitted = {}
    for dim, some in sample.items():
        ids, own = np.array([x[0] for x in some]), np.array([x[1] for x in some])
        fitted[dim] = ids, own, own[pivots_of(own, max(1, min(PIVOTS, math.ceil(n / BLOCK)) * len(some) // SAMPLE))]
    shared = sc.broadcast(fitted)
    cells = common.written(assigned(base, shared), "assigned")
    sizes = common.written(cells.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"), F.max("gap").alias("radius")), "sizes")
    radii = {(r["dim"], r["cell"]): r["radius"] for r in sizes.where("cell >= 0").collect()}  # as many as pivots at most
    dealt = cells.join(sizes, ["dim", "cell"])
    stored = dealt.select("dim", "cell", F.pmod(F.monotonically_increasing_id(), F.col("blocks")).alias("block"), F.lit(0).alias("role"), "id", "v", F.lit(0.0).alias("bound"))
    asked = aimed(cells.where(F.col("id") % every == 0), shared, radii, k).withColumn("cell", F.explode("cells")).join(sizes, ["dim", "cell"])
    asked = asked.select("dim", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "id", "v", "bound")

    def meet(batches):
        held: list[pa.Table] = []
        block = at = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            start = common.group_starts(table, 4)
            for a, b in zip(start[:-1], start[1:], strict=True):
                part = table.slice(a, b - a)
                name, role = tuple(part.column(c)[0].as_py() for c in range(3)), part.column(3)[0].as_py()
                if name != at:
                    held, block, at = [], None, name
                if not role:
                    held.append(part)
                    continue
                if block is None and held:
                    whole = pa.concat_tables(held)
                    block = Block(whole.column("id").to_numpy(), matrix(whole.column("v")))
                if block is None:
                    continue
                for s in range(0, part.num_rows, TOGETHER):
                    some = part.slice(s, TOGETHER)
                    own = some.column("id").to_numpy()
                    found = block.search(matrix(some.column("v")), own, some.column("bound").to_numpy(), k)
                    q, place, gap = (np.array([x[c] for x in found]) for c in range(3)) if found else (np.zeros(0, np.int64),) * 3
                    yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(block.ids[place]), pa.array(gap, pa.float64())], names=["query_id", "id", "score"])

    names = ["dim", "cell", "block"]
    rows = stored.unionByName(asked).repartition(max(1, 2 * math.ceil(n / BLOCK)), *names).sortWithinPartitions(*names, "role")
    local = rows.mapInArrow(meet, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
