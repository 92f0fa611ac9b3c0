"""Approximate nearest neighbours by collision-counting hashing.

Each projection is a hash of its own: a data block keeps its vectors sorted along it. A query opens a narrow window
centred on its own projection in every sorted array and widens all of them level by level (virtual rehashing); only what
a level adds is counted. A vector whose collisions reach the threshold is verified by the exact measure. A query ends
with the level whose radius holds its k best. A block is searched by ranges of norms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged
from .neardup import usable

SEED = 17
#: Projections at most; the radius of the first level, as a share of the vectors' length; how much a level widens it.
PROJECTIONS, START, RATIO = 40, 0.3, 1.12
#: Half a window in deviations of a projection at the radius, and the share of windows that a vector must lie in.
WIDTH, COLLISIONS = 1.36, 0.775
#: Within a range of norms of a block none is below this share of the largest.
NORM_RATIO = 0.8
#: Rows of a data block, queries that meet it in one task, and queries whose collisions are held at a time.
DATA_BLOCK, QUERY_BLOCK, TOGETHER = 16_384, 4_096, 256


def projections(d: int, seed: int = SEED) -> np.ndarray:
    """``d`` directions of a random orthonormal basis, as columns: together they lose nothing of a distance."""
    return np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))[0]


def lifted(v: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with one more component that brings each to length ``norm``.

    The largest inner product is then the least distance; a query gets 0 as its own.
    """
    return np.hstack([v, np.sqrt(np.maximum(norm**2 - (v**2).sum(axis=1), 0))[:, None]])


def norm_ranges(norms: np.ndarray) -> list[np.ndarray]:
    """Places of vectors by falling norm, parted where a norm falls below ``NORM_RATIO`` of the largest of its part."""
    order = np.argsort(-norms, kind="stable")
    falling, out, at = norms[order], [], 0
    while at < len(order):
        to = max(int(np.searchsorted(-falling, -NORM_RATIO * falling[at], side="right")), at + 1)
        out.append(order[at:to])
        at = to
    return out


class _Lines:
    """Vectors of like norm, sorted along each projection."""

    def __init__(self, data: np.ndarray, norm: float, seed: int) -> None:
        self.data, self.norm = data, norm
        self.base = projections(data.shape[1] + 1, seed)[:, :PROJECTIONS]
        self.middle = float(np.median(np.sqrt((data**2).sum(axis=1)))) / norm
        x = lifted(data / norm, 1.0) @ self.base
        order = np.argsort(x, axis=0, kind="stable")
        self.line = np.ascontiguousarray(np.take_along_axis(x, order, axis=0).T)
        self.order = np.ascontiguousarray(order.T)
        self.m, self.n = self.line.shape

    def search(self, queries: np.ndarray, found: list, k: int) -> int:
        """Let the queries' ``found``, each a :class:`_Best`, see every vector that reaches the threshold of collisions;
        returns how many entries of the arrays were counted."""
        length = np.maximum(np.sqrt((queries**2).sum(axis=1)), np.finfo(float).tiny)
        scale = self.middle / length  # a query as long as a vector: that leaves the order as it is
        q = np.hstack([queries * scale[:, None], np.zeros((len(queries), 1))]) @ self.base
        center = np.stack([np.searchsorted(self.line[j], q[:, j]) for j in range(self.m)], axis=1)
        lo, hi = center, center.copy()
        hits = np.zeros((len(queries), self.n), dtype=np.int16)
        threshold, radius, counted = max(1, round(COLLISIONS * self.m)), START, 0
        open_ = np.arange(len(queries))
        while len(open_):
            half = WIDTH * radius / np.sqrt(len(self.base))
            low = np.stack([np.searchsorted(self.line[j], q[open_, j] - half, side="left") for j in range(self.m)], axis=1)
            high = np.stack([np.searchsorted(self.line[j], q[open_, j] + half, side="right") for j in range(self.m)], axis=1)
            on = []
            for a, b, i in zip(low.tolist(), high.tolist(), open_.tolist(), strict=True):
                parts = [self.order[j, x:y] for j, (x, y) in enumerate(zip(a, lo[i].tolist(), strict=True))] + [self.order[j, x:y] for j, (x, y) in enumerate(zip(hi[i].tolist(), b, strict=True))]
                new = np.concatenate(parts)
                counted += len(new)
                was = hits[i]
                now = was + np.bincount(new, minlength=self.n).astype(np.int16)
                reached = np.flatnonzero((now >= threshold) & (was < threshold))
                hits[i] = now
                best = found[i]
                if len(reached):
                    best.see(reached, self.data[reached] @ queries[i])
                near = best.least() * scale[i] / self.norm
                if self.middle**2 + 1 - 2 * near > radius * radius and (now < threshold).any():
                    on.append(i)
            lo[open_], hi[open_] = low, high
            open_ = np.array(on, dtype=np.int64)
            radius *= RATIO
        return counted


class _Best:
    """The best vectors that a query has seen, itself left out, by inner product and then the smaller id."""

    def __init__(self, own: int, k: int) -> None:
        self.own, self.k = own, k
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0)
        self.part = self.ids  # ids of the range that is searched

    def see(self, places: np.ndarray, scores: np.ndarray) -> None:
        ids = self.part[places]
        other = ids != self.own
        ids, scores = np.concatenate([self.ids, ids[other]]), np.concatenate([self.scores, scores[other]])
        first = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[first], scores[first]

    def least(self) -> float:
        return float(self.scores[-1]) if len(self.scores) >= self.k else -np.inf


def search_block(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, seed: int = SEED):
    """(query place, data id, exact inner product) of the ``k`` best vectors that each query verifies in the block, and
    how many entries were counted.

    Vectors are searched by ranges of like norm, the largest first, so that a few long ones push no other out of the
    windows. A query is done once its ``k`` best exceed what its length and a range's norm allow.
    """
    if not len(data) or not len(queries):
        return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0), 0
    norms, lengths = np.sqrt((data**2).sum(axis=1)), np.sqrt((queries**2).sum(axis=1))
    found = [_Best(own, k) for own in query_ids.tolist()]
    counted = 0
    for places in norm_ranges(norms):
        norm = norms[places[0]]
        open_ = [i for i, b in enumerate(found) if b.least() <= lengths[i] * norm * (1 + 1e-9)]
        if not open_:
            break
        lines, ids = _Lines(data[places], norm, seed), data_ids[places]
        for at in range(0, len(open_), TOGETHER):
            some = open_[at : at + TOGETHER]
            for i in some:
                found[i].part = ids
            counted += lines.search(queries[some], [found[i] for i in some], k)
    return np.repeat(np.arange(len(queries)), [len(b.ids) for b in found]), np.concatenate([b.ids for b in found]), np.concatenate([b.scores for b in found]), counted


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", column: str = "embedding", data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK, seed: int = SEED) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its ``k`` nearest by inner product, itself left out.

    Both tables are dealt into blocks by hash of the id, and each block of queries meets each block of vectors in a
    task, so memory is bounded by the block sizes and a task returns at most ``k`` rows for each query. Ties go to the
    smaller id. Vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors whose
    length differs from a query's; a repeated id counts once, with its greatest vector; empty tables give an empty
    table.
    """
    one = lambda df: usable(df, vec_id, column).where("vec_id is not null").groupBy("vec_id").agg(F.max("v").alias("v"))
    data, asks = staged(one(vectors), "ann-data"), staged(one(queries), "ann-queries")
    n_data, n_asks = -(-data.count() // data_block) or 1, -(-asks.count() // query_block) or 1
    place = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asks.withColumn("a", place(n_asks)).withColumn("b", every(n_data)).withColumn("ask", F.lit(True))
    right = data.withColumn("b", place(n_data)).withColumn("a", every(n_asks)).withColumn("ask", F.lit(False))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        width = f["v"].map(len).to_numpy()
        for d in np.unique(width):
            g = f[width == d]
            ask = g["ask"].to_numpy()
            v = np.stack(g["v"].to_numpy()).astype(np.float64)
            ids = g["vec_id"].to_numpy()
            i, near, score, _ = search_block(v[ask], ids[ask], v[~ask], ids[~ask], k, seed)
            out.append(pd.DataFrame({"query_id": ids[ask][i], "vec_id": near, "score": score}))
        return pd.concat(out, ignore_index=True)

    found = left.select("a", "b", "ask", "vec_id", "v").union(right.select("a", "b", "ask", "vec_id", "v")).groupBy("a", "b").applyInPandas(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
