"""Connected components of an edge table by contraction and alternating large-star and small-star rounds (Kiveris et al.,
2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage

#: Edges that a contraction task holds.
PART = 500_000


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the edges (a, b) connect it with."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a task as stars: each node with the least one that they connect it with."""
    edges = [f[["u", "v"]].to_numpy(dtype=np.int64) for f in frames]
    if edges and len(e := np.concatenate(edges)):
        ids, at = np.unique(e, return_inverse=True)
        at = at.reshape(e.shape)
        yield pd.DataFrame({"u": ids, "v": ids[spanning(len(ids), at[:, 0], at[:, 1])]})


def _hooked(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) beside the least neighbour of u, u itself included.

    ``u ^ 0`` hides that the aggregate is already dealt by u: both sides of the join are then plain shuffles, which
    AQE splits at a hub.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.expr("u ^ 0L").alias("u"), F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _starred(cur: DataFrame) -> DataFrame:
    """A large-star and a small-star round over edges (u, v) with u >= v."""
    both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _hooked(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.union(cur.where("u = v"))
    small = _hooked(large.where("u >= v"))
    return small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, part: int = PART, max_rounds: int = 60) -> DataFrame:
    """``edges(u long, v long)`` to ``(id long, component_id long)``: every endpoint with the smallest id it reaches.

    Self-loops count as a component of one; repeated and reversed edges are the same edge; rows with a null end are
    ignored; an empty table gives an empty table. In each round tasks contract ``part`` edges each, and star rounds
    join what lies in different tasks, until nothing changes; a last single task needs none. Each round is written to
    the shared folder, so lineage stays short.
    """
    cur, before = staged(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).dropna(), "cc"), None
    for _ in range(max_rounds):
        parts = max(1, -(-cur.count() // part))
        if parts == 1:
            stars = staged(cur.coalesce(1).mapInPandas(_contract, "u long, v long"), "cc")
            unstage(cur)
            return stars.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        stars = staged(cur.repartition(parts).mapInPandas(_contract, "u long, v long"), "cc")
        nxt = staged(_starred(stars), "cc")
        seen = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        unstage(cur)
        unstage(stars)
        cur = nxt
        if seen == before:
            ends = cur.groupBy("u").agg(F.min("v").alias("v"))
            return ends.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        before = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
