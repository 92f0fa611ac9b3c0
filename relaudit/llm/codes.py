"""Vector code compression: product codes whose nearest entries are found by a GNAT over each codebook.

A geometric near-neighbour access tree keeps, for every pair of split points, the range of distances from the one to all
entries assigned to the other. Distances from a query to the split points then rule out whole subtrees: strictly, so that
an entry as near as the best one survives, with ranges widened by more than the rounding of a square root. What is
compared in the end are whole numbers, and equal distances go to the lower index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .quantised import SCALE, floored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Split points of a node, and entries that are no longer split.
SPLITS, LEAF = 8, 4
#: Distances are widened by this share before they rule anything out: a square root is right to 2^-52.
SLACK = 1e-12
#: Distinct labels whose totals are sent to every task; beyond, they are joined by a shuffle.
FEW_LABELS = 100_000


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``, as whole numbers."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for c in range(a.shape[1]):
        gap = a[:, c, None] - b[None, :, c]
        out += gap * gap
    return out


class _Node:
    """``points`` are indexes of entries: all of a leaf, or the split points of an inner node with a child for each."""

    def __init__(self, entries: np.ndarray, members: np.ndarray) -> None:
        self.points, self.children = members, []
        if len(members) <= LEAF:
            return
        far = squared(entries[members], entries[members])
        picked = [0]  # then always the entry farthest from those picked
        while len(picked) < SPLITS and (least := far[picked].min(axis=0)).max() > 0:
            picked.append(int(least.argmax()))
        rest = np.setdiff1d(np.arange(len(members)), picked)
        if len(picked) < 2 or not len(rest):
            return
        self.points = members[picked]
        own = far[np.ix_(picked, rest)].argmin(axis=0)
        length = np.sqrt(far[picked].astype(np.float64))
        self.low, self.high = np.full((2, len(picked), len(picked)), np.nan)
        for j in range(len(picked)):
            domain = rest[own == j]
            self.children.append(_Node(entries, members[domain]) if len(domain) else None)
            if len(domain):
                self.low[:, j], self.high[:, j] = length[:, domain].min(axis=1), length[:, domain].max(axis=1)


class Gnat:
    """The tree over the entries of one codebook."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries.astype(np.int64)
        self.root = _Node(self.entries, np.arange(len(entries)))
        self.compared = 0

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the index of its nearest entry, the lowest if several are as near, and the squared distance."""
        queries = queries.astype(np.int64)
        best, index = np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), len(self.entries))
        self._visit(self.root, np.arange(len(queries)), queries, best, index)
        return index, best

    def _visit(self, node: _Node, rows: np.ndarray, queries: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if not len(rows):
            return
        d = squared(queries[rows], self.entries[node.points])
        self.compared += d.size
        near = d.min(axis=1)
        at = np.where(d == near[:, None], node.points[None, :], len(self.entries)).min(axis=1)
        better = (near < best[rows]) | ((near == best[rows]) & (at < index[rows]))
        best[rows[better]], index[rows[better]] = near[better], at[better]
        if not node.children:
            return
        own, length = d.argmin(axis=1), np.sqrt(d.astype(np.float64))
        for j, child in enumerate(node.children):  # each query's own domain first, which brings its radius down
            if child:
                self._visit(child, rows[own == j], queries, best, index)
        for j, child in enumerate(node.children):
            if child:
                radius = np.sqrt(best[rows].astype(np.float64))[:, None]
                slack = SLACK * (length + radius + node.high[:, j])
                out = (length - radius > node.high[:, j] + slack) | (length + radius < node.low[:, j] - slack)
                self._visit(child, rows[(own != j) & ~out.any(axis=1)], queries, best, index)


def parted(g: pd.Series, parts: int) -> np.ndarray:
    """Vectors of one length cut into ``parts`` equal parts, zeros added at the end where the length asks for it."""
    v = np.stack(g.to_numpy()).astype(np.int64)
    width = -(-v.shape[1] // parts)
    return np.pad(v, ((0, 0), (0, width * parts - v.shape[1]))).reshape(len(v), parts, width)


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def _trained(rows: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks after one round: each entry the floor of the mean of its parts. A task returns one sum for each entry."""
    parts, n, width = codebooks.shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = [Gnat(c) for c in codebooks]
        count, total = np.zeros((parts, n), dtype=np.int64), np.zeros((parts, n, width), dtype=np.int64)
        for f in frames:
            if len(f):
                v = parted(f["g"], parts)
                for p in range(parts):
                    at, _ = trees[p].nearest(v[:, p])
                    count[p] += np.bincount(at, minlength=n)
                    np.add.at(total[p], at, v[:, p])
        p, e = np.nonzero(count)
        out = pd.DataFrame({"part": p, "entry": e, "n": count[p, e]})
        yield out.assign(**{f"s{c}": total[p, e, c] for c in range(width)})

    sums = rows.select("g").mapInPandas(run, "part int, entry int, n long, " + ", ".join(f"s{c} long" for c in range(width)))
    new = codebooks.copy()
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{c}").alias(f"s{c}") for c in range(width)]).collect():
        new[r.part, r.entry] = [r[f"s{c}"] // r.n for c in range(width)]
    return new


def encode(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code, error)`` of every vector that takes part, and the codebooks (part, entry, component).

    Codebooks start as the parts of the vectors with the ``entries`` smallest ids (of all, if fewer; null ids come
    last, equal ids by vector) and are trained for ``rounds``. A code holds two hex digits for each part, three or more
    from 257 entries on. Vectors that are null or hold null or non-finite components are left out. A length that
    ``parts`` does not divide is filled with zeros. Vectors of another length than the first one's, and those of no
    components, get a null code and error. Repeated rows are coded each; an empty table gives an empty table.
    """
    rows = staged(floored(vectors, vec_id, column, scale, label=F.col(f"`{label}`")), "floored")
    known = rows.where(F.size("g") > 0)
    first = known.orderBy(F.asc_nulls_last("vec_id"), "g").limit(1).collect()
    size = len(first[0].g) if first else 0
    alike = rows.where(F.size("g") == size) if size else rows.limit(0)
    start = alike.orderBy(F.asc_nulls_last("vec_id"), "g").limit(entries).select("g").toPandas()
    codebooks = parted(start["g"], parts).transpose(1, 0, 2) if len(start) else np.zeros((parts, 0, 0), dtype=np.int64)
    for _ in range(rounds if size else 0):
        codebooks = _trained(alike, codebooks)
    digits = max(2, len(f"{entries - 1:x}"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = [Gnat(c) for c in codebooks]
        hexed = np.array([f"{i:0{digits}x}" for i in range(entries)], dtype=object)
        for f in frames:
            good = (f["g"].map(len) == size).to_numpy() & (size > 0)
            code, error = np.full(len(f), None, dtype=object), np.full(len(f), None, dtype=object)
            if good.any():
                v = parted(f["g"][good], parts)
                found = [trees[p].nearest(v[:, p]) for p in range(parts)]
                code[good] = sum((hexed[at] for at, _ in found[1:]), hexed[found[0][0]])
                error[good] = sum(d for _, d in found)
            yield f[["vec_id", "label"]].assign(code=code, error=pd.array(error, dtype="Int64"))

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInPandas(run, f"vec_id long, label {kind}, code string, error long"), codebooks


def coded(vectors: DataFrame, label: str = "label", **options) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``: :func:`encode` with the errors of equal labels summed,
    nulls together; a sum over no error is null."""
    rows, codebooks = encode(vectors, label=label, **options)
    rows = staged(rows, "codes")
    total = staged(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    told = F.broadcast(total) if total.count() <= FEW_LABELS else total
    out = rows.join(told, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
