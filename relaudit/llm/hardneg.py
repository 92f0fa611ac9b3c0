"""Hard-negative mining by coordinate pruning over length buckets, after LEMP (Teflioudi, Gemulla, Mykytiuk, 2015).

Vectors lie in buckets of like length. A bucket keeps, for each coordinate, its vectors sorted by that component of
their directions. An anchor that must reach a score needs a least cosine in a bucket, and so only values within a
range in each coordinate; the ranges of its largest coordinates, its focus, are cut out of the sorted lists, and only
vectors in all of them are verified by exact whole-number products. A bucket that is too short for an anchor's least
score is skipped. Nothing is lost: ranges are widened by more than rounding can do.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged
from .quantised import SCALE, floored, matrix, products

POSITIVES, NEGATIVES = 5, 3
#: A negative's score as hundredths of its positive's, at least and at most.
LOW, HIGH = 50, 95
#: Lengths in a bucket differ by this factor at most; vectors of a bucket; anchors that meet it in one task.
RATIO, BLOCK, CHUNK = 1.1, 16_384, 4_096
#: Coordinates whose ranges are intersected, and anchors whose scores are held at a time.
FOCUS, TOGETHER = 6, 256
#: Vectors that first bounds come from. A bound is a score that enough of them reach, so it holds for the whole table.
SEEDS = 4_096
#: Radians by which ranges are widened: an arc cosine near 1 is right to 2e-8.
WIDER = 1e-6
#: Rows about length classes that are sent to every task; beyond, they are joined by a shuffle.
FEW = 100_000
ANY = 2**62


def _bucket(key, f: pd.DataFrame) -> pd.DataFrame:
    """One row: ids, labels, components, and for each coordinate the places of vectors by falling share of the length."""
    f = f.sort_values("vec_id")
    g = matrix(f["g"], int(key[0]))
    length = np.sqrt((g.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(g / np.maximum(length, 1.0)[:, None], axis=0, kind="stable").T
    small = np.uint16 if len(f) <= 2**16 else np.uint32
    return pd.DataFrame({
        "bucket": [":".join(map(str, key))], "d": [int(key[0])], "n": [len(f)], "longest": [float(length.max())],
        "ids": [f["vec_id"].to_numpy(np.int64).tobytes()], "labels": [f["label"].to_numpy(np.int64).tobytes()],
        "comp": [g.tobytes()], "places": [np.ascontiguousarray(order, dtype=small).tobytes()],
    })


def index(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each bucket of ``rows(vec_id, label, g)``: vectors of one size and like length, dealt by hash of the id
    into as many buckets of about ``block`` as there is need for."""
    length = F.sqrt(F.aggregate("g", F.lit(0.0), lambda t, x: t + x.cast("double") * x))
    placed = rows.select("vec_id", "label", "g", F.size("g").alias("d"), F.floor(F.log(F.greatest(length, F.lit(1.0))) / math.log(RATIO)).cast("int").alias("like"))
    classes = staged(placed.groupBy("d", "like").agg(F.ceil(F.count("*") / block).cast("int").alias("shares")), "length-classes")
    told = F.broadcast(classes) if classes.count() <= FEW else classes
    placed = placed.join(told, ["d", "like"]).withColumn("share", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("shares")).cast("int"))
    schema = "bucket string, d int, n int, longest double, ids binary, labels binary, comp binary, places binary"
    return staged(placed.select("vec_id", "label", "g", "d", "like", "share").groupBy("d", "like", "share").applyInPandas(_bucket, schema), "buckets")


class Bucket:
    """A bucket's row, unpacked."""

    def __init__(self, row) -> None:
        self.n, self.longest = int(row.n), float(row.longest)
        self.ids, self.labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
        self.g = np.frombuffer(row.comp, np.int32).reshape(self.n, int(row.d))
        small = np.uint16 if self.n <= 2**16 else np.uint32
        self.order = np.frombuffer(row.places, small).reshape(int(row.d), self.n)
        length = np.maximum(np.sqrt((self.g.astype(np.float64) ** 2).sum(axis=1)), 1.0)
        self.line = np.stack([self.g[o, c] / length[o] for c, o in enumerate(self.order)]) if row.d else np.zeros((0, self.n))
        self.verified = 0

    def candidates(self, q: np.ndarray, least: np.ndarray) -> list[np.ndarray | None]:
        """For each anchor the places whose focus coordinates are all feasible; None where no coordinate rules any out.

        A score of ``least`` needs the cosine least / (length of q * longest). With a = arccos(q_f) and t the arccos of
        that cosine, a direction reaches it only if its component f lies between cos(a + t) and cos(a - t).
        """
        length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = least / (length * self.longest)
        bound = (least > 0) & (length * self.longest > 0)
        never = (least > 0) & (~bound | (cosine > 1 + 1e-9))
        turn = np.arccos(np.clip(np.where(bound, cosine, -1.0), -1.0, 1.0)) + WIDER
        unit = np.clip(q / np.maximum(length, 1.0)[:, None], -1.0, 1.0)
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        low, high = np.zeros(focus.shape, dtype=np.int64), np.full(focus.shape, self.n)
        for c in np.unique(focus):
            i, k = np.nonzero((focus == c) & bound[:, None])
            angle = np.arccos(unit[i, c])
            low[i, k] = np.searchsorted(self.line[c], np.cos(np.minimum(angle + turn[i], np.pi)) - WIDER, side="left")
            high[i, k] = np.searchsorted(self.line[c], np.cos(np.maximum(angle - turn[i], 0.0)) + WIDER, side="right")
        out: list[np.ndarray | None] = []
        for i in range(len(q)):
            ruling = np.flatnonzero(high[i] - low[i] < self.n)
            if never[i]:
                out.append(np.zeros(0, dtype=np.int64))
            elif not len(ruling):
                out.append(None)
            else:
                lists = [self.order[focus[i, k], low[i, k] : high[i, k]] for k in ruling]
                out.append(np.flatnonzero(np.bincount(np.concatenate(lists), minlength=self.n) == len(lists)))
        return out

    def search(self, asks: pd.DataFrame) -> pd.DataFrame:
        """Of each anchor and window the best vectors with a score in the window, by exact products."""
        out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for at in range(0, len(asks), TOGETHER):
            some = asks.iloc[at : at + TOGETHER]
            q = matrix(some["g"], self.g.shape[1])
            least = np.array([min(w[1] for w in ws) for ws in some["windows"]], dtype=np.float64)
            found = self.candidates(q, least)
            whole = np.array([i for i, c in enumerate(found) if c is None], dtype=np.int64)
            scores = dict(zip(whole.tolist(), products(q[whole], self.g), strict=True)) if len(whole) else {}
            for i, a in enumerate(some.itertuples(index=False)):
                places = np.arange(self.n) if found[i] is None else found[i]
                s = scores[i] if found[i] is None else products(q[i : i + 1], self.g[places])[0]
                self.verified += len(places)
                fits = (self.labels[places] == a.label) == a.same
                fits &= (self.ids[places] != a.anchor_id) & (s >= least[i])
                ids, s = self.ids[places[fits]], s[fits]
                for w in a.windows:
                    inside = np.flatnonzero((s >= w[1]) & (s <= w[2]))
                    first = inside[np.lexsort((ids[inside], -s[inside]))[: a.k]]
                    if len(first):
                        out.append((a.anchor_id, w[0], ids[first], s[first]))
        n = [len(o[2]) for o in out]
        joined = lambda k: np.concatenate([o[k] for o in out]) if out else np.zeros(0, dtype=np.int64)
        return pd.DataFrame({"anchor_id": np.repeat([o[0] for o in out], n).astype(np.int64), "of": np.repeat([o[1] for o in out], n).astype(np.int64), "vec_id": joined(2), "score": joined(3)})


#: An anchor asks in windows: what a window is for, the least and the greatest score.
ASKS = "anchor_id long, label long, g array<int>, same boolean, k int, windows array<array<long>>"


def _raised(asks: DataFrame, seeds: pd.DataFrame) -> DataFrame:
    """``asks`` with the low end of each window at the score that its ``k`` best of the seeds reach, if these are enough."""
    sizes = seeds["g"].map(len)
    by_size = {int(d): (matrix(seeds["g"][sizes == d], int(d)), seeds["vec_id"][sizes == d].to_numpy(), seeds["label"][sizes == d].to_numpy()) for d in sizes.unique()}

    def run(frames):
        for f in frames:
            for d, part in f.groupby(f["g"].map(len)):
                g, ids, labels = by_size.get(d, (np.zeros((0, d), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)))
                for at in range(0, len(part), TOGETHER):
                    some = part.iloc[at : at + TOGETHER].copy()
                    scores = products(matrix(some["g"], d), g)
                    raised = []
                    for a, s in zip(some.itertuples(index=False), scores, strict=True):
                        s = s[((labels == a.label) == a.same) & (ids != a.anchor_id)]
                        windows = []
                        for w in a.windows:
                            inside = s[(s >= w[1]) & (s <= w[2])]
                            low = int(np.partition(inside, len(inside) - a.k)[len(inside) - a.k]) if len(inside) >= a.k else w[1]
                            windows.append([w[0], low, w[2]])
                        raised.append(windows)
                    some["windows"] = raised
                    yield some

    return asks.mapInPandas(run, ASKS)


def best(asks: DataFrame, buckets: DataFrame, seeds: pd.DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(anchor_id, of, rank, vec_id, score)``: for each anchor and window its ``k`` best rows of the same label, or of
    different ones, with scores from ``low`` to ``high``.

    Anchors meet only buckets of their size that are long enough for the least score that a chunk of them asks for. A
    task holds one bucket and one chunk.
    """
    n = -(-asks.count() // chunk) or 1
    length = F.sqrt(F.aggregate("g", F.lit(0.0), lambda t, x: t + x.cast("double") * x))
    low = F.array_min(F.transform("windows", lambda w: w[1]))
    asks = _raised(asks, seeds).withColumns({"d": F.size("g"), "chunk": F.pmod(F.xxhash64("anchor_id", F.lit(9)), F.lit(n)).cast("int")})
    asks = staged(asks.withColumn("need", F.when(low > 0, low / F.greatest(length, F.lit(1.0))).otherwise(F.lit(0.0))), "asks")
    chunks = asks.groupBy("d", "chunk").agg(F.min("need").alias("need"))
    about = buckets.select("bucket", "d", "longest")
    pairs = staged(chunks.join(about, "d").where(F.col("need") * (1 - 1e-9) <= F.col("longest")).select("d", "chunk", "bucket"), "meetings")
    left = asks.drop("need").join(pairs, ["d", "chunk"]).drop("d")
    right = buckets.join(pairs.drop("d"), "bucket")

    def run(f: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return Bucket(b.iloc[0]).search(f) if len(f) and len(b) else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("anchor_id", "of", "vec_id", "score")})

    found = left.groupBy("bucket", "chunk").cogroup(right.groupBy("bucket", "chunk")).applyInPandas(run, "anchor_id long, of long, vec_id long, score long")
    k = asks.select("k").limit(1).collect()
    order = Window.partitionBy("anchor_id", "of").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (k[0].k if k else 0))


def percent(score: Column, hundredths: int, up: bool) -> Column:
    """``hundredths`` of a whole number, rounded up or down to a whole number without leaving whole numbers."""
    x = score * F.lit(-hundredths if up else hundredths)
    down = F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))
    return -down if up else down


def mine(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, vec_id: str = "vec_id", column: str = "embedding", label: str = "label", scale: int = SCALE, block: int = BLOCK, chunk: int = CHUNK, seeds: int = SEEDS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components are floor(scale * x), scores whole-number inner products with the anchor, ties go to the smaller id.
    ``anchors`` is a condition on ``vec_id``. An anchor's positives are its best ``positives`` other rows of its label
    (all, if fewer), whatever their scores; of each the best ``negatives`` rows of other labels with ``low`` to
    ``high`` hundredths of the positive's score are returned, none where there are none (as for a positive below 0).
    Rows with a null id, label or vector, or null or non-finite components, take no part; vectors of different sizes
    are no pair; a repeated id counts once, with its greatest vector and then label; labels are whole numbers; other
    columns are ignored; an empty table gives an empty table.
    """
    good = floored(vectors, vec_id, column, scale, label=F.col(f"`{label}`").cast("long")).where("vec_id is not null and label is not null")
    rows = staged(good.groupBy("vec_id").agg(F.max(F.struct("g", "label")).alias("r")).select("vec_id", "r.label", "r.g"), "mining")
    buckets = index(rows, block)
    some = rows.orderBy(F.xxhash64("vec_id", F.lit(13)), "vec_id").limit(seeds).toPandas()
    own = rows.where(anchors).select(F.col("vec_id").alias("anchor_id"), "label", "g")
    window = lambda of, a, b: F.array(of.cast("long"), a.cast("long"), b.cast("long"))
    everything = F.array(window(F.lit(0), F.lit(-ANY), F.lit(ANY)))
    ask = own.withColumns({"same": F.lit(True), "k": F.lit(positives), "windows": everything})
    near = best(ask, buckets, some, chunk).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = staged(near, "positives")
    between = near.select("anchor_id", window(F.col("positive_id"), percent(F.col("positive_score"), low, True), percent(F.col("positive_score"), high, False)).alias("w"))
    windows = between.where(F.col("w")[1] <= F.col("w")[2]).groupBy("anchor_id").agg(F.collect_list("w").alias("windows"))  # ``positives`` at most
    ask = own.join(windows, "anchor_id").select("anchor_id", "label", "g", F.lit(False).alias("same"), F.lit(negatives).alias("k"), "windows")
    hard = best(ask, buckets, some, chunk).withColumnsRenamed({"of": "positive_id", "vec_id": "negative_id", "score": "negative_score"})
    return hard.join(near, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
