"""Packing token sequences as a cutting-stock problem, by column generation (Gilmore and Gomory, 1961).

Lengths up to the capacity make a histogram, and a few hundred classes of it the rows of a linear program. Its columns are
patterns, what one sequence may hold; a knapsack dynamic program prices them by the duals. Basic patterns are used as
often as the program says, rounded down, and documents take their places by rank. A sequence needs no padding at a power
of two, so a pattern aims at one, mostly the capacity. What it still lacks comes from donors, a share of the documents
picked by hash that are laid end to end and cut where a gap is full; what is left of them makes sequences of its own,
the last ones at powers of two. Only donors and documents above the capacity are cut.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_small_batches, staged
from .packing import END_ID, TOKENIZER, token_ids

CAPACITY = 2048
#: Lengths of a class of the program differ by this share at most; what a sequence costs beside its tokens.
GRAIN, PER_SEQUENCE = 0.02, 16
#: The program ends when its value is within this share of a bound, or after so many pricings or pivots, with
#: patterns that are right but less full; rounding errors below EPS count as none.
GAP, PRICINGS, PIVOTS, EPS = 5e-3, 200, 20_000, 1e-9
#: Documents are dealt by hash into so many shares; donors are the first few, as many as the gaps ask for, and these at least.
SHARES, LEAST, SEED = 64, 2, 29


def targets(capacity: int) -> np.ndarray:
    """Fills that need no padding, in rising order: powers of two, and the capacity."""
    return np.array(sorted({capacity} | {1 << k for k in range(capacity.bit_length()) if 1 << k <= capacity}))


def classes(histogram: dict[int, int]) -> list[tuple[int, list[list[int]]]]:
    """(largest length, [[length, number]...] by rising length) of each class, the longest class first."""
    out: list[tuple[int, list[list[int]]]] = []
    for x, n in sorted(histogram.items(), reverse=True):
        if n and (not out or x < out[-1][0] / (1 + GRAIN)):
            out.append((x, []))
        if n:
            out[-1][1].insert(0, [x, n])
    return out


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The most that items, each as often as one likes, are worth within each fill, and the item taken last (-1: none)."""
    up = np.argsort(sizes, kind="stable")
    size, value = sizes[up], worth[up]
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    some = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for s in range(1, capacity + 1):
        best[s] = best[s - 1]
        if some[s]:
            total = best[s - size[: some[s]]] + value[: some[s]]
            j = int(total.argmax())
            if total[j] > best[s] + EPS:
                best[s], last[s] = total[j], up[j]
    return best, last


def patterns_of(sizes: np.ndarray, last: np.ndarray, fills: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often the knapsack takes each item within each of ``fills``, one of ``first`` (-1: none) put in before."""
    out, rows = np.zeros((len(fills), len(sizes))), np.arange(len(fills))
    place = np.maximum.accumulate(np.where(last >= 0, np.arange(len(last)), 0))  # the fill whose item a fill holds on top
    some = first >= 0
    out[rows[some], first[some]] = 1
    fill = fills - np.where(some, sizes[np.maximum(first, 0)], 0)
    while len(rows):
        fill = place[fill]
        rows, fill = rows[fill > 0], fill[fill > 0]
        item = last[fill]
        out[rows, item] += 1
        fill = fill - sizes[item]
    return out


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(patterns as rows, how often each is used, a lower bound of the cost) of the linear program.

    Every demand is met exactly at least cost, which for a pattern is the least target that holds it and
    ``PER_SEQUENCE``.
    """
    m, aims = len(sizes), targets(capacity)
    cost = lambda a: aims[np.searchsorted(aims, a @ sizes)] + PER_SEQUENCE
    basis = np.diag((capacity // sizes).astype(float))
    price = cost(basis).astype(float)
    inverse, x = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    bound = float(demand @ sizes) * (1 + PER_SEQUENCE / capacity)  # what it costs where all are full
    pool, pivots = np.zeros((0, m)), 0
    for _ in range(PRICINGS):
        if price @ x <= bound * (1 + GAP) or pivots > PIVOTS:
            break
        dual = price @ inverse.T  # rows of ``basis`` are patterns: the duals make each worth its cost
        best, last = knapsack(sizes, dual, capacity)
        ratio = float((best[aims] / (aims + PER_SEQUENCE)).max())
        bound = max(bound, float(price @ x) / max(ratio, 1.0))  # Farley: with duals scaled down no pattern is worth more than it costs
        # one pricing serves many pivots: the best for each target, and the best with each item
        new = patterns_of(sizes, last, np.append(aims, np.full(m, capacity)), np.append(np.full(len(aims), -1), np.arange(m)))
        new = new[cost(new) - new @ dual < -EPS]
        if not len(new):
            break
        pool = np.vstack([pool, new])
        pool = pool[sorted({a.tobytes(): i for i, a in enumerate(pool)}.values())]
        pool_cost = cost(pool)
        while pivots <= PIVOTS:
            dual = price @ inverse.T
            reduced = pool_cost - pool @ dual
            enter = int(reduced.argmin())
            if reduced[enter] >= -1e-6:
                break
            u = pool[enter] @ inverse
            able = u > EPS
            step = np.full(m, np.inf)
            step[able] = np.maximum(x[able], 0) / u[able]
            leave = int(step.argmin())
            x -= step[leave] * u
            x[leave] = step[leave]
            basis[leave], price[leave] = pool[enter], pool_cost[enter]
            column = inverse[:, leave] / u[leave]
            inverse -= np.outer(column, u)
            inverse[:, leave] = column
            pivots += 1
            if pivots % 500 == 0:  # rounding errors do not add up
                inverse = np.linalg.inv(basis)
                x = demand @ inverse
        pool = pool[pool_cost - pool @ (price @ inverse.T) < capacity / 8]
    return basis, np.maximum(x, 0), bound


def rounded(patterns: np.ndarray, used: np.ndarray, sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of sequences that meet the demand exactly: patterns rounded down, then those that still fit, by the
    fractions left, then best-fit of the longest first."""
    out, left = [], demand.astype(np.int64).copy()
    for a, x in zip(patterns.astype(np.int64), used, strict=True):
        n = int(np.floor(x + 1e-6))
        there = a > 0
        n = min(n, int((left[there] // a[there]).min())) if there.any() else 0
        if n:
            out.append((a, n))
            left -= a * n
    for i in np.argsort(-(used - np.floor(used + 1e-6)), kind="stable"):
        a = patterns[i].astype(np.int64)
        if (a > 0).any() and (left >= a).all() and used[i] > EPS:
            out.append((a, 1))
            left -= a
    rooms: list[list] = []
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        while left[i]:
            fits = [r for r in rooms if r[0] >= size]
            if not fits:
                rooms.append([capacity, np.zeros(len(sizes), dtype=np.int64)])
                fits = rooms[-1:]
            r = min(fits, key=lambda r: r[0])
            n = min(int(left[i]), r[0] // size)
            r[1][i] += n
            r[0] -= n * size
            left[i] -= n
    return out + [(a, 1) for _, a in rooms]


def contents(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """([(length, number in a sequence)...], sequences like that): all of the histogram, in sequences within the
    capacity. The work depends on the capacity, not on how many documents there are."""
    groups = classes(histogram)
    if not groups:
        return []
    sizes, demand = np.array([x for x, _ in groups]), np.array([sum(n for _, n in q) for _, q in groups])
    patterns, used, _ = solve(sizes, demand.astype(float), capacity)
    queues, out = [q for _, q in groups], []
    for a, times in rounded(patterns, used, sizes, demand, capacity):
        config = [(int(j), int(a[j])) for j in np.flatnonzero(a)]
        while times:  # actual lengths take the places, the longest of a class first
            same = min([times, *(queues[j][-1][1] // u for j, u in config)])
            held: dict[int, int] = defaultdict(int)
            for j, u in config:
                for _ in range(1 if same else u):
                    queues[j][-1][1] -= u * same if same else 1
                    held[queues[j][-1][0]] += u if same else 1
                    if not queues[j][-1][1]:
                        queues[j].pop()
            out.append((list(held.items()), max(same, 1)))
            times -= max(same, 1)
    return out


class Plan:
    """Where whole pieces go, by length and rank, and where the stream of donors goes, by position."""

    def __init__(self, sequences: list[tuple[list[tuple[int, int]], int]], stream: int, capacity: int) -> None:
        aims, used, number = targets(capacity), defaultdict(int), 0
        whole, gaps = [], []
        for held, n in sequences:
            at = 0
            for x, each in held:
                whole.append((x, used[x], each, number, at))
                used[x] += each * n
                at += x * each
            gap = int(aims[np.searchsorted(aims, at)]) - at
            gaps.append((gap, n, number, at))
            number += n
        gaps = sorted((g for g in gaps if g[0]), key=lambda g: -g[0])
        self.gap = sum(g * n for g, n, _, _ in gaps)
        self.enough = stream >= self.gap
        left = max(stream - self.gap, 0)
        for aim in [capacity, *aims[::-1].tolist()]:
            if n := left // aim:
                gaps.append((aim, n, number, 0))
                number, left = number + n, left % aim
        self.whole = pd.DataFrame(whole, columns=["length", "first", "each", "sequence", "at"]).sort_values(["length", "first"], ignore_index=True).astype("int64")
        self.stream = pd.DataFrame(gaps, columns=["length", "n", "sequence", "at"]).astype("int64")
        self.stream["first"] = (self.stream["length"] * self.stream["n"]).cumsum() - self.stream["length"] * self.stream["n"]
        self.sequences = number


def plan(histogram: pd.DataFrame, capacity: int = CAPACITY) -> tuple[int, Plan]:
    """(shares that are donors, plan) for a histogram ``(length, share, n)``: the fewest shares tried that fill all gaps.
    With all of them donors there are no gaps, so a plan is always found."""
    h, given = histogram.assign(tokens=histogram["length"] * histogram["n"]), LEAST
    while True:
        whole = h[h["share"] >= given].groupby("length")["n"].sum()
        stream = int(h["tokens"][h["share"] < given].sum())
        made = Plan(contents(dict(zip(whole.index.tolist(), whole.tolist(), strict=True)), capacity), stream, capacity)
        if made.enough or given == SHARES:
            return given, made
        given = min(SHARES, max(-(-SHARES * made.gap // max(int(h["tokens"].sum()), 1)), 2 * given))


def share(doc_id: Column, text: Column) -> Column:
    """The share that a document is dealt into: equal rows lie in one share."""
    return F.pmod(F.xxhash64(doc_id.cast("string"), text, F.lit(SEED)), F.lit(SHARES)).cast("int")


def _tokenised(docs: DataFrame, name: str, end_id: int, rows_of, schema: str) -> DataFrame:
    """``rows_of(ids, share)`` for each document, ids with their end, as columns after doc_id and task."""
    end, names = np.array([end_id], dtype="<u4").tobytes(), [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, shares, at, rows = [t or "" for t in b["text"].to_pylist()], b["share"].to_pylist(), [], []
            for lo in range(0, len(texts), 256):
                for i, ids in enumerate(token_ids(texts[lo : lo + 256], name), lo):
                    for row in rows_of(ids + end, shares[i]):
                        at.append(i)
                        rows.append(row)
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            doc, task = b["doc_id"].take(pa.array(at, pa.int64())), pa.array([b["task"][0].as_py()] * len(rows) if len(b) else [], pa.int32())
            yield pa.RecordBatch.from_arrays([doc, task, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc_id", "task", *names])

    told = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", share(F.col("doc_id"), F.col("text")).alias("share"), F.spark_partition_id().alias("task"))
    return told, run, f"doc_id long, task int, {schema}"


def pieces(docs: DataFrame, capacity: int, name: str, end_id: int) -> DataFrame:
    """``(doc_id, task, start, length, ids_crc32, doc_tokens, share)``: each document's pieces of at most ``capacity``. All
    but the last are full and belong to no share (``SHARES``)."""
    wide = capacity * 4

    def rows_of(ids: bytes, share: int) -> Iterator[tuple]:
        for at in range(0, len(ids), wide):
            part = ids[at : at + wide]
            yield at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, share if at + wide >= len(ids) else SHARES

    told, run, schema = _tokenised(docs, name, end_id, rows_of, "start long, length long, ids_crc32 long, doc_tokens long, share int")
    return told.mapInArrow(run, schema)


def donors(docs: DataFrame, given: int, capacity: int, name: str, end_id: int) -> DataFrame:
    """``(doc_id, task, start, doc_tokens, ids)``: the last pieces of the documents in the first ``given`` shares."""

    def rows_of(ids: bytes, share: int) -> Iterator[tuple]:
        start = (len(ids) // 4 - 1) // capacity * capacity
        yield start, len(ids) // 4, ids[start * 4 :]

    some = docs.where(share(F.col("doc_id"), F.col("text")) < given)
    told, run, schema = _tokenised(some, name, end_id, rows_of, "start long, doc_tokens long, ids binary")
    return told.mapInArrow(run, schema)


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _placed_whole(whole: DataFrame, made: Plan) -> DataFrame:
    """Ranks among the pieces of a length: within a task as they come, after those of the tasks before."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = defaultdict(int)
        for b in batches:
            length = b["length"].to_numpy()
            order = np.argsort(length, kind="stable")
            values, first, count = np.unique(length[order], return_index=True, return_counts=True)
            out = np.empty(len(length), dtype=np.int64)
            out[order] = np.arange(len(length)) - np.repeat(first - np.array([seen[v] for v in values.tolist()], dtype=np.int64), count)
            for v, n in zip(values.tolist(), count.tolist(), strict=True):
                seen[v] += n
            yield b.append_column("rank", pa.array(out))

    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int"
    told = whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.spark_partition_id().alias("task"))
    ranked = staged(told.mapInArrow(rank, f"{columns}, rank long"), "ranked")
    per_task = ranked.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    table = {c: made.whole[c].to_numpy() for c in made.whole}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = table["length"] << 42 | table["first"]
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            i = np.searchsorted(key, length << 42 | rank, side="right") - 1
            k = rank - table["first"][i]
            sequence, offset = table["sequence"][i] + k // table["each"][i], table["at"][i] + k % table["each"][i] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    joined = ranked.hint("merge").join(base, ["length", "task"])
    return joined.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("base")).alias("rank")).mapInArrow(place, OUT)


def _placed_stream(given: DataFrame, made: Plan) -> DataFrame:
    """Donors laid end to end, task by task, and cut where the plan's gaps are full."""
    given = staged(given, "donors")
    totals = given.groupBy("task").agg(F.sum(F.octet_length("ids")).alias("n")).orderBy("task").collect()  # a row for each task
    firsts, at = {}, 0
    for r in totals:
        firsts[r.task] = at
        at += r.n // 4
    order = F.col("doc_id"), F.xxhash64("ids"), F.col("start")
    before = F.coalesce(F.sum(F.octet_length("ids") / 4).over(Window.partitionBy("task").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    table = {c: made.stream[c].to_numpy() for c in made.stream}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, (task, start, n, ids, place) in enumerate(zip(*[b[c].to_pylist() for c in ("task", "start", "doc_tokens", "ids", "before")], strict=True)):
                here, done = firsts[task] + place, 0
                while done < len(ids) // 4:
                    k = int(np.searchsorted(table["first"], here, side="right")) - 1
                    size = int(table["length"][k])
                    j, into = divmod(here - int(table["first"][k]), size)
                    take = min(size - into, len(ids) // 4 - done)
                    at.append(i)
                    rows.append((start + done, take, zlib.crc32(ids[done * 4 : (done + take) * 4]), n, int(table["sequence"][k]) + j, int(table["at"][k]) + into))
                    done, here = done + take, here + take
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(at, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], [c.split()[0] for c in OUT.split(", ")])

    return given.withColumn("before", before).mapInArrow(cut, OUT)


def pack(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, a row for each piece of every row.

    Each sequence holds at most ``capacity`` tokens, gapless from offset 0, and every one ends at the capacity or at a
    power of two, so there is no padding. A document is its ids and then ``end_id``; null and empty texts are ``end_id``
    alone; repeated rows are packed each; a null doc_id stays null; other columns are ignored; an empty table gives an
    empty table. Documents are encoded once, donors a second time.
    """
    cut = staged(pieces(docs, capacity, name, end_id), "stock-pieces")
    given, made = plan(cut.groupBy("length", "share").agg(F.count("*").alias("n")).toPandas(), capacity)  # at most capacity * (SHARES + 1) rows
    out = _placed_whole(cut.where(F.col("share") >= given), made)
    return out.union(_placed_stream(donors(docs, given, capacity, name, end_id), made))
