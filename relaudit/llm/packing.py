"""Best-fit packing of token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so a histogram of them, never larger than the capacity, holds all that a
plan depends on. The plan follows the linear grouping scheme (Fernandez de la Vega and Lueker, 1981): large lengths are
sorted into groups of equal cardinality and rounded up to the largest of the group, configurations of the few sizes
left are optimised, actual lengths take the places of the rounded ones, and small lengths go to the sequence that they
fit best. The plan is a table of slots by length and rank; documents get ranks in a distributed way and look theirs up.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, in_small_batches, staged

CAPACITY, TOKENIZER, END_ID = 4096, "word_bpe_49k.json", 1
#: Lengths above this share of the capacity are large; groups that they are rounded in; parts of text that a worker remembers.
LARGE, GROUPS, MEMORY = 0.25, 24, 200_000


#: What plain texts lack: all but ASCII and Latin letters, apostrophes, special tokens' brackets. Without it the
#: tokenizer's pattern ends a part wherever letters and other characters meet.
ODD = re.compile(r"[^\t-\r -&(-~À-ÖØ-öø-ÿ]|<\|")
PARTS = re.compile(r"[a-zß-öø-ÿ]+|[^\sa-zß-öø-ÿ]+")
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
_LETTERS = "".join(c for c in map(chr, range(256)) if LETTERS.fullmatch(c))
_PLAIN = bytes(c for c in range(256) if not ODD.search(chr(c)))
_OTHERS = bytes(32 if chr(c).isspace() or chr(c) in _LETTERS else c for c in range(256))


def latin(text: str) -> bytes | None:
    """The text as one byte a character, where all of them fit: tables of 256 places then do what a pattern of classes does."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


@lru_cache(maxsize=2)
def _tokenizer(name: str):
    """The tokenizer, what its model reads for letters beyond ASCII, and the ids of the words seen so far. The middle one is
    none where a run of letters is not one word of the model."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    split = t.pre_tokenizer.pre_tokenize_str
    read = {ord(c): split(c)[0][0] for c in _LETTERS}
    kept = (t.normalizer is None or t.normalizer.normalize_str(_LETTERS) == _LETTERS) and not any(LETTERS.fullmatch(x.content) for x in t.get_added_tokens_decoder().values())
    whole = kept and t.post_processor is None and [x for x, _ in split(_LETTERS)] == [_LETTERS.translate(read)]
    return t, read if whole else None, {}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _encoded(parts: list[str], tokenizer, read: dict[int, str] | None, sizes: bool = False) -> dict:
    """The ids of each part, packed, or how many they are. Runs of letters go to the tokenizer's model as they are: nothing
    in them is to be normalised or parted."""
    out, alone, model, letters = {}, [], tokenizer.model.tokenize, LETTERS.fullmatch
    for p in parts:
        if read is not None and letters(p):
            got = model(p if p.isascii() else p.translate(read))
            out[p] = len(got) if sizes else _packed([x.id for x in got])
        else:
            alone.append(p)
    for p, e in zip(alone, tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
        out[p] = len(e) if sizes else _packed(e.ids)
    return out


def token_ids(texts: list[str], name: str = TOKENIZER) -> list[bytes]:
    """The ids of each text as packed little-endian 32-bit numbers.

    The tokenizer lowers letters, drops white space and never joins across it, so parts are encoded each and
    remembered: a frequent part is looked up, not encoded again. Plain texts part where letters and others meet, all
    texts at blanks. Beyond ``MEMORY`` parts new ones are forgotten after the call.
    """
    tokenizer, read, known = _tokenizer(name)
    split = [t.replace("\n", " ").split(" ") if ODD.search(t) else PARTS.findall(t.lower()) for t in texts]
    new = _encoded([p for p in set().union(*split) if p not in known], tokenizer, read)
    known.update(new)
    out = [b"".join(map(known.__getitem__, parts)) for parts in split]
    if len(known) > MEMORY:
        for p in new:
            del known[p]
    return out


_SIZES: dict[str, int] = {}


def parts_of(text: str, low: str, words: Counter) -> tuple[Counter, ...]:
    """The parts that :func:`token_ids` encodes of a text, by its lower-case form and its runs of letters, counted."""
    raw = latin(text)
    if raw is None or raw.translate(None, _PLAIN) or b"<|" in raw:  # what ODD finds
        return (Counter(text.replace("\n", " ").split(" ")),)
    return words, Counter(low.encode("latin-1").translate(_OTHERS).decode("latin-1").split())


def token_counts(texts: list[tuple[Counter, ...]], name: str = TOKENIZER) -> list[int]:
    """How many ids :func:`token_ids` gives texts of these parts. Sizes of parts are remembered, and those of all texts
    encoded together where they are new."""
    if len(_SIZES) > 3 * MEMORY:
        forget_sizes(MEMORY)
    tokenizer, read, _ = _tokenizer(name)
    new = set().union(*(count for counts in texts for count in counts)).difference(_SIZES)
    _SIZES.update(_encoded(list(new), tokenizer, read, True))
    size = _SIZES.__getitem__
    return [sum(sum(map(mul, map(size, count), count.values())) for count in counts) for counts in texts]


def forget_sizes(keep: int = 0) -> None:
    """Let go of the sizes of parts that :func:`token_counts` remembers, but for the first ``keep``, which the frequent ones
    are among: a worker's next task needs those again, and a worker outlives the stage that needs any."""
    global _SIZES
    if len(_SIZES) > keep:
        _SIZES = dict(islice(_SIZES.items(), keep))


def pieces(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, task, rank)``: texts as token pieces of at most ``capacity``.

    A document is its ids and then ``end_id``; a null or empty text is ``end_id`` alone; repeated rows are pieces each.
    ``rank`` counts the pieces of one length in a task.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    wide = capacity * 4

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_sizes()
        seen: dict[int, int] = defaultdict(int)
        for f in frames:
            rows, texts = [], [t if isinstance(t, str) else "" for t in f["text"]]
            for lo in range(0, len(texts), 256):
                for doc, ids in zip(f["doc_id"].iloc[lo : lo + 256], token_ids(texts[lo : lo + 256], name), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), wide)):
                        part = ids[at : at + wide]
                        n = len(part) // 4
                        rows.append((doc, k, at // 4, n, zlib.crc32(part), f["task"].iloc[0], seen[n]))
                        seen[n] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])
        give_back()

    out = in_small_batches(docs).select("doc_id", "text", F.spark_partition_id().alias("task"))
    return out.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


class _Bins:
    """Sequences in classes of equal content: class k is ``count[k]`` sequences that hold ``content[k]``."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.content: list[list[tuple[int, int]]] = []
        self.count: list[int] = []
        self.by_room: dict[int, list[int]] = defaultdict(list)
        self.rooms: list[int] = []

    def add(self, content: list[tuple[int, int]], count: int) -> None:
        room = self.capacity - sum(x * m for x, m in content)
        self.content.append(content)
        self.count.append(count)
        if room > 0:
            if not self.by_room.get(room):
                bisect.insort(self.rooms, room)
            self.by_room[room].append(len(self.count) - 1)

    def fit(self, length: int, number: int) -> None:
        """Best fit: ``number`` pieces of one length go where least room is left."""
        while number:
            i = bisect.bisect_left(self.rooms, length)
            if i == len(self.rooms):
                each = self.capacity // length
                if number >= each:
                    self.add([(length, each)], number // each)
                if number % each:
                    self.add([(length, number % each)], 1)
                return
            room = self.rooms[i]
            k = self.by_room[room].pop()
            if not self.by_room[room]:
                self.rooms.pop(i)
            each = min(room // length, number)
            take = min(self.count[k], number // each)
            content, n = self.content[k], self.count[k]
            if take < n:
                self.count[k] = n - take
                if not self.by_room[room]:
                    bisect.insort(self.rooms, room)
                self.by_room[room].append(k)
            else:
                self.count[k] = 0
            self.add([*content, (length, each)], take)
            number -= each * take


def _best_configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size fill a sequence fullest, within what is left; larger sizes are preferred on ties."""
    best = np.full(capacity + 1, -1, dtype=np.int64)  # the size used last to reach a fill
    best[0] = len(sizes)
    prior = np.zeros(capacity + 1, dtype=np.int64)
    used = [0] * len(sizes)
    for j, size in enumerate(sizes):
        for _ in range(min(left[j], capacity // size)):
            new = np.flatnonzero((best[: capacity + 1 - size] >= 0) & (best[size:] < 0))
            if not len(new):
                break
            best[new + size] = j
            prior[new + size] = new
    at = int(np.flatnonzero(best >= 0)[-1])
    while at > 0:
        used[best[at]] += 1
        at = int(prior[at])
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> _Bins:
    """Sequences for all pieces of a histogram; its cost depends on the capacity alone, not on the number of pieces."""
    bins, runs = _Bins(capacity), sorted(histogram.items(), reverse=True)
    big = [(x, n) for x, n in runs if x > large * capacity]
    total = sum(n for _, n in big)
    per = max(1, -(-total // groups))
    queues: list[list[list[int]]] = []  # of each group the actual lengths, largest first
    room = 0
    for x, n in big:
        while n:
            if room == 0:
                queues.append([])
                room = per
            take = min(n, room)
            queues[-1].append([x, take])
            n, room = n - take, room - take
    queues = [q[::-1] for q in queues]  # the next length to place is the last
    sizes, left = [q[-1][0] for q in queues], [sum(n for _, n in q) for q in queues]
    while any(left):
        open_ = [j for j in range(len(sizes)) if left[j]]
        first = open_[0]  # the largest size that is left opens the sequence
        left[first] -= 1
        used = _best_configuration([sizes[j] for j in open_], [left[j] for j in open_], capacity - sizes[first])
        left[first] += 1
        config = {j: u for j, u in zip(open_, used, strict=True) if u}
        config[first] = config.get(first, 0) + 1
        times = min(left[j] // u for j, u in config.items())
        for j, u in config.items():
            left[j] -= u * times
        while times:  # actual lengths take the places
            same = min([times, *(queues[j][-1][1] // u for j, u in config.items())])
            content: dict[int, int] = defaultdict(int)
            for j, u in config.items():
                for _ in range(1 if same else u):
                    queues[j][-1][1] -= u * same if same else 1
                    content[queues[j][-1][0]] += u if same else 1
                    if not queues[j][-1][1]:
                        queues[j].pop()
            bins.add(list(content.items()), max(same, 1))
            times -= max(same, 1)
    for x, n in runs:
        if x <= large * capacity:
            bins.fit(x, n)
    return bins


def slots(bins: _Bins) -> pd.DataFrame:
    """The plan as intervals: pieces of ``length`` and ranks from ``first`` on, ``each`` in a sequence from ``at``."""
    out, sequence = [], 0
    used: dict[int, int] = defaultdict(int)
    for content, n in zip(bins.content, bins.count, strict=True):
        at = 0
        for x, each in content if n else []:
            out.append((x, used[x], each, sequence, at))
            used[x] += each * n
            at += x * each
        sequence += n
    return pd.DataFrame(out, columns=["length", "first", "each", "sequence", "at"]).sort_values(["length", "first"], ignore_index=True)


def pack(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, a row for each piece of every row.

    Only documents longer than ``capacity`` are cut. Sequences are gapless from offset 0. Null and empty texts are
    pieces of one id; other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    cut = staged(pieces(docs, capacity, name, end_id), "pieces")
    per_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    per_task = staged(per_task, "piece-counts")
    histogram = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    table = slots(plan(histogram, capacity))
    told = spark.sparkContext.broadcast({c: table[c].to_numpy() for c in table})
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.hint("merge").join(base, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "task")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = told.value
        key = t["length"] * 2.0**40 + t["first"]
        for f in frames:
            i = np.searchsorted(key, f["length"].to_numpy() * 2.0**40 + f["rank"].to_numpy(), side="right") - 1
            k = f["rank"].to_numpy() - t["first"][i]
            f["sequence_id"] = t["sequence"][i] + k // t["each"][i]
            f["offset"] = t["at"][i] + k % t["each"][i] * f["length"].to_numpy()
            yield f[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return ranked.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
