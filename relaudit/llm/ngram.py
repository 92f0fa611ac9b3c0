"""N-gram Jaccard join by T-occurrence search, lossless.

An inverted index over all shingles, dealt by hash, tells which shingles occur in more than one set. A set can have a
partner only if enough of its shingles do, which nearly all sets fail. Of what is left, sets that share a minimal token
meet and are searched at once, so that families of near copies become one group each. Then the search is completed: a
set asks every group outside its own that holds enough of its prefix tokens, the rarest ones first, and the group, dealt
in parts, answers. A search merges the short inverted lists through a heap, probes the long ones by binary search
(DivideSkip; Li, Lu and Lu, 2008), and links the sets that reach the required overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, in_small_batches, staged
from .components import connected_components

#: Defaults: words of a shingle, and the least similarity in per cent.
WORDS, PERCENT = 5, 80
#: Shingles of an index bucket; tokens whose order is broadcast, each held by so many sets; sets that one search task
#: holds; groups that share a token from which on its list is long and set aside.
BUCKET, HEAVY_TOKENS, HEAVY_FROM, BLOCK, LONG = 2_000_000, 100_000, 16, 512, 64
#: Sets that a task remembers having posted; places that a merge pops at once; links that make a group's members leave
#: off asking.
REMEMBERED, WINDOW, MANY = 200_000, 256, 8

_U = np.uint64
_rng = np.random.default_rng(20_240_607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingle_sets(texts: list, words: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; null and wordless texts have none.

    Words are runs without ASCII white space, A-Z in lower case. With fewer than ``words`` words the whole sequence is
    the one shingle.
    """
    raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    if not raw:
        return []
    buf = _LOWER[np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)]
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    solid = ~_SPACE[buf]
    first = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    if not len(first):
        return [np.zeros(0, dtype=np.uint64)] * len(raw)
    span = np.diff(np.append(first, len(buf)))
    place = np.arange(first[0], len(buf)) - np.repeat(first, span)
    power = np.cumprod(np.full(int(place.max()) + 1, _STEP))
    part = np.where(solid[first[0] :], _BYTE[buf[first[0] :]] * power[place], _U(0))
    word = _mix(np.add.reduceat(part, first - first[0]))
    at = np.searchsorted(first, bounds)  # words before each text
    out = []
    spread = [_U((2 * k + 1) * 0xD6E8FEB86659FD93 % 2**64) for k in range(words)]
    n = len(word) - words + 1
    run = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(words if n > 0 else 0):
        run += _mix(word[k : k + n] + spread[k]) * spread[k]
    run = _mix(run)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            h = np.full(1, b - a, dtype=np.uint64)
            for k in range(a, b):
                h = _mix(h * _STEP + word[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def need(size: int, percent: int) -> int:
    """The least overlap with any set that reaches ``percent`` Jaccard similarity."""
    return -(-percent * size // 100)


def overlap_needed(a, b, percent: int):
    """The least overlap of sets of sizes ``a`` and ``b``: percent * union <= 100 * overlap."""
    return -(-percent * (a + b) // (100 + percent))


def evidence(size: int, percent: int) -> int:
    """Tokens that the prefixes of two similar sets have in common, if the smaller one has ``size`` tokens.

    A prefix is ``size`` - ``need`` + ``evidence`` tokens long in an order that all sets share.
    """
    return min(1 + (size - need(size, percent)) // 2, need(size, percent))


def divide_skip(lists: list[np.ndarray], least: int, n_long: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that occur in at least ``least`` of the inverted lists, and in how many.

    The ``n_long`` longest lists, at most ``least`` - 1 of them, are set aside; the others are merged, and a place
    found ``least`` - ``n_long`` times or more is looked up in the long ones by binary search.
    """
    own = sorted(lists, key=len)
    n_long = max(0, min(n_long, least - 1, len(own)))
    short, long = own[: len(own) - n_long], own[len(own) - n_long :]
    place, times = _merged(short, least - n_long)
    for i, xs in enumerate(long):
        reach = times + len(long) - i >= least
        place, times = place[reach], times[reach]
        if not len(place):
            break
        at = np.minimum(np.searchsorted(xs, place), len(xs) - 1)
        times = times + (xs[at] == place)
    enough = times >= least
    return place[enough], times[enough]


def _merged(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that at least ``least`` of some sorted lists hold, and how many do.

    The heads of the lists are the heap: before the ``least``-th smallest head no place can be held often enough, so
    all lists skip there by binary search. From it on ``WINDOW`` places are popped at once, whatever the lists hold.
    """
    lists = [xs for xs in lists if len(xs)]
    if len(lists) < least:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    size = np.array([len(xs) for xs in lists])
    end = np.cumsum(size)
    flat, base = np.concatenate(lists).astype(np.int64), np.repeat(np.arange(len(lists)), size)
    far = int(flat.max()) + 1
    key, at, row = base * far + flat, end - size, np.arange(len(lists)) * far
    place, times = [], []
    while (open_ := np.flatnonzero(at < end)).size >= least:
        heads = flat[at[open_]]
        first = int(np.partition(heads, least - 1)[least - 1])
        low = np.searchsorted(key, row[open_] + first)
        high = np.searchsorted(key, row[open_] + min(first + WINDOW, far))
        n = high - low
        picked = flat[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())] - first
        held = np.bincount(picked, minlength=1)
        enough = np.flatnonzero(held >= least)
        place.append(enough + first)
        times.append(held[enough])
        at[open_] = high
    return (np.concatenate(place), np.concatenate(times)) if place else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def _root(up: list[int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


class _Lists:
    """The inverted lists of the tokens that at least ``held`` of some sets hold, in flat arrays."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], held: int = 2) -> None:
        token = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        order = np.argsort(token, kind="stable")
        token, self.doc, self.sizes = token[order], doc[order], np.array(sizes)
        first = _runs(token)
        last = np.append(first[1:], len(token))
        shared = last - first >= held
        self.token, self.first, self.last = token[first[shared]], first[shared], last[shared]

    def similar(self, query: np.ndarray, size: int, percent: int) -> list[int]:
        """Places of the sets that reach the similarity with a set of ``size`` tokens, ``query`` the repeated ones.

        The lists count every common token, so what a search returns is the overlap itself.
        """
        if not len(self.token):
            return []
        at = np.minimum(np.searchsorted(self.token, query), len(self.token) - 1)
        at = at[self.token[at] == query]
        least = max(1, overlap_needed(size, need(size, percent), percent))
        if len(at) < least:
            return []
        place, same = divide_skip([self.doc[a:b] for a, b in zip(self.first[at], self.last[at], strict=True)], least, least // 2)
        return place[100 * same >= percent * (size + self.sizes[place] - same)].tolist()


def linked_groups(sizes: list[int], sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set of a group the first one that links connect it with.

    Every set asks for those that it is linked with, but for the members of one group, once a set has been found with
    many links: links inside that group change nothing, and sets outside of it ask themselves.
    """
    up, main, lists = list(range(len(sets))), None, _Lists(sets, sizes)
    for x in range(len(sets)):
        if main is not None and _root(up, x) == _root(up, main):
            continue
        near = lists.similar(sets[x], sizes[x], percent)
        for y in near:
            if (a := _root(up, x)) != (b := _root(up, y)):
                up[max(a, b)] = min(a, b)
        if main is None and len(near) > MANY:
            main = x
    return [_root(up, x) for x in range(len(sets))]


def _batches(frame: pd.DataFrame, chars: int = 1_000_000) -> Iterator[pd.DataFrame]:
    size = frame["text"].str.len().fillna(0).to_numpy().cumsum() // chars
    for _, part in frame.groupby(size, sort=False):
        yield part


def set_keys(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, n_shingles, sid)``: sets are told apart by a 64-bit hash ``sid``; an empty set has none."""

    def run(frames):
        for frame in frames:
            for f in _batches(frame):
                sets = shingle_sets(f["text"].tolist(), words)
                sid = pd.array([_sid(s) if len(s) else None for s in sets], dtype="Int64")
                yield pd.DataFrame({"doc_id": f["doc_id"], "n_shingles": [len(s) for s in sets], "sid": sid})
        give_back()

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, sid long")


def _sid(tokens: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(tokens.tobytes())], dtype=np.uint64).view(np.int64)[0])


#: The index keeps the upper 48 bits of a shingle's hash, six bytes: of two sets of 600 shingles, two different ones
#: agree by chance about once in 10^9 pairs of sets.
KEPT = 6
_SINGLE, _TWICE, _KNOWN = 0, 1, 2


def _pack(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT]).tobytes()


def _unpack(blobs) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, KEPT)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :KEPT] = raw
    return out.view("<u8").ravel()


def _longs(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype="<i8")


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where equal rows of the sorted columns begin."""
    n = len(columns[0])
    head = np.zeros(n, dtype=bool)
    head[:1] = True
    for c in columns:
        head[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(head)


def _by_part(part: np.ndarray, token: np.ndarray, sid: np.ndarray, size: np.ndarray) -> Iterator[tuple]:
    """(part, tokens, sids, sizes, counts), packed, for each part of postings sorted by part and sid."""
    if not len(part):
        return
    first = _runs(part, sid)
    ends = np.append(first[1:], len(sid))
    cut = _runs(part[first])
    for a, b in zip(cut, np.append(cut[1:], len(first)), strict=True):
        rows = slice(first[a], ends[b - 1])
        own = first[a:b]
        yield int(part[first[a]]), _pack(token[rows]), sid[own].astype("<i8").tobytes(), size[own].astype("<i8").tobytes(), (ends[a:b] - own).astype("<i8").tobytes()


def _postings(words: int, buckets: int):
    """Text to rows (bucket, kind, tokens, sids, sizes, counts) of the inverted index, packed: each set once.

    What a batch shows to occur in two sets is known to be repeated: one occurrence goes to the token's bucket to tell
    others, the rest go anywhere (``_KNOWN``), so a token that a third of all sets hold fills no bucket.
    """

    def run(frames):
        salt, met = 0, set()
        for frame in frames:
            for f in _batches(frame):
                sets = [s for s in shingle_sets(f["text"].tolist(), words) if len(s)]
                new = {sid: s for s in sets if (sid := _sid(s)) not in met}
                if not new:
                    continue
                met = met | new.keys() if len(met) < REMEMBERED else set(new)
                ids, sizes = np.fromiter(new, np.int64, len(new)), np.array([len(s) for s in new.values()])
                token, doc = np.concatenate(list(new.values())) >> _U(16), np.repeat(np.arange(len(ids)), sizes)
                order = np.argsort(token, kind="stable")
                token, doc = token[order], doc[order]
                head = np.concatenate([[True], token[1:] != token[:-1]])
                tail = np.concatenate([head[1:], [True]])
                kind = np.where(head & tail, _SINGLE, np.where(head, _TWICE, _KNOWN))
                bucket = (_mix(token) >> _U(8)).astype(np.int64) % buckets
                known = kind == _KNOWN
                bucket[known] = (np.arange(known.sum()) // 4096 + salt) % buckets
                salt += 1 + int(known.sum()) // 4096
                key = bucket * 3 + kind
                order = np.lexsort((doc, key))
                key, token, doc = key[order], token[order], doc[order]
                out = [(k // 3, k % 3, *rest) for k, *rest in _by_part(key, token, ids[doc], sizes[doc])]
                yield pd.DataFrame(out, columns=["bucket", "kind", "tokens", "sids", "sizes", "counts"])
        give_back()

    return run


def _postings_of(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, sid, size) of packed rows."""
    counts = _longs(f["counts"])
    return _unpack(f["tokens"]), np.repeat(_longs(f["sids"]), counts), np.repeat(_longs(f["sizes"]), counts)


def _repeated(parts: int):
    """Of one bucket the postings of tokens that at least two sets hold, dealt by set."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        token, sid, size = _postings_of(f)
        kind = np.repeat(f["kind"].to_numpy().astype(np.int8), [len(x) // KEPT for x in f["tokens"]])
        del f
        free = np.flatnonzero(kind == _KNOWN)
        order = np.flatnonzero(kind != _KNOWN)
        order = order[np.lexsort((-kind[order], sid[order], token[order]))]
        order = order[_runs(token[order], sid[order])]
        first = _runs(token[order])
        held = np.diff(np.append(first, len(order)))
        twice = np.maximum.reduceat(kind[order], first) == _TWICE if len(first) else np.zeros(0, bool)
        take = np.concatenate([order[np.repeat((held > 1) | twice, held)], free])
        token, sid, size = token[take], sid[take], size[take]
        part = (_mix(sid.astype(np.uint64)) >> _U(8)).astype(np.int64) % parts
        order = np.lexsort((sid, part))
        give_back()
        return pd.DataFrame(list(_by_part(part[order], token[order], sid[order], size[order])), columns=["part", "tokens", "sids", "sizes", "counts"])

    return run


def _enough(percent: int):
    """Of one part the sets of which enough tokens are repeated to have a partner, with those tokens, sorted."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        token, sid, size = _postings_of(f)
        order = np.lexsort((token, sid))
        order = order[_runs(sid[order], token[order])]
        token, sid, size = token[order], sid[order], size[order]
        first = _runs(sid)
        held = np.diff(np.append(first, len(sid)))
        good = 100 * held >= percent * size[first]
        out = pd.DataFrame({"sid": sid[first[good]], "n": size[first[good]], "tokens": [_pack(token[a : a + k]) for a, k in zip(first[good], held[good], strict=True)]})
        give_back()
        return out

    return run


def candidates(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """``(sid, n, tokens)``: sets of which enough shingles are repeated to have a partner.

    ``n`` is the size of the set; ``tokens`` are its repeated shingles, sorted and packed; no other set has the rest.
    """
    packed = "tokens binary, sids binary, sizes binary, counts binary"
    posted = docs.select("text").mapInPandas(_postings(words, buckets), f"bucket long, kind long, {packed}")
    again = posted.groupBy("bucket").applyInPandas(_repeated(buckets), f"part long, {packed}")
    return again.groupBy("part").applyInPandas(_enough(percent), "sid long, n long, tokens binary")


def _minimal(frames):
    """(sid, way, token): the least token of each set in two orders, by value and by another hash."""
    for f in frames:
        sets = [_unpack([b]) for b in f["tokens"]]
        least = [t[0] for t in sets], [t[np.argmin(_mix(t))] for t in sets]
        for way in (0, 1):
            yield pd.DataFrame({"sid": f["sid"], "way": way, "token": np.array(least[way], dtype=np.uint64).view(np.int64)})


def _prefixes(percent: int, heavy):
    """``(sid, least, tokens)``: the rarest repeated tokens of each set, as many as it takes to share enough with any
    partner, and the least number of them that it shares.

    The order of tokens is by rank among heavy ones, zero for all others, and then by value: any order that all sets
    share is exact, and this one keeps common passages out of prefixes. Tokens of a single set come first.
    """

    def run(frames):
        hot, rank = heavy.value
        for f in frames:
            tokens = []
            for n, blob in zip(f["n"], f["tokens"], strict=True):
                t = _unpack([blob])
                at = np.minimum(np.searchsorted(hot, t), max(len(hot) - 1, 0))
                order = np.where(hot[at] == t, rank[at], 0) if len(hot) else np.zeros(len(t), int)
                k = n - need(n, percent) + evidence(n, percent) - (n - len(t))
                tokens.append(t[np.lexsort((t, order))[: max(k, 0)]].view(np.int64))
            yield pd.DataFrame({"sid": f["sid"], "least": [evidence(need(n, percent), percent) for n in f["n"]], "tokens": tokens})

    return run


def _search(percent: int):
    """Links of the sets of one task, as a forest."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("sid", ignore_index=True)
        ids = f["sid"].to_numpy()
        head = np.array(linked_groups(f["n"].tolist(), [_unpack([b]) for b in f["tokens"]], percent))
        if len(f) > 100:
            give_back()
        linked = head != np.arange(len(f))
        return pd.DataFrame({"u": ids[linked], "v": ids[head[linked]]})

    return run


def _answer(percent: int, one_group: bool):
    """Links between the sets that ask and the members of a part, as a forest; members of one group are joined already."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["ask", "sid"], ignore_index=True)
        ids, sizes, sets = f["sid"].tolist(), f["n"].tolist(), [_unpack([b]) for b in f["tokens"]]
        members = int((~f["ask"]).sum())
        lists = _Lists(sets[:members], sizes[:members], 1)
        up = [0] * members if one_group else list(range(members))
        place = {x: i for i, x in enumerate(ids[:members])}
        out = []
        for x in range(members, len(ids)):
            own = place.get(ids[x])
            up.append(x if own is None else own)
            for y in lists.similar(sets[x], sizes[x], percent):
                if (a := _root(up, x)) != (b := _root(up, y)):
                    up[max(a, b)] = min(a, b)
                    out.append((ids[x], ids[y]))
        if len(f) > 100:
            give_back()
        return pd.DataFrame(out, columns=["u", "v"])

    return run


def _tokens(frames):
    for f in frames:
        for blob in f["tokens"]:
            yield pd.DataFrame({"token": _unpack([blob]).view(np.int64)})


def _meetings(cand: DataFrame, percent: int, block: int) -> DataFrame:
    """Links ``(u, v)`` found where sets share a least token; sets of a common one are dealt into blocks."""
    ways = cand.select("sid", "tokens").mapInPandas(_minimal, "sid long, way int, token long")
    many = ways.groupBy("way", "token").agg(F.count("*").alias("rows")).where("rows > 1")
    part = F.pmod(F.xxhash64("sid", "way"), F.ceil(F.col("rows") / block)).alias("part")
    placed = ways.join(many, ["way", "token"]).select("sid", "way", "token", part)
    return placed.join(cand, "sid").groupBy("way", "token", "part").applyInPandas(_search(percent), "u long, v long")


def _asked(members: DataFrame, asks: DataFrame, cand: DataFrame, percent: int, block: int, one_group: bool) -> DataFrame:
    """Links ``(u, v)`` between each set of ``asks(sid, g)`` and the sets of ``members(sid, g)``.

    Members are dealt into parts of about ``block`` sets, and so are those that ask, so a task holds two blocks.
    """
    sizes = members.groupBy("g").agg(F.ceil(F.count("*") / block).alias("parts"))
    sizes = asks.groupBy("g").agg(F.ceil(F.count("*") / block).alias("chunks")).join(sizes, "g")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("sid", F.lit(1)), F.col(n))
    index = members.join(sizes, "g").select("sid", "g", own("parts").alias("part"), every("chunks").alias("chunk"), F.lit(False).alias("ask"))
    asking = asks.join(sizes, "g").select("sid", "g", every("parts").alias("part"), own("chunks").alias("chunk"), F.lit(True).alias("ask"))
    return index.union(asking).join(cand, "sid").groupBy("g", "part", "chunk").applyInPandas(_answer(percent, one_group), "u long, v long")


def _completed(cand: DataFrame, links: DataFrame, percent: int, block: int, long: int) -> DataFrame:
    """The links between sets that ``links`` leave apart.

    Two similar sets share enough prefix tokens. Where they lie in two groups of linked sets, the one of the smaller
    group asks the other group if that holds enough of its tokens. Tokens that more than ``long`` groups hold are set
    aside, and so much less is enough; sets with too many of them ask all sets that such tokens connect them with.
    """
    spark = cand.sparkSession
    heavy = cand.mapInPandas(_tokens, "token long").groupBy("token").count().where(F.col("count") >= HEAVY_FROM)
    heavy = heavy.orderBy(F.desc("count"), "token").limit(HEAVY_TOKENS).toPandas()
    heavy = heavy.sort_values(["count", "token"], ignore_index=True)
    hot, rank = heavy["token"].to_numpy().astype(np.int64).view(np.uint64), np.arange(1, len(heavy) + 1)
    order = np.argsort(hot)
    shared = spark.sparkContext.broadcast((hot[order], rank[order]))
    group = connected_components(links).select(F.col("id").alias("sid"), F.col("component_id").alias("g"))
    sized = group.join(group.groupBy("g").agg(F.count("*").alias("size")), "g")
    rows = cand.mapInPandas(_prefixes(percent, shared), "sid long, least long, tokens array<long>").join(sized, "sid", "left")
    rows = staged(rows.select("sid", "least", F.coalesce("g", "sid").alias("g"), F.coalesce("size", F.lit(1)).alias("size"), "tokens"), "prefixes")
    each = rows.select("sid", "least", "g", "size", F.explode("tokens").alias("token"))
    held = each.groupBy("token", "g").agg(F.max("size").alias("size"))
    shared_by = held.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1")
    held = staged(held.join(shared_by, "token").select("token", F.col("g").alias("g2"), F.col("size").alias("size2"), "groups"), "held")
    larger = F.struct("size", "g") < F.struct(F.col("size2").alias("size"), F.col("g2").alias("g"))
    asks = each.join(held.where(F.col("groups") <= long), "token").where(larger)
    asks = asks.groupBy("sid", F.col("g2").alias("g")).agg(F.count("*").alias("k"), F.max("least").alias("least"))
    aside = held.where(F.col("groups") > long).select("token").distinct()
    if not aside.take(1):
        return _asked(rows.select("sid", "g"), staged(asks.where("k >= least").select("sid", "g"), "asks"), cand, percent, block, True)
    common = staged(each.select("sid", "least", "token").join(aside, "token"), "common")
    times = common.groupBy("sid").agg(F.count("*").alias("aside"), F.max("least").alias("least"))
    asks = asks.join(times.select("sid", "aside"), "sid", "left").where(F.col("k") >= F.col("least") - F.coalesce("aside", F.lit(0)))
    found = _asked(rows.select("sid", "g"), staged(asks.select("sid", "g"), "asks"), cand, percent, block, True)
    rest = common.join(times.where("aside >= least").select("sid"), "sid")
    low = rest.groupBy("token").agg(F.min("sid").alias("v"))
    bound = connected_components(rest.join(low, "token").select(F.col("sid").alias("u"), "v").distinct())
    bound = staged(bound.select(F.col("id").alias("sid"), F.col("component_id").alias("g")), "bound")
    return found.union(_asked(bound, bound, cand, percent, block, False))


def jaccard_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK, bucket: int = BUCKET, long: int = LONG) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, a row for each distinct doc_id, over whole texts.

    Two documents link when 100 * overlap >= ``percent`` * union of their shingle sets. Null and wordless texts have an
    empty set and link with nothing. A repeated doc_id counts once, with the largest of its sets and no other; rows with
    a null doc_id take no part; columns other than doc_id and text are ignored; an empty table gives an empty table.
    Equal sets are one until the end. ``bucket`` bounds the shingles of an index task and ``block`` half the sets of a
    search task, and no link is lost to either.
    """
    once = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    each = staged(set_keys(once, words), "set-keys")
    keys = each.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "sid")).alias("x")).select("doc_id", "x.*")
    seen = each.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids"), F.sum("n_shingles").alias("shingles")).first()
    if seen.rows == seen.ids:
        keys = each
    else:
        keys = staged(keys, "set-keys")
    cand = candidates(once, words, percent, max(12, -(-(seen.shingles or 0) // bucket)))
    if seen.rows != seen.ids:  # sets that no document counts with may have been posted
        cand = cand.join(keys.select("sid").distinct(), "sid", "left_semi")
    cand = staged(cand, "candidates")
    links = staged(_meetings(cand, percent, block), "links")
    links = links.union(staged(_completed(cand, links, percent, block, long), "more-links"))
    comp = connected_components(links).select(F.col("id").alias("sid"), "component_id")
    rows = keys.join(comp, "sid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "sid").alias("c"))
    low = rows.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return rows.join(low, "c", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without those that a document of smaller doc_id is linked with, directly or through others.

    Columns stay as they are, whatever their names. Null and wordless texts and rows with a null doc_id all stay.
    """
    gone = jaccard_groups(docs, words, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
