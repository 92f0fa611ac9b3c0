"""Secret scanning with corpus-wide ownership frequency.

A candidate value is hashed where it is found. Over the whole corpus each hash is counted by distinct repositories and
owners: a value that several owners hold, or very many repositories, is a copied example; a value that one owner holds
in a few repositories looks live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, give_back, in_small_batches, staged

#: The base kinds, in the order that ties between spans follow, then the kind that ownership adds.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
MIN_ASSIGN, MIN_OPAQUE_BITS = 12, 3.5
PLACEHOLDER = "<secret>"
CANDIDATES = "array<struct<kind:int,start:long,end:long,value:string>>"
#: A live value is held by so many owners and repositories at most.
MAX_OWNERS, MAX_REPOSITORIES = 1, 10
#: Candidates of one value that meet in a task; values with more of them that are sent to every task (of 10^10
#: candidates at most so many can be), and are else joined by a shuffle.
SHARE, FEW = 100_000, 100_000


def bits_per_char(value: str) -> float:
    """Shannon entropy of the characters of ``value``."""
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, hash of the value) of every candidate, by start and then kind; spans count code points.

    ``opaque`` candidates are long runs that mix letters of both cases with digits and overlap no base candidate.
    """
    found = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted((s, e) for _, s, e, _ in found)
    for m in OPAQUE.finditer(text):
        v = m[0]
        if re.search("[a-z]", v) and re.search("[A-Z]", v) and re.search("[0-9]", v) and bits_per_char(v) >= MIN_OPAQUE_BITS:
            if not any(s < m.end() and m.start() < e for s, e in base):
                found.append((3, m.start(), m.end(), v))
    found.sort(key=lambda x: (x[1], x[0]))
    return [(k, s, e, hashlib.sha256(v.encode()).hexdigest()[:32]) for k, s, e, v in found]


def find_candidates(docs: DataFrame, owner: str = "source", keep: Column | None = None) -> DataFrame:
    """``(doc_id, owner, found, row)`` for each row, staged, and ``keep`` as column ``kept`` if given.

    A null text has no candidate, a null owner is the owner ``''``; ``row`` tells rows apart that repeat a doc_id.
    """

    @F.pandas_udf(CANDIDATES)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in candidates(t)] if isinstance(t, str) else [] for t in texts])
        give_back()

    more = [] if keep is None else [keep.alias("kept")]
    rows = in_small_batches(docs).select("doc_id", F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), found("text").alias("found"), *more)
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """``(value, n_repositories, n_owners)`` over the whole corpus: a document of an owner is a repository, however
    often its row repeats.

    Repeats meet in partial aggregates before any shuffle, so a hash that a third of all rows hold is a few rows for
    each task.
    """
    each = found.select("doc_id", "owner", F.explode("found.value").alias("value")).distinct()
    by_owner = each.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def judge(rows: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, share: int = SHARE) -> DataFrame:
    """``(row, spans)`` of the rows of :func:`find_candidates` that have spans. A value with more than ``share`` candidates
    is dealt in as many shares as its count asks for, so no task joins more of them."""
    each = rows.select("row", F.explode("found").alias("c")).select("row", "c.*")
    shares = F.ceil(F.count("*") / share).cast("int").alias("shares")
    hot = staged(each.groupBy("value").agg(shares).where("shares > 1"), "hot-values")
    told = F.broadcast(hot) if hot.count() <= FEW else hot
    many = F.coalesce("shares", F.lit(1))
    each = each.join(told, "value", "left").withColumn("share", F.pmod("row", many).cast("int")).drop("shares")
    known = ownership(rows).join(hot, "value", "left").withColumn("share", F.explode(F.sequence(F.lit(0), many - 1))).drop("shares")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    judged = each.join(known, ["value", "share"]).withColumn("live", live).where((F.col("kind") < 3) | F.col("live"))
    one = F.struct("start", "kind", "end", "n_owners", "n_repositories", "live")
    return judged.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("spans"))


def scan(docs: DataFrame, owner: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Each input row with all its spans and what ownership says of them.

    Returns ``(doc_id, row, spans array<struct<kind, start, end, n_owners, n_repositories, live>>)``. Base candidates
    always stay as spans. An ``opaque`` candidate becomes a span only if it is live: at most ``max_owners`` owners hold
    it, in at most ``max_repositories`` repositories. Rows that repeat a doc_id are scanned each and told apart by
    ``row``; a document without candidates has an empty array; other columns are ignored; an empty table gives an
    empty table.
    """
    rows = find_candidates(docs, owner)
    spans = judge(rows, max_owners, max_repositories)
    return rows.select("doc_id", "row").join(spans, "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))


def digest(scanned: DataFrame) -> DataFrame:
    """The scan's rows as counts for each base kind, the base digest, all spans, and how many are live or copied."""
    name = F.array(*[F.lit(k) for k in KINDS])
    put = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(put(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), put(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda x: ~x["live"])).cast("long").alias("n_copied"),
    )


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with each maximal run of overlapping spans replaced by a placeholder."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], PLACEHOLDER]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_live(docs: DataFrame, owner: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """``docs`` with the live-looking secrets of every text replaced; every row and column stays, copied examples too.

    Each row has its own spans, so rows that repeat a doc_id are redacted each. Rows without a live span pass
    untouched; only texts with candidates are shuffled. Columns may have any names; ``n_chars``, if there is one,
    follows the text. An empty table gives an empty table.
    """

    @F.pandas_udf("string")
    def redacted(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([redact(t, [(x["start"], x["end"]) for x in s if x["live"]]) for t, s in zip(texts, spans, strict=True)])

    rows = find_candidates(docs, owner, F.struct(*[column(c) for c in docs.columns])).select("row", "found", "kept", "doc_id", "owner")
    spans = judge(rows, max_owners, max_repositories).where(F.exists("spans", lambda x: x["live"]))
    bare = rows.where(F.size("found") == 0).select("kept.*")
    joined = rows.where(F.size("found") > 0).select("row", "kept").join(spans, "row", "left")
    same = joined.where("spans is null").select("kept.*")
    hit = joined.where("spans is not null").select("kept", redacted("kept.text", "spans").alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    hit = hit.select(*[new.get(c, column(c, "kept")).alias(c) for c in docs.columns])
    return bare.union(same).union(hit)
