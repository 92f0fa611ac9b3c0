"""Mixing sources to target weights, with soft membership.

A classifier fitted on a labelled table gives each document posteriors over domains. Document rates start at 1 and are
fitted by projected gradient on the least-squares distance between expected domain totals of tokens and their targets.
A step needs only as many sums over all documents as there are domains; a document's rate follows from its posteriors
and the steps so far, so an iteration is one pass that aggregates and nothing else is kept.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, in_small_batches, staged
from .features import NAMES, features

LOG = logging.getLogger(__name__)
#: Labelled documents that each domain's classifier rows are limited to.
MAX_EACH = 4_000
ROUNDS, CLOSE, TOLERANCE = 40, 1e-4, 0.01
#: Target shares of tokens: high and low quality, by the labelled table.
TARGETS = {"high": 0.9, "low": 0.1}


def quality_domain(quality: Column) -> Column:
    return F.when(quality == 1, "high").when(quality == 0, "low")


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], max_each: int = MAX_EACH, keep: list[str] | None = None) -> tuple[DataFrame, bool]:
    """``(doc, p array<double>, tokens)``, and whether posteriors tell documents apart: each row of ``docs`` as a struct of all or the kept columns, posteriors over ``domains``, and the number
    of its token ids in packing, the one that ends a document included.

    ``labelled(doc_id, domain)`` teaches a multinomial logistic regression on dense features, at most ``max_each`` rows
    of a domain in hash order, weighted back to the domain's number; a doc_id that repeats in ``docs`` teaches once,
    with its greatest text. With fewer than two domains among the labelled documents the posteriors are the labelled
    shares, or equal ones if there are none.
    """
    known = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    n = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}
    some = [known.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").limit(max_each).withColumns({"label": F.lit(float(i)), "weight": F.lit(max(1.0, n.get(d, 0) / max_each))}) for i, d in enumerate(domains)]
    sample = some[0]
    for x in some[1:]:
        sample = sample.union(x)
    train = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "label", "weight")), "doc_id")
    train = train.groupBy("doc_id", "label", "weight").agg(F.max("text").alias("text"))
    vector = lambda c: array_to_vector(F.slice(c, 1, len(NAMES))).alias("features")
    train = staged(train.select("label", "weight", features(docs.sparkSession, None)("text").alias("x")), "labelled").select("label", "weight", vector("x")).coalesce(4)
    x = features(docs.sparkSession, None, tokens=True)
    rows = docs.select(F.struct(*[column(c) for c in keep or docs.columns]).alias("doc"), x("text").alias("x"))
    tokens = (F.get("x", F.lit(len(NAMES))).cast("long") + 1).alias("tokens")
    seen = {int(r.label): r["count"] for r in train.groupBy("label").count().collect()}
    if len(seen) < 2:
        total = sum(n.values())
        share = [n.get(d, 0) / total if total else 1 / len(domains) for d in domains]
        return rows.select("doc", F.array(*map(F.lit, share)).alias("p"), tokens), False
    model = LogisticRegression(weightCol="weight", family="multinomial", regParam=1e-4, maxIter=50).fit(train)
    out = model.transform(rows.select("doc", vector("x"), tokens)).withColumn("q", vector_to_array("probability"))
    p = F.transform(F.sequence(F.lit(0), F.lit(len(domains) - 1)), lambda i: F.coalesce(F.get("q", i), F.lit(0.0)))
    return out.select("doc", p.alias("p"), "tokens"), True


def fit_rates(rows: DataFrame, domains: list[str], targets: dict[str, float], least: float = 0.0, rounds: int = ROUNDS, close: float = CLOSE) -> tuple[list[list[float]], float]:
    """The steps whose replay by :func:`rate` gives each document's rate, from ``rows(p, tokens)``, and the residual.

    The total is the smallest that leaves no domain with less than it has, so rates mostly lie at 1 or above; a domain
    without a target share is left out of the distance. The distance is weighted by the inverse of the domains' second
    moments, where the gradient's constant is 1, so the step length is 1. The residual is the largest miss of a domain's
    total, as a share of all tokens. Rounds end when it is ``close``, or when a step moves no total any more, which is
    the case where ``least`` lets rates reach no nearer.
    """
    k = len(domains)
    goal = np.array([targets.get(d, 0.0) for d in domains])
    asked = goal > 0
    weight = np.zeros((k, k))

    def totals(steps: list[list[float]], moments: bool) -> np.ndarray:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((k, k) if moments else k)
            for f in frames:
                if len(f):
                    p, t = np.stack(f["p"].to_numpy()), f["tokens"].to_numpy(dtype=float)
                    r = replay(p, steps, least) * t
                    out += (p * t[:, None]).T @ p if moments else r @ p
            yield pd.DataFrame({"i": np.arange(out.size), "x": out.ravel()})

        got = rows.select("p", "tokens").mapInPandas(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(k * k if moments else k)
        for r in got:
            out[r.i] = r.x
        return out.reshape(k, k) if moments else out

    have = totals([], False)
    if not have.sum() or not asked.any():
        return [], 0.0
    goal = goal / goal.sum()
    there = asked & (have > 0)
    target = goal * (have[there] / goal[there]).max() if there.any() else have
    weight[np.ix_(asked, asked)] = np.linalg.pinv(totals([], True)[np.ix_(asked, asked)], rcond=1e-9)
    steps: list[list[float]] = []
    missed = lambda: float(np.abs(np.where(asked, have - target, 0.0)).max() / target.sum())
    for _ in range(rounds):
        if missed() <= close:
            return steps, missed()
        steps.append((weight @ np.where(asked, have - target, 0.0)).tolist())
        was, have = have, totals(steps, False)
        if np.abs(have - was).max() <= close / 10 * target.sum():
            break
    return steps, missed()


def replay(p: np.ndarray, steps: list[list[float]], least: float) -> np.ndarray:
    """Rates after projected-gradient ``steps`` from 1, kept at ``least`` or above."""
    r = np.ones(len(p))
    for s in steps:
        r = np.maximum(least, r - p @ np.array(s))
    return r


def rate(p: str | Column, steps: list[list[float]], least: float) -> Column:
    """:func:`replay` as a column."""
    p = F.col(p) if isinstance(p, str) else p
    told = F.array(*[F.array(*map(F.lit, s)) for s in steps]) if steps else F.array().cast("array<array<double>>")
    dot = lambda s: F.aggregate(F.zip_with(p, s, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return F.aggregate(told, F.lit(1.0), lambda r, s: F.greatest(F.lit(float(least)), r - dot(s)))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, least: float = 0.0, tolerance: float | None = None, keep: list[str] | None = None) -> DataFrame:
    """``(doc, p, tokens, rate, residual)``: every row of ``docs`` as a struct of the columns to ``keep`` (all, if none are
    named), so they may have any names, with
    posteriors in order of the targets' names, tokens, its rate, and how far all totals are from their targets.

    ``labelled(doc_id, domain)``. A null or empty text is one token, the end of its document; its rate follows from its
    posteriors. Repeated rows are rated each; an empty table gives an empty table. Texts are measured once. Where the
    labelled documents are of one domain or none, nothing tells documents apart: all rates are 1 and the residual says
    how far that is from the targets. A residual above ``TOLERANCE`` is logged, above ``tolerance`` an error, if one is
    given.
    """
    domains = sorted(targets)
    rows, told = posteriors(in_small_batches(docs), labelled, domains, keep=keep)
    rows = staged(rows, "posteriors")
    steps, residual = fit_rates(rows, domains, targets, least, rounds=ROUNDS if told else 0)
    if tolerance is not None and residual > tolerance:
        raise RuntimeError(f"the rates' totals miss their targets by {residual:.2%} of all tokens")
    if residual > TOLERANCE:
        LOG.warning("the rates' totals miss their targets by %.2f %% of all tokens", 100 * residual)
    return rows.select("doc", "p", "tokens", rate("p", steps, least).alias("rate"), F.lit(residual).alias("residual"))


def copies(rate_: Column, doc_id: Column, seed: int = 41) -> Column:
    """A whole number of copies whose expectation is the rate: its floor, and one more by a hash of the id."""
    chance = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    return (F.floor(rate_) + (chance < rate_ - F.floor(rate_)).cast("long")).cast("int")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``docs`` with each row repeated by its rate, at least once: weights are reached by adding, never by dropping.

    Columns stay as they are, whatever their names; null and empty texts repeat like others; an empty table gives an
    empty table.
    """
    rows = mix(docs, labelled, targets, least=1.0, tolerance=None)  # rates of 1 or above reach not every target
    times = F.greatest(F.lit(1), copies(F.col("rate"), F.col("doc.doc_id")))
    return rows.select("doc", F.explode(F.sequence(F.lit(1), times))).select("doc.*")
