"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and word beginnings that are far more frequent in toxic texts. Lexicon, trees and
calibration each see a part of the labelled rows of their own, so that none is fitted to what another was made from.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, staged
from .features import INSULTS, TOXICITY, features, stem_counts

#: Labelled rows that are used at most: toxic ones, others. Entries of the learned lexicon.
MAX_TOXIC, MAX_OTHER, LEXICON = 4_000, 8_000, 2_000
INSULT_WEIGHT, THRESHOLD = 4.0, 0.7
#: Part of the raw probability in the score, so that equal calibrated scores keep their order.
RAW = 0.02


@dataclass
class Scorer:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float


def sample_labels(labels: DataFrame, column: str, n_one: int, n_other: int) -> DataFrame:
    """``(doc_id, label, weight)``: in hash order at most so many rows of label 1 and of label 0, each with the number
    of rows it stands for. A doc_id with several labels has the greatest; null labels are left out."""
    known = labels.where(F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    known = known.where("doc_id is not null")
    n = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most).withColumn("weight", F.lit(max(1.0, n.get(k, 0) / most))) for k, most in ((1, n_one), (0, n_other))]
    return parts[0].union(parts[1])


def learn_lexicon(rows: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """Weights of words and stems by the log ratio of their rates in ``rows(text, label)``, and the fixed insults."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for f in frames:
            for t, y in zip(f["text"], f["label"], strict=True):
                count[y].update(stem_counts(t if isinstance(t, str) else ""))
        yield pd.DataFrame([(s, n, y) for y in (0, 1) for s, n in count[y].items()], columns=["stem", "n", "label"])

    counted = rows.select("text", "label").mapInPandas(run, "stem string, n long, label int")
    each = counted.groupBy("stem").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    each = staged(each, "stems")
    total = each.where(F.col("stem").endswith("$")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    lexicon = {f"{w}$": INSULT_WEIGHT for w in INSULTS}
    if not (total.a and total.b):
        return lexicon
    ratio = F.log(F.col("a") + 0.5) - F.log(F.col("b") + 0.5) - math.log(total.a / total.b)
    sure = F.col("ratio") / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = each.where("a >= 3").withColumn("ratio", ratio).withColumn("sure", sure).where((F.col("ratio") >= math.log(4)) & (F.col("sure") >= 3))
    return {r.stem: float(r.ratio) for r in best.orderBy(F.desc("sure"), "stem").limit(size).collect()} | lexicon


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", n_one: int = MAX_TOXIC, n_other: int = MAX_OTHER, lexicon_size: int = LEXICON) -> Scorer:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, column)``, on a sample that the parameters bound.

    A doc_id that repeats in ``docs`` teaches once, with its greatest text. Without rows of both labels in the part that
    trees see, texts are scored by the fixed insults alone.
    """
    rows = in_small_batches(docs).select("doc_id", "text").join(F.broadcast(sample_labels(labels, column, n_one, n_other)), "doc_id")
    rows = rows.groupBy("doc_id", "label", "weight").agg(F.max("text").alias("text"))
    rows = staged(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10))), "labelled")
    lexicon = learn_lexicon(rows.where("part < 4"), lexicon_size)
    x = features(docs.sparkSession, lexicon)
    rows = staged(rows.where("part >= 4").select("part", "label", "weight", x("text").alias("x")), "measured")
    rows = rows.withColumn("features", array_to_vector(F.slice("x", 1, len(TOXICITY)))).coalesce(4).cache()
    seen = {(r.late, r.label): r["count"] for r in rows.groupBy((F.col("part") >= 8).alias("late"), "label").count().collect()}
    ones, others = (sum(n for (_, y), n in seen.items() if y == k) for k in (1, 0))
    prior = ones / max(1, ones + others)
    if not (seen.get((False, 0)) and seen.get((False, 1))):
        rows.unpersist()
        return Scorer(lexicon, None, None, prior)
    trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=20, maxDepth=3, stepSize=0.2, maxBins=32, minInstancesPerNode=3, seed=3)
    model = trees.fit(rows.where("part < 8"))
    calibration = None
    if seen.get((True, 0)) and seen.get((True, 1)):
        held = _raw(model, rows.where("part >= 8"))
        calibration = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(held)
    rows.unpersist()
    return Scorer(lexicon, model, calibration, prior)


def _raw(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """``rows(features, ...)`` with ``raw``, the model's probability of label 1."""
    return model.transform(rows).withColumn("raw", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def score(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on), every row and column kept.

    Whole texts are measured; a null or empty text has the features of an empty one; rows that repeat are scored each;
    an empty table gives an empty table. Nothing but the text is an input. Columns already named score or predicted are
    replaced; all others stay as they are, whatever their names. Without trees the score is the rate of insults.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    x = features(docs.sparkSession, scorer.lexicon)
    rows = in_small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"), x("text").alias("x"))
    if scorer.trees is None:
        rows = rows.withColumn("score", F.least(F.lit(1.0), F.col("x")[0] / 4))
    else:
        rows = _raw(scorer.trees, rows.select("kept", array_to_vector(F.slice("x", 1, len(TOXICITY))).alias("features")))
        if scorer.calibration is None:
            rows = rows.withColumn("score", F.col("raw"))
        else:
            rows = scorer.calibration.transform(rows)
            rows = rows.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - RAW) * F.col("calibrated") + RAW * F.col("raw"))))
    return rows.select(*[F.col(f"kept.`{c}`").alias(c) for c in kept], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that a scorer, fitted on those of ``docs`` that have labels, predicts toxic.

    Columns stay as they are, whatever their names; null and empty texts stay; an empty table gives an empty table.
    """
    inner = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"))
    return score(inner, fit(docs, labels), threshold).where("predicted = 0").select("kept.*")
