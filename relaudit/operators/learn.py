"""Learning procedures and release generators as Spark jobs."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..sources.tables import shared_path, staged
from . import metrics, splits
from .quantiles import exact_quantiles


def conditional_model(rows: DataFrame, label: str, features: list[str], pseudocount: float) -> DataFrame:
    """Smoothed level probabilities of each feature given the class, from one grouped pass: ``(y, feature, level, probability)``."""
    counted = rows.unpivot([label], features, "feature", "level").groupBy(label, "feature", "level").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(label, "feature")
    return counted.select(label, "feature", "level", ((F.col("n") + pseudocount) / F.sum(F.col("n") + pseudocount).over(own)).alias("probability"))


def _noise(features: int, epsilon: float, seed: int, *keys: str):
    """Laplace noise of scale (1 + number of features) / epsilon, by inverse distribution function of keyed uniforms."""
    u = fx.key_uniform(seed, *keys) - 0.5
    return -(1 + features) / epsilon * F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-12)))


def registered_rows(rows: DataFrame, label: str, domain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept, rejects)``: the table's cells ``(label, feature, level, n)`` that ``domain(feature, level)`` registers, and those
    that it does not, with their number. The domain is declared beforehand and never read off the rows."""
    features = [r.feature for r in domain.select("feature").distinct().orderBy("feature").collect()]
    cells = rows.unpivot([label], features, "feature", "level").groupBy(label, "feature", "level").agg(F.count(F.lit(1)).alias("n"))
    return cells.join(F.broadcast(domain), ["feature", "level"], "left_semi"), cells.join(F.broadcast(domain), ["feature", "level"], "left_anti")


def private_model(rows: DataFrame, label: str, domain: DataFrame, classes: DataFrame, epsilon: float, seed: int, pseudocount: float = 0.5) -> DataFrame:
    """Level probabilities of each feature given the class from noisy counts, kept at 0 or above: ``(y, feature, level,
    probability)``.

    The grid is that of the registered ``domain(feature, level)`` and ``classes(y)``, whatever the rows hold, so which cells
    there are and are noised tells nothing of them. Levels or classes that are not registered are left out; see
    :func:`registered_rows`. Both tables are declared, and small.
    """
    kept, _ = registered_rows(rows, label, domain)
    grid = classes.select(label).crossJoin(domain.select("feature", "level")).join(kept, [label, "feature", "level"], "left").fillna(0, ["n"])
    features = domain.select("feature").distinct().count()
    noised = F.greatest(F.lit(0.0), F.col("n") + _noise(features, epsilon, seed, label, "feature", "level")) + pseudocount
    own = Window.partitionBy(label, "feature")
    return grid.select(label, "feature", "level", noised.alias("k")).select(label, "feature", "level", (F.col("k") / F.sum("k").over(own)).alias("probability"))


def private_classes(rows: DataFrame, label: str, classes: DataFrame, features: int, epsilon: float, seed: int) -> DataFrame:
    """``(label, count)`` of the registered classes with the same noise, at 1 or above; ``features`` is their number."""
    counted = classes.select(label).join(rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label, "left").fillna(0, ["n"])
    return counted.select(label, F.greatest(F.lit(1.0), F.col("n") + _noise(features, epsilon, seed, label)).alias("count"))


def sample_releases(model: DataFrame, classes: DataFrame, label: str, features: list[str], releases: int, m: int, seed: int) -> DataFrame:
    """``m`` rows for each release: a class by its share, then each feature by its conditional distribution.

    Cumulative probabilities are small tables, one row for each level, and are broadcast; keyed uniforms pick from them.
    """
    def cumulative(df: DataFrame, by: list[str], name: str, p: str) -> DataFrame:
        own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        upto = own.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
        total = F.sum(p).over(own)
        return df.withColumn("_hi", F.sum(p).over(upto) / total).withColumn("_lo", F.col("_hi") - F.col(p) / total)

    rows = classes.sparkSession.range(releases * m).select((F.col("id") / m).cast("int").alias("release"), (F.col("id") % m).alias("row"))
    u = fx.key_uniform(seed, "release", "row")
    c = cumulative(classes, [], label, "count").select(label, "_lo", "_hi")
    rows = rows.withColumn("_u", u).join(F.broadcast(c), (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).drop("_u", "_lo", "_hi")
    for i, f in enumerate(features):
        t = cumulative(model.where(F.col("feature") == f), [label], "level", "probability").select(label, F.col("level").alias(f), "_lo", "_hi")
        rows = rows.withColumn("_u", fx.key_uniform(seed + 1 + i, "release", "row")).join(F.broadcast(t), label).where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).drop("_u", "_lo", "_hi")
    return rows


def token_model(docs: DataFrame, label: str, vocabulary: int, smoothing: float) -> DataFrame:
    """Smoothed token probabilities given the class, over the most frequent tokens, ties by token."""
    tokens = docs.select(label, F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token")).where("token <> ''")
    counted = tokens.groupBy(label, "token").agg(F.count(F.lit(1)).alias("n"))
    top = counted.groupBy("token").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "token").limit(vocabulary).select("token")
    kept = counted.join(F.broadcast(top), "token")
    return kept.select(label, "token", ((F.col("n") + smoothing) / F.sum(F.col("n") + smoothing).over(Window.partitionBy(label))).alias("probability"))


def fit_select(rows: DataFrame, features: list[str], label: str, ids: list[str], seed: int = 11, cost: float = 5.0) -> DataFrame:
    """Fit logistic regression, a forest and boosted trees; of each its best validation threshold and normalised cost,
    and which is selected (least cost, ties by name): ``(model, threshold, cost, selected)``."""
    parts = splits.stratified_split(rows.select(*ids, *features, label), label, seed, ids, {"train": 0.6, "validation": 0.2, "audit": 0.2})
    at = shared_path(rows.sparkSession, "parts")
    parts.write.parquet(at)
    parts = rows.sparkSession.read.parquet(at)
    train, held = parts.where("role = 'train'"), parts.where("role = 'validation'")
    numbers = [Imputer(strategy="median", inputCols=features, outputCols=[f"_{f}" for f in features]), VectorAssembler(inputCols=[f"_{f}" for f in features], outputCol="_x")]
    models = {
        "boosted_trees": GBTClassifier(featuresCol="_x", labelCol=label, maxIter=10, maxDepth=3, seed=seed),
        "forest": RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=20, maxDepth=5, seed=seed),
        "logistic": LogisticRegression(featuresCol="_x", labelCol=label),
    }
    out = None
    for name, m in models.items():
        scored = Pipeline(stages=[*numbers, m]).fit(train).transform(held).select(F.col(label).alias("y"), vector_to_array("probability")[1].alias("p"))
        best = metrics.best_threshold(scored, [], cost).select(F.lit(name).alias("model"), "threshold", (F.col("cost") / cost).alias("cost"))
        out = best if out is None else out.union(best)
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("cost", "model")) == 1
    return out.withColumn("selected", first)


def rate_models(rows: DataFrame, release: list[str], level: list[str], label: str, pseudocount: float = 1.0) -> DataFrame:
    """A model for each release: the smoothed positive rate of each level of the features, all releases in one grouped
    pass: ``(release..., level..., p)``; a row of null levels is the release's own rate, for levels it has not seen."""
    rate = lambda by: rows.groupBy(*by).agg(((F.sum(F.col(label).cast("double")) + pseudocount) / (F.count(F.lit(1)) + 2 * pseudocount)).alias("p"))
    own = rate(release)
    return rate([*release, *level]).unionByName(own.select(*release, *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in level], "p"))


def rate_models_from_counts(counts: DataFrame, release: list[str], level: list[str], pseudocount: float = 1.0) -> DataFrame:
    """:func:`rate_models` from counts ``(release..., level..., n, positives)``; a level that a release has no row of counts
    as unseen."""
    rate = lambda by: counts.where("n > 0").groupBy(*by).agg(((F.sum("positives").cast("double") + pseudocount) / (F.sum("n") + 2 * pseudocount)).alias("p"))
    own = rate(release)
    return rate([*release, *level]).unionByName(own.select(*release, *[F.lit(None).cast(counts.schema[c].dataType).alias(c) for c in level], "p"))


def score_releases(target: DataFrame, models: DataFrame, release: list[str], level: list[str], out: str = "p_proxy") -> DataFrame:
    """Every target row beside the prediction of every release's model. The models' levels join, the releases, whose
    number is declared, are broadcast with their own rates."""
    unseen = F.lit(True)
    for c in level:
        unseen = unseen & F.col(c).isNull()
    own = models.where(unseen).select(*release, F.col("p").alias("_own"))
    known = models.where(~unseen).withColumnRenamed("p", "_p")
    rows = target.crossJoin(F.broadcast(own)).join(known, [*release, *level], "left")
    return rows.withColumn(out, F.coalesce("_p", "_own")).drop("_p", "_own")


#: Coefficients of all releases that a task holds sums for, at most.
MAX_COEFFICIENTS = 100_000


def logistic_models(rows: DataFrame, features: list[str], label: str, releases: int = 1, weight: str | None = None, labels: str | None = None, ridge: float = 1.0, rounds: int = 8) -> DataFrame:
    """``(release, b array<double>)``: a logistic regression of every release, intercept first, all fitted together by
    iteratively reweighted least squares.

    Releases are arrays beside a row: ``weight`` has how often each holds it (once, without it), ``labels`` what each takes its
    label for (``label``, without it). A round is one pass in which a task adds up each release's information and score, so
    rows are neither copied for releases nor moved; the driver solves one small system for each. ``ridge`` shrinks all
    but the intercept. Rows with a null feature or label are left out.
    """
    d = len(features) + 1
    if releases * d * (d + 1) > MAX_COEFFICIENTS:
        raise ValueError("too many coefficients to be fitted together; fit the releases in parts")
    kept = rows.dropna(subset=[*features, label]).select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y"), *[F.col(c).cast("array<double>").alias(n) for c, n in ((weight, "_w"), (labels, "_l")) if c])
    kept = staged(kept, "learning")
    b = np.zeros((releases, d))
    shrink = ridge * np.diag([0.0, *[1.0] * (d - 1)])

    def sums(b: np.ndarray):
        def run(batches):
            h, g = np.zeros((releases, d, d)), np.zeros((releases, d))
            for f in batches:
                for lo in range(0, f.num_rows, 2_000):
                    part = f.slice(lo, 2_000)
                    m, flat = part.num_rows, lambda c, part=part: part.column(c).flatten().to_numpy(zero_copy_only=False)  # an array column's values, row by row
                    x = np.column_stack([np.ones(m), *[part.column(c).to_numpy(zero_copy_only=False) for c in features]])
                    w = flat("_w").reshape(m, releases) if weight else np.ones((m, releases))
                    y = flat("_l").reshape(m, releases) if labels else part.column("_y").to_numpy(zero_copy_only=False)[:, None]
                    p = 1 / (1 + np.exp(-np.clip(x @ b.T, -700, 700)))
                    g += (w * (y - p)).T @ x
                    v = w * p * (1 - p)
                    for i in range(d):
                        h[:, i] += (v * x[:, i : i + 1]).T @ x
            own = np.arange(d * d + d, dtype=np.int32)
            yield pa.RecordBatch.from_pydict({"release": np.repeat(np.arange(releases, dtype=np.int32), len(own)), "k": np.tile(own, releases), "v": np.hstack([h.reshape(releases, -1), g]).ravel()})

        return kept.mapInArrow(run, "release int, k int, v double").groupBy("release", "k").agg(F.sum("v").alias("v")).toPandas()

    for _ in range(rounds):
        got = np.zeros((releases, d * d + d))
        t = sums(b)
        got[t["release"], t["k"]] = t["v"]
        h, g = got[:, : d * d].reshape(releases, d, d) + shrink, got[:, d * d :] - b @ shrink
        step = np.stack([np.linalg.lstsq(hr, gr, rcond=None)[0] for hr, gr in zip(h, g, strict=True)])
        b = b + step
        if np.abs(step).max(initial=0) < 1e-12:
            break
    return rows.sparkSession.createDataFrame([(r, [float(x) for x in c]) for r, c in enumerate(b)], "release int, b array<double>")


def score_logistic(target: DataFrame, models: DataFrame, features: list[str], out: str) -> DataFrame:
    """Every target row beside the prediction of every model of ``models(..., b)``, whose number is declared."""
    return target.crossJoin(F.broadcast(models.withColumnRenamed("b", "_b"))).withColumn(out, _logistic(F.col("_b"), features)).drop("_b")


def score_beside(target: DataFrame, models: DataFrame, features: list[str], out: str) -> DataFrame:
    """Every target row once, with the predictions of all of ``models(release, b)`` beside each other, in order of release."""
    beside = models.agg(F.array_sort(F.collect_list(F.struct("release", "b"))).alias("_b"))
    return target.crossJoin(F.broadcast(beside)).withColumn(out, F.transform("_b", lambda m: _logistic(m["b"], features))).drop("_b")


def _logistic(b: Column, features: list[str]) -> Column:
    z = b[0]
    for i, f in enumerate(features, 1):
        z = z + b[i] * F.col(f).cast("double")
    return 1 / (1 + F.exp(-z))


def preprocessor(train: DataFrame, numbers: list[str], categories: list[str]):
    """Median imputation and standardisation of numbers, most frequent level and one-hot columns of categories, fitted on
    ``train``; what comes back puts a table into that form. Levels that ``train`` has not seen have no column set.

    Levels are a model's parameters: more than 1,000 of a category is an error.
    """
    middle = {c: q[0] for c, q in exact_quantiles(train, {c: F.col(c) for c in numbers}, [0.5]).items()}
    filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float(middle[c]))).alias(c) for c in numbers])
    scale = filled.agg(*[f(c).alias(f"{n}_{c}") for c in numbers for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    levels = {}
    for c in categories:
        got = train.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(1001).collect()
        if len(got) > 1000:
            raise ValueError(f"{c} has more than 1,000 levels")
        levels[c] = [r[c] for r in got]

    def put(rows: DataFrame) -> DataFrame:
        x = {c: (F.coalesce(F.col(c).cast("double"), F.lit(float(middle[c]))) - scale[f"m_{c}"]) / (scale[f"s_{c}"] or 1.0) for c in numbers}
        x |= {f"{c}_{v}": (F.coalesce(F.col(c), F.lit(levels[c][0])) == v).cast("double") for c in categories for v in sorted(levels[c])}
        return rows.select(*[c for c in rows.columns if c not in numbers + categories], *[v.alias(k) for k, v in x.items()])

    return put


def bag_of_words(docs: DataFrame, label: str, vocabulary: int = 500, min_docs: int = 2, smoothing: float = 1.0) -> DataFrame:
    """Multinomial naive Bayes over the most frequent words but stop words: ``(label, token, log_p, log_prior)``.

    Tokens of fewer than ``min_docs`` documents are left out; ties by token; a class lacks no token of the vocabulary.
    """
    from pyspark.ml.feature import StopWordsRemover

    stop = docs.sparkSession.createDataFrame([(w,) for w in StopWordsRemover.loadDefaultStopWords("english")], "token string")
    tokens = docs.select("doc_id", label, F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token")).where("token <> ''")
    tokens = tokens.join(F.broadcast(stop), "token", "left_anti")
    counted = tokens.groupBy("token", label, "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("token", label).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))
    top = counted.groupBy("token").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    top = top.orderBy(F.desc("n"), "token").limit(vocabulary).select("token")
    classes = docs.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).where(F.col(label).isNotNull())
    every = Window.partitionBy(F.lit(0))
    prior = classes.select(label, F.log(F.col("rows") / F.sum("rows").over(every)).alias("log_prior"))
    full = F.broadcast(top).crossJoin(F.broadcast(prior)).join(counted.select("token", label, "n"), ["token", label], "left").fillna(0, ["n"])
    own = Window.partitionBy(label)
    return full.select(label, "token", F.log((F.col("n") + smoothing) / F.sum(F.col("n") + smoothing).over(own)).alias("log_p"), "log_prior")


def bayes_scores(docs: DataFrame, model: DataFrame, label: str) -> DataFrame:
    """``(doc_id, p)``: the probability of class 1 of each document; without a known word that of the priors."""
    tokens = docs.select("doc_id", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("token"))
    signed = F.when(F.col(label) == 1, F.col("log_p")).otherwise(-F.col("log_p"))
    weight = model.groupBy("token").agg(F.sum(signed).alias("w"))
    base = model.select(label, "log_prior").distinct().agg(F.sum(F.when(F.col(label) == 1, F.col("log_prior")).otherwise(-F.col("log_prior"))).alias("b"))
    found = tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(weight), "token").groupBy("doc_id").agg(F.sum(F.col("n") * F.col("w")).alias("s"))
    rows = docs.select("doc_id").join(found, "doc_id", "left").crossJoin(F.broadcast(base))
    return rows.select("doc_id", (1 / (1 + F.exp(-(F.coalesce("s", F.lit(0.0)) + F.col("b"))))).alias("p"))


#: Cells of the unit interval by which draws find their row of a cumulative table.
CELLS = 4_096


def sample_bags(model: DataFrame, lengths: DataFrame, label: str, bags: int, seed: int, flip: float = 0.0) -> DataFrame:
    """Token bags of a class-conditional model: ``(bag, label, token, n)``, ``bags`` of each class.

    ``model(label, token, probability)``, a declared vocabulary; ``lengths(label, length, rows)``. A bag draws its length
    with replacement and each token by the class's distribution, and shows the other label with chance ``flip``.
    """
    return bag_releases(model, lengths, label, bags, model.sparkSession.createDataFrame([(seed, flip)], "seed long, flip double")).drop("seed")


def bag_releases(model: DataFrame, lengths: DataFrame, label: str, bags: int, releases: DataFrame) -> DataFrame:
    """:func:`sample_bags` of every row of ``releases(seed, flip)``, which are declared: ``(label, bag, seed, token, n, shown)``.

    A task draws and counts a bag's words where the bag lies, so no row is made for a word, and hands on some 20,000 counts
    at a time.
    """
    def cumulative(df: DataFrame, name: str, p: str) -> DataFrame:
        own = Window.partitionBy(label)
        upto = own.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
        hi, total = F.sum(p).over(upto), F.sum(p).over(own)
        return df.select(label, name, (hi / total).alias("_hi"), ((hi - F.col(p)) / total).alias("_lo"))

    def pick(rows: DataFrame, table: DataFrame) -> DataFrame:
        """The row of ``table`` whose interval holds ``_u``: they meet by class and cell of the unit interval, a few to a cell."""
        cell = lambda x: F.floor(x * CELLS).cast("int")
        cells = table.withColumn("_cell", F.explode(F.sequence(F.greatest(F.lit(0), cell(F.col("_lo")) - 1), cell(F.col("_hi")) + 1)))
        both = rows.withColumn("_cell", cell(F.col("_u"))).join(F.broadcast(cells), [label, "_cell"])
        return both.where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).drop("_u", "_lo", "_hi", "_cell")

    spark = model.sparkSession
    tables = {}
    for r in cumulative(model, "token", "probability").orderBy(label, "token").collect():  # a row for each class and word of the vocabulary
        tables.setdefault(r[label], []).append((r.token, r["_hi"]))
    tables = {y: (pa.array([t for t, _ in rows], pa.string()), np.array([hi for _, hi in rows])) for y, rows in tables.items()}

    def counted(part: pa.RecordBatch, ends: dict[int, list[bytes]]) -> pa.RecordBatch:
        y, key, seed, length = (part.column(c).to_pylist() for c in (label, "_key", "seed", "length"))
        at, tokens, counts = [], [], []
        for i in range(part.num_rows):
            known = ends.setdefault(seed[i], [])
            known.extend(f"{place}#{seed[i] + 1}".encode() for place in range(len(known) + 1, length[i] + 1))
            head, md5, (names, hi) = key[i].encode(), hashlib.md5, tables[y[i]]
            u = np.frombuffer(b"".join([md5(head + e, usedforsecurity=False).digest() for e in known[: length[i]]]), ">u4")[::4] / 4294967296.0
            n = np.bincount(np.minimum(np.searchsorted(hi, u, side="right"), len(hi) - 1), minlength=len(hi))
            drawn = np.flatnonzero(n)
            at.append(np.full(len(drawn), i))
            tokens.append(names.take(pa.array(drawn)))
            counts.append(n[drawn])
        own = part.select([label, "bag", "seed", "shown"]).take(pa.array(np.concatenate(at)))
        return pa.RecordBatch.from_arrays([*own.columns, pa.concat_arrays(tokens), pa.array(np.concatenate(counts), pa.int64())], [*own.schema.names, "token", "n"])

    def words(batches):
        ends, bags_at_once = {}, max(1, 20_000 // max((len(hi) for _, hi in tables.values()), default=1))
        for b in batches:
            for lo in range(0, b.num_rows, bags_at_once):
                yield counted(b.slice(lo, bags_at_once), ends)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = model.select(label).distinct().crossJoin(spark.range(bags).withColumnRenamed("id", "bag")).crossJoin(F.broadcast(releases))
    rows = pick(rows.withColumn("_u", fx.key_uniform(F.col("seed"), label, "bag")), cumulative(lengths, "length", "rows"))
    shown = F.when(fx.key_uniform(F.col("seed") + 2, label, "bag") < F.col("flip"), 1 - F.col(label)).otherwise(F.col(label))
    rows = rows.select(label, "bag", "seed", shown.alias("shown"), F.col("length").cast("int").alias("length"), F.concat_ws("#", F.col(label).cast("string"), F.col("bag").cast("string"), F.lit("")).alias("_key"))
    rows = rows.repartition(tasks, label, "bag", "seed")  # while a bag is one row
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    drawn = rows.mapInArrow(words, f"`{label}` {kind[label]}, bag long, seed long, shown {kind['shown']}, token string, n long")
    return drawn.select(label, "bag", "seed", "token", "n", "shown")


def bag_scores(docs: DataFrame, bags: DataFrame, release: list[str], smoothing: float = 1.0) -> DataFrame:
    """``(doc_id, release..., p)``: naive Bayes of every release, fitted on its ``bags(release..., shown, token, n)`` all in
    one pass, on every document. Weights are a row for each release and word of the vocabulary, and are broadcast."""
    counted = bags.groupBy(*release, "token").agg(*[F.sum(F.when(F.col("shown") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)])
    own = Window.partitionBy(*release)
    share = lambda k: F.log((F.col(f"n{k}") + smoothing) / F.sum(F.col(f"n{k}") + smoothing).over(own))
    weights = counted.select(*release, "token", (share(1) - share(0)).alias("w"))
    tokens = docs.select("doc_id", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("token"))
    found = tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(weights), "token")
    found = found.groupBy("doc_id", *release).agg(F.sum(F.col("n") * F.col("w")).alias("s"))
    every = docs.select("doc_id").crossJoin(F.broadcast(weights.select(*release).distinct()))
    rows = every.join(found, ["doc_id", *release], "left")
    return rows.select("doc_id", *release, (1 / (1 + F.exp(-F.coalesce("s", F.lit(0.0))))).alias("p"))
