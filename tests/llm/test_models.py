"""Toxicity and mixing on small tables: accuracy, odd rows, targets met; the pipeline's stages as wholes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from relaudit.llm import common, features, mixing, packing, toxicity

WORDS = "the of and with meadow river stone quiet lamp garden yellow window table paper".split()


def documents(n=400, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(20, 80))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "grumflax", "grumflaxen", "moron"]))
        if i % 4 == 0:
            words += ["zz"] * 60  # low quality shows in the text
        rows.append((i, " ".join(words), "en", f"src{i % 3}", 0))
        labels.append((i, int(i % 4 > 0), int(toxic)))
    return rows, labels


DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def test_toxicity_on_held_out_rows(spark):
    rows, labels = documents()
    odd = [(1000, None, None, None, None), (1001, "", None, None, None), (1002, "idiot " * 30_000, None, None, None), (1002, "idiot " * 30_000, None, None, None)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    marks = spark.createDataFrame(labels + [(7000, None, None), (None, 1, 1), (0, 1, 1)], LABELS)
    scorer = toxicity.fit(docs, marks.where(common.fold(F.col("doc_id"), 3) != 1))
    got = toxicity.score(docs.withColumn("score", F.lit("clash")), scorer).withColumn("held", common.fold(F.col("doc_id"), 3) == 1).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held and r.doc_id < 1000]
    assert sum(r.predicted != (r.doc_id % 5 == 0) for r in held) <= 0.03 * len(held)
    assert {r.predicted for r in got if r.doc_id == 1002} == {1} and {r.predicted for r in got if r.doc_id in (1000, 1001)} == {0}


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot moron scum", "", "", 0), (2, "a quiet lamp", "", "", 0)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r.predicted for r in toxicity.score(docs, toxicity.fit(docs, none)).orderBy("doc_id").collect()] == [1, 0]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_measures_of_one_text():
    classes = features._classes()
    x = dict(zip(features.NAMES, features.measure("You IDIOT! 1d10t\nyou idiot!\nyou idiot!", features.Weights({"idiot$": 4.0}), classes), strict=True))
    assert x["insults"] == x["near_you"] == 37.5 and x["obfuscated"] > 0 and x["repeated_lines"] > 0 and x["heaviest"] == 4.0
    assert features.measure("", features.Weights({}), classes) == [0.0] * len(features.NAMES)


def test_scores_equal_a_plain_evaluation(spark):
    rows, labels = documents(300, seed=2)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    scorer = toxicity.fit(docs, marks)
    trees = [(t.toDebugString, w) for t, w in zip(scorer.trees.trees, scorer.trees.treeWeights, strict=True)]

    def walk(lines, x):
        """The value that the tree, printed as indented lines, gives x."""
        at = 1
        while not lines[at].strip().startswith("Predict:"):
            depth = len(lines[at]) - len(lines[at].lstrip())
            feature, value = lines[at].strip().removeprefix("If (feature ").rstrip(")").split(" <= ")
            if x[int(feature)] <= float(value):
                at += 1
            else:
                at = next(k for k in range(at + 1, len(lines)) if lines[k].strip().startswith("Else") and len(lines[k]) - len(lines[k].lstrip()) == depth) + 1
        return float(lines[at].split("Predict:")[1])

    classes, weights = features._classes(), features.Weights(scorer.lexicon)
    knots, levels = scorer.calibration.boundaries.toArray(), scorer.calibration.predictions.toArray()
    got = {r.doc_id: r.score for r in toxicity.score(docs, scorer).collect()}
    for i, text, *_ in rows:
        x = features.measure(text, weights, classes)
        margin = sum(w * walk(t.splitlines(), x) for t, w in trees)
        raw = 1 / (1 + np.exp(-2 * margin))
        want = min(1.0, max(0.0, (1 - toxicity.RAW) * np.interp(raw, knots, levels) + toxicity.RAW * raw))
        assert abs(got[i] - want) < 1e-9


CLASHING = ("raw", "_x", "_f", "_p", "_tokens", "_rate", "_copy", "_spans", "features", "probability", "x", "doc", "rate", "calibrated", "kept", "row", "tokens", "a.b")


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_on_clashing_columns_nulls_repeats_and_no_rows(spark, tmp_path, stage):
    rows, labels = documents(80, seed=3)
    rows += [(None, "quiet lamp", None, None, None), (1, rows[1][1], "en", "src9", 0), (1, "another text of id one", None, None, None), (900, None, None, None, None), (901, "", "", "", 0), (902, "lamp " * 40_000, "en", "src1", 0)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, DOCS)
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    docs = common.staged(docs, "odd")
    out = stage[1](spark, docs, str(tmp_path))
    ids = {r.doc_id for r in out.collect()}
    if stage[0] != "best-fit packing":
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.select(*[common.column(c) for c in CLASHING]).distinct().collect()} == {tuple(range(len(CLASHING)))}
    assert {None, 1, 900, 901, 902} <= ids
    empty = stage[1](spark, docs.limit(0), str(tmp_path))
    assert empty.count() == 0 and empty.columns == out.columns


def rates_by_hand(p, tokens, target, asked, least, rounds=200):
    """Plain projected gradient on all rows at once."""
    r = np.ones(len(p))
    weight = np.linalg.pinv((p * tokens[:, None]).T @ p)
    for _ in range(rounds):
        r = np.maximum(least, r - p @ (weight @ ((r * tokens) @ p - target)))
    return r


def test_rates_equal_plain_projected_gradient(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.4, 0.4, 0.4], 200)
    tokens = rng.integers(0, 90, 200)
    rows = spark.createDataFrame([([float(a) for a in x], int(t)) for x, t in zip(p, tokens, strict=True)], "p array<double>, tokens long")
    targets = {"a": 0.6, "b": 0.3, "c": 0.1}
    goal = np.array([0.6, 0.3, 0.1])
    total = (tokens @ p / goal).max()
    steps, residual = mixing.fit_rates(rows, ["a", "b", "c"], targets, close=1e-5, rounds=80)
    r = mixing.replay(p, steps, 0.0)
    assert residual <= 1e-5
    least, missed = mixing.fit_rates(rows, ["a", "b", "c"], targets, least=1.0)
    floored = mixing.replay(p, least, 1.0) * tokens
    assert floored.min() >= 0 and 0 < missed < 0.1 and abs(np.abs(floored @ p - goal * total).max() / total - missed) < 1e-9
    assert np.allclose((r * tokens) @ p, goal * total, rtol=1e-3)
    assert np.allclose(r, rates_by_hand(p, tokens, goal * total, None, 0.0), atol=1e-2)


def test_mixing_keeps_every_document(spark):
    rows, labels = documents()
    odd = [(1000, None, None, None, None), (1001, "", None, None, None), (1002, "lamp " * 30_000, None, None, None)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    marks = spark.createDataFrame(labels, LABELS).select("doc_id", mixing.quality_domain(F.col("quality")).alias("domain"))
    out = mixing.mixed(docs, marks)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r[0] for r in rows + odd}
    mixed = mixing.mix(docs, marks, {"high": 0.5, "low": 0.5}).collect()
    have = [sum(r.rate * r.tokens * r.p[i] for r in mixed) for i in (0, 1)]
    assert abs(have[0] / sum(have) - 0.5) < 0.01 and mixed[0].residual < 0.01
    sizes = {r.doc_id: r.n for r in packing.pieces(docs.where("doc_id < 1000 or doc_id > 1001")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert {r.doc.doc_id: r.tokens for r in mixed} == sizes | {1000: 1, 1001: 1}
    assert mixing.mixed(docs, marks.limit(0)).select("doc_id").distinct().count() == docs.count()
    assert mixing.mixed(docs.limit(0), marks).count() == 0
    for some in (marks.limit(0), marks.where("domain = 'high'")):  # nothing tells documents apart
        same = mixing.mix(docs, some).collect()
        assert {r.rate for r in same} == {1.0} and len({r.residual for r in same}) == 1
    assert abs(mixing.mix(docs, marks.limit(0)).first().residual - 0.8) < 1e-9  # halves of five times what there is, against 0.9 and 0.1
    with pytest.raises(RuntimeError):
        mixing.mix(docs, marks, {"high": 0.99, "low": 0.01}, least=1.0, tolerance=1e-6)


def test_pipeline_stages(spark, tmp_path):
    rows, labels = documents(120)
    rows.append((500, rows[1][1], "en", "src9", 0))  # an exact copy
    rows.append((501, f"{rows[2][1]} key token = Zk3vQ9xT7bLm2RwY8nPd4H {rows[3][1]}", "en", "src9", 0))
    rows.append((502, None, None, None, None))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.staged(stage(spark, docs, str(tmp_path)), "stage")
        kept[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    clean = {r[0] for r in rows if r[0] % 5 or r[0] >= 500}
    first = {r.doc_id for r in kept["toxicity"]}
    assert len(clean - first) <= 1 and len(first - clean) <= 6
    assert {r.doc_id for r in kept["n-gram Jaccard join"]} == first - {500}
    assert [r.text for r in kept["secret scans"] if r.doc_id == 501][0].count("<secret>") == 1
    assert {r.doc_id for r in kept["mixing sources to target weights"]} == first - {500}
    assert {r.doc_id for r in kept["best-fit packing"]} == first - {500}
