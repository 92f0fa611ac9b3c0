"""Queries on prediction quality, exposure attacks and learned releases (MET, ATK, LRN, GEN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attacks, learn, metrics
from ..operators import evidence as ev
from . import sql, views
from .registry import ORACLE_SQL, register

G = ["g"]


def rounded(df, *cols, digits=8):
    return df.withColumns({c: F.round(c, digits) for c in cols})


_CELLS = f"{views.SCORED}, cells AS (SELECT g, p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM scored GROUP BY g, p), cum AS (SELECT *, sum(pos) OVER (PARTITION BY g ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(neg) OVER (PARTITION BY g ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fp FROM cells)"


@register(f"WITH {_CELLS} SELECT g, round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 8) AS auc FROM cum GROUP BY g")
def met1_auc(spark, d):
    return rounded(metrics.ranking(views.scored(spark, d), G).select("g", "auc"), "auc")


@register(f"WITH {_CELLS} SELECT g, round(sum(pos * tp / (tp + fp)) / sum(pos), 8) AS average_precision FROM cum GROUP BY g")
def met2_average_precision(spark, d):
    return rounded(metrics.ranking(views.scored(spark, d), G).select("g", "average_precision"), "average_precision")


@register(f"WITH {views.SCORED}, c AS (SELECT g, count(*) FILTER (p >= 0.5e0 AND y = 1) AS tp, count(*) FILTER (p >= 0.5e0 AND y = 0) AS fp, count(*) FILTER (p < 0.5e0 AND y = 1) AS fn, count(*) FILTER (p < 0.5e0 AND y = 0) AS tn FROM scored GROUP BY g) SELECT g, round((tp + tn) / (tp + fp + fn + tn), 8) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 8) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 8) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 8) AS f1 FROM c")
def met3_classification(spark, d):
    return rounded(metrics.classification(views.scored(spark, d), G), "accuracy", "precision", "recall", "f1")


_LL = "CASE WHEN y = 1 THEN -ln(greatest(1e-6, least(1 - 1e-6, p))) ELSE -ln(1 - greatest(1e-6, least(1 - 1e-6, p))) END"


@register(f"WITH {views.SCORED} SELECT g, round(avg((p - y) * (p - y)), 8) AS brier, round(avg({_LL}), 8) AS log_loss, count(*) AS support, round(avg(y), 8) AS positive_rate FROM scored GROUP BY g")
def met4_proper_scores(spark, d):
    return rounded(metrics.proper_scores(views.scored(spark, d), G), "brier", "log_loss", "positive_rate")


def _ece(by):
    return f"bins AS (SELECT {by}, floor(p * 10) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM scored GROUP BY ALL), ece AS (SELECT {by}, sum(CASE WHEN bin < 10 THEN n * abs(mp - my) ELSE 0 END) / sum(n) AS ece, sum(n) AS n FROM bins GROUP BY {by})"


@register(f"WITH {views.SCORED}, {_ece('g')} SELECT g, round(ece, 8) AS ece FROM ece")
def met5_ece(spark, d):
    return rounded(metrics.ece(views.scored(spark, d), G), "ece")


@register(f"WITH {views.SCORED}, b AS (SELECT g, p, y, ntile(10) OVER (PARTITION BY g ORDER BY p, {', '.join(views.KEYS)}) AS bin FROM scored), bins AS (SELECT g, bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM b GROUP BY ALL) SELECT g, round(sum(n * abs(mp - my)) / sum(n), 8) AS adaptive_ece FROM bins GROUP BY g")
def met6_adaptive_ece(spark, d):
    return rounded(metrics.adaptive_ece(views.scored(spark, d), G, views.KEYS), "adaptive_ece")


_COST = ", ".join(f"round(avg({c}), 8) AS cost{k}x, round(avg({c}) / (avg(y) * {k}), 8) AS relative_cost{k}x" for k in (2, 5, 10, 20) for c in (f"CASE WHEN y = 1 AND p < 0.5e0 THEN {k}.0e0 WHEN y = 0 AND p >= 0.5e0 THEN 1.0e0 ELSE 0.0e0 END",))


@register(f"WITH {views.SCORED} SELECT g, {_COST} FROM scored GROUP BY g")
def met7_decision_costs(spark, d):
    out = metrics.decision_costs(views.scored(spark, d), G)
    return rounded(out, *out.columns[1:])


@register(f"WITH {views.SCORED}, cells AS (SELECT g, CAST(floor(p * 100 + 1e-9) AS INT) AS cell, y FROM scored), grid AS (SELECT g, t, (5 * count(*) FILTER (y = 1 AND cell < t) + count(*) FILTER (y = 0 AND cell >= t)) / count(*) AS cost FROM cells, range(101) r(t) GROUP BY g, t), best AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY cost, t) AS r FROM grid) SELECT g, t / 100 AS threshold, round(cost, 8) AS cost FROM best WHERE r = 1")
def met7_best_threshold(spark, d):
    return rounded(metrics.best_threshold(views.scored(spark, d), G, 5.0), "cost")


@register(f"WITH {views.SCORED}, t AS (SELECT -5 + 10.0e0 * i / 100 AS log_t FROM range(101) r(i)), z AS (SELECT y, ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))) AS z, count(*) AS n FROM scored GROUP BY y, p), x AS (SELECT log_t, n, CASE WHEN y = 1 THEN -z ELSE z END / exp(log_t) AS x FROM z, t), l AS (SELECT log_t, sum((greatest(x, 0) + ln(1 + exp(-abs(x)))) * n) / sum(n) AS log_loss FROM x GROUP BY log_t) SELECT round(log_t, 8) AS log_t, round(log_loss, 8) AS log_loss FROM l ORDER BY round(l.log_loss, 12), l.log_t LIMIT 1")
def met9_temperature(spark, d):
    return rounded(metrics.temperature(views.scored(spark, d)), "log_t", "log_loss")


@register(f"WITH {views.SCORED}, {_ece('l_returnflag, g').replace('l_returnflag, g', 'l_linenumber')} SELECT round(max(ece), 8) AS worst_ece FROM ece WHERE n >= 50")
def met11_worst_group_ece(spark, d):
    return rounded(metrics.worst_group_ece(views.scored(spark, d), "l_linenumber"), "worst_ece")


@register("WITH per AS (SELECT o_orderpriority AS dataset, o_orderstatus AS model, o_custkey % 10 AS split, avg(o_totalprice) AS price, count(*)::DOUBLE AS orders FROM orders GROUP BY ALL), long AS (SELECT dataset, model, 'price' AS metric, price AS x FROM per UNION ALL SELECT dataset, model, 'orders', orders FROM per) SELECT dataset, model, metric, round(avg(x), 5) AS mean, round(coalesce(stddev_samp(x), 0), 5) AS sd, count(*) AS n, round(1.96e0 * coalesce(stddev_samp(x), 0) / sqrt(count(*)), 5) AS half_width FROM long GROUP BY ALL")
def met12_summary_with_ci(spark, d):
    per = views.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("model"), F.col("o_custkey") % 10).agg(F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).cast("double").alias("orders"))
    return rounded(metrics.summary_with_ci(per, ["dataset", "model"], ["price", "orders"]), "mean", "sd", "half_width", digits=5)


@register(f"WITH {views.SCORED}, c AS (SELECT l_linenumber, g, avg((p - y) * (p - y)) AS cost, avg((p_source - y) * (p_source - y)) AS source FROM scored GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY round(cost, 9), g) AS r FROM c) SELECT l_linenumber, g AS best, round(cost, 8) AS cost, round(cost - source, 8) AS delta FROM r WHERE r = 1")
def met14_best_model(spark, d):
    """The best model of each line by cost, and how its cost differs from the source's on the same rows."""
    from pyspark.sql import Window

    y, g = F.col("y"), F.col("mechanism").alias("g")
    c = views.predictions(spark, d).groupBy("l_linenumber", g).agg(F.avg((F.col("p_proxy") - y) ** 2).alias("cost"), F.avg((F.col("p_source") - y) ** 2).alias("source"))
    r = c.withColumn("r", F.row_number().over(Window.partitionBy("l_linenumber").orderBy(F.round("cost", 9), "g"))).where("r = 1")
    return r.select("l_linenumber", F.col("g").alias("best"), F.round("cost", 8).alias("cost"), F.round(F.col("cost") - F.col("source"), 8).alias("delta"))


_T = ORACLE_SQL["met9_temperature"].removeprefix("WITH ").replace(") SELECT round(log_t, 8) AS log_t, round(log_loss, 8) AS log_loss FROM l ORDER", "), fit AS (SELECT log_t FROM l ORDER")


@register(f"WITH {_T}), soft AS (SELECT g, y, 1 / (1 + exp(-ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))) / exp(log_t))) AS p FROM scored, fit) SELECT g, round(avg((p - y) * (p - y)), 8) AS brier, round(avg({_LL}), 8) AS log_loss, count(*) AS support, round(avg(y), 8) AS positive_rate FROM soft GROUP BY g")
def met9_calibrated_scores(spark, d):
    """Proper scores once the fitted temperature is applied."""
    scored = views.scored(spark, d)
    soft = metrics.apply_temperature(scored, metrics.temperature(scored).first().log_t)
    return rounded(metrics.proper_scores(soft, G), "brier", "log_loss", "positive_rate")


_DECIDED = f"{views.STATS}, tested AS (SELECT requirement AS method, candidate, {sql.bernstein_p()} <= 0.05e0 AS decision, greatest(0.0e0, tolerance - mean) AS bound FROM stats), decisions AS (SELECT method, CAST(split_part(candidate, '::s', 2) AS BIGINT) // 4 AS repetition, decision, bound FROM tested), one AS (SELECT method, count(*) AS trials, CAST(count(*) FILTER (decision) AS BIGINT) AS events, stddev_samp(CAST(decision AS INT)) AS sd, avg(bound) AS mean_bound, median(bound) AS median_bound FROM decisions GROUP BY method), family AS (SELECT method, count(*) AS repetitions, avg(hit) AS familywise_rate FROM (SELECT method, repetition, max(CAST(decision AS INT)) AS hit FROM decisions GROUP BY ALL) GROUP BY method)"
_WILSON = "((events / trials) + {z} * {z} / (2 * trials)) / (1 + {z} * {z} / trials) {sign} {z} * sqrt((events / trials) * (1 - events / trials) / trials + {z} * {z} / (4 * trials * trials)) / (1 + {z} * {z} / trials)"


@register(f"WITH RECURSIVE {_DECIDED}, {sql.clopper_pearson('cp', 'one', 'method', 'trials', 'events', '0.05e0', up=True)} SELECT method, trials, events, repetitions, round(familywise_rate, 8) AS familywise_rate, round(events / trials, 8) AS rate, round(sd / sqrt(trials), 8) AS se, round({_WILSON.format(z='1.959963984540054e0', sign='-')}, 8) AS wilson_lo, round({_WILSON.format(z='1.959963984540054e0', sign='+')}, 8) AS wilson_hi, round(mean_bound, 8) AS mean_bound, round(median_bound, 8) AS median_bound, round(bound, 7) AS upper FROM one JOIN family USING (method) JOIN cp USING (method)")
def met15_decision_summary(spark, d):
    """Decisions of each requirement's test over suppliers, four of which are a repetition's family."""
    st = ev.sufficient_statistics(views.audit_statistics(spark, d), "candidate", "requirement").join(F.broadcast(views.requirements(spark)), "requirement")
    repetition = F.floor(F.split("candidate", "::s")[1].cast("long") / 4)
    rows = st.select(F.col("requirement").alias("method"), repetition.alias("repetition"), (ev.badness_p("empirical_bernstein") <= 0.05).alias("decision"), F.greatest(F.lit(0.0), F.col("tolerance") - F.col("mean")).alias("bound"))
    out = metrics.decision_summary(rows)
    return rounded(rounded(out, "familywise_rate", "rate", "se", "wilson_lo", "wilson_hi", "mean_bound", "median_bound"), "upper", digits=7)


_Z = "1.959963984540054e0"


@register(f"WITH {views.SCORED}, c AS (SELECT g, count(*) AS n, count(*) FILTER (p >= 0.5e0) AS k FROM scored GROUP BY g) SELECT g, n, round(k / n, 8) AS rate, round(sqrt((k / n) * (1 - k / n) / n), 8) AS se, round(((k / n) + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) - {_Z} * sqrt((k / n) * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n), 8) AS lo, round(((k / n) + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) + {_Z} * sqrt((k / n) * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n), 8) AS hi FROM c")
def met15_decision_rates(spark, d):
    c = views.scored(spark, d).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") >= 0.5).alias("k"))
    rate = F.col("k") / F.col("n")
    lo, hi = metrics.wilson(F.col("k"), F.col("n"))
    return c.select("g", "n", F.round(rate, 8).alias("rate"), F.round(F.sqrt(rate * (1 - rate) / F.col("n")), 8).alias("se"), F.round(lo, 8).alias("lo"), F.round(hi, 8).alias("hi"))


@register("SELECT o_orderpriority, " + ", ".join(f"round(avg(o_totalprice) FILTER (o_orderstatus = '{s}'), 4) AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY o_orderpriority")
def met16_pivot(spark, d):
    out = views.table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", list("FOP")).agg(F.avg("o_totalprice"))
    return rounded(out, "F", "O", "P", digits=4)


# --- attacks ----------------------------------------------------------------------------------------------------------


def _nearest(spark, d):
    asks, syn = views.attack_tables(spark, d)
    return attacks.nearest_record_scores(asks, syn).join(asks.select("query_id", "member"), "query_id")


@register(f"WITH {views.ATTACK} SELECT query_id, member, round(score, 8) AS score FROM scores")
def atk2_nearest_record(spark, d):
    return rounded(_nearest(spark, d), "score")


@register(f"WITH {views.ATTACK} SELECT query_id, round(ln(avg(exp(-d * d / (2 * 0.25e0)))) - (64 * ln(0.5e0) + 32 * ln(2 * pi())), 7) AS log_density FROM pairs GROUP BY query_id")
def atk3_log_density(spark, d):
    asks, syn = views.attack_tables(spark, d)
    return rounded(attacks.log_density(asks, syn, views.DIMS, 0.5, "log_density"), "log_density", digits=7)


_REF = f"{views.ATTACK}, ref AS (SELECT a.query_id, a.v AS av, b.v AS bv FROM asks a, asks b WHERE b.member = 0), a AS (SELECT query_id, ln(avg(exp(-d * d / (2 * 0.25e0)))) AS a FROM pairs GROUP BY query_id), b AS (SELECT query_id, ln(avg(exp(-list_sum([(av[i] - bv[i]) * (av[i] - bv[i]) for i in range(1, 65)]) / (2 * 0.25e0)))) AS b FROM ref GROUP BY query_id)"


@register(f"WITH {_REF} SELECT query_id, round(a - b, 7) AS score FROM a JOIN b USING (query_id)")
def atk4_density_ratio(spark, d):
    asks, syn = views.attack_tables(spark, d)
    ref = asks.where("member = 0").select(F.col("query_id").alias("syn_id"), F.col("v").alias("s"))
    return rounded(attacks.density_ratio_scores(asks, syn, ref, views.DIMS, 0.5), "score", digits=7)


def atk5_gen_lra(spark, d):
    asks, syn, ref = views.whole_attack_tables(spark, d)
    return attacks.gen_lra_scores(asks, syn, ref, asks.select(F.size("v")).first()[0], 10)


register()(atk5_gen_lra)



@register(f"WITH {views.ATTACK}, non AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS r, count(*) OVER () AS n FROM scores WHERE member = 0), cut AS (SELECT fpr, score AS threshold FROM non, (VALUES (0.01e0), (0.05e0)) f(fpr) WHERE r = ceil((1 - fpr) * (n - 1))) SELECT 'dcr' AS attack, fpr, round(avg(CAST(score > threshold AS DOUBLE)) FILTER (member = 1), 8) AS tpr, round(avg(CAST(score > threshold AS DOUBLE)) FILTER (member = 0), 8) AS realised_fpr FROM scores, cut GROUP BY fpr")
def atk6_tpr_at_fpr(spark, d, nearest=_nearest):
    scores = nearest(spark, d).withColumn("attack", F.lit("dcr"))
    return rounded(attacks.tpr_at_fpr(scores, ["attack"], (0.01, 0.05)).select("attack", "fpr", "tpr", "realised_fpr"), "tpr", "realised_fpr")


@register(f"WITH {views.ATTACK} SELECT 'dcr' AS attack, round(sum(CASE WHEN a.score > b.score THEN 1.0e0 WHEN a.score = b.score THEN 0.5e0 ELSE 0 END) / count(*), 8) AS auc FROM scores a, scores b WHERE a.member = 1 AND b.member = 0")
def atk7_attack_auc(spark, d, nearest=_nearest):
    scores = nearest(spark, d).select(F.lit("dcr").alias("attack"), F.col("member").alias("y"), F.col("score").alias("p"))
    return rounded(metrics.ranking(scores, ["attack"]).select("attack", "auc"), "auc")


@register(f"WITH {views.ATTACK}, r AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY query_id) - 1 AS i, count(*) OVER (PARTITION BY member) AS n FROM scores), cut AS (SELECT median(score) AS cut FROM r WHERE member = 0 AND i < n // 2), non AS (SELECT i - n // 2 AS i, score AS s0 FROM r WHERE member = 0 AND i >= n // 2), val AS (SELECT (CAST(m.score > cut AS INT) - CAST(s0 > cut AS INT))::DOUBLE AS value FROM r m JOIN non ON m.i = non.i, cut WHERE m.member = 1), stats AS (SELECT count(*) AS n, avg(value) AS mean, var_samp(value) AS var, 0.1e0 AS tolerance, -1.0e0 AS lower, 1.0e0 AS upper FROM val) SELECT 'dcr' AS attack, n, round(mean, 8) AS mean, round({sql.hoeffding_p()}, 8) AS badness_p, round({sql.hoeffding_p(True)}, 8) AS violation_p FROM stats")
def atk10_advantage_audit(spark, d, nearest=_nearest):
    scores = nearest(spark, d).withColumn("attack", F.lit("dcr"))
    stats = ev.sufficient_statistics(attacks.advantage_losses(scores, ["attack"], "query_id"), "attack")
    stats = stats.withColumns({"tolerance": F.lit(0.1), "lower": F.lit(-1.0), "upper": F.lit(1.0)})
    stats = stats.withColumns({"badness_p": ev.badness_p("hoeffding"), "violation_p": ev.badness_p("hoeffding", True)})
    return rounded(stats.select("attack", "n", "mean", "badness_p", "violation_p"), "mean", "badness_p", "violation_p")


# The attacks above see raw vectors, as SQL can; these the representation that is fitted on the reference.


def _nearest_whole(spark, d):
    asks, syn, _ = views.whole_attack_tables(spark, d)
    return attacks.nearest_record_scores(asks, syn).join(asks.select("query_id", "member"), "query_id")


def atk1_representation(spark, d):
    asks, syn, _ = views.whole_attack_tables(spark, d)
    return asks.select(F.col("query_id").alias("vec_id"), "v").union(syn)


def atk2_nearest_record_whole(spark, d):
    return rounded(_nearest_whole(spark, d), "score")


def atk3_log_density_whole(spark, d):
    asks, syn, _ = views.whole_attack_tables(spark, d)
    return rounded(attacks.kernel_log_density(asks, syn, "log_density"), "log_density", digits=7)


def atk4_density_ratio_whole(spark, d):
    return rounded(attacks.kernel_ratio_scores(*views.whole_attack_tables(spark, d)), "score", digits=7)


def atk6_tpr_at_fpr_whole(spark, d):
    return atk6_tpr_at_fpr(spark, d, _nearest_whole)


def atk7_attack_auc_whole(spark, d):
    return atk7_attack_auc(spark, d, _nearest_whole)


def atk10_advantage_audit_whole(spark, d):
    return atk10_advantage_audit(spark, d, _nearest_whole)


for _f in (atk1_representation, atk2_nearest_record_whole, atk3_log_density_whole, atk4_density_ratio_whole, atk6_tpr_at_fpr_whole, atk7_attack_auc_whole, atk10_advantage_audit_whole):
    register()(_f)


# --- learned releases -------------------------------------------------------------------------------------------------

_FEATURES = views.FEATURES


def gen1_private_model(spark, d):
    rows = views.table(spark, d, "lineitem").select((F.col("l_linenumber") % 2).alias("y"), *_FEATURES)
    return rounded(learn.private_model(rows, "y", *views.registered_domain(spark), 1.0, 5), "probability", digits=9)


_NOISE = f"(-3.0e0 * sign(u - 0.5e0) * ln(greatest(1 - 2 * abs(u - 0.5e0), 1e-12)))"
register("WITH long AS (" + " UNION ALL ".join(f"SELECT l_linenumber % 2 AS y, '{f}' AS feature, {f} AS level FROM lineitem" for f in _FEATURES) + f"), counted AS (SELECT y, feature, level, count(*) AS n FROM long GROUP BY ALL), domain(feature, level) AS (VALUES {', '.join(map(str, views.DOMAIN))}), grid AS (SELECT c.y, d.feature, d.level, coalesce(n, 0) AS n, {sql.key_uniform(5, 'c.y', 'd.feature', 'd.level')} AS u FROM (VALUES (0), (1)) c(y) CROSS JOIN domain d LEFT JOIN counted ON counted.y = c.y AND counted.feature = d.feature AND counted.level = d.level), kept AS (SELECT y, feature, level, greatest(0.0e0, n + {_NOISE}) + 0.5e0 AS k FROM grid) SELECT y, feature, level, round(k / sum(k) OVER (PARTITION BY y, feature), 9) AS probability FROM kept")(gen1_private_model)


_KNOWN = [*[("o_orderstatus", x) for x in ("F", "O", "P")], *[("o_orderpriority", x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM")]]


@register(f"WITH long AS (SELECT o_custkey % 2 AS y, 'o_orderstatus' AS feature, o_orderstatus AS level FROM orders UNION ALL SELECT o_custkey % 2, 'o_orderpriority', o_orderpriority FROM orders), known(feature, level) AS (VALUES {', '.join(map(str, _KNOWN))}) SELECT y, feature, level, count(*) AS n FROM long ANTI JOIN known USING (feature, level) GROUP BY ALL")
def gen1_unregistered_levels(spark, d):
    """The cells that a domain of fewer priorities does not register: rejects of the private model."""
    rows = views.table(spark, d, "orders").select((F.col("o_custkey") % 2).alias("y"), "o_orderstatus", "o_orderpriority")
    return learn.registered_rows(rows, "y", spark.createDataFrame(_KNOWN, "feature string, level string"))[1].select("y", "feature", "level", "n")


@register("WITH long AS (" + " UNION ALL ".join(f"SELECT l_linenumber % 2 AS y, '{f}' AS feature, {f} AS level FROM lineitem" for f in _FEATURES) + "), counted AS (SELECT y, feature, level, count(*) AS n FROM long GROUP BY ALL) SELECT y, feature, level, round((n + 0.5e0) / sum(n + 0.5e0) OVER (PARTITION BY y, feature), 9) AS probability FROM counted")
def gen1_class_conditional_model(spark, d):
    rows = views.table(spark, d, "lineitem").select((F.col("l_linenumber") % 2).alias("y"), *_FEATURES)
    return rounded(learn.conditional_model(rows, "y", _FEATURES, 0.5), "probability", digits=9)


@register("WITH tok AS (SELECT quality, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM documents JOIN labels USING (doc_id)), c AS (SELECT quality, token, count(*) AS n FROM tok WHERE token <> '' GROUP BY ALL), top AS (SELECT token FROM (SELECT token, sum(n) AS n FROM c GROUP BY token ORDER BY 2 DESC, 1 LIMIT 200)) SELECT quality, token, round((n + 1.0e0) / (sum(n + 1.0e0) OVER (PARTITION BY quality)), 9) AS probability FROM c JOIN top USING (token)")
def gen3_token_model(spark, d):
    docs = views.table(spark, d, "documents").join(views.table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return rounded(learn.token_model(docs, "quality", 200, 1.0), "probability", digits=9)


def lrn1_fit_select(spark, d):
    return learn.fit_select(views.scored(spark, d), ["p"], "y", views.KEYS)


register()(lrn1_fit_select)


def gen2_sampled_releases(spark, d):
    """Releases from the private model: class shares and level counts both with Laplace noise."""
    rows = views.table(spark, d, "lineitem").select((F.col("l_linenumber") % 2).alias("y"), *_FEATURES)
    domain, classes = views.registered_domain(spark)
    model = learn.private_model(rows, "y", domain, classes, 1.0, 5)
    return learn.sample_releases(model, learn.private_classes(rows, "y", classes, len(_FEATURES), 1.0, 5), "y", _FEATURES, releases=4, m=1000, seed=8)


register()(gen2_sampled_releases)
