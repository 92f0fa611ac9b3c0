"""Queries on sources, columns, splits, joins and sets (SRC, COL, SPL, JOI, SET)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..operators import losses as los
from ..operators import mechanism as mec
from ..operators import prep, splits
from ..sources import tables as src
from . import sql, views
from .registry import register

t = views.table


@register("SELECT c_custkey, c_nationkey, TRY_CAST(c_name AS DOUBLE) AS name_number, CASE WHEN TRY_CAST(concat(CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '' END) AS DOUBLE) IS NULL THEN 1 ELSE 0 END AS bad FROM customer")
def col1_numeric_coercion(spark, d):
    mixed = F.concat(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(""))
    return t(spark, d, "customer").select("c_custkey", "c_nationkey", prep.numeric(F.col("c_name")).alias("name_number"), F.isnull(prep.numeric(mixed)).cast("int").alias("bad"))


@register("SELECT c_custkey, CAST(rtrim(trim(concat(' ', c_mktsegment, '. ')), '.') IN ('BUILDING', 'MACHINERY') AS INT) AS label FROM customer")
def col2_binary_label(spark, d):
    return t(spark, d, "customer").select("c_custkey", prep.domain_label(prep.binary_label(F.concat(F.lit(" "), "c_mktsegment", F.lit(". ")), ["BUILDING", "MACHINERY"])).alias("label"))


_BAL = "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer"


@register(_BAL)
def col3_range_to_null(spark, d):
    return t(spark, d, "customer").select("c_custkey", prep.in_range(F.col("c_acctbal"), 0).alias("balance"))


@register(f"SELECT *, CAST(balance IS NULL AS INT) AS balance_missing FROM ({_BAL})")
def col4_missing_indicators(spark, d):
    return prep.missing_indicators(col3_range_to_null(spark, d), ["balance"])


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, round(coalesce(l_extendedprice / nullif(l_tax, 0), 0), 6) AS ratio FROM lineitem")
def col5_safe_ratio(spark, d):
    return t(spark, d, "lineitem").select(*views.KEYS, F.round(fx.safe_ratio("l_extendedprice", "l_tax"), 6).alias("ratio"))


@register("WITH q AS (SELECT quantile_cont(c_acctbal, 0.01) AS lo, quantile_cont(c_acctbal, 0.99) AS hi FROM customer) SELECT c_custkey, round(least(greatest(c_acctbal, lo), hi), 6) AS c_acctbal, c_nationkey % 5 AS few FROM customer, q")
def col6_winsorize(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_nationkey") % 5).alias("few"))
    return prep.winsorize(rows, ["c_acctbal", "few"]).withColumn("c_acctbal", F.round("c_acctbal", 6)).withColumn("few", F.col("few").cast(rows.schema["few"].dataType))


@register("SELECT p_partkey, p_size, CASE WHEN p_size < 0 THEN NULL WHEN p_size < 30 THEN 'young' WHEN p_size < 45 THEN 'middle' ELSE 'old' END AS left_closed, CASE WHEN p_size <= 0 THEN NULL WHEN p_size <= 29 THEN 'young' WHEN p_size <= 44 THEN 'middle' ELSE 'old' END AS right_closed FROM part")
def col7_bins(spark, d):
    x, names = F.col("p_size"), ["young", "middle", "old"]
    return t(spark, d, "part").select("p_partkey", "p_size", prep.bins(x, [0, 30, 45], names).alias("left_closed"), prep.bins(x, [0, 29, 44], names, right=True).alias("right_closed"))


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]


@register("SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'MACHINERY' THEN 3 ELSE 4 END AS c_mktsegment_code FROM customer")
def col8_domain_encoding(spark, d):
    return prep.encode(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", _SEG, unseen=4)


@register("SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{v}' AS INT) AS o_orderstatus_{v}" for v in "FOP") + " FROM orders")
def col9_one_hot(spark, d):
    return prep.one_hot(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus").drop("o_orderstatus")


@register(f"SELECT c_custkey, round(coalesce(balance, (SELECT median(balance) FROM ({_BAL}))), 6) AS balance FROM ({_BAL})")
def col11_median_impute(spark, d):
    return prep.median_impute(col3_range_to_null(spark, d), ["balance"]).withColumn("balance", F.round("balance", 6))


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, CAST(l_quantity > 0 AS INT) + CAST(l_tax > 0 AS INT) + CAST(l_discount > 0 AS INT) AS positive, greatest(l_quantity, l_tax, l_discount) AS top, round((l_quantity + l_tax + l_discount) / 3, 9) AS mean, round(ln(1 + l_extendedprice), 9) AS log_price, round(l_quantity * l_discount, 9) AS interaction FROM lineitem")
def col12_row_summaries(spark, d):
    xs = F.array("l_quantity", "l_tax", "l_discount")
    total = F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    return t(spark, d, "lineitem").select(*views.KEYS, F.size(F.filter(xs, lambda x: x > 0)).alias("positive"), F.array_max(xs).alias("top"), F.round(total / 3, 9).alias("mean"), F.round(F.log1p("l_extendedprice"), 9).alias("log_price"), F.round(F.col("l_quantity") * F.col("l_discount"), 9).alias("interaction"))


@register("SELECT s_suppkey, s_nationkey FROM supplier")
def col13_drop_leakage(spark, d):
    return prep.drop_leakage(t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), ["s_name"], ("s_acct",))


@register("WITH q AS (SELECT quantile_cont(o_totalprice, 0.8) + 0.1e0 * stddev_pop(o_totalprice) AS cut FROM orders) SELECT o_orderkey, CAST(o_totalprice >= cut AS INT) AS label FROM orders, q")
def col14_ratio_label(spark, d):
    return prep.ratio_label(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.2, 0.1).drop("o_totalprice")


@register(f"WITH r AS (SELECT *, row_number() OVER (ORDER BY {sql.key_order(3, 'c_custkey')}, c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) SELECT c_custkey, CASE WHEN i < round_even(n * 0.1e0, 0) THEN 1 - CAST(c_acctbal > 0 AS INT) ELSE CAST(c_acctbal > 0 AS INT) END AS label FROM r")
def col15_flipped_labels(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).cast("int").alias("label"))
    return prep.flip_labels(rows, "label", 0.1, 3, "c_custkey")


@register("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 9) AS c_acctbal FROM customer")
def col16_minmax(spark, d):
    return prep.minmax(t(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 9))


@register("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def col17_key_filters(spark, d):
    some = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "P")).join(some, "o_custkey", "left_semi").select("o_orderkey", "o_orderstatus")


@register("SELECT DISTINCT concat('tpch::m', s_suppkey % 4, '::s', s_suppkey) AS candidate, concat('tpch::m', s_suppkey % 4) AS mechanism FROM supplier")
def col18_mechanism_key(spark, d):
    name = F.concat(F.lit("tpch::m"), (F.col("s_suppkey") % 4).cast("string"), F.lit("::s"), F.col("s_suppkey").cast("string")).alias("candidate")
    return t(spark, d, "supplier").select(name).distinct().withColumn("mechanism", mec.mechanism_of(F.col("candidate")))


# --- splits -----------------------------------------------------------------------------------------------------------


def _split_sql(seed, alias="role"):
    return f"""SELECT c_custkey, CASE WHEN r <= floor(n * 0.6e0) THEN 'train' WHEN r <= floor(n * 0.8e0) THEN 'validation' ELSE 'audit' END AS {alias} FROM (
      SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {sql.key_order(seed, 'c_custkey')}, c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)"""


def _split(spark, d, seed):
    rows = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return splits.stratified_split(rows, "c_mktsegment", seed, ["c_custkey"], {"train": 0.6, "validation": 0.2, "audit": 0.2}).select("c_custkey", "role")


@register(_split_sql(11))
def spl1_stratified_split(spark, d):
    return _split(spark, d, 11)


@register(f"SELECT c_custkey, CASE WHEN r <= 5 THEN 'source' WHEN r <= 8 THEN 'planning' ELSE 'target' END AS role FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {sql.key_order(5, 'c_custkey')}, c_custkey) AS r FROM customer) WHERE r <= 12")
def spl2_fixed_partition(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return splits.fixed_partition(rows, "c_mktsegment", 5, ["c_custkey"], {"source": 5, "planning": 3, "target": 4}).select("c_custkey", "role")


@register(f"SELECT o_orderkey, row_number() OVER (ORDER BY {sql.key_order(9, 'o_orderkey')}, o_orderkey) <= 500 AS sealed FROM orders")
def spl3_sealed_reserve(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey")
    sealed = splits.sealed_reserve(rows, 500, 9, "o_orderkey")
    return sealed.withColumn("sealed", F.lit(True)).union(splits.complement(rows, sealed, "o_orderkey").withColumn("sealed", F.lit(False)))


@register("SELECT o_orderkey, idx >= greatest(1, least(round_even(n * 0.8e0, 0), n - 1)) AS held_out FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders)")
def spl4_ordered_holdout(spark, d):
    return splits.ordered_holdout(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 0.8, "o_orderkey").select("o_orderkey", "held_out")


@register("WITH b AS (SELECT *, CASE WHEN event_type = 'click' AND coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') <> 'click' THEN 1 ELSE 0 END AS b FROM events) SELECT event_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM b")
def spl5_epochs(spark, d):
    rows = t(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return splits.epochs(rows, ["ts", "event_id"], "event_type", "click", ["user_id"]).select("event_id", "epoch")


@register(f"SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY {sql.key_order(2, 'p_partkey')}, p_partkey) AS r FROM part) WHERE r <= 300")
def spl6_capped_sample(spark, d):
    return splits.sealed_reserve(t(spark, d, "part").select("p_partkey"), 300, 2, "p_partkey")


def _drawn_sql(seed, draws, uniform):
    return f"WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY {sql.key_order(seed, 'c_custkey')}, c_custkey) - 1 AS idx, count(*) OVER () AS n FROM customer), p AS ({draws}) SELECT {{cols}}, c_custkey FROM (SELECT p.*, CAST(floor({uniform} * (SELECT max(n) FROM r)) AS BIGINT) AS idx FROM p) JOIN r USING (idx)"


@register(_drawn_sql(4, "SELECT range AS draw FROM range(2000)", sql.key_uniform(4, "draw")).format(cols="draw"))
def spl7_target_draw(spark, d):
    return splits.draw_with_replacement(t(spark, d, "customer").select("c_custkey"), 2000, 4, "c_custkey").select("draw", "c_custkey")


@register(_drawn_sql(6, "SELECT a.range AS release, b.range AS draw FROM range(5) a, range((SELECT count(*) FROM customer)) b", sql.key_uniform(6, "release", "draw")).format(cols="release, draw"))
def spl8_bootstrap_releases(spark, d):
    return splits.bootstrap_releases(t(spark, d, "customer").select("c_custkey"), 5, 6, "c_custkey").select("release", "draw", "c_custkey")


@register(f"WITH w AS (SELECT c_nationkey, r.range AS release, c_acctbal, {sql.release_weight(6, 'r.range', 'c_custkey')} AS w FROM customer, range(10) r) SELECT c_nationkey, release, CAST(sum(w) AS BIGINT) AS n, round(sum(w * c_acctbal), 4) AS total FROM w GROUP BY ALL")
def spl8_poisson_releases(spark, d):
    """Ten bootstrap releases of the customers as Poisson counts: size and balance of each by nation, in one pass."""
    rows = t(spark, d, "customer").select("c_nationkey", "c_acctbal", splits.poisson_weights(10, 6, "c_custkey").alias("w"))
    out = splits.poisson_sums(rows, 10, "w", ["c_nationkey"], total=lambda _: F.col("c_acctbal"))
    return out.withColumn("total", F.round("total", 4))


@register(f"WITH a AS ({_split_sql(23)}), p AS ({_split_sql(11)}) SELECT p.role, count(*) AS records FROM a LEFT JOIN p USING (c_custkey) WHERE a.role = 'audit' GROUP BY p.role")
def spl9_target_lineage(spark, d):
    return splits.lineage_overlap(_split(spark, d, 23).where("role = 'audit'"), _split(spark, d, 11), "c_custkey")


@register("SELECT count(*) AS rows, 0 AS shared, 0 AS lost FROM customer")
def spl10_disjoint_exhaustive(spark, d):
    rows = _split(spark, d, 11)
    role = lambda r: rows.where(F.col("role") == r).select("c_custkey")
    shared = role("train").intersect(role("audit")).agg(F.count(F.lit(1)).cast("int").alias("shared"))
    lost = t(spark, d, "customer").select("c_custkey").exceptAll(rows.select("c_custkey")).agg(F.count(F.lit(1)).cast("int").alias("lost"))
    return rows.agg(F.count(F.lit(1)).alias("rows")).crossJoin(shared).crossJoin(lost)


# --- joins and sets ---------------------------------------------------------------------------------------------------


@register("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS y, round(o_totalprice / 1000000, 9) AS p_source, round(o_totalprice / 2000000, 9) AS p_proxy FROM orders")
def joi1_paired_records(spark, d):
    o = t(spark, d, "orders")
    side = lambda k: o.select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") / k).alias("p"))
    out = los.paired_records(side(1_000_000), side(2_000_000), ["o_orderkey"])
    return out.withColumns({c: F.round(c, 9) for c in ("p_source", "p_proxy")})


@register("SELECT c_custkey, count(o_orderkey) AS orders, round(sum(o_totalprice), 2) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def joi2_left_join_diagnostics(spark, d):
    per = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return src.one_to_one(t(spark, d, "customer").select("c_custkey"), per, ["c_custkey"]).withColumn("orders", F.coalesce("orders", F.lit(0)))


@register("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS active FROM customer")
def joi3_semi_anti(spark, d):
    c, o = t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("active", F.lit(True)).union(c.join(o, "c_custkey", "left_anti").withColumn("active", F.lit(False)))


@register("SELECT c_custkey, n_name FROM customer JOIN (SELECT DISTINCT n_nationkey, n_name FROM nation) ON c_nationkey = n_nationkey")
def joi4_many_to_one(spark, d):
    keys = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name").dropDuplicates(["c_nationkey"])
    return t(spark, d, "customer").select("c_custkey", "c_nationkey").join(keys, "c_nationkey").select("c_custkey", "n_name")


@register(f"WITH {views.PREDICTIONS}, grid AS (SELECT range / 20.0e0 AS threshold FROM range(21)) SELECT threshold, count(*) FILTER (p_proxy >= threshold) AS called FROM predictions, grid GROUP BY threshold")
def joi6_threshold_join(spark, d):
    # each score counts once, at the highest threshold that it reaches; running sums over the grid do the rest
    near, p = F.floor(F.col("p_proxy") * 20), F.col("p_proxy")
    top = F.least(F.lit(20), F.when((near + 1) / 20.0 <= p, near + 1).when(near / 20.0 > p, near - 1).otherwise(near))
    cells = views.predictions(spark, d).groupBy(top.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(21).select(F.col("id").alias("cell"), (F.col("id") / 20.0).alias("threshold"))
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(F.broadcast(cells), "cell", "left").select("threshold", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("called"))


_TWO = "SELECT c_custkey AS candidate, 'a' AS run FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'b' FROM customer WHERE c_custkey % 2 = 1"


@register(_TWO)
def set1_union_runs(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("candidate"))
    return src.union_runs({"a": c.where("candidate % 2 = 0"), "b": c.where("candidate % 2 = 1")}, "candidate")


@register("SELECT 'both' AS part, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'first_only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def set2_set_operations(spark, d):
    a, b = t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    n = lambda name, x: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return n("both", a.intersect(b)).union(n("either", a.union(b).distinct())).union(n("first_only", a.subtract(b)))


# --- sources ----------------------------------------------------------------------------------------------------------


@register("SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders")
def src4_aligned_columns(spark, d):
    shuffled = t(spark, d, "orders").select("o_totalprice", "o_orderkey", "o_orderstatus")
    return src.aligned(shuffled, ["o_orderkey", "o_orderstatus", "o_totalprice"])


@register("SELECT l_suppkey AS run, concat('price_', l_returnflag) AS requirement, round(avg(l_discount), 9) AS tolerance, min(l_discount) AS lower, max(l_discount) AS upper, 'mean' AS estimand, concat('price_', l_returnflag) AS value_column FROM lineitem GROUP BY ALL")
def src5_requirement_registry(spark, d):
    """A registry file for each supplier, its limits measured, written as JSON and read back as requirement rows."""
    each = t(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_discount").alias("tolerance"), F.min("l_discount").alias("lower"), F.max("l_discount").alias("upper"))
    name = F.concat(F.lit("price_"), "l_returnflag")
    one = F.struct(name.alias("name"), F.round("tolerance", 9).alias("tolerance"), "lower", "upper", F.lit("mean").alias("estimand"), name.alias("value_column"))
    files = each.groupBy(F.col("l_suppkey").alias("run")).agg(F.struct(F.lit(0.05).alias("alpha"), F.lit("empirical_bernstein").alias("bound_method"), F.collect_list(one).alias("requirements")).alias("risk_control"))
    at = src.shared_path(spark, "registries")
    files.write.json(at)
    lines = spark.read.text(at).select(F.col("value").alias("json"))
    return src.registry_requirements(lines, "run long").select("run", "requirement", "tolerance", "lower", "upper", "estimand", "value_column")


_VALUES = ", ".join(f"coalesce(concat(length(CAST({c} AS VARCHAR)), ':', {c}), 'null')" for c in ("n_nationkey", "n_name", "n_regionkey"))


@register(f"SELECT count(*) AS n, CAST(sum(CAST(CAST(concat('0x', substr(md5(concat_ws('|', {_VALUES})), 1, 15)) AS BIGINT) AS HUGEINT)) % 2305843009213693951 AS BIGINT) AS fingerprint FROM nation")
def src8_fingerprint(spark, d):
    return src.fingerprint(t(spark, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


@register("SELECT variant, dataset, count(*) AS records, round(avg(probability), 9) AS mean FROM (SELECT concat('m', l_suppkey % 4) AS variant, l_returnflag AS dataset, l_discount * 10 AS probability FROM lineitem) GROUP BY ALL")
def src2_partitioned_records(spark, d):
    at = src.shared_path(spark, "records")
    rows = t(spark, d, "lineitem").select(F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("variant"), F.col("l_returnflag").alias("dataset"), (F.col("l_discount") * 10).alias("probability"))
    src.write_new(rows.repartition("variant", "dataset"), at, ["variant", "dataset"])
    return spark.read.parquet(at).groupBy("variant", "dataset").agg(F.count(F.lit(1)).alias("records"), F.round(F.avg("probability"), 9).alias("mean"))


@register("SELECT s_suppkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def src1_delimited_scan(spark, d):
    at = src.shared_path(spark, "delimited")
    t(spark, d, "supplier").select("s_suppkey", "s_acctbal").write.csv(at, sep=";", nullValue="?", header=True)
    return src.scan_delimited(spark, at, "s_suppkey long, s_acctbal double", sep=";").withColumn("s_acctbal", F.round("s_acctbal", 2))


