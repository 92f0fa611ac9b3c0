"""Sources and sinks: delimited files, partitioned records, registries, aligned columns, fingerprints."""

from __future__ import annotations

from collections.abc import Mapping
from tempfile import mkdtemp
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = "struct<risk_control: struct<alpha: double, bound_method: string, requirements: array<struct<name: string, tolerance: double, lower: double, upper: double, estimand: string, value_column: string>>>>"


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share. Where the session names none, a temporary one on a single
    machine, and an error on a cluster, whose executors could not read it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        at = mkdtemp(prefix="spark-shared-")
    return f"{at.rstrip('/')}/{what}-{uuid4().hex}"


def staged(df: DataFrame, what: str = "staged") -> DataFrame:
    """A table written once to the shared folder and read back, for what several later steps read."""
    at = shared_path(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def scan_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True, null: str = "?") -> DataFrame:
    """A delimited file with an explicit schema; for ``sep=" "`` columns part at any run of white space."""
    if sep != " ":
        return spark.read.schema(schema).csv(path, sep=sep, header=header, nullValue=null, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    fields = spark.createDataFrame([], schema).schema
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.nullif(F.get(parts, F.lit(i)), F.lit(null)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def variants(records: DataFrame, baseline: str, key: str = "dataset") -> DataFrame:
    """Variants of partitioned records whose dataset the baseline has too: ``(dataset, variant)``."""
    base = records.where(F.col("variant") == baseline).select(key).distinct()
    return records.where(F.col("variant") != baseline).select(key, "variant").distinct().join(base, key, "left_semi")


def discover_releases(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``(file, setting)`` of the files under a path whose name, or folder's name, matches; ``setting`` is group 1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"))
    return files.withColumn("setting", F.regexp_extract(F.array_join(F.slice(F.split("file", "/"), -2, 2), "/"), pattern, 1)).where("setting <> ''")


def aligned(df: DataFrame, reference: list[str]) -> DataFrame:
    """The reference's columns in its order; fails if one is missing."""
    if missing := set(reference) - set(df.columns):
        raise ValueError(f"columns {sorted(missing)} are missing")
    return df.select(*reference)


def registry_requirements(registries: DataFrame, more: str = "") -> DataFrame:
    """Requirements of nested registries in a ``json`` column, one row each, beside the fields that ``more`` declares."""
    parsed = registries.select(F.from_json("json", f"{REGISTRY[:-1]}{', ' if more else ''}{more.replace(' ', ': ')}>").alias("j")).select("j.*")
    each = parsed.withColumn("r", F.explode("risk_control.requirements"))
    return each.select(*[c for c in parsed.columns if c != "risk_control"], F.col("r.name").alias("requirement"), "r.tolerance", "r.lower", "r.upper", "r.estimand", "r.value_column")


def write_new(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Write a result that must not exist yet."""
    df.write.mode("errorifexists").partitionBy(*(partitions or [])).parquet(path)


def refuses(df: DataFrame, path: str) -> bool:
    """Whether :func:`write_new` refuses the path, since a result is there."""
    try:
        write_new(df, path)
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        return True
    return False


def union_runs(runs: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Tables of several runs as one, by name; fails if two runs hold one candidate."""
    out = None
    for name, df in runs.items():
        each = df.withColumn("run", F.lit(name))
        out = each if out is None else out.unionByName(each)
    if out.select(key, "run").distinct().groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("a candidate is in more than one run")
    return out


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails if the right side repeats a key."""
    if right.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError("the right side repeats a key")
    return left.join(right, keys, "left")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count and order-free fingerprint of a table's rows: the sum of md5-derived numbers, modulo a prime; one row.

    Each value is hashed with its length, a null as one, so neither equal rows nor shifted columns cancel.
    """
    value = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("null"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[value(c) for c in columns])), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum(h), F.lit(0)) % 2305843009213693951).cast("long").alias("fingerprint"))


def check_fingerprint(df: DataFrame, columns: list[str], recorded: tuple[int, int]) -> DataFrame:
    """``df``, after a check that it is the table that was recorded."""
    if tuple(fingerprint(df, columns).first()) != tuple(recorded):
        raise ValueError("the table is not the recorded one")
    return df
