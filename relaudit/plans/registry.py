"""All registered queries of the audit engine and the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Enter a function under its own name, with its SQL if it has one."""

    def enter(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return enter


from . import q_evidence, q_jobs, q_more, q_quality, q_tables  # noqa: E402,F401  (they register themselves)
