"""Reliability audits of derived data releases as Spark DataFrame jobs."""
