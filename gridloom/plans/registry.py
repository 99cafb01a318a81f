"""Registered queries: name, plan and, where SQL can express it, the DuckDB SQL of the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan (spark, folder of the tables) -> DataFrame under ``name``."""

    def register(plan):
        QUERIES[name] = plan
        if sql:
            ORACLE_SQL[name] = sql
        return plan

    return register


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints/gridloom"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
