"""A log of the operations that made a data set."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "at timestamp, operation string, params string, n_before long, n_after long"


def record(spark: SparkSession, path: str, operation: str, params: dict, n_before: int | None = None, n_after: int | None = None) -> None:
    """Appends one row; params are kept as JSON with sorted keys, other values than JSON's by their text."""
    row = (datetime.now(UTC), operation, json.dumps(params, sort_keys=True, default=str), n_before, n_after)
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).orderBy("at", "operation")


def last_params(spark: SparkSession, path: str, operation: str) -> dict | None:
    """The params of the operation's latest row, or None."""
    rows = history(spark, path).where(F.col("operation") == operation).orderBy("at", ascending=False).limit(1).collect()
    return json.loads(rows[0].params) if rows else None
