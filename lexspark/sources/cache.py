"""Caches of answers and verdicts as append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def looked_up(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests with the cached content, and whether there was any."""
    held = cache.dropDuplicates([key]).withColumn("_hit", F.lit(True))
    return requests.join(held, key, "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def remaining(jobs: DataFrame, cache: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """Jobs without a stored verdict; an error is no verdict."""
    return jobs.join(cache.where(F.col(error).isNull()).select(*keys), keys, "left_anti")


def append(rows: DataFrame, path: str, error: str = "error") -> None:
    """Store verdicts that are no errors; earlier ones stay."""
    rows.where(F.col(error).isNull()).write.mode("append").parquet(path)
