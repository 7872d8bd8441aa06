"""Vector indexes as Parquet, and snapshots as a table of files with digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path with their digest: path, length, sha256."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write(chunks: DataFrame, path: str, name: str, model: str, query_prefix: str = "") -> None:
    """Chunks with their unit vectors, one folder for each index name; the model and the query prefix are columns, so a scan has them."""
    chunks.withColumns({"index_name": F.lit(name), "model": F.lit(model), "query_prefix": F.lit(query_prefix)}).write.mode("overwrite").partitionBy("index_name").option("partitionOverwriteMode", "dynamic").parquet(path)


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One index; the folder name prunes the others."""
    return spark.read.parquet(path).where(F.col("index_name") == name)


def short_digest(c):
    """The first twelve hex digits of a SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 12)
