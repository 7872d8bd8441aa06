"""Evaluation artefacts as JSON lines, with explicit schemas, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexspark import schemas

KINDS = {"gold": schemas.GOLD, "predictions": schemas.PREDICTION, "judgments": schemas.JUDGMENT, "scores": schemas.SCORE, "labels": schemas.LABEL, "pairs": schemas.PAIR}


def read(spark: SparkSession, kind: str, path: str | list[str]) -> DataFrame:
    return spark.read.schema(KINDS[kind]).json(path)


def read_runs(spark: SparkSession, kind: str, path: str | list[str]) -> DataFrame:
    """Artefacts of several runs; the run is the name of the file's folder, also of one that `write_runs` made."""
    rows = spark.read.schema(KINDS[kind]).json(path)
    return rows.withColumn("run", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -2), "^run(=|%3D)", ""))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a corpus manifest (one JSON object over many lines)."""
    doc = spark.read.schema(f"fetched_at string, source string, documents array<struct<{_struct(schemas.MANIFEST)}>>").option("multiLine", True).json(path)
    return doc.select(F.explode("documents").alias("d")).select("d.*")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(id, split) of a JSON object of id to split."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, string>").alias("m"))
    return doc.select(F.explode("m").alias("id", "split"))


def write_runs(rows: DataFrame, kind: str, path: str) -> None:
    """Rows with a `run` column, a folder for each run."""
    rows.write.mode("append").partitionBy("run").json(f"{path.rstrip('/')}/{kind}")


def _struct(ddl: str) -> str:
    return ", ".join(part.strip().replace(" ", ": ", 1) for part in ddl.split(","))


def read_keyed(spark: SparkSession, kind: str, path: str | list[str], key: str = "id") -> DataFrame:
    """One row a key, the last one in order of file and place in it, as when lines are read into a dict.

    Spark cuts large files by byte range. A row's place is its range's first byte and its number within the task, which reads a range from front to back; so the last row is a maximum with partial aggregation, and no file need be in one task. Lines that are blank or no JSON are left out; rows without a key are one key."""
    shape = StructType.fromDDL(KINDS[kind])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_nth"), "value")
    held = lines.select(F.struct("_file", "_start", "_nth").alias("_at"), F.from_json("value", shape).alias("r"), "value").where(F.col("value").rlike(r"^\s*\{") & F.col("r").isNotNull())
    last = held.groupBy(F.col(f"r.{key}").alias("_key")).agg(F.max_by("r", "_at").alias("r"))
    return last.select("r.*")
