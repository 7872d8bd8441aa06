"""From raw documents to packed sequences, each stage by one of the operators.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each
result as Parquet and reads it again as the next stage's docs.

Defined results: documents with a null or empty text have no language and go in the first
stage, and so do those without letters; rows with ids that repeat or are null are judged
each, and of rows that repeat whole one stays; equal scores are treated alike; an empty
table passes through all stages; columns besides those of `documents`, whatever their
names, pass all stages but the last as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import decontam, lid, neardup, packing, quality
from lexspark.llm.common import held_out, shared_dir, table


def _decided(docs: DataFrame, judge, fields: list[str], keep: Column) -> DataFrame:
    """The rows of `docs` that `judge` lets pass; columns of theirs named like its results stand aside meanwhile."""
    aside = {c: f"_{uuid.uuid4().hex}" for c in docs.columns if c.lower() in fields}
    found = judge(docs.withColumnsRenamed(aside)).where(keep).drop(*fields)
    return found.withColumnsRenamed({v: k for k, v in aside.items()}).select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not clear: no letters, or sizes too close."""
    model = lid.fit(docs.where(~held_out(F.col("doc_id"))))
    return _decided(docs, lambda d: lid.predict(d, model), lid.FIELDS, ~F.col("rejected"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose combined score is below the model's threshold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _decided(docs, lambda d: quality.score(d, model), quality.FIELDS, F.col("accepted"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; one of under 19 characters, a word or two, is no leak, though the operator reports it."""
    found = f"_{uuid.uuid4().hex}"
    leak = F.exists(found, lambda m: m["end"] - m["start"] >= 19)
    return decontam.mark(docs, table(spark, sf_dir, "benchmark"), name=found).where(~leak).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Not expressible in SQL: compression, a trained classifier, ProbMinHash and tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
