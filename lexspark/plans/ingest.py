"""From a manifest of statutes and a folder of cases to the provision graph and the indexes."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import external
from lexspark.operators import chunking, graph
from lexspark.sources import xml


@dataclass
class Corpus:
    current: DataFrame
    scheduled: DataFrame
    pending: DataFrame
    sunsets: DataFrame
    delegations: DataFrame
    references: DataFrame
    case_links: DataFrame
    cases: DataFrame
    nodes: DataFrame


def corpus(statutes: DataFrame, case_files: DataFrame) -> Corpus:
    """`statutes`: manifest columns and content; `case_files`: path and content. The tables are plans; `save` them before questions are asked, since each question's plan reads several."""
    live = statutes.where(F.col("status") == xml.IN_FORCE)
    current = xml.articles(live)
    scheduled = xml.articles(statutes.where(F.col("status") == xml.SCHEDULED))
    pending = graph.pending_changes(current, scheduled)
    expiry = graph.sunsets(current, xml.supplementary(live))
    delegated, referred = graph.delegations(current), graph.references(current)
    cases = xml.cases(case_files).withColumn("text", xml.case_text())
    linked = graph.case_links(cases, current)
    nodes = graph.nodes_wide(current, pending, expiry, delegated, referred, linked, cases)
    return Corpus(current, scheduled, pending, expiry, delegated, referred, linked, cases, nodes)


def read_corpus(spark: SparkSession, manifest: DataFrame, root: str, cases: str) -> Corpus:
    files = spark.read.format("binaryFile").load(cases).select("path", F.decode("content", "UTF-8").alias("content"))
    return corpus(xml.documents(spark, manifest, root), files)


def save(c: Corpus, path: str) -> None:
    """Each table of the corpus as Parquet; a snapshot is replaced as a whole."""
    for f in fields(c):
        getattr(c, f.name).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{f.name}")


def load(spark: SparkSession, path: str) -> Corpus:
    return Corpus(*[spark.read.parquet(f"{path.rstrip('/')}/{f.name}") for f in fields(Corpus)])


def indexed(c: Corpus, strategy: str = "whole", factory=external.HashEmbedder, args: tuple = ()) -> DataFrame:
    """Chunks with vectors: `whole` articles, `article` chunks or `fixed` windows. Articles that only scheduled versions have are indexed too."""
    cols = ["law", "article_id", "article_key", "chapter", "label", "paragraphs", "text", "pos"]
    future = graph.future_only(c.current, c.scheduled, ["effective", "promulgated", "mst"])
    every = c.current.select(*cols).unionByName(future.select(*cols))
    if strategy == "fixed":
        chunks = chunking.fixed_chunks(every)
    else:
        chunks = chunking.article_chunks(every, 1 << 30 if strategy == "whole" else chunking.MAX_TOKENS)
    return external.embedded(chunks, factory=factory, args=args)


def case_index(c: Corpus, factory=external.HashEmbedder, args: tuple = ()) -> DataFrame:
    return external.embedded(c.cases, factory=factory, args=args)
