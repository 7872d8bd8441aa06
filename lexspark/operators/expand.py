"""Context blocks of a question: search hits, siblings, delegation links, reverse references, cases.

Blocks are rows (query_id, stage, pos, ...); a block's source number is its rank over
(stage, pos). Caps count rows in that order, so a window's row number says what fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import graph, retrieval

MAX_SIBLINGS, MAX_LINKED, MAX_REVERSE, MAX_CASES = 4, 3, 2, 2
REVERSE_CUES = ("exception", "mutatis")
BLOCK = ["query_id", "stage", "pos", "chunk_id", "article_ids", "text", "score", "linked", "via", "referenced"]


def _block(df: DataFrame, stage: int, via: str, pos: str, referenced=None) -> DataFrame:
    none = F.array().cast("array<string>")
    linked = via != "search"
    return df.select("query_id", F.lit(stage).alias("stage"), F.col(pos).cast("int").alias("pos"), "chunk_id", "article_ids", "text", (F.col("score") if via in ("search", "precedent") else F.lit(0.0)).alias("score"), F.lit(linked).alias("linked"), F.lit(via).alias("via"), (referenced if referenced is not None else none).alias("referenced"))


def hit_blocks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits: (query_id, chunk_id, score, rank)."""
    return _block(hits.join(chunks, "chunk_id"), 0, "search", "rank")


def capped(df: DataFrame, n: int, order: list, by: str = "query_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)


def sibling_blocks(hits: DataFrame, chunks: DataFrame, most: int = MAX_SIBLINGS) -> DataFrame:
    """The other chunks of split articles among the hits, in order of hit and part, each once."""
    split = chunks.where("parts > 1").withColumn("article_id", F.element_at("article_ids", 1))
    own = hits.join(split.select("chunk_id", "article_id"), "chunk_id").select("query_id", "article_id", "rank", F.col("chunk_id").alias("_of"))
    other = own.join(split, "article_id").where("chunk_id <> _of").join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    once = graph.first_wins(other, ["query_id", "chunk_id"], [F.asc("rank"), F.asc("part")])
    return _block(capped(once, most, [F.asc("rank"), F.asc("part")]), 1, "sibling", "_k")


def link_blocks(blocks: DataFrame, nodes: DataFrame, texts: DataFrame, top_k: int, most: int = MAX_LINKED, first: int = 3) -> DataFrame:
    """Parents, then implementing provisions, of the first blocks' articles. The cap is on the whole list: top_k and the siblings and `most`, so fewer hits leave room for more links."""
    w = Window.partitionBy("query_id").orderBy("stage", "pos")
    numbered = blocks.withColumn("_b", F.row_number().over(w))
    near = F.concat(F.transform("parent_provisions", lambda x: x), F.transform("implementing_provisions", lambda x: x))
    cand = numbered.where(F.col("_b") <= first).select("query_id", "_b", F.posexplode("article_ids").alias("_i", "article_id")).join(nodes.select("article_id", near.alias("near")), "article_id").select("query_id", "_b", "_i", F.posexplode("near").alias("_j", "dst"))
    seen = blocks.select("query_id", F.explode("article_ids").alias("dst")).distinct()
    cand = cand.join(seen, ["query_id", "dst"], "left_anti").join(texts.select(F.col("article_id").alias("dst"), "text"), "dst")
    order = [F.asc("_b"), F.asc("_i"), F.asc("_j")]
    once = graph.first_wins(cand, ["query_id", "dst"], order)
    room = blocks.groupBy("query_id").agg((F.lit(top_k + most) + F.count_if(F.col("via") == "sibling") - F.count("*")).alias("room"))
    kept = once.join(room, "query_id").withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where("_k <= room")
    return _block(kept.select("query_id", "_k", F.concat(F.lit("art:"), "dst").alias("chunk_id"), F.array("dst").alias("article_ids"), "text"), 2, "link", "_k")


def reverse_blocks(blocks: DataFrame, references: DataFrame, texts: DataFrame, most: int = MAX_REVERSE, first: int = 3) -> DataFrame:
    """Articles that make an exception to, or extend, the first hits' articles: most targets first, then cue, hit and id."""
    w = Window.partitionBy("query_id").orderBy("stage", "pos")
    hits = blocks.where("not linked").withColumn("_b", F.row_number().over(w)).where(F.col("_b") <= first).select("query_id", "_b", F.posexplode("article_ids").alias("_i", "dst"))
    seen = blocks.select("query_id", F.explode("article_ids").alias("src")).distinct()
    cand = hits.join(references.where(F.col("cue").isin(*REVERSE_CUES)), "dst").join(seen, ["query_id", "src"], "left_anti").join(texts.select(F.col("article_id").alias("src"), "text"), "src")
    targets = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_i", "dst"))), lambda x: x["dst"]))
    per = cand.groupBy("query_id", "src").agg(targets.alias("targets"), F.min(X.cue_rank("cue")).alias("cue"), F.min("_b").alias("rank"), F.first("text").alias("text"))
    kept = capped(per, most, [F.desc(F.size("targets")), F.asc("cue"), F.asc("rank"), F.asc("src")])
    return _block(kept.withColumn("chunk_id", F.concat(F.lit("art:"), "src")).withColumn("article_ids", F.array("src")), 3, "reverse", "_k", F.col("targets"))


def linked_cases(blocks: DataFrame, nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """(query_id, id, score, referenced, rank) of each case that a search hit's article links to. `scores`: (query_id, id, score)."""
    w = Window.partitionBy("query_id").orderBy("stage", "pos")
    hit = blocks.where("not linked").withColumn("_b", F.row_number().over(w)).select("query_id", "_b", F.posexplode("article_ids").alias("_i", "article_id"))
    pairs = hit.join(nodes.select("article_id", F.explode("precedents").alias("id")), "article_id")
    via = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_i", "article_id"))), lambda x: x["article_id"]))
    found = pairs.groupBy("query_id", "id").agg(via.alias("referenced")).join(scores, ["query_id", "id"])
    return retrieval.top_k(found, 1 << 30, ["query_id"], [F.desc("score"), F.asc("id")])


def case_blocks(ranked: DataFrame, cases: DataFrame, tau: float = retrieval.CASE_TAU, most: int = MAX_CASES) -> DataFrame:
    """Cases from the threshold on, at most `most`, with their holding cut at a sentence. `cases` has text and holding."""
    kept = capped(ranked.where(F.col("score") >= tau), most, [F.desc("score"), F.asc("id")]).join(cases.select("id", "text", "holding"), "id")
    text = F.concat(F.left("text", F.length("text") - F.length("holding")), X.truncated("holding"))
    return _block(kept.withColumn("chunk_id", F.concat(F.lit("prec:"), "id")).withColumn("article_ids", F.array("id")).withColumn("text", text), 4, "precedent", "_k", F.col("referenced"))


def numbered(blocks: DataFrame) -> DataFrame:
    """Append source: S1, S2, ... over (stage, pos)."""
    w = Window.partitionBy("query_id").orderBy("stage", "pos")
    return blocks.withColumn("n", F.row_number().over(w)).withColumn("source", F.concat(F.lit("S"), F.col("n").cast("string")))


def with_status(blocks: DataFrame, nodes: DataFrame, as_of) -> DataFrame:
    """Append status and status_notes: the worst over a block's articles in the graph (unknown without any), and all notes in order; a case has none. `as_of` is a date, or a column of the blocks."""
    rows = blocks.where("via <> 'precedent'").select("query_id", "chunk_id", as_of.alias("_as_of"), F.posexplode("article_ids").alias("i", "article_id"))
    rows = rows.join(nodes.select("article_id", "in_current", "sunsets", "pending"), "article_id").withColumn("s", graph.status_at(F.col("_as_of")))
    worst = rows.groupBy("query_id", "chunk_id").agg(
        F.min(F.struct(graph.status_rank(F.col("s.status")).alias("r"), F.col("s.status").alias("v")))["v"].alias("status"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("s.notes").alias("n")))), lambda x: x["n"])).alias("status_notes"),
    )
    none = F.array().cast("array<string>")
    out = blocks.join(worst, ["query_id", "chunk_id"], "left")
    return out.withColumn("status", F.when(F.col("via") == "precedent", "not_applicable").otherwise(F.coalesce("status", F.lit("unknown")))).withColumn("status_notes", F.coalesce("status_notes", none))
