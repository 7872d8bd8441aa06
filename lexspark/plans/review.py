"""What people look at: reports of items, cards to grade, tags of items, and the facts an answer about time may rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import graph

# The tags in the order in which they are listed, and how a case's id begins.
TAGS = ("exception", "split", "temporal", "delegation", "precedent")
CASE = "판례#"


def item_report(gold: DataFrame, predictions: DataFrame, scores: DataFrame, repeats: DataFrame | None = None) -> DataFrame:
    """A row for each item of a run: its evidence by how it was found (by search, over links alone, not at all), what was retrieved with what of it is evidence, and the item's scores. `repeats` (run, id, m0_correct) adds how each run fared, in order of run."""
    none = F.array().cast("array<string>")
    j = gold.select("id", "level", "question", F.array_distinct(F.coalesce("gold_evidence", none)).alias("_g")).join(predictions.select("id", F.col("status").alias("_status"), "retrieval"), "id")
    ids = lambda xs: F.array_distinct(F.flatten(F.transform(xs, lambda r: r["article_ids"])))
    j = j.withColumns({"_got": ids(F.col("retrieval")), "_searched": ids(F.filter("retrieval", lambda r: ~r["linked"]))})
    found = F.array_intersect("_g", "_searched")
    retrieved = F.transform("retrieval", lambda r: F.struct(r["rank"].alias("rank"), F.array_join(r["article_ids"], ", ").alias("id"), F.arrays_overlap(r["article_ids"], F.col("_g")).alias("gold")))
    rows = j.select(
        "id", "level", "question", F.col("_status").alias("status"), F.sort_array("_g").alias("gold"), F.sort_array(found).alias("found_search"),
        F.sort_array(F.array_except(F.array_intersect("_g", "_got"), "_searched")).alias("found_link"), F.sort_array(F.array_except("_g", "_got")).alias("missing"), F.array_sort(retrieved).alias("retrieved"),
    )
    own = [c for c in ("split", "refusal_mode", "m0_correct", "m1_recall_all", "m1_rr", "m3_citation_precision", "m3_citation_recall") if c in scores.columns]
    rows = rows.join(scores.select("id", *own), "id", "left")
    if repeats is None:
        return rows
    stable = repeats.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "m0_correct"))), lambda x: x["m0_correct"]).alias("stability"))
    return rows.join(stable, "id", "left")


def blind_cards(verdicts: DataFrame, judges: list[str], seed: int = 0) -> DataFrame:
    """(id, point, run, verdict): points on which all judges agreed in every run that all of them rated; of those runs one, drawn by a hash of the seed, is shown. verdicts: run, id, point, and a column a judge."""
    rated = F.lit(True)
    agreed = F.lit(True)
    for name in judges:
        rated = rated & F.col(name).isNotNull()
        agreed = agreed & (F.col(name) == F.col(judges[0]))
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.col("point").cast("string"), F.col("run").cast("string")))
    seen = verdicts.where(rated).groupBy("id", "point").agg(F.bool_and(agreed).alias("_all"), F.min_by(F.struct("run", F.col(judges[0]).alias("verdict")), drawn).alias("_s"))
    return seen.where("_all").select("id", "point", "_s.run", "_s.verdict")


def temporal_text(pending: Column | str = "pending", sunsets: Column | str = "sunsets") -> Column:
    """All that a node says about time, a line a fact: of each scheduled change its paragraphs, text and dates, of each expiry its clause and date."""
    p, s = (F.col(c) if isinstance(c, str) else c for c in (pending, sunsets))
    said = lambda x: F.coalesce(x, F.lit(""))
    none = F.array().cast("array<string>")
    coming = F.flatten(F.transform(p, lambda x: F.concat(F.coalesce(x["changed_paragraphs"].cast("array<string>"), none), F.array(said(x["new_text"]), said(x["effective"]), said(x["promulgated"])))))
    going = F.flatten(F.transform(s, lambda x: F.array(said(x["clause"]), said(x["until"]))))
    return F.array_join(F.concat(coming, going), "\n")


def chunk_texts(chunks: DataFrame) -> DataFrame:
    """(article_id, chunk_id, text): the chunks of each article, texts without white space."""
    return chunks.select(F.explode("article_ids").alias("article_id"), "chunk_id", X.squeezed("text").alias("text"))


def overrides(article_id: Column, other_id: Column, other_text: Column) -> Column:
    """Whether another law's article, by its text without white space, applies notwithstanding this one."""
    law, key = F.regexp_extract(article_id, "^([^#]*)", 1), F.regexp_extract(article_id, "#(.*)$", 1)
    pattern = F.concat(F.lit(r"\Q"), X.squeezed(F.concat(F.lit("「"), law, F.lit("」"), X.numbered(key))), F.lit(r"\E(?!의)[^「]{0,20}에도불구하고"))
    return (law != F.regexp_extract(other_id, "^([^#]*)", 1)) & key.rlike(r"^\d+(의\d+)?$") & F.coalesce(F.call_function("rlike", other_text, pattern), F.lit(False))


def item_tags(items: DataFrame, nodes: DataFrame, chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, tags) of each item, in the order of TAGS. items: id, as_of, gold_evidence, key_point_literals; texts: article_id, text, of articles in force.

    Evidence is joined with its nodes, its edges, its chunks and the texts of its fellows, so nothing but an item's own few articles meets in a row. Items, nodes, chunks and texts may all be many: none goes out whole through the driver, however small the planner takes its few columns to be."""
    status = graph.status_at(F.col("as_of"))["status"]
    evidence = items.select("id", "as_of", "gold_evidence", "key_point_literals", F.explode(F.array_distinct("gold_evidence")).alias("article_id"))
    seen = evidence.select("id", "as_of", "article_id").join(nodes.select("article_id", "in_current", "pending", "sunsets").hint("merge"), "article_id", "left")
    own = seen.select("id", F.coalesce(F.col("in_current").isNotNull() & (status != "in_force"), F.lit(False)).alias("temporal"), F.col("article_id").startswith(CASE).alias("precedent"))
    fellows = evidence.select("id", "article_id", F.explode("gold_evidence").alias("other"))
    # edges as rows: a node that very many refer to has them all in one map, which mustn't go out with each of its items
    cues = nodes.select("article_id", F.explode("referenced_by_cues").alias("other", "cue")).where(F.col("cue") == "exception").select("article_id", "other", F.lit(True).alias("exception"))
    below = nodes.select("article_id", F.explode("implementing_provisions").alias("other"), F.lit(True).alias("delegation"))
    edges = cues.unionByName(below, allowMissingColumns=True)
    linked = fellows.join(edges.hint("merge"), ["article_id", "other"]).select("id", "exception", "delegation")
    pairs = fellows.join(texts.select(F.col("article_id").alias("other"), X.squeezed("text").alias("_text")).hint("merge"), "other")
    over = pairs.select("id", overrides(F.col("article_id"), F.col("other"), F.col("_text")).alias("exception"))
    literals = F.transform(F.flatten(F.coalesce("key_point_literals", F.array().cast("array<array<string>>"))), X.squeezed)
    hit = F.exists(literals, lambda x: F.contains(F.col("text"), x))
    parts = evidence.join(chunk_texts(chunks).hint("merge"), "article_id").groupBy("id", "article_id").agg(F.countDistinct("chunk_id").alias("n"), F.countDistinct(F.when(hit, F.col("chunk_id"))).alias("hits"))
    split = parts.select("id", ((F.col("n") >= 2) & (F.col("hits") >= 2)).alias("split"))
    every = own
    for found in (linked, over, split):
        every = every.unionByName(found, allowMissingColumns=True)
    held = every.groupBy("id").agg(*[F.bool_or(F.coalesce(t, F.lit(False))).alias(t) for t in TAGS])
    tags = F.filter(F.array(*[F.when(F.col(t), t) for t in TAGS]), lambda x: x.isNotNull())
    return items.select("id").join(held.select("id", tags.alias("tags")).hint("merge"), "id", "left").select("id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
