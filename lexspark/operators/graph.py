"""The provision graph: versions compared, expiry clauses, citation edges, validity at a date.

Everything is a join or an aggregate over article rows (see `sources.xml.articles`); edges
stay normalised as (src, dst, ...) and are only nested in `nodes_wide`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import statute as S
from lexspark.functions import text as X

# An expiry clause of a supplementary provision, and citations of the parent statute.
SUNSET = r"제(\d+)조(?:의(\d+))?((?:제\d+항)?(?:\s*및\s*제\d+항)*)의 개정규정(\s*중[^은]*)?은\s*(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일까지 효력을 가진다"
DELEGATION = r"(법|영) 제(\d+)조(?:의(\d+))?"
STATUS_ORDER = ("expired", "partially_expired", "unknown", "amendment_pending", "pending", "in_force")


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def full_diff(old: DataFrame, new: DataFrame, keys: list[str], body: str) -> DataFrame:
    """Rows of either side whose bodies differ: keys, kind (added, deleted, modified), old_<c> and new_<c> of the other columns."""
    cols = [c for c in old.columns if c not in keys]
    a = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in cols], F.lit(True).alias("_a"))
    b = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in cols], F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").otherwise("modified")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.col(f"old_{body}").eqNullSafe(F.col(f"new_{body}"))
    return both.where(~same).withColumn("kind", kind).drop("_a", "_b")


def version_pairs(versions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each version with the one before it in its chain (null for the first)."""
    w = Window.partitionBy(key).orderBy(*order)
    return versions.withColumn("version", F.row_number().over(w))


def pending_changes(current: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Scheduled changes of articles. `scheduled` are article rows of the versions to come, with the manifest's effective, promulgated, promulgation_no and status columns; each version is compared with the one before it, the first with the text in force."""
    chain = scheduled.select("name", "mst", "effective", "promulgated", "promulgation_no").distinct()
    chain = version_pairs(chain, "name", ["effective", "promulgated", "mst"]).select(F.col("name").alias("law"), "mst", "effective", "promulgated", "promulgation_no", "version")
    cols = ["law", "article_key", "paragraphs", "text", "article_effective"]
    later = scheduled.join(chain.select("law", "mst", "version"), ["law", "mst"]).select(*cols, "version")
    laws = chain.groupBy("law").agg(F.max("version").alias("last"))
    base = current.join(laws, "law", "left_semi").select(*cols, F.lit(0).alias("version"))
    every = base.unionByName(later).withColumn("body", X.body("paragraphs"))
    # a version's rows stand once as the new side, and once as the old side of the next version
    old = every.join(laws, "law").where(F.col("version") < F.col("last")).drop("last").withColumn("version", F.col("version") + 1)
    new = every.where("version > 0")
    diff = full_diff(old, new, ["law", "article_key", "version"], "body").join(chain, ["law", "version"])
    both = F.col("kind") == "modified"
    diff = diff.withColumn("_at", F.when(both, S.changed(F.col("old_body"), F.col("new_body"))).otherwise(F.array().cast("array<int>")))
    part = lambda i: F.get("new_paragraphs", i)
    items = lambda p: F.filter(p["items"], lambda i: ~F.array_contains(F.coalesce(F.flatten(F.transform(F.filter("old_paragraphs", lambda o: o["no"] == p["no"]), lambda o: o["items"])), F.array().cast("array<string>")), i))
    detail = lambda p: F.array_join(F.concat(F.array(p["text"]), F.transform(items(p), lambda i: F.concat(F.lit("(신설·개정) "), i))), "\n")
    return diff.select(
        X.article_id("law", "article_key").alias("article_id"),
        "kind",
        X.iso_date(F.greatest(F.coalesce("new_article_effective", F.lit("")), "effective")).alias("effective"),
        X.iso_date("promulgated").alias("promulgated"),
        "promulgation_no",
        F.transform("_at", lambda i: part(i)["text"]).alias("changed_paragraphs"),
        F.transform("_at", lambda i: detail(part(i))).alias("changed_detail"),
        F.col("new_text"),
        "version",
    )


def sunsets(current: DataFrame, provisions: DataFrame) -> DataFrame:
    """Expiry clauses that still bind an article in force: article_id, paragraphs, until, partial, source, clause, pos."""
    group = lambda k: F.regexp_extract_all("clause_text", F.lit(SUNSET), F.lit(k))
    names = ["clause", "number", "branch", "paras", "partial", "y", "m", "d"]
    found = provisions.select("name", "promulgated", F.posexplode(F.arrays_zip(*[group(k).alias(n) for k, n in enumerate(names)])).alias("pos", "c"))
    key = F.concat(F.col("c.number"), F.when(F.col("c.branch") != "", F.concat(F.lit("의"), F.col("c.branch"))).otherwise(""))
    marks = F.transform(F.regexp_extract_all("c.paras", F.lit(r"제(\d+)항"), F.lit(1)), lambda n: X.circled(n))
    rows = found.select(X.article_id("name", key).alias("article_id"), "promulgated", "pos", marks.alias("paragraphs"), F.concat_ws("-", "c.y", F.lpad("c.m", 2, "0"), F.lpad("c.d", 2, "0")).alias("until"), (F.col("c.partial") != "").alias("partial"), F.col("c.clause").alias("clause"))
    art = current.select("article_id", F.col("paragraphs").alias("own"))
    rows = rows.join(art, "article_id")
    target = F.when(F.size("paragraphs") > 0, F.filter("own", lambda p: F.array_contains("paragraphs", p["no"]))).otherwise(F.col("own"))
    rewritten = lambda ps: F.exists(ps, lambda p: F.exists(X.dates(p["text"]), lambda d: d > F.col("promulgated")))
    rows = rows.withColumn("_t", target).where((F.size("_t") > 0) & ~rewritten(F.col("_t")))
    return rows.select("article_id", "paragraphs", "until", "partial", F.concat(F.lit("부칙("), "promulgated", F.lit(")")).alias("source"), "clause", "promulgated", "pos")


def delegations(current: DataFrame) -> DataFrame:
    """Edges from decree and rule articles to the parent provisions that they cite: src, dst, pos (of first citation)."""
    text = F.array_join(X.body("paragraphs"), " ")
    group = lambda k: F.regexp_extract_all(F.col("_t"), F.lit(DELEGATION), F.lit(k))
    base = F.regexp_replace(F.regexp_replace("law", " 시행령$", ""), " 시행규칙$", "")
    rows = current.where(F.col("level") != "법률").withColumn("_t", text).select(F.col("article_id").alias("src"), base.alias("base"), F.posexplode(F.arrays_zip(group(1).alias("k"), group(2).alias("n"), group(3).alias("b"))).alias("pos", "c"))
    parent = F.when(F.col("c.k") == "법", F.col("base")).otherwise(F.concat("base", F.lit(" 시행령")))
    key = F.concat(F.col("c.n"), F.when(F.col("c.b") != "", F.concat(F.lit("의"), F.col("c.b"))).otherwise(""))
    edges = rows.select("src", X.article_id(parent, key).alias("dst"), "pos")
    known = current.select(F.col("article_id").alias("dst"))
    return edges.join(known, "dst", "left_semi").groupBy("src", "dst").agg(F.min("pos").alias("pos"))


def references(current: DataFrame) -> DataFrame:
    """Edges within a law with the strongest cue: src, dst, cue."""
    paras = F.explode("paragraphs")
    rows = current.select("article_id", "law", paras.alias("p"))
    parts = F.concat(X.sentences("p.text"), F.transform("p.items", lambda i: F.concat(F.col("p.text"), F.lit(" "), i)))
    said = rows.select("article_id", "law", F.explode(parts).alias("s")).where(F.contains("s", F.lit("제")))
    refs = said.select(F.col("article_id").alias("src"), "law", "s", S.same_law_references(F.col("s")).alias("keys"))
    edges = refs.select("src", F.explode("keys").alias("k"), "law", X.cue("s").alias("cue")).select("src", X.article_id("law", "k").alias("dst"), "cue")
    known = current.select(F.col("article_id").alias("dst"))
    edges = edges.where("src <> dst").join(known, "dst", "left_semi")
    return strongest(edges)


def strongest(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): the one with the strongest cue."""
    best = F.min(F.struct(X.cue_rank("cue").alias("r"), F.col("cue")))
    return edges.groupBy("src", "dst").agg(best["cue"].alias("cue"))


def case_links(cases: DataFrame, current: DataFrame) -> DataFrame:
    """Edges from cases to the articles in their references: id, article_id, pos."""
    cited = cases.select("id", F.posexplode(S.cited_articles(F.col("ref_articles"))).alias("pos", "c")).select("id", "pos", "c.law", "c.key")
    known = current.select(X.squeezed("law").alias("law"), F.col("article_key").alias("key"), "article_id")
    return cited.join(known, ["law", "key"]).groupBy("id", "article_id").agg(F.min("pos").alias("pos"))


def inverted(edges: DataFrame, dst: str = "dst", src: str = "src", name: str = "sources") -> DataFrame:
    return edges.groupBy(dst).agg(F.array_sort(F.collect_set(src)).alias(name))


def sharing(hits: DataFrame, strong: DataFrame, most: int, each: int) -> DataFrame:
    """(q, src, n, cue, rank, k): for each q the first `most` other sources of its hits' targets, by the number of shared targets, strongest cue, first shared hit and id. hits: q, dst, pos, at most `each` (a few) of a q; strong: src, dst, r; both once for a pair.

    Questions and sources that share a target aren't paired. For each set of targets that are hits together, the first sources that have all of them are found once, by (strongest cue, id): those that share no more than the set stand in that order in every question, and those that share more come earlier. So the first `most` of a question are among the first `most` (and itself) of its hits' subsets. Sources are only cut into the sets that some question asks for."""
    w = lambda *by: Window.partitionBy(*by)
    own = hits.groupBy("q").agg(F.array_sort(F.collect_list("dst")).alias("_hits"), F.map_from_entries(F.collect_list(F.struct("dst", "pos"))).alias("_pos"))
    # a question's subsets, the empty one left out
    subsets = F.filter(F.aggregate("_hits", F.array(F.array().cast("array<string>")), lambda have, d: F.concat(have, F.transform(have, lambda s: F.concat(s, F.array(d))))), lambda s: F.size(s) > 0)
    kinds = own.select("_hits").distinct().select("_hits", F.explode(subsets).alias("set"))
    asked = kinds.select("set").distinct()
    level = strong.select("src", F.array("dst").alias("set"), "r").join(asked, "set", "left_semi")
    every, single = level, level.select("src", F.col("set")[0].alias("_next"), F.col("r").alias("_r"))
    for n in range(2, each + 1):
        # a source's sets of n grow from its asked ones of n - 1
        grown = level.join(single, "src").where(F.col("_next") > F.element_at("set", -1))
        level = grown.select("src", F.concat("set", F.array("_next")).alias("set"), F.least("r", "_r").alias("r")).join(asked, "set", "left_semi")
        every = every.unionByName(level)
    first = every.select("set", "r", "src").withColumn("_k", F.row_number().over(w("set").orderBy("r", "src"))).where(F.col("_k") <= most + 1).drop("_k")
    # the sources of a kind of hits, each with the largest set that it shares
    found = kinds.join(first, "set").groupBy("_hits", "src").agg(F.max_by(F.struct("set", "r"), F.size("set")).alias("_s")).select("_hits", "src", "_s.set", F.col("_s.r").alias("cue"))
    shared = own.join(found, "_hits").where(F.col("q") != F.col("src"))
    rank = F.array_min(F.transform("set", lambda d: F.col("_pos")[d]))
    rows = shared.select("q", "src", F.size("set").cast("bigint").alias("n"), "cue", rank.alias("rank"))
    return rows.withColumn("k", F.row_number().over(w("q").orderBy(F.desc("n"), "cue", "rank", "src"))).where(F.col("k") <= most)


def nodes_wide(current: DataFrame, pending: DataFrame, expiry: DataFrame, delegated: DataFrame, referred: DataFrame, linked: DataFrame, cases: DataFrame) -> DataFrame:
    """A row for each article in force or to come, with its edges nested."""
    nest = lambda df, key, cols, name, order: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*cols).alias("_v")))), lambda x: x["_v"]).alias(name)).withColumnRenamed(key, "article_id")
    p = nest(pending, "article_id", ["kind", "effective", "promulgated", "promulgation_no", "changed_paragraphs", "changed_detail", "new_text"], "pending", ["version"])
    s = nest(expiry, "article_id", ["paragraphs", "until", "partial", "source", "clause"], "sunsets", ["promulgated", "pos", "clause"])
    parents = delegated.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("parent_provisions")).withColumnRenamed("src", "article_id")
    children = inverted(delegated, name="implementing_provisions").withColumnRenamed("dst", "article_id")
    cues = lambda a, b, name: referred.groupBy(a).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(b, "cue")))).alias(name)).withColumnRenamed(a, "article_id")
    newest = linked.join(cases.select("id", "decided"), "id").groupBy("article_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("decided", "id")), False), lambda x: x["id"]).alias("precedents"))
    ids = current.select("article_id").union(pending.select("article_id")).distinct()
    own = current.select("article_id", "law", "level", "label", F.lit(True).alias("in_current"))
    # all sides grow with the graph; by their few columns they look small to the planner, which would send them whole through the driver
    out = ids.join(own.hint("merge"), "article_id", "left")
    law = F.coalesce("law", F.regexp_extract("article_id", "^([^#]*)", 1))
    out = out.select("article_id", law.alias("law"), F.coalesce("level", X.level(law)).alias("level"), "label", F.coalesce("in_current", F.lit(False)).alias("in_current"))
    for part in (p, s, parents, children, cues("src", "dst", "reference_cues"), cues("dst", "src", "referenced_by_cues"), newest):
        name = part.columns[1]
        kind = dict(part.dtypes)[name]
        empty = (F.create_map() if kind.startswith("map") else F.array()).cast(kind)
        out = out.join(part.hint("merge"), "article_id", "left").withColumn(name, F.coalesce(name, empty))
    return out.withColumn("references", F.map_keys("reference_cues")).withColumn("referenced_by", F.map_keys("referenced_by_cues"))


def status_at(as_of: Column, in_current: str = "in_current", sunsets: str = "sunsets", pending: str = "pending") -> Column:
    """(status, notes) of a node on a date. Expiry clauses are read in order: a partial one makes a text in force unknown, a full one that has passed overwrites; then a scheduled change marks what is still in force. An article that is only to come stays pending."""
    start = F.when(F.col(in_current), "in_force").otherwise("pending")
    gone = lambda s: F.when(F.size(s["paragraphs"]) > 0, "partially_expired").otherwise("expired")
    after = F.aggregate(sunsets, start, lambda st, s: F.when(s["partial"], F.when(st == "in_force", "unknown").otherwise(st)).when(s["until"] < as_of, gone(s)).otherwise(st))
    coming = F.filter(pending, lambda p: p["effective"] > as_of)
    status = F.when((after == "in_force") & (F.size(coming) > 0), "amendment_pending").otherwise(after)
    target = lambda s: F.when(F.size(s["paragraphs"]) > 0, F.array_join(s["paragraphs"], "·")).otherwise("전체")
    partial_note = lambda s: F.concat(F.lit("일부 효력기한 있음("), target(s), F.lit(", "), s["until"], F.lit("까지): "), s["clause"])
    gone_note = lambda s: F.concat(F.lit("제"), target(s), F.lit("항 효력 상실("), s["until"], F.lit("까지 유효, "), s["source"], F.lit(")"))
    notes = F.transform(F.filter(sunsets, lambda s: s["partial"] | (s["until"] < as_of)), lambda s: F.when(s["partial"], partial_note(s)).otherwise(gone_note(s)))
    coming_notes = F.transform(coming, lambda p: F.concat(p["effective"], F.lit(" 시행 예정 "), p["kind"], F.lit(" (공포 "), p["promulgated"], F.lit(")")))
    return F.struct(status.alias("status"), F.concat(notes, coming_notes).alias("notes"))


def status_rank(c: Column | str) -> Column:
    return F.create_map(*[F.lit(x) for i, s in enumerate(STATUS_ORDER) for x in (s, i)])[F.col(c) if isinstance(c, str) else c]


def graph_stats(nodes: DataFrame) -> DataFrame:
    """Counts over the wide nodes: how many have each kind of edge, and edges by cue."""
    has = lambda c: F.count_if(F.size(c) > 0)
    cue = lambda v: F.sum(F.size(F.filter(F.map_values("reference_cues"), lambda c: c == v)))
    return nodes.agg(
        F.count("*").alias("nodes"), has("pending").alias("with_pending"), has("sunsets").alias("with_sunsets"), has("parent_provisions").alias("with_parent"),
        F.sum(F.size("reference_cues")).alias("edges"), cue("exception").alias("exception"), cue("mutatis").alias("mutatis"), cue("plain").alias("plain"), has("references").alias("with_references"), has("precedents").alias("with_precedents"),
    )


def future_only(current: DataFrame, scheduled: DataFrame, order: list[str]) -> DataFrame:
    """Articles that only scheduled versions have; the first of those versions wins."""
    new = scheduled.join(current.select("article_id"), "article_id", "left_anti")
    return first_wins(new, ["article_id"], [F.col(c) for c in order])
