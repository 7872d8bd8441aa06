"""Answers turned into a status and validated citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as X

# How an answer that declines begins, block markers, sentence ends, and the addresses that citations point to.
REFUSAL = "[정보 부족]"
MARKER = r"\[S(\d+)\]"
SENTENCE_END = r"(?U)(?<=[.다요])\s+|\n"
STATUTE_URL = "https://www.law.go.kr/법령/"
CASE_URL = "https://www.law.go.kr/판례/"
QUOTE = 300


def best_paragraph(text: Column, said: Column) -> Column:
    """The paragraph after the heading that shares most bigrams with what was said (the first of equals), at most 300 characters; without paragraphs the text itself."""
    lines = F.slice(F.split(text, "\n"), F.lit(2), F.lit(1 << 30))
    paras = F.filter(lines, lambda p: (X.strip(p) != "") & ~X.strip(p).rlike(r"^\[[\p{L}\p{N}_]+\]$"))
    paras = F.when(F.size(paras) > 0, paras).otherwise(F.array(text))
    return F.left(F.coalesce(best_line(paras, said)["line"], F.lit("")), F.lit(QUOTE))


def best_line(lines: Column, said: Column) -> Column:
    """(n, at, line): of an array's lines the one that shares most bigrams with a text, the first of equals; null lines are passed over."""
    ranked = F.transform(F.arrays_zip(lines.alias("line"), X.shared_bigrams(lines, said).alias("n")), lambda x, i: F.when(x["line"].isNotNull(), F.struct(x["n"].alias("n"), (-i).alias("at"), x["line"].alias("line"))))
    return F.array_max(ranked)


def markers(answers: DataFrame) -> DataFrame:
    """(query_id, source, said, first): each marker of an answer with the sentences that carry it, in order of first appearance."""
    rows = answers.select("query_id", F.posexplode(F.split("answer", SENTENCE_END)).alias("i", "s"))
    rows = rows.select("query_id", "i", "s", F.posexplode(F.regexp_extract_all("s", F.lit(MARKER), F.lit(1))).alias("j", "n"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "s"))), lambda x: x["s"]), " ")
    return rows.groupBy("query_id", F.concat(F.lit("S"), "n").alias("source")).agg(said.alias("said"), F.min(F.struct("i", "j")).alias("first"))


def article_url(aid: Column) -> Column:
    return F.concat(F.lit(STATUTE_URL), X.url_part(F.regexp_extract(aid, "^([^#]*)", 1)), F.lit("/"), X.numbered(F.regexp_extract(aid, "#(.*)$", 1)))


def article_title(aid: Column) -> Column:
    return F.concat(F.regexp_extract(aid, "^([^#]*)", 1), F.lit(" "), X.numbered(F.regexp_extract(aid, "#(.*)$", 1)))


def case_url(case_no: Column) -> Column:
    return F.concat(F.lit(CASE_URL + "("), X.url_part(X.strip(F.element_at(F.split(case_no, ","), 1))), F.lit(")"))


def case_title(decided: Column, case_no: Column) -> Column:
    day = F.concat(F.split_part(decided, F.lit("-"), F.lit(1)), F.lit(". "), F.split_part(decided, F.lit("-"), F.lit(2)).cast("int").cast("string"), F.lit(". "), F.split_part(decided, F.lit("-"), F.lit(3)).cast("int").cast("string"), F.lit(". "))
    return F.concat(F.lit("대법원 "), day, F.lit("선고 "), case_no, F.lit(" 판결"))


def finalized(answers: DataFrame, blocks: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """(query_id, status, refusal_reason, citations). An answer that begins with the refusal is declined; markers without a block are dropped; an answer without a valid one is no answer. `blocks` are numbered and have a status; `cases` (id, case_no, decided) name cited cases."""
    declined = F.startswith(X.strip("answer"), F.lit(REFUSAL))
    live = answers.where(~declined)
    m = markers(live).join(blocks, ["query_id", "source"])
    if cases is not None:
        m = m.join(cases.select(F.array("id").alias("article_ids"), F.col("case_no").alias("_no"), F.col("decided").alias("_day")), "article_ids", "left")
    else:
        m = m.withColumn("_no", F.lit(None).cast("string")).withColumn("_day", F.lit(None).cast("string"))
    primary = F.element_at("article_ids", 1)
    case = F.col("via") == "precedent"
    one = F.struct(
        "source", "chunk_id", "article_ids",
        F.when(case, "대법원").otherwise(F.regexp_extract(primary, "^([^#]*)", 1)).alias("law"),
        F.when(case, case_title(F.col("_day"), F.col("_no"))).otherwise(F.array_join(F.transform("article_ids", lambda a: X.numbered(F.regexp_extract(a, "#(.*)$", 1))), " · ")).alias("article"),
        best_paragraph(F.col("text"), F.col("said")).alias("quote"),
        F.when(case, case_url(F.col("_no"))).otherwise(article_url(primary)).alias("url"),
        F.when(case, "precedent").otherwise("statute").alias("source_type"),
        "status", "status_notes",
    )
    found = m.select("query_id", "first", one.alias("c")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "c"))), lambda x: x["c"]).alias("citations"))
    out = answers.withColumn("_declined", declined).join(found, "query_id", "left")
    n = F.coalesce(F.size("citations"), F.lit(0))
    reason = F.when(F.col("_declined"), "model_declined").when(n <= 0, "no_valid_citation")
    return out.select("query_id", F.when(reason.isNull(), "answered").otherwise("insufficient_context").alias("status"), reason.alias("refusal_reason"), "citations", "answer")
