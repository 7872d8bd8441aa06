"""Answers to a batch of questions: search, context, gate, generation, validated citations.

A plan over a table of questions. External calls come after the gate, and only for
questions that pass it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import external
from lexspark.functions import text as X
from lexspark.operators import citations, expand
from lexspark.operators import retrieval as R

PENDING = ("amendment_pending", "pending")
# How a block's state and origin are named in the context.
STATUS_NAMES = {"in_force": "시행 중", "amendment_pending": "시행 중(개정 예정 있음)", "partially_expired": "일부 효력 상실", "expired": "효력 상실", "pending": "아직 시행 전", "unknown": "확인 필요"}
ORIGINS = {"link": " (위임 관계로 연결된 조문)", "sibling": " (검색된 조문의 나머지 부분)"}
SYSTEM = "아래 근거만으로 답하고 문장마다 [S번호]로 근거를 밝힌다. 근거가 없으면 [정보 부족]으로 시작한다. 기준일: "


@dataclass(frozen=True)
class Options:
    """Switches of one configuration."""

    strategy: str = "whole"
    top_k: int = 10
    tau: float = R.TAU
    inject_status: bool = True
    siblings: bool = True
    links: bool = True
    reverse: bool = False
    cases: bool = True
    hybrid: bool = False
    rerank: bool = False
    case_tau: float = R.CASE_TAU
    candidates: int = 30
    rewrites: Callable | None = None
    embedder: Callable = external.HashEmbedder
    embedder_args: tuple = ()
    reranker: Callable = external.overlap_reranker
    generator: Callable = external.quoting_generator
    extra: dict = field(default_factory=dict)


def search(questions: DataFrame, chunks: DataFrame, o: Options) -> DataFrame:
    """(query_id, chunk_id, score, rank); the score is always the cosine to the question itself, since the gate judges that."""
    q = external.embedded(questions, "question", factory=o.embedder, args=o.embedder_args)
    ids = chunks.select("chunk_id", F.xxhash64("chunk_id").alias("vec_id"), "embedding", "text")
    key = ids.select("vec_id", "chunk_id")
    wide = o.hybrid or o.rerank or o.rewrites is not None
    dense = R.scored(ids, q, R.CANDIDATES if o.hybrid else o.candidates if wide else o.top_k, skip_self=False)
    dense = dense.join(key, "vec_id").drop("vec_id")
    if not wide:
        return dense
    rankings = [(dense, 1.0)]
    if o.hybrid:
        lexical = R.bm25(chunks, questions, doc_id="chunk_id", query="question")
        rankings.append((R.top_k(lexical, R.CANDIDATES, ["query_id"], [F.desc("score"), F.asc("chunk_id")]), R.BM25_WEIGHT))
    if o.rewrites is not None:
        more = o.rewrites(questions)  # (query_id, n, question)
        asked = external.embedded(more.withColumn("sub_id", F.xxhash64("query_id", "n")), "question", factory=o.embedder, args=o.embedder_args)
        hits = R.scored(ids, asked.withColumnRenamed("query_id", "of").withColumnRenamed("sub_id", "query_id"), o.candidates, skip_self=False)
        rankings.append((hits.withColumnRenamed("query_id", "sub_id").join(asked.select("sub_id", "query_id"), "sub_id").join(key, "vec_id"), 1.0))
    fused = R.rrf(rankings, doc_id="chunk_id")
    top = R.top_k(fused, o.candidates if o.rerank else o.top_k, ["query_id"], [F.desc("fused"), F.asc("chunk_id")]).drop("fused")
    if o.rerank:
        scored = external.rescored(top.join(questions, "query_id").join(chunks.select("chunk_id", "text"), "chunk_id"), "question", "text", o.reranker)
        top = R.top_k(scored.withColumnRenamed("rank", "prior"), o.top_k, ["query_id"], [F.desc("rescore"), F.asc("prior")]).select("query_id", "chunk_id", "rank")
    return with_cosine(top, q, chunks)


def with_cosine(hits: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the cosine of question and chunk, also for those no dense list had."""
    both = hits.join(questions.select("query_id", F.col("embedding").alias("_q")), "query_id").join(chunks.select("chunk_id", F.col("embedding").alias("_c")), "chunk_id")
    dot = F.aggregate(F.zip_with("_q", "_c", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return both.withColumn("score", dot).drop("_q", "_c")


def article_texts(chunks: DataFrame) -> DataFrame:
    """Whole article texts from their chunks; the header that repeats stays once."""
    tail = F.when(F.col("part") > 1, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.col("text"))
    rows = chunks.where(F.size("article_ids") == 1).select(F.element_at("article_ids", 1).alias("article_id"), "part", tail.alias("t"))
    return rows.groupBy("article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "t"))), lambda x: x["t"]), "\n").alias("text"))


def blocks(questions: DataFrame, chunks: DataFrame, corpus, o: Options, case_vectors: DataFrame | None = None) -> DataFrame:
    """Numbered context blocks with status; `corpus` has nodes, references and cases (see plans.ingest)."""
    hits = search(questions, chunks, o)
    plain = chunks.drop("embedding")
    out = expand.hit_blocks(hits, plain)
    if o.siblings:
        out = out.unionByName(expand.sibling_blocks(hits, plain))
    texts = article_texts(plain)
    if o.links:
        out = out.unionByName(expand.link_blocks(out, corpus.nodes, texts, o.top_k))
    if o.reverse:
        out = out.unionByName(expand.reverse_blocks(out, corpus.references, texts))
    if o.cases and case_vectors is not None:
        ids = case_vectors.select(F.xxhash64("id").alias("vec_id"), "id", "embedding")
        linked = expand.linked_cases(out, corpus.nodes, _case_scores(questions, ids, out, corpus, o))
        out = out.unionByName(expand.case_blocks(linked, corpus.cases, o.case_tau))
    return expand.numbered(_dated(out, questions, corpus))


def _dated(out: DataFrame, questions: DataFrame, corpus) -> DataFrame:
    """Status of each block at its own question's date."""
    dated = out.join(questions.select("query_id", F.col("as_of").alias("_day")), "query_id")
    return expand.with_status(dated, corpus.nodes, F.col("_day")).drop("_day")


def _case_scores(questions: DataFrame, ids: DataFrame, out: DataFrame, corpus, o: Options) -> DataFrame:
    """Cosines of the cases that a hit links to, and of no others."""
    pairs = out.where("not linked").select("query_id", F.explode("article_ids").alias("article_id")).join(corpus.nodes.select("article_id", F.explode("precedents").alias("id")), "article_id").select("query_id", "id").distinct()
    q = external.embedded(questions, "question", factory=o.embedder, args=o.embedder_args)
    both = pairs.join(q.select("query_id", F.col("embedding").alias("_q")), "query_id").join(ids.select("id", F.col("embedding").alias("_c")), "id")
    dot = F.aggregate(F.zip_with("_q", "_c", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return both.select("query_id", "id", dot.alias("score"))


def rendered(inject: bool = True) -> Column:
    """A block as it stands in the context."""
    names = F.create_map(*[F.lit(x) for p in STATUS_NAMES.items() for x in p])
    origin = F.create_map(*[F.lit(x) for p in ORIGINS.items() for x in p])
    label = lambda a: X.numbered(F.regexp_extract(a, "#(.*)$", 1))
    joined = lambda f: F.array_join(F.transform("referenced", f), "·")
    case = F.col("via") == "precedent"
    note = (
        F.when(case & (F.size("referenced") > 0), F.concat(F.lit(" (검색된 조문 "), joined(citations.article_title), F.lit("에 연결된 대법원 판례)")))
        .when(case, " (질문과 유사한 대법원 판례)")
        .when(F.size("referenced") > 0, F.concat(F.lit(" ("), joined(label), F.lit("의 예외·준용을 정한 조문)")))
        .otherwise(F.coalesce(origin[F.col("via")], F.lit("")))
    )
    notes = F.array_join(F.transform("status_notes", lambda n: F.concat(F.lit("\n- "), n)), "")
    status = F.concat(F.lit("시행 상태(기준일 "), F.col("as_of"), F.lit("): "), F.coalesce(names[F.col("status")], F.lit("")), notes)
    head = F.concat(F.lit("["), F.col("source"), F.lit("]"), note)
    return F.array_join(F.array_compact(F.array(head, F.when(~case & F.lit(inject), status), F.col("text"))), "\n")


def prompts(questions: DataFrame, numbered: DataFrame, o: Options) -> DataFrame:
    """(query_id, prompt): the blocks in order, then the question."""
    rows = numbered.join(questions.select("query_id", "as_of"), "query_id").select("query_id", "n", rendered(o.inject_status).alias("r"))
    context = rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "r"))), lambda x: x["r"]), "\n\n").alias("context"))
    return questions.join(context, "query_id", "left").select("query_id", F.concat(F.lit(SYSTEM), "as_of", F.lit("\n[근거]\n"), F.coalesce("context", F.lit("")), F.lit("\n\n[질문]\n"), "question").alias("prompt"))


def answered(questions: DataFrame, numbered: DataFrame, o: Options, cases: DataFrame | None = None) -> DataFrame:
    """(query_id, status, refusal_reason, citations, answer) for each question (query_id, question, as_of). Answers are stored before their citations are looked up, so both are of one call; a call that failed gives the status `error` and what failed as the reason."""
    hits = numbered.where("via = 'search'").select("query_id", "score")
    gated = R.gate(hits, questions, o.tau)
    through = questions.join(gated.where("not refused"), "query_id", "left_semi")
    got = external.called_once(prompts(through, numbered, o), o.generator, ["query_id"])
    done = citations.finalized(got.where("error is null").select("query_id", F.coalesce("response", F.lit("")).alias("answer")), numbered, cases)
    failed = got.where("error is not null").select("query_id", F.lit("error").alias("status"), F.col("error").alias("refusal_reason"))
    refused = gated.where("refused").select("query_id", F.lit("insufficient_context").alias("status"), F.lit("retrieval_below_tau").alias("refusal_reason"))
    return done.unionByName(refused, allowMissingColumns=True).unionByName(failed, allowMissingColumns=True)


def has_pending(numbered: DataFrame) -> DataFrame:
    """Whether any block of a question has a change to come."""
    return numbered.groupBy("query_id").agg(F.bool_or(F.col("status").isin(*PENDING)).alias("pending"))
