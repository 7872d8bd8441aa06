"""Exact dense search, bigram BM25, rank fusion and gates.

Queries are a DataFrame too, so one job answers many. The query side of a dense search is
collected up to a bound and multiplied as a matrix with a slice of vectors at a time, of a
bounded number of scores; more queries than that go in blocks. A task holds the scores of
one slice and each query's best so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as X

TAU, CASE_TAU = 0.50, 0.54
CANDIDATES, RRF_K, BM25_WEIGHT = 50, 60, 0.5
K1, B = 1.5, 0.75
QUERY_BLOCK = 2000
#: Scores of a slice of vectors with a block of queries; digits to which equal vectors have equal scores wherever they stand.
SLICE_SCORES, DIGITS = 1 << 19, 12


def cosine(vector: Column | str, query: list[float]) -> Column:
    """Inner product with one query vector, in double precision."""
    q = np.asarray(query, float)

    @F.arrow_udf("double")
    def run(col: pa.Array) -> pa.Array:
        return pa.array(_matrix(col, len(q)) @ q)

    return run(F.col(vector) if isinstance(vector, str) else vector)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), float).reshape(-1, dim) if len(col) else np.empty((0, dim))


def _query_blocks(queries: DataFrame, columns: list[str], size: int = QUERY_BLOCK):
    """Queries in blocks of bounded size: ids, matrix, and the tags that each allows or bars."""
    held: list = []
    for r in queries.select(*columns).toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def scored(corpus: DataFrame, queries: DataFrame, top: int, doc_id: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", skip_self: bool = True, tag: str | None = None, only: str | None = None, never: str | None = None) -> DataFrame:
    """The `top` rows of the corpus for each query by (inner product, id): query_id, doc_id, score, rank.

    Each task keeps its own best, so what is shuffled is queries * top * tasks, not queries * corpus. With a `tag` column of the corpus, `only` and `never` name array columns of the queries: the tags that a hit must or must not have.
    """
    columns = [query_id, vector, *filter(None, [only, never])]
    out = None
    for held in _query_blocks(queries, columns):
        one = _block(corpus, held, top, doc_id, vector, query_id, skip_self, tag, only is not None)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return corpus.sparkSession.createDataFrame([], f"{query_id} bigint, {doc_id} bigint, score double, rank int")
    best = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(doc_id))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


class Best:
    """Each query's k best rows so far, by (score, id). Of equal scores only those with the least ids are held, so copies of a vector take no more room than others."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        self.held = self._none()
        self.new: list = []
        self.least, self.last = np.full(queries, -np.inf), np.full(queries, np.iinfo(np.int64).max)

    @staticmethod
    def _none() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, s: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries (rows) with vectors (columns); what isn't finite is no hit."""
        s[~np.isfinite(s)] = -np.inf
        slack = 10.0**-DIGITS
        least = self.least
        if s.shape[1] > self.k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])
        i, j = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
        score = np.round(s[i, j], DIGITS)
        may = (score > self.least[i]) | ((score == self.least[i]) & (ids[j] < self.last[i]))
        self.new.append((i[may], ids[j[may]], score[may]))
        if sum(len(x[0]) for x in self.new) > max(self.queries * self.k, SLICE_SCORES // 4):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of what is held now, each query's best first."""
        i, ids, score = (np.concatenate(x) for x in zip(self.held, *self.new, strict=True))
        order = np.lexsort((ids, -score, i))
        i, ids, score = i[order], ids[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i, "left")
        top = place < self.k
        self.held, self.new = (i[top], ids[top], score[top]), []
        full = place == self.k - 1
        self.least[i[full]], self.last[i[full]] = score[full], ids[full]
        return self.held


def _slices(b: pa.RecordBatch, queries: int):
    """Slices of a batch that have a bounded number of scores."""
    step = max(1, SLICE_SCORES // max(1, queries))
    for a in range(0, b.num_rows, step):
        yield a, b.slice(a, step)


def _block(corpus: DataFrame, held: list, top: int, doc_id: str, vector: str, query_id: str, skip_self: bool, tag: str | None, must: bool) -> DataFrame:
    known, q = np.asarray([r[0] for r in held]), np.array([r[1] for r in held], float)
    tags = [np.asarray(r[2]) for r in held] if tag else None

    def run(batches):
        best = Best(len(known), top)
        for b in batches:
            if tags is not None:
                kinds, kind = np.unique(b.column(2).to_numpy(zero_copy_only=False), return_inverse=True)
                barred = np.array([np.isin(kinds, t) != must for t in tags]).reshape(len(tags), len(kinds))
            for a, part in _slices(b, len(known)):
                docs = part.column(0).to_numpy(zero_copy_only=False)
                s = q @ _matrix(part.column(1), q.shape[1]).T
                if skip_self:
                    s[known[:, None] == docs[None, :]] = -np.inf
                if tags is not None:
                    s[barred[:, kind[a : a + len(docs)]]] = -np.inf
                best.add(s, docs)
        i, ids, score = best.merge()
        yield pa.record_batch([pa.array(known[i]), pa.array(ids), pa.array(score)], names=[query_id, doc_id, "score"])

    return corpus.select(doc_id, vector, *([tag] if tag else [])).mapInArrow(run, f"{query_id} bigint, {doc_id} bigint, score double")


#: Bigrams of a batch's questions up to which each is counted in the texts as they are; with more, the texts are cut into bigrams.
FEW_BIGRAMS = 200


def _length(text: Column) -> Column:
    """The number of a text's bigrams (one for a word of one character), without making them."""
    s = F.trim(F.regexp_replace(text, X.NO_WORD, " "))
    letters = F.length(F.replace(s, F.lit(" "), F.lit("")))
    words = F.when(s == "", 0).otherwise(F.length(s) - letters + 1)
    return letters - words + F.regexp_count(s, F.lit("(?<![^ ])[^ ](?![^ ])"))


def _quoted(s: str) -> str:
    return rf"\Q{s}\E"


def _count(text: Column, bigram: str) -> Column:
    """How often a bigram (or a word of one character) occurs, overlaps counted."""
    if len(bigram) == 1:
        return F.regexp_count(text, F.lit(f"(?<!{X.WORD_CHAR}){_quoted(bigram)}(?!{X.WORD_CHAR})"))
    if bigram[0] == bigram[1]:
        return F.regexp_count(text, F.lit(f"(?={_quoted(bigram)})"))
    return ((F.length(text) - F.length(F.replace(text, F.lit(bigram), F.lit("")))) / 2).cast("int")


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """Scores of all documents that share a bigram with a query: query_id, doc_id, score. Only postings of the queries' bigrams are made, and only those are shuffled; the corpus is read once for its statistics and once for the scores."""
    asked = queries.select(query_id, F.explode(F.array_distinct(X.bigrams(query))).alias("t"))
    few = sorted(r.t for r in asked.select("t").distinct().limit(FEW_BIGRAMS + 1).collect())
    c = F.col(text)
    if 0 < len(few) <= FEW_BIGRAMS:
        found = F.array(*[F.struct(F.lit(t).alias("t"), _count(c, t).cast("double").alias("tf")) for t in few])
        own = docs.select(doc_id, _length(c).cast("double").alias("len"), F.filter(found, lambda p: p["tf"] > 0).alias("p"))
        total = own.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("mean"))
        postings = own.select(doc_id, "len", F.explode("p").alias("p")).select("p.t", doc_id, "p.tf", "len")
    else:
        cut = docs.select(F.col(doc_id), X.bigrams(text).alias("_t")).select(doc_id, F.size("_t").cast("double").alias("len"), "_t")
        total = cut.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("mean"))
        postings = cut.select(doc_id, "len", F.explode("_t").alias("t")).join(asked.select("t").distinct(), "t").groupBy("t", doc_id).agg(F.count("*").cast("double").alias("tf"), F.first("len").alias("len"))
    df = postings.groupBy("t").agg(F.count("*").cast("double").alias("df"))
    n, mean = total.select("n").scalar(), F.coalesce(F.nullif(total.select("mean").scalar(), F.lit(0.0)), F.lit(1.0))
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = asked.join(df.select("t", idf.alias("idf")), "t")
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    return postings.join(known, "t").select(query_id, doc_id, weight.alias("w")).groupBy(query_id, doc_id).agg(F.sum("w").alias("score"))


def nearest(rows: DataFrame, gold: DataFrame, row_id: str, gold_id: str, vector: str = "embedding") -> DataFrame:
    """For each row its gold item of the largest inner product, by (score, id): row_id, nearest, score. Gold items go in blocks of bounded size, each multiplied with a batch of rows, so no pairs are made."""
    out = None
    for held in _query_blocks(gold.orderBy(gold_id), [gold_id, vector]):
        one = _nearest(rows, held, row_id, vector)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return rows.limit(0).select(row_id, F.lit(None).cast("bigint").alias("nearest"), F.lit(None).cast("double").alias("score"))
    best = F.max(F.struct("score", (-F.col("nearest")).alias("k")))
    return out.groupBy(row_id).agg(best.alias("b")).select(row_id, (-F.col("b.k")).alias("nearest"), F.col("b.score").alias("score"))


def _nearest(rows: DataFrame, held: list, row_id: str, vector: str) -> DataFrame:
    known, q = np.asarray([r[0] for r in held]), np.array([r[1] for r in held], float)

    def run(batches):
        for b in batches:
            for _, part in _slices(b, len(known)):
                s = np.round(_matrix(part.column(1), q.shape[1]) @ q.T, 9)
                at = s.argmax(axis=1)
                yield pa.record_batch([part.column(0), pa.array(known[at]), pa.array(s[np.arange(len(s)), at])], names=[row_id, "nearest", "score"])

    return rows.select(row_id, vector).mapInArrow(run, f"{row_id} bigint, nearest bigint, score double")


def top_k(scores: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each group with their rank; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(rankings: list[tuple[DataFrame, float]], k: int = RRF_K, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, doc_id, rank): query_id, doc_id, fused."""
    every = None
    for ranking, weight in rankings:
        one = ranking.select(query_id, doc_id, (F.lit(float(weight)) / (F.lit(k) + F.col("rank"))).alias("w"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(query_id, doc_id).agg(F.sum("w").alias("fused"))


def hybrid(dense: DataFrame, lexical: DataFrame, k: int, weight: float = BM25_WEIGHT, rrf_k: int = RRF_K, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """Fused top k of a dense and a lexical ranking, by (fused, id). The gate's score is the dense one, so callers join it for documents that only the lexical ranking had."""
    fused = rrf([(dense, 1.0), (lexical, weight)], rrf_k, query_id, doc_id)
    return top_k(fused, k, [query_id], [F.desc("fused"), F.asc(doc_id)])


def gate(hits: DataFrame, queries: DataFrame, tau: float = TAU, query_id: str = "query_id") -> DataFrame:
    """Whether each query is refused: no hit, or a best score below tau."""
    best = hits.groupBy(query_id).agg(F.max("score").alias("best"), F.count("*").alias("n_hits"))
    return queries.select(query_id).join(best, query_id, "left").withColumn("refused", F.col("best").isNull() | (F.col("best") < tau)).withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))


def excluding(ranked: DataFrame, blocked: DataFrame, n: int, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """The first n ranked candidates that are not blocked for their query (hard negatives, competitors)."""
    return top_k(ranked.drop("rank").join(blocked, [query_id, doc_id], "left_anti"), n, [query_id], [F.desc("score"), F.asc(doc_id)])


def reranked(hits: DataFrame, score: Column, k: int, query_id: str = "query_id") -> DataFrame:
    """Hits in the order of another score; equal scores keep the order they had."""
    return top_k(hits.withColumnRenamed("rank", "prior_rank").withColumn("rescored", score), k, [query_id], [F.desc("rescored"), F.asc("prior_rank")])
