"""Search, fusion, gates and retrieval metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import retrieval as R
from lexspark.operators import sampling
from lexspark.queries.registry import load, query
from lexspark.sources import postings
from lexspark.tables import shared_dir, stored

TOKENS = "flatten(list_transform(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: case when length(w) = 1 then [w] else list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) end))"
E = "e as (select vec_id, embedding::double[] v, label from embeddings), q as (select vec_id query_id, v qv, label ql from e where vec_id % 50 = 0)"
SCORED = f"{E}, s as (select query_id, ql, vec_id, label, list_inner_product(v, qv) score from e, q where vec_id <> query_id), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)"


def _vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings")


def _queries(e):
    """The stated query set: every vector whose id is divisible by 50, against all vectors."""
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("ql"))


def _ranked(spark, sf_dir, top):
    e = _vectors(spark, sf_dir)
    q = _queries(e)
    return e, q, R.scored(e, q, top)


ASKED = f"""tok as (select doc_id, {TOKENS.format(c="text")} t from documents), len as (select doc_id, len(t)::double n from tok), st as (select count(*)::double n, avg(n) m from len),
    p as (select t, doc_id, count(*)::double tf from (select doc_id, unnest(t) t from tok) group by all), df as (select t, count(*)::double df from p group by 1),
    qt as (select distinct conv_id * 1000 + turn query_id, unnest({TOKENS.format(c="text")}) t from conversations where conv_id % 50 = 0),
    b as (select query_id, doc_id, sum(ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len.n / st.m))) score from qt join p using (t) join df using (t) join len using (doc_id), st group by 1, 2),
    bm as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) rank from b)"""


@query(f"with {ASKED} select query_id, rank::int rank, doc_id, round(score, 6) score from bm where rank <= 10")
def bm25_topk(spark, sf_dir):
    """The turns of each conversation whose id is divisible by 50 as questions, whole, to a stored index of all documents."""
    path = f"{shared_dir(spark).rstrip('/')}/postings-{uuid.uuid4().hex}"
    postings.write(load(spark, sf_dir, "documents"), path)
    asked = load(spark, sf_dir, "conversations").where("conv_id % 50 = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return postings.search(postings.read(spark, path), asked, 10).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query(f"with t as (select doc_id, {TOKENS.format(c='text')} t from documents) select doc_id, len(t)::int n_tokens, len(list_distinct(t))::int n_distinct, coalesce(t[1], '') first_token from t")
def bigram_tokens(spark, sf_dir):
    """F14."""
    return load(spark, sf_dir, "documents").select("doc_id", X.bigrams("text").alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first_token"))


@query(f"with {E}, r as (select query_id, vec_id, list_inner_product(v, qv) score, row_number() over (partition by query_id order by list_inner_product(v, qv) desc, vec_id) rank from e, q) select query_id, rank::int rank, vec_id, round(score, 6) score from r where rank <= 10")
def dense_topk(spark, sf_dir):
    """The stated queries against all vectors."""
    e = _vectors(spark, sf_dir)
    return R.scored(e, _queries(e), 10, skip_self=False).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(
    f"""with dv as (select doc_id, text from documents where doc_id in (select vec_id from embeddings)), e as (select vec_id, embedding::double[] v from embeddings where vec_id in (select doc_id from documents)),
    tok as (select doc_id, {TOKENS.format(c="text")} t from dv), len as (select doc_id, len(t)::double n from tok), st as (select count(*)::double n, avg(n) m from len),
    p as (select t, doc_id, count(*)::double tf from (select doc_id, unnest(t) t from tok) group by all), df as (select t, count(*)::double df from p group by 1), qt as (select doc_id query_id, t from p where doc_id % 50 = 0),
    b as (select query_id, p.doc_id, sum(ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len.n / st.m))) score from qt join p using (t) join df using (t) join len on len.doc_id = p.doc_id, st group by 1, 2),
    c as (select q.vec_id query_id, e.vec_id doc_id, list_inner_product(e.v, q.v) cos from e, e q where q.vec_id % 50 = 0),
    r as (select query_id, doc_id, 1.0::double / (60 + row_number() over (partition by query_id order by cos desc, doc_id)) w, row_number() over (partition by query_id order by cos desc, doc_id) k from c
    union all select query_id, doc_id, 0.5::double / (60 + row_number() over (partition by query_id order by round(score, 9) desc, doc_id)), row_number() over (partition by query_id order by round(score, 9) desc, doc_id) from b),
    f as (select query_id, doc_id, sum(w) fused from r where k <= 50 group by 1, 2), k as (select *, row_number() over (partition by query_id order by round(fused, 12) desc, doc_id) rank from f)
    select query_id, rank::int rank, doc_id, round(fused, 6) fused, round(cos, 6) score from k join c using (query_id, doc_id) where rank <= 10"""
)
def rrf_hybrid(spark, sf_dir):
    """Each document whose id is divisible by 50, by its vector and its whole text, against all documents with a vector; the gate's score is the cosine, also for hits of BM25 alone."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    e = _vectors(spark, sf_dir).join(docs, F.col("vec_id") == F.col("doc_id"), "left_semi").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = stored(docs.join(e, "doc_id", "left_semi"))  # read three times; the texts are shuffled once
    asked = lambda df: df.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    dense = R.scored(e, asked(e), R.CANDIDATES, doc_id="doc_id", skip_self=False)
    path = f"{shared_dir(spark).rstrip('/')}/postings-{uuid.uuid4().hex}"
    postings.write(docs, path)
    lexical = postings.search(postings.read(spark, path), asked(docs).withColumnRenamed("text", "query"), R.CANDIDATES)
    fused = R.rrf([(dense, 1.0), (lexical, R.BM25_WEIGHT)])
    top = R.top_k(fused, 10, ["query_id"], [F.desc(F.round("fused", 12)), F.asc("doc_id")])
    both = top.join(e, "doc_id").join(asked(e).withColumnRenamed("embedding", "q"), "query_id")
    dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return both.select("query_id", "rank", "doc_id", F.round("fused", 6).alias("fused"), F.round(dot, 6).alias("score"))


@query(
    """with e as (select vec_id, embedding::double[] v from embeddings), q as (select vec_id n, v qv from e where vec_id % 50 < 3),
    r as (select n, vec_id, row_number() over (partition by n order by list_inner_product(v, qv) desc, vec_id) rank from e, q),
    f as (select n - n % 50 query_id, vec_id, sum(1.0::double / (60 + rank)) fused from r where rank <= 30 group by 1, 2),
    k as (select *, row_number() over (partition by query_id order by round(fused, 12) desc, vec_id) rank from f) select query_id, rank::int rank, vec_id, round(fused, 6) fused from k where rank <= 10"""
)
def multi_query_rrf(spark, sf_dir):
    """equal weights over the rankings of each stated query and its two rewrites, the vectors after it."""
    e = _vectors(spark, sf_dir)
    asked = e.where("vec_id % 50 < 3").select(F.col("vec_id").alias("query_id"), "embedding")
    ranked = R.scored(e, asked, 30, skip_self=False).withColumn("query_id", F.col("query_id") - F.col("query_id") % 50)
    fused = R.rrf([(ranked, 1.0)], doc_id="vec_id")
    return R.top_k(fused, 10, ["query_id"], [F.desc(F.round("fused", 12)), F.asc("vec_id")]).select("query_id", "rank", "vec_id", F.round("fused", 6).alias("fused"))


@query(f"with {SCORED} select query_id, round(max(score), 6) best, max(score) < 0.5 refused from s group by 1")
def tau_gate(spark, sf_dir):
    """P10."""
    _, q, hits = _ranked(spark, sf_dir, 1)
    return R.gate(hits, q).select("query_id", F.round("best", 6).alias("best"), "refused")


@query(f"with {SCORED} select query_id, vec_id, round(score, 6) score from r where score >= 0.54 and rank <= 2")
def threshold_topk(spark, sf_dir):
    """At most two above the threshold; the cap counts rows that pass."""
    hits = _ranked(spark, sf_dir, 2)[2]
    return hits.where(F.col("score") >= R.CASE_TAU).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("select lang, doc_id, n_chars, rank::int rank from (select *, row_number() over (partition by lang order by n_chars desc, doc_id) rank from documents) where rank <= 5")
def topk_per_group(spark, sf_dir):
    """W09, T13."""
    docs = load(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    return R.top_k(docs, 5, ["lang"], [F.desc("n_chars"), F.asc("doc_id")])


@query(
    f"""with {SCORED}, h as (select query_id, label, count(*)::bigint n_links from r where rank <= 10 group by all),
    c as (select query_id, vec_id, score, n_links from s join h using (query_id, label))
    select query_id, vec_id, round(score, 6) score, n_links, rank::int rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from c) where rank <= 10"""
)
def linked_rank(spark, sf_dir):
    """Candidates are linked to the hits by label, and scored only then."""
    e, q, hits = _ranked(spark, sf_dir, 10)
    links = hits.join(e.select("vec_id", "label"), "vec_id").groupBy("query_id", "label").agg(F.count("*").alias("n_links"))
    asked = q.join(links.groupBy("query_id").agg(F.collect_set("label").alias("labels")), "query_id")
    found = R.scored(e, asked, 10, tag="label", only="labels").join(e.select("vec_id", "label"), "vec_id").join(links, ["query_id", "label"])
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "n_links", "rank")


@query(f"with {SCORED} select query_id, string_agg(vec_id::varchar, ',' order by score desc, vec_id) nearest from (select *, row_number() over (partition by query_id order by score desc, vec_id) k from s) where k <= 3 group by 1")
def fewshot_nn(spark, sf_dir):
    """The store is all vectors; a query never gets itself."""
    e = _vectors(spark, sf_dir)
    hits = R.scored(e, _queries(e), 3)
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"].cast("string")), ",").alias("nearest"))


@query(f"with {SCORED} select query_id, vec_id negative, round(score, 6) score from (select *, row_number() over (partition by query_id order by score desc, vec_id) k from s where label <> ql) where k = 1")
def hard_negative(spark, sf_dir):
    """The first candidate outside the blocked ones (same label)."""
    e = _vectors(spark, sf_dir)
    q = _queries(e).withColumn("barred", F.array("ql"))
    return R.scored(e, q, 1, tag="label", never="barred").select("query_id", F.col("vec_id").alias("negative"), F.round("score", 6).alias("score"))


@query(f"with {SCORED}, c as (select query_id, vec_id, rank from r where rank <= 12 and label <> ql), k as (select *, row_number() over (partition by query_id order by rank) n from c) select query_id, string_agg(vec_id::varchar, ',' order by rank) competitors from k where n <= 5 group by 1")
def competitors_top5(spark, sf_dir):
    """The top 12 without positives, the first five of them."""
    e, q, hits = _ranked(spark, sf_dir, 12)
    own = hits.join(e.select("vec_id", "label"), "vec_id").join(q.select("query_id", "ql"), "query_id").where("label <> ql")
    seq = F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"].cast("string"))
    return own.groupBy("query_id").agg(F.array_join(F.slice(F.array_distinct(seq), 1, 5), ",").alias("competitors"))


@query(
    f"""with {SCORED}, p as (select query_id, min(rank) filter (label = ql) first_rank, count(*) filter (label = ql) n_hit from r where rank <= 5 group by 1),
    g as (select ql label, query_id, (select count(*) from e where label = ql and vec_id <> query_id) n_gold from q)
    select query_id, first_rank::int first_rank, round(coalesce(1.0::double / first_rank, 0), 6) rr, first_rank is not null recall_any, n_hit = n_gold recall_all from p join g using (query_id)"""
)
def retrieval_metrics(spark, sf_dir):
    """A05, A06, P12, U07, K08."""
    e, q, hits = _ranked(spark, sf_dir, 5)
    same = F.col("label") == F.col("ql")
    per = hits.join(e.select("vec_id", "label"), "vec_id").join(q.select("query_id", "ql"), "query_id").groupBy("query_id", "ql").agg(F.min(F.when(same, F.col("rank"))).alias("first_rank"), F.count_if(same).alias("n_hit"))
    gold = e.groupBy(F.col("label").alias("ql")).agg((F.count("*") - 1).alias("n_gold"))
    return per.join(gold, "ql").select("query_id", "first_rank", F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 6).alias("rr"), F.col("first_rank").isNotNull().alias("recall_any"), (F.col("n_hit") == F.col("n_gold")).alias("recall_all"))


@query(
    f"""with {SCORED}, h as (select query_id, ql, vec_id, label, list_inner_product(v[1:32], qv[1:32]) s2 from e, q where vec_id <> query_id),
    r2 as (select query_id, vec_id, row_number() over (partition by query_id order by s2 desc, vec_id) rank2 from h),
    g as (select * from (values (20), (50)) a(n), (values (20), (60)) b(k), (values (0.5::double), (1.0::double)) c(w)),
    f as (select n, k, w, query_id, vec_id, sum(x) fused from (select n, k, w, query_id, vec_id, 1.0::double / (k + rank) x from r, g where rank <= n union all select n, k, w, query_id, vec_id, w / (k + rank2) from r2, g where rank2 <= n) group by all),
    t as (select *, row_number() over (partition by n, k, w, query_id order by round(fused, 12) desc, vec_id) p from f),
    m as (select n, k, w, query_id, min(p) filter (label = ql) first from t join (select vec_id, label from e) using (vec_id) join (select query_id, ql from q) using (query_id) where p <= 5 group by all)
    select n::int n, k::int k, w, round(avg((first is not null)::int), 6) recall_any, round(avg(coalesce(1.0::double / first, 0)), 6) mrr from m group by 1, 2, 3"""
)
def grid_argmax(spark, sf_dir):
    """A table of parameters joined with two rankings, in one job; the caller takes the maximum by (recall, mrr)."""
    e = _vectors(spark, sf_dir)
    q = _queries(e)
    grid = F.broadcast(spark.createDataFrame([(n, k, w) for n in (20, 50) for k in (20, 60) for w in (0.5, 1.0)], "n int, k int, w double"))
    first = R.scored(e, q, 50).select("query_id", "vec_id", "rank", F.lit(1).alias("which"))
    half = e.withColumn("embedding", F.slice("embedding", 1, 32))
    second = R.scored(half, _queries(half), 50).select("query_id", "vec_id", "rank", F.lit(2).alias("which"))
    ranked = first.unionByName(second).join(grid, F.col("rank") <= F.col("n"))
    fused = ranked.groupBy("n", "k", "w", "query_id", "vec_id").agg(F.sum(F.when(F.col("which") == 1, 1.0).otherwise(F.col("w")) / (F.col("k") + F.col("rank"))).alias("fused"))
    top = R.top_k(fused, 5, ["n", "k", "w", "query_id"], [F.desc(F.round("fused", 12)), F.asc("vec_id")])
    hit = top.join(e.select("vec_id", "label"), "vec_id").join(q.select("query_id", "ql"), "query_id").groupBy("n", "k", "w", "query_id").agg(F.min(F.when(F.col("label") == F.col("ql"), F.col("rank"))).alias("first"))
    return hit.groupBy("n", "k", "w").agg(F.round(F.avg(F.col("first").isNotNull().cast("int")), 6).alias("recall_any"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


WORDS = "list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'))"


@query(
    f"""with {E}, s as (select vec_id, query_id, round(list_inner_product(v, qv), 9) score from e, q where vec_id % 50 <> 0), r as (select *, row_number() over (partition by vec_id order by score desc, query_id) k from s)
    select vec_id, query_id nearest, round(score, 6) score, score >= 0.35 leaks from r where k = 1"""
)
def leakage_guard(spark, sf_dir):
    """Each row's largest cosine over the evaluation set (the vectors whose ids are divisible by 50), in blocks."""
    e = _vectors(spark, sf_dir)
    near = R.nearest(e.where("vec_id % 50 <> 0"), _queries(e), "vec_id", "query_id")
    return near.select("vec_id", "nearest", F.round("score", 6).alias("score"), (F.col("score") >= 0.35).alias("leaks"))


@query("select lang, count(*)::bigint n from documents where doc_id not in (select doc_id from labels where toxic = 1 or quality = 0) group by 1")
def strict_anti(spark, sf_dir):
    """J22."""
    bad = load(spark, sf_dir, "labels").where("toxic = 1 or quality = 0").select("doc_id")
    return load(spark, sf_dir, "documents").join(bad, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


@query(
    f"""with p as (select item_id, {WORDS.format(c='b.text')} g, {WORDS.format(c='d.text')} c from benchmark b join documents d on doc_id = item_id)
    select item_id, round(len(list_intersect(g, c))::double / nullif(len(c), 0), 6) "precision", round(len(list_intersect(g, c))::double / nullif(len(g), 0), 6) recall from p"""
)
def set_precision_recall(spark, sf_dir):
    """A07, U04."""
    words = lambda t: F.array_distinct(X.words(F.lower(t)))
    b = load(spark, sf_dir, "benchmark").select("item_id", words("text").alias("g"))
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), words("text").alias("c"))
    both = F.size(F.array_intersect("g", "c"))
    return d.join(b, "item_id").select("item_id", F.round(both / F.nullif(F.size("c"), F.lit(0)), 6).alias("precision"), F.round(both / F.nullif(F.size("g"), F.lit(0)), 6).alias("recall"))
