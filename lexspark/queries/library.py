"""Library operators on statutes, cases, questions and scores that are made from the driver tables, so that SQL can say what must come out."""

from __future__ import annotations

import json
import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexspark.functions import external
from lexspark.functions import statute as S
from lexspark.functions import text as X
from lexspark.operators import chunking, citations, expand, graph, metrics
from lexspark.plans import answer, evaluate, review
from lexspark.queries.registry import load, query
from lexspark.sources import graphjson, jsonl, ledger, reports, rest, vectors, xml
from lexspark.tables import shared_dir, stored


def _said(*parts) -> Column:
    """Columns and plain strings one after another."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _one_of(n: Column, *values: str) -> Column:
    """The value at place n."""
    return F.element_at(F.array(*map(F.lit, values)), n.cast("int") + 1)


# --- sources ------------------------------------------------------------------------

SIZES = (0, 1, 99, 100, 250)


def _service(options):
    """A search service that fails on the first try of each page, and gives a row alone as an object."""
    held, tries = json.loads(options["sizes"]), Counter()

    def get(endpoint, params):
        tries[params["page"]] += 1
        if tries[params["page"]] == 1:
            return 503, b""
        n, first = held[params["query"]], (params["page"] - 1) * rest.PAGE
        rows = [{"id": i} for i in range(first, min(n, first + rest.PAGE))]
        return 200, json.dumps({"R": {"law": rows[0] if n == 1 else rows}}).encode()

    return get


@query(f"with n as (select n_name \"query\", {list(SIZES)}[n_nationkey % 5 + 1] n from nation) select \"query\", n::bigint n, (n * (n - 1) // 2)::bigint total from n where n > 0")
def rest_scan(spark, sf_dir):
    """A paged search for each nation (a table of fixed size), with a failure before each page."""
    sizes = {r.n_name: SIZES[r.n_nationkey % 5] for r in load(spark, sf_dir, "nation").select("n_name", "n_nationkey").collect()}
    rest.register(spark, _service, "rest_scan")
    found = spark.read.format("rest_scan").option("queries", json.dumps(sorted(sizes))).option("sizes", json.dumps(sizes)).option("wait", "0").load()
    return found.groupBy("query").agg(F.count("*").alias("n"), F.sum(F.col("id").cast("bigint")).alias("total"))


@query(
    """with r as (select user_id::varchar mst, strftime(ts, '%Y%m%d') effective, ['현행', '시행예정', '폐지'][event_id % 3 + 1] status, event_id pos from events where event_type = 'signup')
    select mst, effective, status, pos from (select *, row_number() over (partition by mst, effective order by pos) k from r where status <> '폐지') where k = 1"""
)
def statute_versions(spark, sf_dir):
    """Versions of one name, in force or to come, each once."""
    e = load(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("mst"), _one_of(F.col("event_id") % 3, "현행", "시행예정", "폐지").alias("status"), F.date_format("ts", "yyyyMMdd").alias("effective"), F.col("event_id").alias("pos"))
    return rest.versions(rows, "signup").select("mst", "effective", "status", "pos")


@query("select o_orderkey id, strftime(o_orderdate, '%Y.%m.%d') decided from orders where o_orderpriority = '1-URGENT' and o_orderdate >= timestamp '2000-06-01'")
def newest_cases(spark, sf_dir):
    """One court's cases from a day on."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("court"), F.date_format("o_orderdate", "yyyy.MM.dd").alias("decided"))
    return rest.newest(o, "1-URGENT", "20000601").select("id", "decided")


def _tag(name: str, *inside) -> Column:
    return _said(f"<{name}>", *inside, f"</{name}>")


def _statutes(spark, sf_dir) -> DataFrame:
    """A statute for each conversation: every fourth turn is a heading, the others are articles without paragraphs, with items in them, and with items alone."""
    t, role, m = F.col("turn"), F.col("role"), F.md5("text")
    item = _said("1. ", F.substring(m, 1, 8))
    paragraphs = (
        F.when(t % 4 == 2, _tag("항", _tag("항번호", "①"), _tag("항내용", "①", m), _tag("호", _tag("호내용", item), _tag("목", _tag("목내용", "가. x")))))
        .when(t % 4 == 3, _tag("항", _tag("호", _tag("호내용", item))))
        .otherwise("")
    )
    amended = F.when(t % 4 == 1, _said(" &lt;개정 2020. 1. ", t % 28 + 1, ".&gt;")).otherwise("")
    article = _said(_tag("조문여부", "조문"), _tag("조문번호", t), _tag("조문가지번호", F.when(t % 3 == 0, "2").otherwise("")), _tag("조문제목", role), _tag("조문시행일자", "20200101"), _tag("조문내용", "제", t, "조(", role, ") ", m, amended), paragraphs)
    heading = _said(_tag("조문여부", "전문"), _tag("조문번호", t), _tag("조문내용", "Part ", t))
    unit = _tag("조문단위", F.when(t % 4 == 0, heading).otherwise(article))
    units = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", unit.alias("u")))), lambda x: x["u"]), "")
    docs = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(units.alias("units"))
    name = _said("Act ", F.col("conv_id"), _one_of(F.col("conv_id") % 3, "", " 시행령", " 시행규칙"))
    return docs.select(name.alias("name"), _tag("법령", _tag("기본정보", _tag("법령ID", F.col("conv_id")), _tag("시행일자", "20200101")), _tag("조문", F.col("units"))).alias("content"))


@query(
    """with c as (select *, md5(text) m, 'Act ' || conv_id || ['', ' 시행령', ' 시행규칙'][conv_id % 3 + 1] law, case when turn % 3 = 0 then '의2' else '' end branch from conversations),
    h as (select *, coalesce(last_value(case when turn % 4 = 0 then 'Part ' || turn end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding), '') chapter, row_number() over (partition by conv_id order by turn) - 1 pos from c),
    a as (select *, '제' || turn || '조' || branch || '(' || role || ')' label from h where turn % 4 <> 0)
    select law, turn || branch article_key, role title, ['법률', '시행령', '시행규칙'][conv_id % 3 + 1] level, chapter, label, pos::int pos, law || '#' || turn || branch article_id,
    md5(law || ' ' || label || chr(10) || case turn % 4 when 1 then m || ' <개정 2020. 1. ' || (turn % 28 + 1) || '.>' when 2 then '①' || m || chr(10) || '  1. ' || substr(m, 1, 8) || chr(10) || '    가. x' else m || chr(10) || '  1. ' || substr(m, 1, 8) end) digest,
    case when turn % 4 = 1 then '2020-01-' || lpad((turn % 28 + 1)::varchar, 2, '0') else '' end amended from a"""
)
def statute_articles(spark, sf_dir):
    """Articles of statute XML with the chapter that holds, label, paragraphs and rendered text."""
    a = xml.articles(_statutes(spark, sf_dir))
    return a.select("law", "article_key", "title", "level", "chapter", "label", "pos", "article_id", F.md5("text").alias("digest"), F.array_join("amended", ",").alias("amended"))


@query(
    """with c as (select o_orderkey k, '2020다' || o_custkey % 500 no1, '2020다' || o_custkey % 500 || case when o_orderkey % 4 = 0 then ', 2020다1' else '' end case_no, strftime(o_orderdate, '%Y-%m-%d') decided, o_orderpriority title, o_orderkey % 3 = 0 fallback,
    case when o_orderkey % 3 = 0 then '이유 because ' || o_orderkey else 'held ' || o_orderkey end holding from orders), f as (select *, row_number() over (partition by no1 order by k) n from c)
    select '판례#' || no1 id, case_no, decided, holding, fallback, md5('[판례] 대법원 ' || decided || ' 선고 ' || case_no || ' 판결 (' || title || ')' || chr(10) || '[판시사항]' || chr(10) || '[1] q' || chr(10) || 'w' || chr(10) || '[판결요지]' || chr(10) || holding) digest from f where n = 1"""
)
def case_records(spark, sf_dir):
    """Case XML, cleaned; the reasons' opening stands for a missing holding, and the first file of a case number wins."""
    k = F.col("o_orderkey")
    fields = (
        _tag("사건번호", "2020다", F.col("o_custkey") % 500, F.when(k % 4 == 0, ", 2020다1").otherwise("")), _tag("선고일자", F.date_format("o_orderdate", "yyyyMMdd")), _tag("사건명", F.col("o_orderpriority")),
        _tag("판시사항", "[1] q&lt;br/&gt;w"), _tag("판결요지", F.when(k % 3 == 0, "").otherwise(_said("held ", k))), _tag("판례내용", "주문 이유 because ", k),
    )
    files = load(spark, sf_dir, "orders").select(F.lpad(k.cast("string"), 12, "0").alias("path"), _tag("판례", *fields).alias("content"))
    c = xml.cases(files)
    return c.select("id", "case_no", "decided", "holding", F.col("holding_from_reasons").alias("fallback"), F.md5(xml.case_text()).alias("digest"))


@query(
    r"""with a as (select conv_id, turn, text || chr(10) || chr(10) t from conversations), sp as (select conv_id, turn, sum(length(t)) over w - length(t) s, sum(length(t)) over w e from a window w as (partition by conv_id order by turn)),
    st as (select conv_id, regexp_extract_all(string_agg(t, '' order by turn), '\S+|\s+') p, string_agg(t, '' order by turn) s from a group by 1), pc as (select conv_id, unnest(p) p, generate_subscripts(p, 1) k from st),
    po as (select conv_id, p, k, sum(length(p)) over (partition by conv_id order by k) e from pc), wd as (select conv_id, e - length(p) b, e, row_number() over (partition by conv_id order by k) - 1 n, count(*) over (partition by conv_id) total from po where regexp_matches(p, '^\S')),
    wi as (select conv_id, max(total) total, unnest(range(0, greatest(max(total) - 16, 1), 48)) t0 from wd group by 1),
    w as (select wi.conv_id, t0 // 48 i, x.b c0, y.e c1 from wi join wd x on x.conv_id = wi.conv_id and x.n = t0 join wd y on y.conv_id = wi.conv_id and y.n = least(t0 + 64, wi.total) - 1)
    select 'fixed:' || w.conv_id || ':' || i chunk_id, c0::int start, c1::int stop, md5(substr(st.s, c0::int + 1, (c1 - c0)::int)) digest, string_agg(turn::varchar, ',' order by turn) articles from w join st using (conv_id) join sp on sp.conv_id = w.conv_id and sp.s < c1 and sp.e > c0 group by 1, 2, 3, 4"""
)
def token_windows(spark, sf_dir):
    """2.10 tokenizer, W08, J10: windows of 64 words that share 16 over each conversation's running text, read turn by turn, with the turns that they overlap."""
    c = load(spark, sf_dir, "conversations")
    laws = c.select(F.col("conv_id").cast("string").alias("law"), F.col("turn").alias("pos"), F.col("turn").cast("string").alias("article_id"), "text")
    return chunking.fixed_chunks(laws, 64, 16).select("chunk_id", "start", "stop", F.md5("text").alias("digest"), F.array_join("article_ids", ",").alias("articles"))


# --- questions, context and citations ----------------------------------------------


@query(
    f"""with q as (select distinct conv_id q from conversations), m as (select q, 1 k, 1 n from q where q % 5 > 1 union all select q, 2, q % 7 + 1 from q where q % 5 > 1 and q % 7 > 0),
    b as (select q, k, turn, turn % 4 = 3 c, '제' || turn || '조' || case when turn % 3 = 0 then '의2' else '' end art from m join conversations on conv_id = q and turn + 1 = n),
    g as (select q, string_agg('S' || (turn + 1), '|' order by k) sources, string_agg(case when c then '대법원' else 'Act ' || q end, '|' order by k) laws,
    string_agg(case when c then '대법원 2020. ' || (turn % 9 + 1) || '. 5. 선고 2020다' || q || ' 판결' else art end, '|' order by k) articles,
    string_agg(case when c then '{citations.CASE_URL}(2020%EB%8B%A4' || q || ')' else '{citations.STATUTE_URL}Act%20' || q || '/' || art end, '|' order by k) urls,
    string_agg(case when q % 2 = 0 then 'gamma delta' else 'alpha beta' end, '|' order by k) quotes from b group by 1)
    select q query_id, case when g.q is null then 'insufficient_context' else 'answered' end status, case when q.q % 5 = 0 then 'model_declined' when g.q is null then 'no_valid_citation' end refusal_reason, sources, laws, articles, urls, quotes from q left join g using (q)"""
)
def citations_finalized(spark, sf_dir):
    """Answers to statuses and validated citations, with titles, addresses and quotes."""
    c = load(spark, sf_dir, "conversations")
    q, t = F.col("conv_id"), F.col("turn")
    case = t % 4 == 3
    case_id = _said("판례#", q, "-", t)
    none = F.array().cast("array<string>")
    blocks = c.select(
        q.alias("query_id"), _said("S", t + 1).alias("source"), _said("c", t).alias("chunk_id"), F.array(F.when(case, case_id).otherwise(_said("Act ", q, "#", t, F.when(t % 3 == 0, "의2").otherwise("")))).alias("article_ids"),
        F.lit("head\nalpha beta\ngamma delta\n[x]").alias("text"), F.when(case, "precedent").otherwise("search").alias("via"), F.lit("in_force").alias("status"), none.alias("status_notes"),
    )
    cases = c.where(case).select(case_id.alias("id"), _said("2020다", q).alias("case_no"), _said("2020-0", t % 9 + 1, "-05").alias("decided"))
    word = F.when(q % 2 == 0, "gamma delta").otherwise("alpha beta")
    said = F.when(q % 5 == 0, " [정보 부족] none [S1]").when(q % 5 == 1, "no source [S99]").otherwise(_said(word, " [S1] and more. ", word, " [S", q % 7 + 1, "] again. last [S99]"))
    found = citations.finalized(c.select("conv_id").distinct().select(q.alias("query_id"), said.alias("answer")), blocks, cases)
    joined = lambda f: F.array_join(F.transform("citations", lambda x: x[f]), "|")
    return found.select("query_id", "status", "refusal_reason", joined("source").alias("sources"), joined("law").alias("laws"), joined("article").alias("articles"), joined("url").alias("urls"), joined("quote").alias("quotes"))


STATES = tuple(answer.STATUS_NAMES)


@query(
    f"""with b as (select conv_id q, turn, text, turn % 5 v, (['{"', '".join(answer.STATUS_NAMES.values())}'])[turn % {len(STATES)} + 1] state from conversations),
    r as (select q, turn, '[S' || (turn + 1) || ']' || case v when 1 then '{answer.ORIGINS["sibling"]}' when 2 then '{answer.ORIGINS["link"]}' when 3 then ' (제5조의2·제6조의 예외·준용을 정한 조문)' when 4 then case when turn % 2 = 0 then ' (검색된 조문 Act 1 제7조에 연결된 대법원 판례)' else ' (질문과 유사한 대법원 판례)' end else '' end
    || case when v = 4 then '' else chr(10) || '시행 상태(기준일 2020-06-01): ' || state || case when turn % 2 = 0 then chr(10) || '- a' || chr(10) || '- b' else '' end end || chr(10) || text r from b)
    select q query_id, md5('{answer.SYSTEM}2020-06-01' || chr(10) || '[근거]' || chr(10) || string_agg(r, chr(10) || chr(10) order by turn) || chr(10) || chr(10) || '[질문]' || chr(10) || 'Q' || q) digest from r group by 1"""
)
def context_prompts(spark, sf_dir):
    """Blocks as they stand in the context, by origin and state, and the whole prompt."""
    t, v = F.col("turn"), F.col("turn") % 5
    none = F.array().cast("array<string>")
    referenced = F.when(v == 3, F.array(F.lit("Act 1#5의2"), F.lit("Act 1#6"))).when((v == 4) & (t % 2 == 0), F.array(F.lit("Act 1#7"))).otherwise(none)
    c = load(spark, sf_dir, "conversations")
    blocks = c.select(
        F.col("conv_id").alias("query_id"), (t + 1).alias("n"), _said("S", t + 1).alias("source"), _one_of(v, "search", "sibling", "link", "reverse", "precedent").alias("via"),
        referenced.alias("referenced"), _one_of(t % len(STATES), *STATES).alias("status"), F.when(t % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(none).alias("status_notes"), "text",
    )
    questions = c.select("conv_id").distinct().select(F.col("conv_id").alias("query_id"), _said("Q", F.col("conv_id")).alias("question"), F.lit("2020-06-01").alias("as_of"))
    return answer.prompts(questions, blocks, answer.Options()).select("query_id", F.md5("prompt").alias("digest"))


#: Hits: a conversation's first turn, then the second turn of the next one.
HITS = "c as (select conv_id, turn, count(*) over (partition by conv_id) parts from conversations), h as (select conv_id q, conv_id a, turn, 1 rank from c where turn = 0 union all select conv_id - 1, conv_id, turn, 2 from c where turn = 1 and conv_id - 1 in (select conv_id from conversations))"


def _hits(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, chunks, article texts); a conversation is an article, its turns are chunks."""
    c = load(spark, sf_dir, "conversations")
    q, t = F.col("conv_id"), F.col("turn")
    parts = c.groupBy("conv_id").agg(F.count("*").alias("parts"))
    chunks = c.join(parts, "conv_id").select(_said("c", q, "-", t).alias("chunk_id"), F.array(_said("a", q)).alias("article_ids"), "text", (t + 1).alias("part"), "parts")
    hit = lambda of, rank: c.where(t == rank - 1).select(of.alias("query_id"), _said("c", q, "-", t).alias("chunk_id"), F.lit(0.9).alias("score"), F.lit(rank).alias("rank"))
    known = parts.select(q.alias("query_id"))
    hits = hit(q, 1).unionByName(hit(q - 1, 2).join(known, "query_id", "left_semi"))
    return hits, chunks, parts.select(_said("a", q).alias("article_id"), F.lit("t").alias("text"))


@query(f"with {HITS}, o as (select h.q, c.conv_id a, c.turn, min(h.rank) rank from h join c on c.conv_id = h.a and c.turn <> h.turn where c.parts > 1 group by all), p as (select *, row_number() over (partition by q order by rank, turn) pos from o) select q query_id, 'c' || a || '-' || turn chunk_id, pos::int pos from p where pos <= 4")
def sibling_blocks(spark, sf_dir):
    """The other chunks of split articles among the hits, up to the cap."""
    hits, chunks, _ = _hits(spark, sf_dir)
    return expand.sibling_blocks(hits, chunks).select("query_id", "chunk_id", "pos")


@query(
    f"""with {HITS}, n as (select unnest([2, 3, 1, 5]) d, unnest([1, 2, 3, 4]) j), e as (select h.q, h.a + d dst, min(h.rank * 10 + j) place from h, n where h.a + d in (select conv_id from conversations) group by all),
    f as (select * from e where not exists (select 1 from h where h.q = e.q and h.a = e.dst)), s as (select q, count(*) n from h group by 1),
    k as (select f.*, row_number() over (partition by q order by place) pos from f) select q query_id, 'art:a' || dst chunk_id, pos::int pos from k join s using (q) where pos <= 5 - n"""
)
def link_blocks(spark, sf_dir):
    """Parents, then implementing provisions of the first blocks, each once, under the cap on the whole list."""
    hits, chunks, texts = _hits(spark, sf_dir)
    a = lambda d: _said("a", F.col("conv_id") + d)
    nodes = load(spark, sf_dir, "conversations").select("conv_id").distinct().select(a(0).alias("article_id"), F.array(a(2)).alias("parent_provisions"), F.array(a(3), a(1), a(5)).alias("implementing_provisions"))
    return expand.link_blocks(expand.hit_blocks(hits, chunks), nodes, texts, top_k=2).select("query_id", "chunk_id", "pos")


@query(
    f"""with {HITS}, r as (select x.conv_id src, x.conv_id - d dst, ['exception', 'mutatis', 'plain'][(x.conv_id + d) % 3 + 1] cue, (x.conv_id + d) % 3 cr from (select distinct conv_id from conversations) x, (select unnest([1, 2]) d)),
    k as (select h.q, r.src, count(distinct r.dst) n, min(r.cr) cr, min(h.rank) rank, string_agg(distinct 'a' || r.dst, ',' order by 'a' || r.dst) targets from h join r on r.dst = h.a where r.cr < 2 and not exists (select 1 from h g where g.q = h.q and g.a = r.src) group by all),
    p as (select *, row_number() over (partition by q order by n desc, cr, rank, 'a' || src) pos from k) select q query_id, 'art:a' || src chunk_id, pos::int pos, targets from p where pos <= 2"""
)
def reverse_blocks(spark, sf_dir):
    """Articles that make an exception to the hits' articles or extend them."""
    hits, chunks, texts = _hits(spark, sf_dir)
    ids = load(spark, sf_dir, "conversations").select("conv_id").distinct()
    c = F.col("conv_id")
    refs = ids.select("conv_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("d")).select(_said("a", c).alias("src"), _said("a", c - F.col("d")).alias("dst"), _one_of((c + F.col("d")) % 3, "exception", "mutatis", "plain").alias("cue"))
    found = expand.reverse_blocks(expand.hit_blocks(hits, chunks), refs, texts)
    return found.select("query_id", "chunk_id", "pos", F.array_join(F.array_sort("referenced"), ",").alias("targets"))


@query(
    f"""with {HITS}, p as (select distinct q, a, rank, unnest([a % 4, a % 6]) p from h), g as (select q, p, string_agg('a' || a, ',' order by rank) referenced from p group by all)
    select q query_id, 'p' || p id, round(((q * 7 + p * 3) % 10) / 10, 6) score, (row_number() over (partition by q order by (q * 7 + p * 3) % 10 desc, p))::int rank, referenced from g"""
)
def linked_case_ranks(spark, sf_dir):
    """The cases that the hits' articles link to, by score, each with the articles that link it."""
    hits, chunks, texts = _hits(spark, sf_dir)
    ids = load(spark, sf_dir, "conversations").select("conv_id").distinct()
    c = F.col("conv_id")
    nodes = ids.select(_said("a", c).alias("article_id"), F.array(_said("p", c % 4), _said("p", c % 6)).alias("precedents"))
    scores = ids.select(c.alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("p")).select("query_id", _said("p", F.col("p")).alias("id"), (((F.col("query_id") * 7 + F.col("p") * 3) % 10) / 10).alias("score"))
    found = expand.linked_cases(expand.hit_blocks(hits, chunks), nodes, scores)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank", F.array_join("referenced", ",").alias("referenced"))


GRAMS = "list_distinct(list_transform(range(1, greatest(length({c}), 1)), lambda i: substr({c}, i, 2)))"


@query(f"with p as (select u.conv_id, u.turn, u.text q, a.text t from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1) select conv_id, turn, len(list_intersect({GRAMS.format(c='q')}, {GRAMS.format(c='t')}))::double rescore from p")
def pair_rescores(spark, sf_dir):
    """A second score of question and text, by the stand-in for a cross encoder."""
    c = load(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t"))
    return external.rescored(c.join(after, ["conv_id", "turn"]), "text", "t", external.overlap_reranker).select("conv_id", "turn", "rescore")


# --- the graph, indexes and calls ----------------------------------------------------

NODES = """i as (select p_partkey n, p_partkey % 5 <> 0 cur, p_partkey % 7 law from part where p_partkey % 5 <> 0 or p_partkey % 10 = 0),
    kids as (select p_partkey // 2 n, string_agg('#' || p_partkey, ',' order by '#' || p_partkey) kids from part group by 1), back as (select p_partkey % 13 n, count(*) referenced_by from part where p_partkey > 13 group by 1),
    w as (select i.*, case when n % 10 = 0 then 2 else 0 end pending, (n % 11 = 0)::int sunsets, '#' || n // 2 parents, coalesce(kids, '') implementing, (n > 13)::int refs, ['exception', 'mutatis', 'plain'][n % 3 + 1] cue, coalesce(referenced_by, 0) referenced_by from i left join kids using (n) left join back using (n))"""


def _nodes(spark, sf_dir) -> DataFrame:
    """A part is an article; its half is its parent, its number's rest by 13 is what it refers to."""
    n = F.col("p_partkey")
    p = load(spark, sf_dir, "part").select("p_partkey")
    me = _said("#", n)
    text = F.lit("x")
    none = F.array().cast("array<string>")
    current = p.where(n % 5 != 0).select(me.alias("article_id"), _said("Act ", n % 7).alias("law"), F.lit("법률").alias("level"), _said("제", n, "조").alias("label"))
    pending = p.where(n % 10 == 0).select(me.alias("article_id"), text.alias("kind"), text.alias("effective"), text.alias("promulgated"), text.alias("promulgation_no"), none.alias("changed_paragraphs"), none.alias("changed_detail"), text.alias("new_text"), F.explode(F.array(F.lit(2), F.lit(1))).alias("version"))
    expiry = p.where(n % 11 == 0).select(me.alias("article_id"), none.alias("paragraphs"), text.alias("until"), F.lit(False).alias("partial"), text.alias("source"), text.alias("clause"), text.alias("promulgated"), F.lit(0).alias("pos"))
    delegated = p.select(me.alias("src"), _said("#", F.floor(n / 2)).alias("dst"), F.lit(0).alias("pos"))
    referred = p.where(n > 13).select(me.alias("src"), _said("#", n % 13).alias("dst"), _one_of(n % 3, "exception", "mutatis", "plain").alias("cue"))
    linked = p.select(F.explode(F.array(_said("case ", n % 50), _said("case ", n % 3))).alias("id"), me.alias("article_id")).distinct()
    cases = spark.range(50).select(_said("case ", F.col("id")).alias("id"), _said("20", F.col("id") + 10).alias("decided"))
    return graph.nodes_wide(current, pending, expiry, delegated, referred, linked, cases)


@query(f"with {NODES} select '#' || n article_id, case when cur then 'Act ' || law else '' end law, case when cur then '제' || n || '조' end label, cur in_current, pending, sunsets, parents, implementing, case when refs = 1 then '#' || n % 13 || ':' || cue else '' end refs, referenced_by, case when n % 50 > n % 3 then 'case ' || n % 50 || ',case ' || n % 3 when n % 50 < n % 3 then 'case ' || n % 3 || ',case ' || n % 50 else 'case ' || n % 3 end precedents from w")
def graph_nodes(spark, sf_dir):
    """The nodes of the provision graph, of articles in force or to come, with all their edges nested."""
    w = _nodes(spark, sf_dir)
    cues = F.array_join(F.transform(F.map_entries("reference_cues"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    joined = lambda c: F.array_join(c, ",").alias({"parent_provisions": "parents", "implementing_provisions": "implementing"}.get(c, c))
    law = F.when(F.col("in_current"), F.col("law")).otherwise("")
    return w.select("article_id", law.alias("law"), "label", "in_current", F.size("pending").alias("pending"), F.size("sunsets").alias("sunsets"), joined("parent_provisions"), joined("implementing_provisions"), cues.alias("refs"), F.size("referenced_by").alias("referenced_by"), joined("precedents"))


@query(f"with {NODES} select count(*) nodes, count(*) filter (pending > 0) with_pending, count(*) filter (sunsets > 0) with_sunsets, count(*) with_parent, sum(refs)::bigint edges, count(*) filter (refs = 1 and cue = 'exception') exception, count(*) filter (refs = 1 and cue = 'mutatis') mutatis, count(*) filter (refs = 1 and cue = 'plain') plain, count(*) filter (refs = 1) with_references, count(*) with_precedents from w")
def graph_node_stats(spark, sf_dir):
    """Counts over the nodes."""
    return graph.graph_stats(_nodes(spark, sf_dir))


@query(f"with {NODES} select '#' || n article_id, case when cur then 'Act ' || law else '' end law, case when cur then '제' || n || '조' end label, cur in_current, pending, sunsets, implementing, case when refs = 1 then '#' || n % 13 || ':' || cue else '' end refs from w")
def graph_json(spark, sf_dir):
    """The nodes are written as one JSON object with free keys, in ordered parts, and read again with all that is nested in them."""
    path = f"{shared_dir(spark).rstrip('/')}/graph-{uuid.uuid4().hex}"
    w = stored(_nodes(spark, sf_dir))
    fields = StructType([f for f in w.schema if f.name != "article_id"])
    cases = w.select(F.explode("precedents").alias("id")).distinct().select("id", F.col("id").alias("title"))
    graphjson.write(path, "2020-01-01", w, cases)
    w = graphjson.read(spark, path, "nodes", fields)
    cues = F.array_join(F.transform(F.map_entries("reference_cues"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    law = F.when(F.col("in_current"), F.col("law")).otherwise("")
    return w.select("article_id", law.alias("law"), "label", "in_current", F.size("pending").alias("pending"), F.size("sunsets").alias("sunsets"), F.array_join("implementing_provisions", ",").alias("implementing"), cues.alias("refs"))


@query("select user_id::varchar id, arg_max(event_type, event_id) source, max(event_id)::varchar \"query\" from events group by 1")
def keyed_lines(spark, sf_dir):
    """JSON lines over several files with many lines an id, read as a dict is: the last line of an id in order of files and lines."""
    path = f"{shared_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    e = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("source"), F.col("event_id").cast("string").alias("query"), "event_id")
    e.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").drop("event_id").write.json(path)
    return jsonl.read_keyed(spark, "pairs", path).select("id", "source", "query")


@query("select o_orderkey id, array_to_string(list_filter(range(0, o_orderkey % 20 + 1), lambda i: i % 3 = o_custkey % 3)::varchar[], ',') places from orders")
def changed_paragraphs(spark, sf_dir):
    """the places of a new version's paragraphs that an alignment with the old one finds changed."""
    n = (F.col("o_orderkey") % 20).cast("int")
    old = F.transform(F.sequence(F.lit(0), n), lambda i: _said("l", i))
    new = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i % 3 == F.col("o_custkey") % 3, _said("x", i)).otherwise(_said("l", i)))
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.changed(old, new).alias("at"))
    return rows.select("id", F.array_join(F.transform("at", lambda x: x.cast("string")), ",").alias("places"))


@query("select vec_id, label, round(list_sum(embedding::double[]), 5) total, len(embedding)::int dim, 'hash' model, 'query: ' query_prefix from embeddings where label % 2 = 0")
def index_scan(spark, sf_dir):
    """Two indexes are written with all their vectors, and one is read with its model and query prefix."""
    e = load(spark, sf_dir, "embeddings")
    whole = _index(spark, e.where("label % 2 = 0"), "whole", "cases", e.where("label % 2 = 1"))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return whole.rows.select("vec_id", "label", F.round(total, 5).alias("total"), F.size("embedding").alias("dim"), F.lit(whole.model).alias("model"), F.lit(whole.query_prefix).alias("query_prefix"))


def _index(spark, rows, name="whole", other=None, other_rows=None):
    path = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    if other:
        vectors.write(other_rows, path, other, "hash")
    vectors.write(rows, path, name, "hash", "query: ")
    return vectors.read(spark, path, name)


def _asked(e):
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


INDEXED = "e as (select vec_id, embedding::double[] v from embeddings), s as (select q.vec_id query_id, e.vec_id, list_inner_product(e.v, q.v) score from e, e q where q.vec_id % 50 = 0)"


@query(f"with {INDEXED}, r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) select query_id, rank::int rank, vec_id, round(score, 6) score from r where rank <= 10")
def index_exact(spark, sf_dir):
    """The stated queries against all vectors of a stored index, exact: a few cells, then those that their bound leaves open."""
    e = load(spark, sf_dir, "embeddings")
    index = _index(spark, e)
    hits = vectors.search(index, _asked(e), 10, max(1, index.cells // 8), exact=True)
    return hits.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("select count(*)::bigint queries, 10 k, true reached from embeddings where vec_id % 50 = 0")
def index_recall(spark, sf_dir):
    """Whether as many cells as were measured to suffice give the stated queries nine of ten true neighbours on average."""
    e = load(spark, sf_dir, "embeddings")
    index = _index(spark, e)
    found = vectors.search(index, _asked(e), 10, vectors.probes_for(index, 10))
    true = vectors.search(index, _asked(e), 10, index.cells)
    return vectors.recall(found, true).agg(F.count("*").alias("queries"), F.lit(10).alias("k"), (F.avg("recall") >= 0.9).alias("reached"))


@query(f"with {INDEXED}, r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s where vec_id <> query_id) select query_id, string_agg(vec_id::varchar, ',' order by rank) nearest from r where rank <= 3 group by 1")
def index_fewshot(spark, sf_dir):
    """The nearest three stored examples but the query itself, from a stored index."""
    e = load(spark, sf_dir, "embeddings")
    index = _index(spark, e)
    hits = vectors.search(index, _asked(e), 4, max(1, index.cells // 8), exact=True).where("vec_id <> query_id")
    held = F.slice(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), 1, 3)
    return hits.groupBy("query_id").agg(F.array_join(F.transform(held, lambda x: x["vec_id"].cast("string")), ",").alias("nearest"))


def _counting():
    def call(prompt: str) -> str:
        if len(prompt) % 3 == 0:
            raise ValueError("refused")
        return str(len(prompt))

    return call


@query("select item_id, case when length(text) % 3 <> 0 then length(text)::varchar end response, case when length(text) % 3 = 0 then 'ValueError: refused' end error from benchmark")
def calls_with_errors(spark, sf_dir):
    """A call for each item, its failure a row's error."""
    return external.called_once(load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("prompt")), _counting, ["item_id"], tries=2)


@query("with p as (select item_id id, md5(text) p from benchmark) select id, case when p in (select p from p where id % 2 = 0) then 'held' else '32' end response, null::varchar error from p")
def calls_over_cache(spark, sf_dir):
    """What the cache holds isn't called again; equal requests are one call."""
    jobs = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.md5("text").alias("prompt"))
    held = jobs.where("id % 2 = 0").select(X.request_hash(F.col("prompt")).alias("key"), F.lit("held").alias("response")).distinct()
    return external.cached_calls(jobs, held, _counting)[0].select("id", "response", "error")


# --- scores --------------------------------------------------------------------------

SCORED = """l as (select l_orderkey id, list(distinct 'p' || l_partkey % 7) every, coalesce(list(distinct 'p' || l_partkey % 7) filter (l_returnflag <> 'R'), []) searched, coalesce(list(distinct 'p' || l_partkey % 7) filter (l_linestatus = 'O'), []) cited,
    coalesce(list({'r': l_linenumber, 'a': 'p' || l_partkey % 7}) filter (l_returnflag <> 'R'), []) hits from lineitem group by 1),
    g as (select o_orderkey id, o_custkey c, ['L1', 'OOS', 'L5b', 'L2', 'L2'][substr(o_orderpriority, 1, 1)::int] level, case when o_orderkey % 10 <> 0 then case when o_orderkey % 2 = 0 then 'dev' else 'test' end end split, o_orderkey % 5 <> 0 e, o_orderstatus <> 'F' a, o_orderkey % 7 <> 0 j,
    case when o_orderkey % 4 <> 0 then list_distinct(['p' || o_custkey % 7, 'p' || o_custkey % 3]) else [] end gs, o_orderkey % 3 <> 2 points, case when o_orderkey % 7 = 0 or o_orderkey % 11 = 0 then 0 when o_orderkey % 3 <> 2 then 1 else 2 end n_kp from orders),
    x as (select *, (c % 2 = 0)::int + (n_kp = 2)::int n_true, len(list_intersect(cited, gs)) common, list_min(list_transform(list_filter(hits, lambda h: list_contains(gs, h.a)), lambda h: h.r)) best, j and c % 4 = 0 hedged, a and j judged from g join l using (id)),
    y as (select *, case when judged and n_kp > 0 and e then n_true = n_kp end m4_all_kp, case when e then a else not a or hedged end m2_correct_status from x),
    z as (select *, case when e then coalesce(m4_all_kp, false) end m4_complete from y),
    s as (select id, level, split, case when e then 'answered' else 'insufficient_context' end expected, case when a then 'answered' else 'insufficient_context' end status,
    case when not e then case when not a then case when id % 2 = 0 then 'gate' else 'declined' end when hedged then 'hedged' else 'asserted' end end refusal_mode, case when e then m4_complete else m2_correct_status end m0_correct,
    case when len(gs) > 0 then best is not null end m1_recall_any, case when len(gs) > 0 then len(list_intersect(searched, gs)) = len(gs) end m1_recall_all, case when len(gs) > 0 then coalesce(1.0::double / best, 0) end m1_rr, case when len(gs) > 0 then len(list_intersect(every, gs)) > 0 end m1_with_links_any,
    m2_correct_status, case when a and len(gs) > 0 and len(cited) > 0 then common::double / len(cited) end m3_citation_precision, case when e and len(gs) > 0 then case when a then common::double / len(gs) else 0 end end m3_citation_recall,
    case when judged and n_kp > 0 and e then n_true::double / n_kp when e and not a and points then 0 end m4_kp_coverage, m4_all_kp, m4_complete, case when judged and c % 5 > 0 then (c % 2)::double / (c % 5) end m5_unsupported_rate, case when judged then c % 13 = 0 end m6_temporal_error, case when judged then c % 4 = 0 end soft_refusal_ok, (c % 10)::double cost_krw, c % 1000 latency_ms from z)"""


def _item_scores(spark, sf_dir) -> DataFrame:
    return metrics.item_scores(*_items(spark, sf_dir))


def _items(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Gold, predictions, judgments and splits. An order is a question, its lines are what was retrieved (returned ones over a link, open ones are cited); the rest comes from its keys."""
    part = F.array(_said("p", F.col("l_partkey") % 7)).alias("article_ids")
    l = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(  # noqa: E741
        F.collect_list(F.struct(F.col("l_linenumber").alias("rank"), part, (F.col("l_returnflag") == "R").alias("linked"))).alias("retrieval"),
        F.collect_list(F.when(F.col("l_linestatus") == "O", F.struct(part))).alias("citations"),
    )
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = load(spark, sf_dir, "orders")
    none = F.array().cast("array<string>")
    named = lambda yes: F.when(yes, "answered").otherwise("insufficient_context")
    gold = o.select(
        k.alias("id"), _one_of(F.substring("o_orderpriority", 1, 1).cast("int") - 1, "L1", "OOS", "L5b", "L2", "L2").alias("level"), named(k % 5 != 0).alias("expected_status"),
        F.when(k % 4 != 0, F.array(_said("p", c % 7), _said("p", c % 3))).otherwise(none).alias("gold_evidence"), F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(k % 3 == 1, F.array(F.lit("a"))).otherwise(none).alias("key_points"),
    )
    meta = F.struct(F.when(k % 2 == 0, "retrieval_below_tau").otherwise("model_declined").alias("refusal_reason"), (c % 10).cast("double").alias("cost_krw"), (c % 1000).alias("latency_ms"))
    predictions = o.select(k.alias("id"), named(F.col("o_orderstatus") != "F").alias("status"), meta.alias("meta")).join(l, "id")
    point = lambda i, name, yes: F.struct(F.lit(i).alias("index"), F.lit(name).alias("key_point"), yes.alias("asserted"), F.lit("").alias("quote"))
    points = F.when(k % 11 != 0, F.array(point(1, "a", c % 2 == 0), point(2, "gone", F.lit(True)))).otherwise(F.array().cast("array<struct<index: int, key_point: string, asserted: boolean, quote: string>>"))
    grade = F.struct(points.alias("key_points"), (c % 13 == 0).alias("temporal_error"), (c % 4 != 0).alias("asserts_conclusion"))
    judgments = o.where(k % 7 != 0).select(k.alias("id"), grade.alias("grade"), F.struct((c % 5).alias("n_claims"), (c % 2).alias("n_unsupported")).alias("grounding"))
    splits = o.where(k % 10 != 0).select(k.alias("id"), F.when(k % 2 == 0, "dev").otherwise("test").alias("split"))
    return gold, predictions, judgments, splits


ROUNDED = ("m1_rr", "m3_citation_precision", "m3_citation_recall", "m4_kp_coverage", "m5_unsupported_rate")


@query(f"with {SCORED} select * replace ({', '.join(f'round({c}, 6) as {c}' for c in ROUNDED)}) from s")
def score_records(spark, sf_dir):
    """All rules of an item's score record."""
    s = _item_scores(spark, sf_dir).drop("refusal_reason")
    return s.select(*[F.round(c, 6).alias(c) if c in ROUNDED else c for c in s.columns])


SCOPES = "e as (select 'overall' scope, null::varchar as value, * from s union all select 'level', level, * from s union all select 'split', split, * from s)"
_CASES = {m: f"case when {population} then cast(({expression}) as double) end" for m, (expression, population) in metrics.MEANS.items()}


@query(f"with {SCORED}, {SCOPES} " + " union all ".join(f"select scope, value, '{m}' metric, round(avg({c}), 6) mean, count({c})::bigint n from e group by 1, 2" for m, c in _CASES.items()))
def score_report(spark, sf_dir):
    """The metric table overall, by level and by split, one row a metric."""
    rows = metrics.long_form(metrics.report(_item_scores(spark, sf_dir)))
    return rows.select("scope", "value", "metric", F.round("mean", 6).alias("mean"), "n")


@query(f"with {SCORED}, {SCOPES} select scope, value, count(*)::bigint n, sum(cost_krw) cost, (list_sort(list(latency_ms)))[count(*) // 2 + 1]::bigint p50 from e group by 1, 2")
def score_costs(spark, sf_dir):
    """Cost and upper median of the latency in the same report."""
    return metrics.report(_item_scores(spark, sf_dir)).select("scope", "value", "n", F.col("cost_krw").alias("cost"), F.col("latency_ms_p50").cast("bigint").alias("p50"))


@query(f"with {SCORED} select id, level from s where not m2_correct_status or coalesce(not m1_recall_any, false) or coalesce(not m4_all_kp, false) or coalesce(m5_unsupported_rate > 0, false) or coalesce(m6_temporal_error, false)")
def score_failing(spark, sf_dir):
    """Items with any sign of failure."""
    return metrics.failing(_item_scores(spark, sf_dir)).select("id", "level")


@query(f"with {SCORED} select id::varchar id, case when id % 2 = 0 then 'even' else 'odd' end run, status, m0_correct, round(m1_rr, 6) m1_rr, latency_ms from s")
def run_files(spark, sf_dir):
    """Score records are written as JSON lines, a folder for each run, and read again."""
    path = f"{shared_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    s = _item_scores(spark, sf_dir)
    jsonl.write_runs(s.withColumn("run", F.when(F.col("id") % 2 == 0, "even").otherwise("odd")).withColumn("id", F.col("id").cast("string")), "scores", path)
    return jsonl.read_runs(spark, "scores", f"{path}/scores/*").select("id", "run", "status", "m0_correct", F.round("m1_rr", 6).alias("m1_rr"), "latency_ms")


@query("select conv_id, md5('[질문]' || chr(10) || 'Q' || conv_id || chr(10) || chr(10) || '[조문]' || chr(10) || string_agg(substr(text, 1, 1500), chr(10) || chr(10) order by turn)) digest from conversations group by 1")
def judge_prompts(spark, sf_dir):
    """What a judge is shown, each article up to the operator's limit."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("ts"))
    return c.select("conv_id", F.md5(evaluate.judge_prompt(_said("Q", F.col("conv_id")), F.col("ts"))).alias("digest"))


@query("""select conv_id, '[' || string_agg('{"turn":' || turn || ',"role":"' || role || '","mark":"<\\/' || role || '>"}', ',' order by turn) || ']' payload from conversations group by 1""")
def review_payloads(spark, sf_dir):
    """Rows as JSON that may stand inside a script element."""
    c = load(spark, sf_dir, "conversations").withColumn("mark", _said("</", F.col("role"), ">"))
    return c.groupBy("conv_id").agg(reports.payload("turn", "role", "mark").alias("payload"))


# --- reviews -------------------------------------------------------------------------

_SORTED = "array_to_string(list_sort({}), ',')"


@query(
    f"with {SCORED} select id, {_SORTED.format('gs')} gold, {_SORTED.format('list_intersect(gs, searched)')} found_search, {_SORTED.format('list_filter(gs, lambda x: list_contains(every, x) and not list_contains(searched, x))')} found_link,"
    f" {_SORTED.format('list_filter(gs, lambda x: not list_contains(every, x))')} missing, (select count(*) from lineitem where l_orderkey = id)::int retrieved from g join l using (id)"
)
def item_report(spark, sf_dir):
    """An item's evidence by how it was found."""
    gold, predictions, judgments, splits = _items(spark, sf_dir)
    rows = review.item_report(gold.withColumn("question", F.lit("q")), predictions, metrics.item_scores(gold, predictions, judgments, splits))
    joined = [F.array_join(c, ",").alias(c) for c in ("gold", "found_search", "found_link", "missing")]
    return rows.select("id", *joined, F.size("retrieved").alias("retrieved"))


@query(
    """with v as (select o_custkey id, o_orderkey % 3 point, o_orderkey run, case when o_orderkey % 9 > 0 then o_totalprice > 150000 end a, o_totalprice > 150000 + 1000 * (o_orderkey % 2) b, o_totalprice > 150000 or o_orderkey % 7 = 0 c from orders),
    g as (select id, point, bool_and(a = b and b = c) agreed, arg_min({'run': run, 'verdict': a}, md5(concat_ws(':', '0', id, point, run))) s from v where a is not null and b is not null and c is not null group by 1, 2) select id, point, s.run run, s.verdict verdict from g where agreed"""
)
def blind_cards(spark, sf_dir):
    """Points that all judges agree on in every run, and the run that is shown."""
    k, t = F.col("o_orderkey"), F.col("o_totalprice")
    v = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (k % 3).alias("point"), k.alias("run"), F.when(k % 9 > 0, t > 150000).alias("a"), (t > 150000 + 1000 * (k % 2)).alias("b"), ((t > 150000) | (k % 7 == 0)).alias("c"))
    return review.blind_cards(v, ["a", "b", "c"])


@query(f"with {NODES} select '#' || n article_id, md5(array_to_string(list_concat(flatten(list_transform(range(pending), lambda i: ['x', 'x', 'x'])), flatten(list_transform(range(sunsets), lambda i: ['x', 'x']))), chr(10))) facts from w")
def temporal_facts(spark, sf_dir):
    """All that a node says about time, as one text."""
    return _nodes(spark, sf_dir).select("article_id", F.md5(review.temporal_text()).alias("facts"))


@query(
    f"""with {NODES}, it as (select n id, ['#' || n, '#' || n // 2, '#' || n % 13] || case when n % 4 = 0 then ['판례#' || n] else [] end ev from w), e as (select id, ev, unnest(ev) a from it), j as (select distinct id, ev, a, w.n, pending, cur from e left join w on '#' || w.n = a),
    x as (select id, bool_or(list_contains(list_transform(list_filter(ev, lambda b: b like '#%' and try_cast(substr(b, 2) as bigint) > 13 and try_cast(substr(b, 2) as bigint) % 13 = n and try_cast(substr(b, 2) as bigint) % 3 = 0), lambda b: 1), 1) and n is not null) exception,
    bool_or(n is not null and n % 3 > 0) split, bool_or(n is not null and (pending > 0 or not cur)) temporal, bool_or(n is not null and len(list_filter(ev, lambda b: b like '#%' and try_cast(substr(b, 2) as bigint) // 2 = n)) > 0) delegation, bool_or(a like '판례#%') precedent from j group by 1)
    select id, array_to_string(list_filter([case when exception then 'exception' end, case when split then 'split' end, case when temporal then 'temporal' end, case when delegation then 'delegation' end, case when precedent then 'precedent' end], lambda t: t is not null), ',') tags from x"""
)
def item_tags(spark, sf_dir):
    """The tags of an item by its evidence's nodes, texts and chunks."""
    w = stored(_nodes(spark, sf_dir))
    n = F.substring(F.col("article_id"), F.lit(2), F.lit(20)).cast("bigint")
    evidence = F.concat(F.array("article_id", _said("#", F.floor(n / 2)), _said("#", n % 13)), F.when(n % 4 == 0, F.array(_said("판례#", n))).otherwise(F.array().cast("array<string>")))
    items = w.select(n.alias("id"), F.lit("a").alias("as_of"), evidence.alias("gold_evidence"), F.array(F.array(F.lit("al pha"), F.lit("no")), F.array(F.lit("beta"))).alias("key_point_literals"))
    chunks = w.select(F.array("article_id").alias("article_ids"), F.explode(F.sequence(F.lit(0), n % 3)).alias("i")).select("article_ids", _said(F.col("article_ids")[0], ":", F.col("i")).alias("chunk_id"), _one_of(F.col("i"), "alpha", "x be ta", "none").alias("text"))
    tags = review.item_tags(items, w, chunks, w.select("article_id", F.lit("t").alias("text")))
    return tags.select("id", F.array_join("tags", ",").alias("tags"))


@query("select o_orderkey id, [" + ", ".join(f"'{v}'" for v in X.SHORT_LAWS.values()) + "][o_orderkey % 8 + 1] || ['', ' 시행령', ' 시행규칙'][o_custkey % 3 + 1] short from orders")
def short_laws(spark, sf_dir):
    """Laws by their short names."""
    law = _said(_one_of(F.col("o_orderkey") % 8, *X.SHORT_LAWS), _one_of(F.col("o_custkey") % 3, "", " 시행령", " 시행규칙"), "#", F.col("o_orderkey"), "의2")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), X.short_law(law).alias("short"))


@query("select event_id, user_id, case when event_id % 3 = 0 then 'first' else 'second' end verdict from events")
def ledger_appends(spark, sf_dir):
    """Two jobs append verdicts to a ledger, the second for all keys and twice; each key is held once, as it came first."""
    path = f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    e = load(spark, sf_dir, "events").select("event_id", "user_id")
    ledger.append(e.where("event_id % 3 = 0").withColumn("verdict", F.lit("first")), path, ["event_id"])
    for _ in range(2):
        ledger.append(e.withColumn("verdict", F.lit("second")), path, ["event_id"])
    return ledger.read(spark, path).select("event_id", "user_id", "verdict")


# --- parsers -------------------------------------------------------------------------


@query("select o_orderkey id, ['exception', 'mutatis', 'plain', 'exception'][o_orderkey % 4 + 1] || ',' || ['exception', 'mutatis', 'plain', 'exception'][o_custkey % 4 + 1] cues from orders")
def statute_cues(spark, sf_dir):
    """a statute's sentences, and the strongest cue of each."""
    s = ("제1조를 적용하지 아니한다.", "제2조를 준용한다.", "제3조에 따른다.", "제4조에도 불구하고 준용한다.")
    text = _said(_one_of(F.col("o_orderkey") % 4, *s), " ", _one_of(F.col("o_custkey") % 4, *s))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.transform(X.sentences(text), X.cue), ",").alias("cues"))


@query(
    """select o_orderkey id, array_to_string(list_concat(list_concat([a], case when b - a <= 10 then range(a + 1, b) else [] end), [b])::varchar[], ',') || ',90의2' own, '근로기준법#' || a || ',근로기준법#' || b || '의2,상법#' || o_custkey cited
    from (select *, o_orderkey % 50 + 1 a, o_orderkey % 50 + 1 + o_custkey % 13 b from orders)"""
)
def statute_references(spark, sf_dir):
    """references within a law, with ranges and another law's left out, and those of a case, with a replaced law's left out."""
    a = F.col("o_orderkey") % 50 + 1
    b = a + F.col("o_custkey") % 13
    own = _said("제", a, "조부터 제", b, "조까지 및 제90조의2에 따라 민법 제7조는")
    cited = _said("근로 기준법 제", a, "조, [1] 제", b, "조의2 / 구 민법(1958. 2. 22. 법률로 전부 개정되기 전의 것) 제5조, 제6조 / 상법 제", F.col("o_custkey"), "조")
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.same_law_references(own).alias("own"), S.cited_articles(cited).alias("cited"))
    return rows.select("id", F.array_join("own", ",").alias("own"), F.array_join(F.transform("cited", lambda x: F.concat(x["law"], F.lit("#"), x["key"])), ",").alias("cited"))


@query("select doc_id, md5(text) || '|' || md5(source) issues, case when length(t) <= 600 then t when regexp_extract(substr(t, 1, 600), '(?s)^(.+다\\.)', 1) <> '' then regexp_extract(substr(t, 1, 600), '(?s)^(.+다\\.)', 1) || ' …(이하 생략)' else substr(t, 1, 600) || ' …(이하 생략)' end cut from (select *, replace(text, '.', '다.') t from documents)")
def case_texts(spark, sf_dir):
    """a case's issues, and its holding cut at a sentence."""
    said = _said("[1] ", F.md5("text"), " / too short\n [2] ", F.md5("source"))
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(X.issues(said), "|").alias("issues"), X.truncated(F.replace("text", F.lit("."), F.lit("다.")), 600).alias("cut"))


@query(
    """with p as (select 'Act ' || o_custkey % 50 || '#' || (o_orderkey % 7 + 1) || case when o_orderkey % 4 = 0 then '의2' else '' end article_id, o_orderkey % 7 + 1 k, o_orderkey % 4 = 0 branch, o_orderkey % 3 = 0 paras, o_orderkey % 5 = 0 part, '2021-' || lpad((o_orderkey % 12 + 1)::varchar, 2, '0') || '-05' until from orders)
    select article_id, case when paras then '①②' else '' end paragraphs, until, part "partial", '부칙(2019-01-01)' source, count(*)::bigint n from p where k <> 3 and (not branch or k <= 2) group by all"""
)
def expiry_clauses(spark, sf_dir):
    """Expiry clauses joined with the articles in force, unless their paragraphs were rewritten since."""
    k, law = F.col("o_orderkey"), _said("Act ", F.col("o_custkey") % 50)
    o = load(spark, sf_dir, "orders")
    clause = _said("제", k % 7 + 1, "조", F.when(k % 4 == 0, "의2").otherwise(""), F.when(k % 3 == 0, "제1항 및 제2항").otherwise(""), "의 개정규정", F.when(k % 5 == 0, " 중 일부").otherwise(""), "은 2021년 ", k % 12 + 1, "월 5일까지 효력을 가진다.")
    provisions = o.select(law.alias("name"), F.lit("2019-01-01").alias("promulgated"), clause.alias("clause_text"))
    keys = F.array(*[F.lit(str(i)) for i in range(1, 8)], F.lit("1의2"), F.lit("2의2"))
    none = F.array().cast("array<string>")
    para = lambda no, text: F.struct(F.lit(no).alias("no"), text.alias("text"), none.alias("items"))
    first = F.when(F.col("key") == "3", "x <개정 2020. 5. 1.>").otherwise("x <개정 2018. 5. 1.>")
    current = o.select(law.alias("law")).distinct().select("law", F.explode(keys).alias("key")).select(X.article_id("law", "key").alias("article_id"), F.array(para("①", first), para("③", F.lit("y"))).alias("paragraphs"))
    found = graph.sunsets(current, provisions)
    return found.groupBy("article_id", F.array_join("paragraphs", "").alias("paragraphs"), "until", "partial", "source").agg(F.count("*").alias("n"))
