"""Sources, sets, samples, hashes and caches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import sampling
from lexspark.queries.registry import load, query
from lexspark.sources import cache, rest


@query("select c_custkey from customer except select o_custkey from orders")
def set_difference(spark, sf_dir):
    """U05, R15, R16."""
    c, o = load(spark, sf_dir, "customer").select("c_custkey"), load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti").distinct()


@query("select kind, count(*)::bigint n, sum(id)::bigint total from (select 'document' kind, doc_id id from documents union all select 'page', page_id from pages) group by 1")
def union_all(spark, sf_dir):
    """U02."""
    d = load(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    p = load(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"))
    return d.unionByName(p).groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@query("select l_partkey % 100 key from lineitem union select ps % 100 from (select p_partkey ps from part)")
def union_distinct(spark, sf_dir):
    """U01, U03."""
    a = load(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("key"))
    return a.union(load(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("key"))).distinct()


@query("select source, count(*)::bigint n, round(avg((lang = 'en')::int), 6) share_en from documents group by 1")
def count_by_group(spark, sf_dir):
    """A18, A24."""
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg((F.col("lang") == "en").cast("int")), 6).alias("share_en"))


@query("with t as (select lang, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) w from documents) select lang, count(distinct x)::bigint n_words, count(*)::bigint total from (select lang, unnest(w) x from t) group by 1")
def distinct_exploded(spark, sf_dir):
    """Distinct words by language; grouped twice, so that a language with most of the rows is split by word first."""
    w = load(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(X.words(F.lower("text")))).alias("w"))
    return w.groupBy("lang", "w").agg(F.count("*").alias("c")).groupBy("lang").agg(F.count("*").alias("n_words"), F.sum("c").alias("total"))


@query("select min(doc_id) first, count(*)::bigint copies from documents group by text having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """A26."""
    return load(spark, sf_dir, "documents").groupBy(F.xxhash64("text").alias("h"), F.md5("text").alias("m")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("first", "copies")


REASON = "case when n_chars < 100 then 'short' when quality = 0 then 'quality' when toxic = 1 then 'toxic' when lang <> 'en' then 'language' else 'kept' end"


@query(f"select {REASON} reason, count(*)::bigint n from documents left join labels using (doc_id) group by 1")
def drop_reasons(spark, sf_dir):
    """The first reason that holds."""
    d = load(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy(F.expr(REASON).alias("reason")).agg(F.count("*").alias("n"))


@query("select lang, doc_id, pick::int pick from (select lang, doc_id, row_number() over (partition by lang order by md5('42:' || doc_id), doc_id) pick from documents) where pick <= 10")
def stratified_sample(spark, sf_dir):
    """A sampling operator; its limit is the sample's size."""
    return sampling.stratified(load(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 10)


@query("select doc_id from documents where ('0x' || substr(md5('42:' || doc_id), 1, 8))::bigint < 858993459")
def hash_subsample(spark, sf_dir):
    """A fifth of the rows by hash."""
    return sampling.fraction(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.2)


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by md5('42:' || doc_id), doc_id) k from documents) where k = 1")
def one_per_group(spark, sf_dir):
    """T16, R16."""
    return sampling.one_of_each(load(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


@query("select kind, count(*)::bigint pool, min(doc_id) first from (select 'long' kind, doc_id from documents where n_chars > 5000 union all select 'lines', doc_id from documents where contains(text, chr(10)) union all select 'digits', doc_id from documents where regexp_matches(text, '[0-9]{4}') union all select 'foreign', doc_id from documents where lang <> 'en') where doc_id not in (select doc_id from labels) group by 1")
def candidate_mining(spark, sf_dir):
    """Typed filters in one scan, unused rows only."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    kinds = F.array(F.when(F.col("n_chars") > 5000, "long"), F.when(F.contains("text", F.lit("\n")), "lines"), F.when(F.col("text").rlike("[0-9]{4}"), "digits"), F.when(F.col("lang") != "en", "foreign"))
    return d.select("doc_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("kind")).groupBy("kind").agg(F.count("*").alias("pool"), F.min("doc_id").alias("first"))


@query("select doc_id, lang from (select *, row_number() over (partition by text order by doc_id) k from documents) where k = 1")
def dedup_first_wins(spark, sf_dir):
    """The first of equal texts, as an aggregate by digest."""
    d = load(spark, sf_dir, "documents").groupBy(F.md5("text").alias("m"), F.length("text").alias("n")).agg(F.min(F.struct("doc_id", "lang")).alias("r"))
    return d.select("r.doc_id", "r.lang")


@query(
    """with c as (select source, count(*) n from documents group by 1), f as (select doc_id, source, n, n_chars from documents join c using (source) where doc_id not in (select doc_id from labels)),
    o as (select doc_id, source, row_number() over (order by n, source, n_chars desc, doc_id) k from f) select doc_id, source from o where k <= 100"""
)
def capped_smallest_first(spark, sf_dir):
    """The smallest group first, its newest first, what is held left out, up to the cap (the operator's own)."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    held = load(spark, sf_dir, "labels").select("doc_id")
    return rest.bulk_order(d, held, held.count() + 100, "source", "doc_id", "n_chars").select("doc_id", "source")


@query("select page_id, case when t <> '' then t else substr(html, 1, 40) end title, t = '' fallback from (select page_id, html, trim(regexp_extract(html, '(?s)<h2[^>]*>(.*?)</h2>', 1)) t from pages)")
def fallback_column(spark, sf_dir):
    """A field, or the opening of another when it is empty."""
    t = X.strip(F.regexp_extract("html", r"(?s)<h2[^>]*>(.*?)</h2>", 1))
    p = load(spark, sf_dir, "pages").select("page_id", "html", t.alias("t"))
    return p.select("page_id", F.when(F.col("t") != "", F.col("t")).otherwise(F.substring("html", 1, 40)).alias("title"), (F.col("t") == "").alias("fallback"))


@query("select p_partkey, case when p_name like '%widget' then 'rule' when p_name like '%ring' then 'decree' else 'law' end level from part")
def case_suffix(spark, sf_dir):
    """P03."""
    n = F.col("p_name")
    return load(spark, sf_dir, "part").select("p_partkey", F.when(n.endswith("widget"), "rule").when(n.endswith("ring"), "decree").otherwise("law").alias("level"))


@query("select o_orderkey, case o_orderpriority when '1-URGENT' then 'U' when '2-HIGH' then 'H' when '5-LOW' then 'L' else '?' end || lower(o_orderstatus) short from orders")
def map_lookup(spark, sf_dir):
    """P22."""
    names = F.create_map(*[F.lit(x) for p in (("1-URGENT", "U"), ("2-HIGH", "H"), ("5-LOW", "L")) for x in p])
    return load(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.coalesce(names[F.col("o_orderpriority")], F.lit("?")), F.lower("o_orderstatus")).alias("short"))


@query("select doc_id, sha256(text) digest, substr(sha256(text), 1, 12) short, sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') request from documents")
def content_hash(spark, sf_dir):
    """Content digests, and the hash of a request with its keys in order."""
    h = F.sha2("text", 256)
    return load(spark, sf_dir, "documents").select("doc_id", h.alias("digest"), F.substring(h, 1, 12).alias("short"), X.request_hash(F.col("lang"), F.col("source")).alias("request"))


@query("with c as (select distinct md5(text) h from documents where doc_id % 2 = 0) select count(*)::bigint n, count(*) filter (md5(text) in (select h from c))::bigint hits from documents")
def cache_hit_miss(spark, sf_dir):
    """A cache filled by half of the requests."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"))
    held = d.where("doc_id % 2 = 0").select("key", F.lit("seen").alias("content")).distinct()
    return cache.looked_up(d, held).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels where quality is not null and toxic = 0)")
def resume_anti_join(spark, sf_dir):
    """Jobs whose verdict isn't held; failed ones were never stored."""
    jobs = load(spark, sf_dir, "documents").select("doc_id")
    done = load(spark, sf_dir, "labels").withColumn("error", F.when(F.col("toxic") != 0, "failed"))
    return cache.remaining(jobs, done.where("quality is not null"), ["doc_id"])


@query("select user_id, event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) signup from events")
def carry_forward(spark, sf_dir):
    """The last heading holds until the next."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return load(spark, sf_dir, "events").select("user_id", "event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), True).over(w).alias("signup"))


@query("select conv_id, md5('conversation ' || conv_id || chr(10) || string_agg(role || chr(10) || '  ' || text, chr(10) order by turn)) digest, count(*)::bigint n from conversations group by 1")
def nested_render(spark, sf_dir):
    """A header, then each part with its items indented."""
    p = F.struct(F.col("turn").cast("string").alias("no"), F.col("role").alias("text"), F.array("text").alias("items"))
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", p.alias("p")))), lambda x: x["p"]).alias("ps"), F.count("*").alias("n"))
    return c.select("conv_id", F.md5(X.rendered(F.concat(F.lit("conversation "), F.col("conv_id").cast("string")), "ps")).alias("digest"), "n")


@query("select conv_id, md5(string_agg(case when turn > 0 and contains(text, chr(10)) then substr(text, strpos(text, chr(10)) + 1) else text end, chr(10) order by turn)) digest from conversations group by 1")
def reassemble(spark, sf_dir):
    """parts put together again, the repeated first line dropped from all but the first."""
    cut = F.when((F.col("turn") > 0) & F.contains("text", F.lit("\n")), F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.col("text"))
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", cut.alias("t")))), lambda x: x["t"]).alias("ts"))
    return c.select("conv_id", F.md5(F.array_join("ts", "\n")).alias("digest"))


@query("with u as (select conv_id k, 0 stage, turn pos, text from conversations union all select page_id, 1, 0, url from pages where page_id in (select conv_id from conversations)) select k, stage, pos::bigint pos, 'S' || row_number() over (partition by k order by stage, pos) source from u")
def block_numbering(spark, sf_dir):
    """W01, R19."""
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("k"), F.lit(0).alias("stage"), F.col("turn").alias("pos"))
    p = load(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), F.lit(1).alias("stage"), F.lit(0).cast("bigint").alias("pos"))
    p = p.join(c.select("k").distinct(), "k", "left_semi").select("k", "stage", "pos")
    w = Window.partitionBy("k").orderBy("stage", "pos")
    return c.unionByName(p).select("k", "stage", "pos", F.concat(F.lit("S"), F.row_number().over(w).cast("string")).alias("source"))


@query("select source, bool_or(quality = 0) pending, max((toxic = 1)::int) toxic from documents join labels using (doc_id) group by 1")
def any_flag(spark, sf_dir):
    """P16."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("source").agg(F.bool_or(F.col("quality") == 0).alias("pending"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))


@query("select doc_id from documents where length(text) >= 60 and strpos(substr(text, 1, 120), '!!') = 0")
def substantive_filter(spark, sf_dir):
    """P13."""
    return load(spark, sf_dir, "documents").where((F.length("text") >= 60) & (F.instr(F.substring("text", 1, 120), "!!") == 0)).select("doc_id")


@query("select doc_id from documents where regexp_matches(text, '(^|[^a-z])(this|dies|esto)[^a-z]')")
def regex_filter(spark, sf_dir):
    """P14, P09."""
    return load(spark, sf_dir, "documents").where(F.col("text").rlike("(^|[^a-z])(this|dies|esto)[^a-z]")).select("doc_id")


@query("select n_nationkey, r_regionkey from nation join region on upper(replace(' ' || r_name || ' ', ' ', '')) = replace(upper(r_name), ' ', '') and n_regionkey = r_regionkey")
def normalized_key_join(spark, sf_dir):
    """Names are compared without white space and case."""
    r = load(spark, sf_dir, "region")
    spaced = r.select("r_regionkey", F.upper(X.squeezed(F.concat(F.lit(" "), F.substring("r_name", 1, 2), F.lit(" "), F.expr("substring(r_name, 3)")))).alias("name"))
    n = load(spark, sf_dir, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.upper(X.squeezed("r_name")).alias("name"))
    return n.join(F.broadcast(spaced), "name").select("n_nationkey", "r_regionkey")

