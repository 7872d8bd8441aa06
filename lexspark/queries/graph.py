"""Graph edges, expansion, versions and validity on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import graph as G
from lexspark.queries.registry import load, query
from lexspark.tables import stored

# a page's links: src is the page, dst the word linked to; the cue comes from the word
LINKS = """raw as (select page_id src, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) dst, generate_subscripts(regexp_extract_all(html, 'href="/([^"]*)"', 1), 1) - 1 pos from pages),
    cued as (select *, case when length(dst) > 8 then 'exception' when length(dst) > 4 then 'mutatis' else 'plain' end cue, case when length(dst) > 8 then 0 when length(dst) > 4 then 1 else 2 end r from raw where dst <> ''),
    edges as (select src, lower(dst) dst, min(pos) pos, min(r) r, arg_min(cue, r) cue from cued group by 1, 2)"""


def _links(spark, sf_dir):
    raw = load(spark, sf_dir, "pages").select(F.col("page_id").alias("src"), F.posexplode(F.regexp_extract_all("html", F.lit(r'href="/([^"]*)"'), F.lit(1))).alias("pos", "dst")).where("dst <> ''")
    cue = F.when(F.length("dst") > 8, "exception").when(F.length("dst") > 4, "mutatis").otherwise("plain")
    return raw.select("src", F.lower("dst").alias("dst"), "pos", cue.alias("cue"))


@query(f"with {LINKS} select src, dst, pos::int pos from edges")
def graph_edges(spark, sf_dir):
    """Distinct citations in order of first appearance."""
    return _links(spark, sf_dir).groupBy("src", "dst").agg(F.min("pos").alias("pos"))


@query(f"with {LINKS} select src, dst, cue from edges")
def graph_edges_strongest(spark, sf_dir):
    """J06, A20."""
    return G.strongest(_links(spark, sf_dir))


@query(f"with {LINKS} select dst, string_agg(src::varchar, ',' order by src) sources, count(*)::bigint n from edges group by 1")
def graph_invert(spark, sf_dir):
    """J08, T05."""
    inv = G.inverted(_links(spark, sf_dir))
    return inv.select("dst", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"), F.size("sources").cast("bigint").alias("n"))


@query(
    f"""with {LINKS}, ids as (select dst id from edges union select distinct lower(p_name) from part), o as (select dst id, string_agg(src::varchar || ':' || cue, ',' order by src) cues, count(*) n from edges group by 1)
    select id, coalesce(cues, '') cues, coalesce(n, 0)::bigint n, o.id is not null in_graph from ids left join o using (id)"""
)
def graph_nodes_wide(spark, sf_dir):
    """The union of ids with the edges nested."""
    e = G.strongest(_links(spark, sf_dir))
    ids = e.select(F.col("dst").alias("id")).union(load(spark, sf_dir, "part").select(F.lower("p_name").alias("id"))).distinct()
    nest = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "cue"))), lambda x: F.concat(x["src"].cast("string"), F.lit(":"), x["cue"])), ",")
    o = e.groupBy(F.col("dst").alias("id")).agg(nest.alias("cues"), F.count("*").alias("n"))
    return ids.join(o, "id", "left").select("id", F.coalesce("cues", F.lit("")).alias("cues"), F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("in_graph"))


@query(f"with {LINKS} select count(*)::bigint edges, count(distinct src)::bigint n_src, count(distinct dst)::bigint n_dst, count(*) filter (cue = 'exception')::bigint exception, count(*) filter (cue = 'mutatis')::bigint mutatis, count(*) filter (cue = 'plain')::bigint plain from edges")
def graph_stats(spark, sf_dir):
    """A29."""
    e = G.strongest(_links(spark, sf_dir))
    return e.agg(F.count("*").alias("edges"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"), *[F.count_if(F.col("cue") == c).alias(c) for c in ("exception", "mutatis", "plain")])


@query(
    """with b as (select c_nationkey q, c_custkey, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) k from customer), h as (select q, c_custkey, k from b where k <= 5), s as (select distinct q, 'customer ' || c_custkey dst from h),
    e as (select q, k, 0 kind, 'nation ' || q dst, 0 j from h where k <= 3 union all select q, k, 0, 'region ' || n_regionkey, 1 from h join nation on n_nationkey = q where k <= 3 union all select h.q, h.k, 1, 'order ' || o_orderkey, row_number() over (partition by h.q, h.k order by o_orderkey) from h join orders on o_custkey = h.c_custkey where h.k <= 3),
    f as (select q, dst, min(k * 1000000 + kind * 100000 + j) place from e where (q, dst) not in (select q, dst from s) group by 1, 2), r as (select *, row_number() over (partition by q order by place, dst) n from f)
    select q, dst, n::int n from r where n <= 8"""
)
def link_expand(spark, sf_dir):
    """From the first three hits, parents before children, each once, up to the cap."""
    c = load(spark, sf_dir, "customer")
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    h = c.withColumn("k", F.row_number().over(w)).where("k <= 5").select(F.col("c_nationkey").alias("q"), "c_custkey", "k")
    top = h.where("k <= 3")
    n = load(spark, sf_dir, "nation")
    up = top.join(F.broadcast(n), F.col("q") == F.col("n_nationkey"))
    named = lambda a, b: F.concat(F.lit(a), b.cast("string"))
    parents = up.select("q", "k", F.lit(0).alias("kind"), F.posexplode(F.array(named("nation ", F.col("q")), named("region ", F.col("n_regionkey")))).alias("j", "dst"))
    kids = top.join(load(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    kids = kids.select("q", "k", F.lit(1).alias("kind"), F.row_number().over(Window.partitionBy("q", "k").orderBy("o_orderkey")).alias("j"), named("order ", F.col("o_orderkey")).alias("dst"))
    seen = h.select("q", named("customer ", F.col("c_custkey")).alias("dst"))
    cand = parents.unionByName(kids).join(seen, ["q", "dst"], "left_anti")
    once = cand.groupBy("q", "dst").agg(F.min(F.struct("k", "kind", "j")).alias("place"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("place", "dst"))).where("n <= 8").select("q", "dst", "n")


@query(
    f"""with {LINKS}, h as (select src q, dst, pos from edges where pos < 3), c as (select h.q, e.src, count(distinct h.dst) n, min(e.r) cue, min(h.pos) rank from h join edges e on e.dst = h.dst and e.src <> h.q where e.r < 2 group by all),
    r as (select *, row_number() over (partition by q order by n desc, cue, rank, src) k from c) select q, src, n::bigint n, k::int k from r where k <= 2"""
)
def reverse_expand(spark, sf_dir):
    """Sources that share strong targets with the first hits, however many share them."""
    e = stored(_links(spark, sf_dir))
    strong = G.strongest(e).withColumn("r", X.cue_rank("cue")).where("r < 2").select("src", "dst", "r")
    h = e.groupBy(F.col("src").alias("q"), "dst").agg(F.min("pos").alias("pos")).where("pos < 3")
    return G.sharing(h, strong, 2, 3).select("q", "src", "n", "k")


VERSIONS = "v as (select user_id, event_type, (day(ts) - 1) // 7 w, count(*) body from events group by all)"


def _versions(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type", F.floor((F.dayofmonth("ts") - 1) / 7).alias("w")).agg(F.count("*").alias("body"))


@query(f"with {VERSIONS}, a as (select * from v where w = 0), b as (select * from v where w = 1) select user_id, event_type, case when a.body is null then 'added' when b.body is null then 'deleted' else 'modified' end kind, a.body old_body, b.body new_body from a full join b using (user_id, event_type) where a.body is distinct from b.body")
def version_diff(spark, sf_dir):
    """J01, U01, R01."""
    v = _versions(spark, sf_dir)
    side = lambda w: v.where(F.col("w") == w).select("user_id", "event_type", "body")
    return G.full_diff(side(0), side(1), ["user_id", "event_type"], "body").select("user_id", "event_type", "kind", "old_body", "new_body")


@query(f"with {VERSIONS}, s as (select generate_series w from generate_series(0, 3)), x as (select user_id, event_type, w + 1 w, body from v where w <= 3), y as (select * from v where w >= 1) select user_id, event_type, w::bigint w, case when x.body is null then 'added' when y.body is null then 'deleted' else 'modified' end kind from x full join y using (user_id, event_type, w) where x.body is distinct from y.body")
def version_chain(spark, sf_dir):
    """Each version against the one before it, all pairs in one join."""
    v = _versions(spark, sf_dir)
    old = v.where("w <= 3").withColumn("w", F.col("w") + 1)
    return G.full_diff(old, v.where("w >= 1"), ["user_id", "event_type", "w"], "body").select("user_id", "event_type", "w", "kind")


@query(f"with {VERSIONS} select user_id, event_type, min(w)::bigint first from v where w > 0 and (user_id, event_type) not in (select user_id, event_type from v where w = 0) group by all")
def added_only(spark, sf_dir):
    """What only later versions have; the first of them."""
    v = _versions(spark, sf_dir).withColumn("article_id", F.concat_ws("#", F.col("user_id").cast("string"), "event_type"))
    got = G.future_only(v.where("w = 0"), v.where("w > 0"), ["w"])
    return got.select("user_id", "event_type", F.col("w").alias("first"))


@query("select l_orderkey, l_linenumber, l_shipdate < timestamp '2000-06-01' expired from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F'")
def expiry_join(spark, sf_dir):
    """J03."""
    o = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    l = load(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", (F.col("l_shipdate") < F.lit("2000-06-01").cast("timestamp")).alias("expired"))


ASOF = """s as (select o_orderkey, o_orderstatus = 'F' in_current, bool_or(l_linestatus = 'F' and l_returnflag = 'R') partial, bool_or(not (l_linestatus = 'F' and l_returnflag = 'R') and l_returnflag = 'A' and l_shipdate < timestamp '2000-06-01') gone, bool_or(l_returnflag = 'N' and l_shipdate > timestamp '2000-06-01') coming from orders join lineitem on l_orderkey = o_orderkey group by 1, 2),
    t as (select o_orderkey, case when gone then 'expired' when in_current and partial then 'unknown' when in_current and coming then 'amendment_pending' when in_current then 'in_force' else 'pending' end status from s)"""


def _asof(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    partial = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")
    none = F.array().cast("array<string>")
    sunset = F.when(partial | (F.col("l_returnflag") == "A"), F.struct((~partial).alias("last"), none.alias("paragraphs"), day.alias("until"), partial.alias("partial"), F.lit("").alias("source"), F.lit("").alias("clause")))
    pending = F.when(F.col("l_returnflag") == "N", F.struct(F.lit("modified").alias("kind"), day.alias("effective"), day.alias("promulgated")))
    per = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(sunset)).alias("sunsets"), F.collect_list(pending).alias("pending"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").alias("in_current"))
    return o.join(per, "o_orderkey").withColumn("s", G.status_at(F.lit("2000-06-01")))


@query(f"with {ASOF} select o_orderkey, status from t")
def status_asof(spark, sf_dir):
    """Lines are expiry clauses or coming changes of their order."""
    return _asof(spark, sf_dir).select("o_orderkey", F.col("s.status").alias("status"))


@query(f"with {ASOF} select o_custkey, arg_min(status, case status when 'expired' then 0 when 'unknown' then 2 when 'amendment_pending' then 3 when 'pending' then 4 else 5 end) status, count(*)::bigint n from t join orders using (o_orderkey) group by 1")
def worst_status(spark, sf_dir):
    """J15, A21."""
    s = _asof(spark, sf_dir).select("o_custkey", F.col("s.status").alias("status"))
    worst = F.min(F.struct(G.status_rank("status").alias("r"), F.col("status").alias("v")))
    return s.groupBy("o_custkey").agg(worst["v"].alias("status"), F.count("*").alias("n"))
