"""Metrics and statistics over labels, documents and weekly runs of events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import metrics as M
from lexspark.operators import stats as S
from lexspark.queries.registry import load, query

# labels stand in for scored items: quality for correctness, toxic for an error flag
SCORES = """sc as (select d.doc_id id, d.lang level, d.source split, case when d.doc_id % 5 = 0 then 'insufficient_context' else 'answered' end expected,
    case when coalesce(quality, 1) = 1 then 'answered' else 'insufficient_context' end status, quality, toxic, n_chars from documents d left join labels l using (doc_id))"""


def _scores(spark, sf_dir):
    """Items joined with their judgments (which may be missing)."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("level"), F.col("source").alias("split"),
        F.when(F.col("doc_id") % 5 == 0, "insufficient_context").otherwise("answered").alias("expected"),
        F.when(F.coalesce("quality", F.lit(1)) == 1, "answered").otherwise("insufficient_context").alias("status"), "quality", "toxic", "n_chars",
    )


@query(f"with {SCORES} select id, level, split, expected, status, quality, toxic from sc")
def score_join(spark, sf_dir):
    """J17, R10, S12."""
    return _scores(spark, sf_dir).drop("n_chars")


ITEM = """case when expected = 'answered' then status = 'answered' else status <> 'answered' or coalesce(toxic = 0, false) end"""


@query(
    f"""with {SCORES} select id, {ITEM} m2_correct_status, case when expected <> 'answered' then case when status <> 'answered' then case when quality is null then 'declined' else 'gate' end when toxic = 0 then 'hedged' else 'asserted' end end refusal_mode,
    case when expected = 'answered' then status = 'answered' and coalesce(toxic = 0, false) end m4_complete, case when status = 'answered' and toxic is not null then toxic = 1 end m6_temporal_error from sc"""
)
def item_scores(spark, sf_dir):
    """F37, F38, R08 on substitute columns; the full rules are `metrics.item_scores`."""
    s = _scores(spark, sf_dir)
    expected, answered = F.col("expected") == "answered", F.col("status") == "answered"
    hedged = F.coalesce(F.col("toxic") == 0, F.lit(False))
    return s.select(
        "id", F.when(expected, answered).otherwise(~answered | hedged).alias("m2_correct_status"),
        F.when(~expected, F.when(~answered, F.when(F.col("quality").isNull(), "declined").otherwise("gate")).when(hedged, "hedged").otherwise("asserted")).alias("refusal_mode"),
        F.when(expected, answered & hedged).alias("m4_complete"), F.when(answered & F.col("toxic").isNotNull(), F.col("toxic") == 1).alias("m6_temporal_error"),
    )


GROUPS = f"""with {SCORES} select case grouping(level) * 2 + grouping(split) when 3 then 'overall' when 1 then 'level' else 'split' end scope, coalesce(level, split, '') value, count(*)::bigint n,
    round(avg(quality), 6) quality, count(quality)::bigint quality_n, round(avg(case when expected = 'answered' then (status <> 'answered')::int end), 6) over_refusal, count(case when expected <> 'answered' then 1 end)::bigint refusable from sc group by grouping sets ((), (level), (split))"""


def _grouped(spark, sf_dir):
    s = _scores(spark, sf_dir)
    got = s.groupingSets([[], ["level"], ["split"]], "level", "split").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.count("quality").alias("quality_n"),
        F.round(F.avg(F.when(F.col("expected") == "answered", (F.col("status") != "answered").cast("int"))), 6).alias("over_refusal"), F.count(F.when(F.col("expected") != "answered", 1)).alias("refusable"),
    )
    scope = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "level").otherwise("split")
    return got.select(scope.alias("scope"), F.coalesce("level", "split", F.lit("")).alias("value"), "n", "quality", "quality_n", "over_refusal", "refusable")


@query(GROUPS)
def metrics_grouping_sets(spark, sf_dir):
    """Overall, by level and by split in one pass."""
    return _grouped(spark, sf_dir)


@query(f"with {SCORES} select split, round(avg(quality) filter (level = 'de'), 6) de, round(avg(quality) filter (level = 'en'), 6) en, round(avg(quality) filter (level = 'es'), 6) es, round(avg(quality) filter (level = 'fr'), 6) fr from sc group by 1")
def metrics_pivot(spark, sf_dir):
    """S19, R34."""
    return _scores(spark, sf_dir).groupBy("split").pivot("level", ["de", "en", "es", "fr"]).agg(F.round(F.avg("quality"), 6))


@query(f"with {SCORES} select id, status, expected from sc where not ({ITEM}) or coalesce(quality = 0, false) or coalesce(toxic > 0, false)")
def failing_items(spark, sf_dir):
    """A missing metric is no failure."""
    s = _scores(spark, sf_dir)
    expected, answered = F.col("expected") == "answered", F.col("status") == "answered"
    right = F.when(expected, answered).otherwise(~answered | F.coalesce(F.col("toxic") == 0, F.lit(False)))
    return s.where(~right | F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") > 0, F.lit(False))).select("id", "status", "expected")


@query("select l_returnflag, (list_sort(list(l_extendedprice)))[count(*) // 2 + 1] price_p50 from lineitem group by 1")
def upper_median(spark, sf_dir):
    """The value at floor(n / 2) of the sorted values, by a bracket and counts rather than one array a group."""
    return M.upper_medians(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "price_p50")


@query("select conv_id, round(avg((length(text) > 200)::int), 6) coverage, bool_and(length(text) > 200) all_points from conversations group by 1")
def kp_coverage(spark, sf_dir):
    """A turn stands for a key point, met if it is long."""
    met = F.length("text") > 200
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.round(F.avg(met.cast("int")), 6).alias("coverage"), F.bool_and(met).alias("all_points"))


@query("select conv_id, round(count(*) filter (role = 'user')::double / nullif(count(*), 0), 6) unsupported from conversations group by 1")
def unsupported_rate(spark, sf_dir):
    """A09."""
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.round(F.count_if(F.col("role") == "user") / F.nullif(F.count("*"), F.lit(0)), 6).alias("unsupported"))


@query("select conv_id, array_to_string(list_transform(range(0, 6), lambda i: coalesce((map_from_entries(list({k: turn, v: length(text) > 200}))[i])::varchar, 'false')), ',') aligned from conversations where turn < 6 group by 1")
def align_sequence(spark, sf_dir):
    """indices 1..n, missing ones false."""
    c = load(spark, sf_dir, "conversations").where("turn < 6").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("turn") + 1).cast("int").alias("k"), (F.length("text") > 200).alias("v")))).alias("m"))
    return c.select("conv_id", F.array_join(F.transform(X.aligned(F.col("m"), F.lit(6)), lambda x: x.cast("string")), ",").alias("aligned"))


@query("with a as (select conv_id, turn // 2 pos, text from conversations where turn % 2 = 0), b as (select conv_id, turn // 2 pos, text from conversations where turn % 2 = 1) select conv_id, pos::bigint pos, length(a.text)::int human, length(b.text)::int judge from a full join b using (conv_id, pos)")
def positional_align(spark, sf_dir):
    """Two raters side by side by position."""
    c = load(spark, sf_dir, "conversations").withColumn("pos", F.floor(F.col("turn") / 2)).withColumn("n", F.length("text"))
    a = c.where("turn % 2 = 0").select("conv_id", "pos", F.col("n").alias("human"))
    b = c.where("turn % 2 = 1").select("conv_id", "pos", F.col("n").alias("judge"))
    return a.join(b, ["conv_id", "pos"], "full_outer")


# --- events: a week is a run, a user an item ----------------------------------------

RUNS = "r as (select user_id id, ((day(ts) - 1) // 7)::int run, event_type, value from events)"
ITEMS = f"{RUNS}, i as (select id, run, avg(value) v, count(*) filter (event_type = 'purchase') > 0 bought from r group by all)"


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("run"), "event_type", "value")


def _items(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("id", "run").agg(F.avg("value").alias("v"), (F.count_if(F.col("event_type") == "purchase") > 0).alias("bought"))


@query(f"with {RUNS}, m as (select run, event_type metric, round(avg(value), 3) v from r where run < 4 group by all) select metric, round(avg(v), 6) mean, min(v) min, max(v) max, round(max(v) - min(v), 6) range, round(stddev_pop(v), 6) std from m group by 1")
def noise_floor(spark, sf_dir):
    """Over metrics that are rounded first."""
    m = _events(spark, sf_dir).where("run < 4").groupBy("run", F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 3).alias("value"))
    n = S.noise_floor(m)
    return n.select("metric", F.round("mean", 6).alias("mean"), "min", "max", F.round("range", 6).alias("range"), F.round("std", 6).alias("std"))


@query(f"with {ITEMS} select id from i where run < 4 group by 1 having count(distinct bought::varchar) > 1")
def unstable_items(spark, sf_dir):
    """A11."""
    return S.unstable(_items(spark, sf_dir).where("run < 4"), ["bought"])


@query(f"with {ITEMS} select id, round(avg(v), 6) v, round(avg(bought::int), 6) bought from i group by 1")
def multirun_mean(spark, sf_dir):
    """A12."""
    m = S.item_means(_items(spark, sf_dir), ["v", "bought"])
    return m.select("id", F.round("v", 6).alias("v"), F.round("bought", 6).alias("bought"))


@query(f"with {ITEMS} select id, case when count(v) = 5 then round(avg(v), 6) end v from i group by 1")
def multirun_mean_strict(spark, sf_dir):
    """Null unless all five runs have the item."""
    return S.item_means(_items(spark, sf_dir), ["v"], strict=5).select("id", F.round("v", 6).alias("v"))


@query(
    f"""with {ITEMS}, b as (select id, 'even' subset from i where id % 2 = 0 union all select id, 'third' from i where id % 3 = 0), s as (select distinct * from b)
    select subset, round(avg(v), 4) mean, count(v)::bigint n, round(avg(bought::int), 4) share from i join s using (id) where run = 0 group by 1"""
)
def subset_metrics(spark, sf_dir):
    """A bridge table of named subsets."""
    i = _items(spark, sf_dir).where("run = 0")
    names = F.filter(F.array(F.when(F.col("id") % 2 == 0, "even"), F.when(F.col("id") % 3 == 0, "third")), lambda x: x.isNotNull())
    return i.withColumn("subset", F.explode(names)).groupBy("subset").agg(F.round(F.avg("v"), 4).alias("mean"), F.count("v").alias("n"), F.round(F.avg(F.col("bought").cast("int")), 4).alias("share"))


PAIRS = f"{ITEMS}, p as (select x.id, x.v a, y.v b, y.v - x.v delta from i x join i y using (id) where x.run = 0 and y.run = 1)"


def _pairs(spark, sf_dir):
    i = _items(spark, sf_dir)
    return S.paired(i.where("run = 0"), i.where("run = 1"), "v")


@query(f"with {PAIRS} select id, round(a, 6) a, round(b, 6) b, round(delta, 6) delta, row_number() over (order by round(delta, 9) desc, id)::int place from p where abs(delta) > 1e-9")
def paired_delta(spark, sf_dir):
    """J18, T11, R14."""
    p = _pairs(spark, sf_dir).where(F.abs("delta") > 1e-9)
    w = Window.orderBy(F.desc(F.round("delta", 9)), F.asc("id"))  # items of one evaluation, not a corpus
    return p.select("id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("delta", 6).alias("delta"), F.row_number().over(w).alias("place"))


@query(f"with {PAIRS} select coalesce(string_agg(id::varchar, ',' order by id::varchar) filter (delta >= 10), '') gained, coalesce(string_agg(id::varchar, ',' order by id::varchar) filter (delta <= -10), '') lost from p")
def gained_lost(spark, sf_dir):
    """A28."""
    return S.gained_lost(_pairs(spark, sf_dir), by=10.0)


BOOT = """, d as (select row_number() over (order by id) - 1 k, delta from p), n as (select count(*) n from d),
    m as (select b, avg(d.delta) m from range(2000) t(b), range(1000000) u(k), n, d where u.k < n.n and d.k = concat('0x', substring(md5(concat(t.b, ':', u.k)), 1, 8))::bigint % n.n group by 1),
    s as (select m, row_number() over (order by m) - 1 r from m),
    ci as (select (select n from n)::int n, round(max(m) filter (r = 50), 6) lo, round(max(m) filter (r = 1950), 6) hi from s)"""
BOOT = BOOT.replace("range(1000000) u(k), n, d where u.k < n.n and", "(select unnest(range((select n from n))) k) u, n, d where")


@query(f"with {PAIRS}{BOOT} select n, lo, hi from ci")
def paired_bootstrap(spark, sf_dir):
    """2000 resamples drawn by md5; `stats.seeded_bootstrap` repeats the published index rules."""
    b = S.hash_bootstrap(_pairs(spark, sf_dir), 2000)
    return b.select("n", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


NOISE = "nz as (select max(m) - min(m) noise from (select run, avg(v) m from i where run < 4 group by 1))"


@query(f"with {PAIRS}{BOOT}, {NOISE}, x as (select avg(delta) delta from p) select round(delta, 6) delta, round(noise, 6) noise, lo, hi, case when not (abs(delta) > noise and (lo > 0 or hi < 0)) then 'insignificant' when delta > 0 then 'better' else 'worse' end verdict from x, nz, ci")
def verdict(spark, sf_dir):
    """K03, K04, R07."""
    p = _pairs(spark, sf_dir)
    noise = _items(spark, sf_dir).where("run < 4").groupBy("run").agg(F.avg("v").alias("m")).agg((F.max("m") - F.min("m")).alias("noise"))
    row = p.agg(F.avg("delta").alias("delta")).join(noise, F.lit(True)).join(S.hash_bootstrap(p, 2000), F.lit(True))
    return row.select(F.round("delta", 6).alias("delta"), F.round("noise", 6).alias("noise"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), S.verdict(F.col("delta"), F.col("noise"), F.col("lo"), F.col("hi"), needs_interval=True).alias("verdict"))


@query(
    f"""with {ITEMS}, a as (select id, avg(v) a from i where run in (0, 1) group by 1 having count(v) = 2), b as (select id, avg(v) b from i where run in (2, 3) group by 1 having count(v) = 2),
    p as (select id, b - a delta, a, b from a join b using (id)){BOOT} select ci.n, round(avg(a), 6) base, round(avg(b), 6) exp, round(avg(delta), 6) delta, lo, hi, lo > 0 and avg(delta) > 0.03 significant from p, ci group by ci.n, lo, hi"""
)
def multirun_compare(spark, sf_dir):
    """Items that both runs of a side have."""
    i = _items(spark, sf_dir)
    side = lambda runs: S.item_means(i.where(F.col("run").isin(runs)), ["v"], strict=2)
    p = S.paired(side([0, 1]), side([2, 3]), "v")
    m = p.agg(F.avg("a").alias("base"), F.avg("b").alias("exp"), F.avg("delta").alias("delta")).join(S.hash_bootstrap(p, 2000), F.lit(True))
    r = lambda c: F.round(c, 6).alias(c)
    return m.select("n", r("base"), r("exp"), r("delta"), r("lo"), r("hi"), ((F.col("lo") > 0) & (F.col("delta") > S.NOISE_M0)).alias("significant"))


@query(f"with {PAIRS}{BOOT}, {NOISE} select n, round(noise, 6) range, round((hi - lo) / 2, 5) half, round(greatest(noise, (hi - lo) / 2), 5) mde from ci, nz")
def mde(spark, sf_dir):
    """K06, over one pair of runs."""
    means = _items(spark, sf_dir).where("run < 4").groupBy("run").agg(F.avg("v").alias("value"), F.count("v").alias("n"))
    half = S.hash_bootstrap(_pairs(spark, sf_dir), 2000)
    m = S.minimal_effect(means, half).drop("n").join(half.select("n"), F.lit(True))
    return m.select("n", F.round("range", 6).alias("range"), F.round("half", 5).alias("half"), F.round("mde", 5).alias("mde"))


CONF = "c as (select count(*) filter (quality = 1 and toxic = 1) tp, count(*) filter (quality = 0 and toxic = 1) fp, count(*) filter (quality = 1 and toxic = 0) fn, count(*) filter (quality = 0 and toxic = 0) tn, count(*) n from labels where quality is not null and toxic is not null)"


@query(f"with {CONF} select tp, fp, fn, tn, n, round((tp + tn) / n, 6) agreement, round(tp / nullif(tp + fp, 0), 6) \"precision\", round(tp / nullif(tp + fn, 0), 6) recall from c")
def rater_confusion(spark, sf_dir):
    """A15."""
    c = S.confusion(load(spark, sf_dir, "labels"), "quality", "toxic")
    return c.select("tp", "fp", "fn", "tn", "n", *[F.round(x, 6).alias(x) for x in ("agreement", "precision", "recall")])


@query(f"with {CONF}, k as (select (tp + tn) / n po, ((tp + fn)::double * (tp + fp) + (tn + fp)::double * (tn + fn)) / (n::double * n) pe from c) select round((po - pe) / (1 - pe), 6) kappa, coalesce((po - pe) / (1 - pe) >= 0.6, false) adopt from k")
def cohen_kappa(spark, sf_dir):
    """A16, R24."""
    k = S.kappa(S.confusion(load(spark, sf_dir, "labels"), "quality", "toxic"))
    return k.select(F.round("kappa", 6).alias("kappa"), F.coalesce(F.col("kappa") >= 0.6, F.lit(False)).alias("adopt"))


@query(f"with {ITEMS}, k as (select id, count(bought) c, count(distinct bought) d from i where run < 4 group by 1) select count(*)::bigint n, count(*) filter (d > 1)::bigint flipped, round(avg((d > 1)::int), 6) flip_rate from k where c = 4")
def judge_flips(spark, sf_dir):
    """A17."""
    return S.flips(_items(spark, sf_dir).where("run < 4"), ["id"], "bought").select("n", "flipped", F.round("flip_rate", 6).alias("flip_rate"))


@query(f"with {ITEMS} select x.run run_a, y.run run_b, count(*)::bigint n, count(*) filter (x.bought = y.bought)::bigint agreed, round(avg((x.bought = y.bought)::int), 6) agreement from i x join i y using (id) where x.run < y.run group by all")
def pairwise_agreement(spark, sf_dir):
    """A17, A23, R21."""
    return S.pairwise(_items(spark, sf_dir), ["id"], "bought").select("run_a", "run_b", "n", "agreed", F.round("agreement", 6).alias("agreement"))


@query("select doc_id, coalesce(quality = 1, false) and coalesce(toxic = 0, false) correct, (quality = 1) is not distinct from (toxic = 0) agreed from documents left join labels using (doc_id)")
def two_judge_consensus(spark, sf_dir):
    """A missing verdict counts as false."""
    d, v = load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels")
    j = d.join(v, "doc_id", "left").select("doc_id", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))
    rows = j.select("doc_id", F.explode(F.array(F.struct(F.lit("a").alias("judge"), F.col("a").alias("met")), F.struct(F.lit("b").alias("judge"), F.col("b").alias("met")))).alias("x")).select("doc_id", "x.*")
    return S.consensus(rows, ["doc_id"], ["a", "b"]).select("doc_id", "correct", F.col("a").eqNullSafe(F.col("b")).alias("agreed"))


@query(
    """select doc_id, case when q and t and l then 'all' when not q and not t and not l then 'none' when q and not t then 'first only' else 'mixed' end pattern,
    case when q and t and l then 3 when not q and not t and not l then 2 when q and not t then 0 else 1 end place from (select doc_id, quality = 1 q, toxic = 1 t, n_chars > 1500 l from documents join labels using (doc_id)) where not (q = t and t = l)"""
)
def disagreement_pattern(spark, sf_dir):
    """P23, T12, R17."""
    j = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id").select("doc_id", (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t"), (F.col("n_chars") > 1500).alias("l"))
    name = F.expr("case when q and t and l then 'all' when not q and not t and not l then 'none' when q and not t then 'first only' else 'mixed' end")
    place = F.create_map(*[F.lit(x) for p in (("first only", 0), ("mixed", 1), ("none", 2), ("all", 3)) for x in p])
    return j.where(~((F.col("q") == F.col("t")) & (F.col("t") == F.col("l")))).select("doc_id", name.alias("pattern")).withColumn("place", place[F.col("pattern")])


@query(f"with {ITEMS} select id, bool_or(not bought) disputed from i group by 1")
def disputed_any_run(spark, sf_dir):
    """R11."""
    return _items(spark, sf_dir).groupBy("id").agg(F.bool_or(~F.col("bought")).alias("disputed"))


@query(f"with {RUNS} select id from r where run < 4 group by 1 having count(distinct run) = 4")
def all_runs_intersect(spark, sf_dir):
    """J19, U04."""
    return _events(spark, sf_dir).where("run < 4").groupBy("id").agg(F.countDistinct("run").alias("n")).where("n = 4").select("id")


@query("select role, sum(length(text))::bigint chars, round(sum(case when role = 'assistant' then length(text) * 1827.0::double when role = 'system' then length(text) * 30.0::double else length(text) * 304.0::double end) / 1e6, 6) cost from conversations group by 1")
def usage_cost(spark, sf_dir):
    """Characters stand for tokens; prices by role."""
    price = F.when(F.col("role") == "assistant", 1827.0).when(F.col("role") == "system", 30.0).otherwise(304.0)
    n = F.length("text")
    return load(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(n).alias("chars"), F.round(F.sum(n * price) / 1e6, 6).alias("cost"))

