"""Text functions, chunks and intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexspark.functions import text as X
from lexspark.operators import chunking as C
from lexspark.operators import citations
from lexspark.queries.registry import load, query


def _docs(spark, sf_dir):
    return load(spark, sf_dir, "documents")


@query("select page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '<br\\s*/?>', chr(10), 'g'), '[ \\t\\x{3000}]+', ' ', 'g'), '\\n\\s*\\n+', chr(10), 'g'), ' ' || chr(10)))::int n, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<br\\s*/?>', chr(10), 'g'), '[ \\t\\x{3000}]+', ' ', 'g'), '\\n\\s*\\n+', chr(10), 'g'), ' ' || chr(10))) digest from pages")
def clean_text(spark, sf_dir):
    """F03."""
    c = X.clean_markup("html")
    return load(spark, sf_dir, "pages").select("page_id", F.length(c).alias("n"), F.md5(c).alias("digest"))


@query("select doc_id, contains(regexp_replace(text, '\\s+', '', 'g'), 'inthe') hit from documents")
def normalized_contains(spark, sf_dir):
    """white space doesn't count."""
    return _docs(spark, sf_dir).select("doc_id", F.contains(X.squeezed("text"), F.lit("inthe")).alias("hit"))


@query("select doc_id, md5(regexp_replace(text, '^[A-Za-z]+(\\([^)]*\\))?\\s*', '')) rest from documents")
def regex_strip_prefix(spark, sf_dir):
    """the first match at the start only."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.regexp_replace("text", r"^[A-Za-z]+(\([^)]*\))?\s*", "")).alias("rest"))


DATE3 = "(\\d{4})-(\\d{2})-(\\d{2})"


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') iso, '<개정 ' || strftime(o_orderdate, '%Y. %-m. %-d.') || '>' tagged from orders")
def date_reformat(spark, sf_dir):
    """P06."""
    o = load(spark, sf_dir, "orders").withColumn("raw", F.date_format("o_orderdate", "yyyyMMdd"))
    return o.select("o_orderkey", X.iso_date("raw").alias("iso"), F.concat(F.lit("<개정 "), F.date_format("o_orderdate", "yyyy. M. d."), F.lit(">")).alias("tagged"))


@query("select o_custkey, array_to_string(list_sort(list(distinct strftime(o_orderdate, '%Y-%m-%d'))), ',') dates from orders group by 1")
def regex_extract_dates(spark, sf_dir):
    """dates are written into amendment marks and read back; distinct, in order."""
    mark = F.concat(F.lit("[신설 "), F.date_format("o_orderdate", "yyyy. M. d."), F.lit("]"))
    o = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(mark), " text ").alias("t"))
    return o.select("o_custkey", F.array_join(X.amendment_dates("t"), ",").alias("dates"))


@query("select o_custkey, bool_or(o_orderdate >= timestamp '2000-06-01') rewritten from orders group by 1")
def any_date_after(spark, sf_dir):
    """F07."""
    o = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.date_format("o_orderdate", "yyyy. M. d.")), " ").alias("t"))
    return o.select("o_custkey", X.any_date_after("t", F.lit("2000-05-31")).alias("rewritten"))


@query("select doc_id, case when regexp_matches(text, 'not |nicht |sin ') then 'exception' when regexp_matches(text, 'and |und |et ') then 'mutatis' else 'plain' end cue from documents")
def cue_classify(spark, sf_dir):
    """the first of the cues in order; `text.cue` has the statutes' own."""
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.when(t.rlike("not |nicht |sin "), "exception").when(t.rlike("and |und |et "), "mutatis").otherwise("plain").alias("cue"))


@query("with s as (select doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) s from documents) select doc_id, len(s)::int n, length(s[1])::int first, length(s[len(s)])::int last from s")
def sentence_split(spark, sf_dir):
    """a split behind the end of a sentence."""
    s = F.split("text", r"(?<=[.!?])\s+")
    return _docs(spark, sf_dir).select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n"), F.length(F.element_at("s", 1)).alias("first"), F.length(F.element_at("s", -1)).alias("last"))


@query("with s as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(trim(x), '^\\[\\d+\\]\\s*', ''))), lambda x: length(x) >= 15) s from documents) select doc_id, len(s)::int n, coalesce(substr(s[1], 1, 20), '') first from s")
def split_filter(spark, sf_dir):
    """lines, cleaned, the short ones left out."""
    s = F.filter(F.transform(F.split("text", "\n"), lambda x: X.strip(F.regexp_replace(X.strip(x), r"^\[\d+\]\s*", ""))), lambda x: F.length(x) >= 15)
    return _docs(spark, sf_dir).select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n"), F.coalesce(F.substring(F.get("s", F.lit(0)), 1, 20), F.lit("")).alias("first"))


@query("with p as (select o_custkey, o_orderkey k, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) n from orders) select o_custkey, sum(case when n - k <= 10 then n - k else 1 end)::bigint keys, sum(case when n - k <= 10 then (n - k) * (n + k - 1) // 2 else k end)::bigint total from p group by 1")
def range_expand(spark, sf_dir):
    """F11, numeric part: neighbours at most 10 apart are expanded, as `제55조부터 제57조까지` is."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    p = load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("k"), F.lead("o_orderkey").over(w).alias("n"))
    run = F.when(F.col("n") - F.col("k") <= 10, F.sequence("k", F.col("n") - 1)).otherwise(F.array("k"))
    return p.select("o_custkey", F.explode(run).alias("x")).groupBy("o_custkey").agg(F.count("*").alias("keys"), F.sum("x").alias("total"))


@query("select doc_id, case when length(text) <= 600 then text when regexp_extract(substr(text, 1, 600), '(?s)^(.+\\.)', 1) <> '' then regexp_extract(substr(text, 1, 600), '(?s)^(.+\\.)', 1) || ' ...' else substr(text, 1, 600) || ' ...' end cut from documents")
def truncate_sentence(spark, sf_dir):
    """F26."""
    head = F.left("text", F.lit(600))
    whole = F.regexp_extract(head, r"(?s)^(.+\.)", 1)
    cut = F.when(F.length("text") <= 600, F.col("text")).otherwise(F.concat(F.when(whole != "", whole).otherwise(head), F.lit(" ...")))
    return _docs(spark, sf_dir).select("doc_id", cut.alias("cut"))


BG = "list_distinct(list_transform(range(1, greatest(length({c}), 1)), lambda i: substr({c}, i, 2)))"


@query(
    f"""with a as (select conv_id, turn, text from conversations where role = 'assistant'), u as (select conv_id, turn + 1 turn, regexp_replace(text, '\\s+', '', 'g') q from conversations where role = 'user'),
    j as (select conv_id, turn, text, {BG.format(c='q')} g from a join u using (conv_id, turn)),
    l as (select conv_id, turn, g, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from j),
    m as (select conv_id, turn, line, i, len(list_intersect({BG.format(c="regexp_replace(line, '\\s+', '', 'g')")}, g)) n from l where i > 1 and trim(line) <> '')
    select conv_id, turn, substr(arg_max(line, n * 100000 - i), 1, 300) quote, max(n)::int n from m group by 1, 2"""
)
def quote_argmax(spark, sf_dir):
    """The line (after the first) of an answer that shares most bigrams with the question."""
    c = load(spark, sf_dir, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", "text")
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("said"))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.when((i > 0) & (X.strip(line) != ""), line))
    best = a.join(u, ["conv_id", "turn"]).select("conv_id", "turn", citations.best_line(lines, F.col("said")).alias("b")).where("b is not null")
    return best.select("conv_id", "turn", F.substring("b.line", 1, 300).alias("quote"), "b.n")


@query(
    """with a as (select conv_id, unnest([turn % 3 + 1, (turn + 1) % 5 + 1]) n, turn, unnest([1, 2]) j from conversations where role = 'assistant'),
    c as (select conv_id, 'S' || n source, min(turn * 10 + j) first, count(*)::bigint said from a group by all), b as (select distinct conv_id, 'S' || (turn + 1) source from conversations)
    select conv_id, string_agg(source, ',' order by first) sources, sum(said)::bigint said from c join b using (conv_id, source) group by 1"""
)
def citation_validate(spark, sf_dir):
    """Markers that point at no block are dropped; sources in order of first appearance."""
    c = load(spark, sf_dir, "conversations")
    mark = lambda n: F.concat(F.lit("[S"), n.cast("string"), F.lit("]"))
    a = c.where("role = 'assistant'").withColumn("said", F.concat(mark(F.col("turn") % 3 + 1), F.lit(" 합니다. "), mark((F.col("turn") + 1) % 5 + 1)))
    a = a.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "said"))), lambda x: x["said"]), "\n").alias("answer"))
    m = a.select("conv_id", F.posexplode(F.regexp_extract_all("answer", F.lit(citations.MARKER), F.lit(1))).alias("i", "n"))
    m = m.groupBy("conv_id", F.concat(F.lit("S"), "n").alias("source")).agg(F.min("i").alias("first"), F.count("*").alias("said"))
    blocks = c.select("conv_id", F.concat(F.lit("S"), (F.col("turn") + 1).cast("string")).alias("source")).distinct()
    ok = m.join(blocks, ["conv_id", "source"])
    seq = F.transform(F.array_sort(F.collect_list(F.struct("first", "source"))), lambda x: x["source"])
    return ok.groupBy("conv_id").agg(F.array_join(seq, ",").alias("sources"), F.sum("said").alias("said"))


@query("select event_id, (props::json ->> '$.k')::int k from events")
def json_extract(spark, sf_dir):
    """the outermost braces of a text that says more around them."""
    e = load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Answer: "), "props", F.lit(" done")).alias("t"))
    return e.select("event_id", F.from_json(X.json_object("t"), "k int")["k"].alias("k"))


@query("select doc_id, (contains(s, 'the') or contains(s, 'der')) and (contains(s, 'on') or contains(s, 'ein')) ok from (select doc_id, regexp_replace(text, '\\s+', '', 'g') s from documents)")
def must_groups(spark, sf_dir):
    """F31, F32."""
    groups = F.array(F.array(F.lit("the"), F.lit("der")), F.array(F.lit("o n"), F.lit("ein")))
    return _docs(spark, sf_dir).select("doc_id", X.holds_groups("text", groups).alias("ok"))


@query("select doc_id, array_to_string(list_filter([case when n_chars > 3000 then 'long' end, case when contains(text, chr(10)) then 'split' end, case when lang <> 'en' then 'foreign' end], lambda x: x is not null), ',') tags from documents")
def structural_tags(spark, sf_dir):
    """An ordered list of the tags that hold."""
    tags = F.array(F.when(F.col("n_chars") > 3000, "long"), F.when(F.contains("text", F.lit("\n")), "split"), F.when(F.col("lang") != "en", "foreign"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.filter(tags, lambda x: x.isNotNull()), ",").alias("tags"))


LINES = "l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 pos from documents)"


def _lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query(f"with {LINES} select doc_id, pos::int pos, (sum(length(line)) over (partition by doc_id order by pos) - length(line))::bigint start, (sum(length(line)) over (partition by doc_id order by pos))::bigint stop from l")
def running_offset(spark, sf_dir):
    """W06."""
    return C.running_spans(_lines(spark, sf_dir), "doc_id", ["pos"], "line").select("doc_id", "pos", "start", "stop")


@query("with t as (select doc_id, regexp_extract_all(text, '\\S+') w from documents), c as (select doc_id, w, unnest(range(0, greatest(len(w) - 64, 1), 448)) a from t) select doc_id, a::int start, least(a + 512, len(w))::int stop, md5(array_to_string(w[a + 1:a + 512], ' ')) digest from c")
def fixed_chunks(spark, sf_dir):
    """Windows of 512 words that share 64."""
    d = _docs(spark, sf_dir).select("doc_id", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("w"))
    cut = lambda s: F.struct(s.alias("start"), F.least(s + 512, F.size("w")).alias("stop"), F.md5(F.array_join(F.slice("w", s + 1, F.lit(512)), " ")).alias("digest"))
    return d.select("doc_id", F.explode(F.transform(C.windows(F.size("w")), cut)).alias("c")).select("doc_id", "c.*")


@query(
    f"""with {LINES}, s as (select doc_id, pos, sum(length(line)) over (partition by doc_id order by pos) - length(line) s0, sum(length(line)) over (partition by doc_id order by pos) s1 from l),
    w as (select doc_id, unnest(range(0, greatest(length(replace(text, chr(10), '')), 1), 700)) c0 from documents)
    select doc_id, c0::int start, count(*)::bigint n_lines, min(pos)::int first from w join s using (doc_id) where s0 < c0 + 800 and s1 > c0 group by 1, 2"""
)
def interval_overlap_join(spark, sf_dir):
    """Windows against line spans of the same document; touching ends don't overlap."""
    spans = C.running_spans(_lines(spark, sf_dir), "doc_id", ["pos"], "line").select("doc_id", "pos", "start", "stop")
    n = F.length(F.replace("text", F.lit("\n"), F.lit("")))
    w = _docs(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1, F.lit(700))).alias("start")).withColumn("stop", F.col("start") + 800)
    return C.overlapping(w, spans, "doc_id").groupBy("doc_id", "start").agg(F.count("*").alias("n_lines"), F.min("pos").alias("first"))


@query(
    """with e as (select user_id, epoch_us(ts) s, epoch_us(ts) + 3600000000 f from events), m as (select *, max(f) over (partition by user_id order by s, f rows between unbounded preceding and 1 preceding) before from e),
    g as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by user_id order by s, f rows unbounded preceding) island from m)
    select user_id, island::bigint island, min(s)::bigint start, max(f)::bigint stop, count(*)::bigint n from g group by 1, 2"""
)
def merge_intervals(spark, sf_dir):
    """An hour after each event; intervals that touch or overlap are one."""
    s = F.unix_micros(F.col("ts").cast("timestamp"))
    e = load(spark, sf_dir, "events").select("user_id", s.alias("s"), (s + 3_600_000_000).alias("f"))
    w = Window.partitionBy("user_id").orderBy("s", "f")
    before = F.max("f").over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    e = e.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return e.groupBy("user_id", "island").agg(F.min("s").alias("start"), F.max("f").alias("stop"), F.count("*").alias("n"))


@query(
    f"""with recursive {LINES.replace('l as', 'l0 as')}, l as (select doc_id, pos, len(regexp_extract_all(line, '\\S+')) n from l0),
    f as (select doc_id, pos, n s, 0 g from l where pos = 0 union all select l.doc_id, l.pos, case when f.s + l.n > 120 then l.n else f.s + l.n end, case when f.s + l.n > 120 then f.g + 1 else f.g end from f join l on l.doc_id = f.doc_id and l.pos = f.pos + 1)
    select doc_id, g::int part, count(*)::bigint n_lines from f group by 1, 2"""
)
def greedy_pack(spark, sf_dir):
    """Lines are packed up to 120 words; the sum starts anew with each part."""
    words = F.transform(F.split("text", "\n"), lambda x: F.size(F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0))).cast("bigint"))
    d = _docs(spark, sf_dir).select("doc_id", F.explode(C.greedy_groups(words, 120)).alias("part"))
    return d.groupBy("doc_id", "part").agg(F.count("*").alias("n_lines"))


@query(
    """with c as (select doc_id, unnest(range(0, greatest(len(regexp_extract_all(text, '\\S+')) - 64, 1), 448)) // 448 part from documents), h as (select doc_id, max(part) part from c group by 1),
    s as (select h.doc_id, h.part hit, c.part sibling, row_number() over (partition by h.doc_id order by c.part) k from h join c on c.doc_id = h.doc_id and c.part <> h.part) select doc_id, hit::int hit, sibling::int sibling from s where k <= 4"""
)
def sibling_expand(spark, sf_dir):
    """The other chunks of a hit's document, in order, at most four."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    c = _docs(spark, sf_dir).select("doc_id", F.explode(C.windows(n)).alias("a")).select("doc_id", (F.col("a") / 448).cast("int").alias("part"))
    hit = c.groupBy("doc_id").agg(F.max("part").alias("hit"))
    w = Window.partitionBy("doc_id").orderBy("sibling")
    s = hit.join(c.withColumnRenamed("part", "sibling"), "doc_id").where("hit <> sibling")
    return s.withColumn("k", F.row_number().over(w)).where("k <= 4").drop("k")


@query("select part.p_partkey, region.r_regionkey from part join region on regexp_matches(part.p_name, '^' || lower(substr(region.r_name, 1, 1)) || '|' || lower(substr(region.r_name, 3, 2)))")
def theta_regex_join(spark, sf_dir):
    """A pattern made from one side matches the other's text; the pattern side is a small lookup table."""
    r = load(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit("^"), F.lower(F.substring("r_name", 1, 1)), F.lit("|"), F.lower(F.substring("r_name", 3, 2))).alias("pattern"))
    return load(spark, sf_dir, "part").join(F.broadcast(r), F.expr("p_name rlike pattern")).select("p_partkey", "r_regionkey")


@query("select conv_id, case when len(m) > 0 then array_to_string(m, ',') else array_to_string(t, ',') end targets from (select conv_id, list(turn::varchar order by turn) t, list_filter(list(turn::varchar order by turn), lambda x: x in ('1', '3')) m from conversations group by 1)")
def array_semi(spark, sf_dir):
    """The paragraphs with the wanted numbers, or all of them if there is none."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t.cast("string")).alias("t"))
    m = F.filter("t", lambda x: F.array_contains(F.array(F.lit("1"), F.lit("3")), x))
    return c.select("conv_id", F.array_join(F.when(F.size(m) > 0, m).otherwise(F.col("t")), ",").alias("targets"))


@query("with b as (select doc_id, string_split(text, chr(10)) n from documents), p as (select x.doc_id, x.n, coalesce(y.n, []) o from b x left join b y on y.doc_id = x.doc_id - 1) select doc_id, len(list_filter(n, lambda i: not list_contains(o, i)))::int changed, md5(array_to_string(list_filter(n, lambda i: not list_contains(o, i)), chr(10))) digest from p")
def array_diff(spark, sf_dir):
    """items of the new version that the old one lacks, in order (an approximation of F23, which is `statute.changed`)."""
    b = _docs(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("n"))
    old = b.select((F.col("doc_id") + 1).alias("doc_id"), F.col("n").alias("o"))
    new = F.filter("n", lambda i: ~F.array_contains(F.coalesce("o", F.array().cast("array<string>")), i))
    return b.join(old, "doc_id", "left").select("doc_id", F.size(new).alias("changed"), F.md5(F.array_join(new, "\n")).alias("digest"))
