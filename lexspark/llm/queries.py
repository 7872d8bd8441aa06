"""The queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import decontam, fim, fixity, html, imatch, license, lid, neardup, packing, quality, tokencount, toxicity, vectorcode
from lexspark.llm.common import held_out, shared_dir, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text", "source", "lang", "n_chars"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "text_score", "metadata_score", "accepted")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lid.fit(docs.where(~held_out(F.col("doc_id"))))
    return lid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages, html.fit(pages)).select("page_id", "url", "text", "n_chars")


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lex = imatch.lexicon(docs)
    both = imatch.with_next(docs, "doc_id", "text", lambda d: imatch.subsets(d, lex, "text", "subs"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    got = imatch.subsets(both.withColumn("edited", edited), lex, "edited", "edited_subs")
    for name, text in (("", "text"), ("edited_", "edited"), ("next_", "next_text")):
        got = got.withColumn(f"{name}fingerprint", imatch.named(f"{name}subs", text))
    like = lambda other: imatch.likeness(F.col("subs"), F.col(f"{other}_subs"), F.col("fingerprint"), F.col(f"{other}_fingerprint"))
    return got.select("doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", like("edited").alias("near_edited"), like("next").alias("near_next"))


def op6_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC records, against a replica in which some payloads have one byte changed, some records are lost and some were added, by the CRC of the id; the audit must find just these. Added records have an id below 0 and no place in the reference, so no url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    shards = fixity.shard_count(pages)
    a = fixity.manifest(pages, "page_id", "url", "html", shards, ["page_id", "url"])
    body = F.coalesce("html", F.lit(""))
    chosen = lambda n, r: F.coalesce(F.pmod(F.crc32(F.col("page_id").cast("string").cast("binary")), F.lit(n)) == r, F.lit(False))
    flipped = F.overlay(body, F.when(F.substring(body, 1, 1) == "#", "~").otherwise("#"), F.lit(1), F.lit(1))
    copy = pages.where(~chosen(101, 7)).withColumn("html", F.when(chosen(97, 5) & (F.length(body) > 0), flipped).otherwise(body))
    added = pages.where(chosen(103, 11)).withColumn("page_id", (-1 - F.col("page_id")).cast(pages.schema["page_id"].dataType))
    b = fixity.manifest(copy.unionByName(added), "page_id", "url", "html", shards, ["page_id"])
    return fixity.audited(a, b, shards, "page_id").select("page_id", "url", "shard", "ordinal", "offset", "length", F.col("digest").alias("sha256"), "status")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = docs.where(~held_out(F.col("doc_id")))
    model = toxicity.fit(toxicity.collect_sample(train, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "offending")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license.scan(docs, license.frequencies(docs)).drop("text").withColumn("score", F.round("score", 6))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vectorcode.fit(rows)
    coded = vectorcode.with_label_error(vectorcode.encode(rows, books).drop("embedding"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is a new one on each call, in the shared folder, so the query's work is that of its table; `tokencount.counts` takes one that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = f"{shared_dir(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}"
    return tokencount.counts(docs, cache).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_language, op3_near_duplicates, op4_main_text, op5_imatch, op6_fixity, op7_toxicity, op8_packing, op9_decontamination, op10_licenses, op11_vector_codes, op12_token_counts, op13_fill_in_middle)
}

def _sql_crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    byte = "list_reduce(list_prepend(xor(h, v), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(({text})::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda h, v: {byte}), 4294967295::bigint)"


_CRLF = "chr(13) || chr(10)"
_RECORD = f"""'WARC/1.0' || {_CRLF} || 'WARC-Type: resource' || {_CRLF} || 'WARC-Record-ID: <urn:record:' || page_id || '>' || {_CRLF} || 'WARC-Target-URI: ' || coalesce(url, '') || {_CRLF} || 'Content-Type: text/html' || {_CRLF} || 'Content-Length: ' || strlen(body) || {_CRLF} || {_CRLF} || body || {_CRLF} || {_CRLF}"""
_FIXITY = f"""with n as (select greatest(1, count(*) // {fixity.SHARD_RECORDS}) shards from pages), p as (select page_id, url, coalesce(html, '') body, {_sql_crc32('page_id')} c from pages),
    ra as (select page_id, url, c, strlen(body) size, {_RECORD} rec from p),
    kept as (select page_id, url, body, c from p where c % 101 <> 7 union all select -1 - page_id, url, body, {_sql_crc32('-1 - page_id')} from p where c % 103 = 11),
    rb as (select page_id, c, strlen({_RECORD}) length, sha256({_RECORD}) digest from kept),
    a as (select page_id, url, c, size, c % shards shard, strlen(rec) length, sha256(rec) sha256 from ra, n),
    am as (select *, row_number() over w - 1 ordinal, sum(length) over w - length "offset" from a window w as (partition by shard order by page_id, sha256 rows unbounded preceding)),
    bm as (select rb.*, c % shards shard, sum(length) over (partition by c % shards order by page_id, digest rows unbounded preceding) - length "offset" from rb, n),
    size as (select shard, count(*) records from a group by 1)
    select page_id, url, shard::bigint shard, ordinal::bigint ordinal, "offset"::bigint "offset", length::bigint length, sha256, case when c % 101 = 7 then 'missing' when c % 97 = 5 and size > 0 then 'corrupt' else 'ok' end status from am
    union all select page_id, null, shard::bigint, (coalesce(records, 0) + row_number() over (partition by shard order by page_id, digest) - 1)::bigint, "offset"::bigint, length::bigint, digest, 'extra' from bm left join size using (shard) where page_id < 0"""


def _sql_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_TEMPLATES = ", ".join(f"({_sql_list(t.words)}, {_sql_list(t.key)}, {t.key_at}, '{t.label}', {str(t.base).lower()})" for t in license.templates())
_LICENSES = f"""with t(words, key, key_at, label, base) as (values {_TEMPLATES}),
    d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
    k as (select doc_id, w, t.*, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = key[1] and w[i:i + len(key) - 1] = key)) - 1 - key_at start from d, t where list_has_all(w, key)),
    h as (select doc_id, label, base, start, list_sum(list_transform(range(len(words)), lambda j: case when start + j >= 0 and w[start + j + 1] = words[j + 1] then 1.0 else 0.0 end))::double / len(words) share from k),
    g as (select doc_id, count(*) filter (base) n_base, min(start) filter (base) first_word, max(start) filter (base) last_word, string_agg(distinct label, ',' order by label) filter (base) base_labels, string_agg(distinct label, ',' order by label) labels, max(share) score from h where base or share >= {license.LEAST_SHARE} group by 1)
    select doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, round(coalesce(score, 0.0), 6) score from d left join g using (doc_id)"""

_H = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::bigint h{i + 1}" for i in range(4))
_FIM = f"""with t as (select doc_id, coalesce(text, '') t, sha256('{fim.SEED}:' || coalesce(doc_id::varchar, '')) h from documents),
    u as (select doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') u, {_H} from t),
    r as (select *, len(u) n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) b from u),
    p as (select *, array_to_string(u[1:a], '') pre, array_to_string(u[a + 1:b], '') mid, array_to_string(u[b + 1:], '') suf,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end form from r)
    select doc_id, n::bigint n, form, case when form <> 'plain' then length(pre)::bigint end prefix_chars, case when form <> 'plain' then length(mid)::bigint end middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256, sha256(t) restored_sha256 from p"""


def _sql_round(k: int) -> str:
    """Assign the parts to the codebooks c{k} and move the entries."""
    floor = "((s - ((s % n) + n) % n) // n)::bigint"
    return f"""d{k} as materialized (select r, part, p, e, dist from (select r, x.part, p, e, list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - c[i]) * (p[i] - c[i])))::bigint dist, row_number() over (partition by r, x.part order by list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - c[i]) * (p[i] - c[i]))), e) k from x join c{k} using (part)) where k = 1),
    m{k} as (select part, e, list({floor} order by i) c from (select part, e, i, sum(p[i])::hugeint s, count(*) n from (select part, e, p, unnest(range(1, len(p) + 1)) i from d{k}) group by 1, 2, 3) group by 1, 2),
    c{k + 1} as materialized (select part, e, coalesce(m{k}.c, c{k}.c) c from c{k} left join m{k} using (part, e))"""


_CODES = f"""with v as (select vec_id, label, list_transform(embedding, lambda y: floor(256 * y::double)::bigint) v from embeddings where embedding is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
    w as materialized (select row_number() over (order by vec_id, v) r, * from v),
    x as materialized (select r, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] p from w, range(16) g(part)),
    c0 as materialized (select part, r - 1 e, p c from x where r <= 64), {_sql_round(0)}, {_sql_round(1)}, {_sql_round(2)},
    f as (select r, string_agg(printf('%02x', e), '' order by part) code, sum(dist)::bigint error from d2 group by 1),
    l as (select label, sum(error)::bigint label_error from w join f using (r) group by 1)
    select vec_id, code, error, label_error, (select sha256(string_agg(array_to_string(c, ','), ',' order by part, e)) from c2) codebooks_sha256 from w join f using (r) join l on l.label is not distinct from w.label"""

#: SQL for the queries that it can express over whole tables; the others are tested against brute force.
ORACLE: dict[str, str] = {"op6_fixity": _FIXITY, "op10_licenses": _LICENSES, "op11_vector_codes": _CODES, "op13_fill_in_middle": _FIM}
