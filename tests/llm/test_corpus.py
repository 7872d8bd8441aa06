"""Near-duplicates, fingerprints, licences, fixity, packing and the pipeline, against brute force."""

import gzip
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexspark.llm import fixity, imatch, license, neardup, packing, queries

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ba", "ko", "li", "mu", "ne", "ra", "ti", "so"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def edited(text, k, seed):
    rng, w = random.Random(seed), text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"neu{rng.randrange(1000)}"
    return " ".join(w)


# --- near-duplicates ----------------------------------------------------------------


def weighted(values):
    h = np.array(sorted(values), np.uint64)
    return h, np.array([values[int(x)] for x in h], float)


def naive_similarity(a, b):
    both = set(a) & set(b)
    return sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in set(a) | set(b)) for x in both)


def test_probability_jaccard():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ({rng.randrange(12): rng.randint(1, 4) for _ in range(rng.randint(1, 10))} for _ in "ab")
        assert neardup.similarity(weighted(a), weighted(b)) == pytest.approx(naive_similarity(a, b))
    one = weighted({1: 1, 2: 1})
    assert neardup.similarity(one, one) == pytest.approx(1) and neardup.similarity(one, weighted({})) == 0


def test_signatures_estimate_it():
    rng = random.Random(3)
    a = {rng.randrange(1 << 60): rng.randint(1, 3) for _ in range(200)}
    b = {k: v for k, v in a.items() if rng.random() < 0.8} | {rng.randrange(1 << 60): 1 for _ in range(20)}
    slots = 4000
    s = neardup.signatures([weighted(a), weighted(b), weighted({5: 1.0})], slots)
    assert (s[0] == s[1]).mean() == pytest.approx(naive_similarity(a, b), abs=0.04)
    assert len(set(s[2].tolist())) == 1
    assert (neardup.signatures([weighted(a)], slots)[0] == s[0]).all()  # alone or in company alike
    assert neardup.signatures([], 4).shape == (0, 4)


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def same_partition(a, b):
    pairs = {(a[k], b[k]) for k in a}
    return len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    links = [(a, b) for a, b in links if a != b]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert same_partition(got, union_find({x for p in links for x in p}, links))
    assert neardup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.fixture(scope="module")
def copies():
    base = prose(120, "base")
    docs = [base] * 15 + [edited(base, 1 + i % 3, i) for i in range(60)] + [edited(base, 30, i) for i in range(5)]
    docs += [prose(90, i) for i in range(20)] + [edited(prose(90, i), 2, i) for i in range(20)]
    docs += [prose(40, "shared") + " " + prose(60, f"own{i}") for i in range(40)]  # a passage in common is no copy
    docs += ["", "", None, None, "...", "ba ko", "ba ko", "BA, ko!", prose(20000, "long"), edited(prose(20000, "long"), 30, 1)]
    return docs


def brute_classes(texts, p=neardup.NearDup()):
    """Class of each row: equal texts, and texts with a similarity from the threshold on, linked."""
    bags = [neardup.bag(t, p.width) for t in texts]
    links = [(i, j) for j in range(len(texts)) for i in range(j) if texts[i] is not None and (texts[i] == texts[j] or neardup.similarity(bags[i], bags[j]) >= p.similarity)]
    return union_find(range(len(texts)), links)


def test_near_duplicates_against_brute_force(spark, copies):
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id bigint, text string").withColumn("class_id", F.lit("x")).repartition(3)
    rows = neardup.classes(docs).collect()
    got = {r.doc_id: r.class_id for r in rows}
    want = brute_classes(copies)
    assert len(rows) == len(copies) and same_partition(got, want)
    assert all(r.class_id <= r.doc_id for r in rows)
    sizes = {r.doc_id: r.class_size for r in rows}
    assert all(sizes[i] == sum(w == want[i] for w in want.values()) for i in want)
    kept = {r.doc_id for r in neardup.keep_one(docs).collect()}
    assert kept == set(got.values())
    assert neardup.classes(docs.limit(0)).count() == 0 and neardup.keep_one(docs.limit(0)).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "ba ko li mu ne"), (1, "ba ko li mu ne"), (None, "ba ko li mu ne"), (None, "ra ti"), (None, "so mu"), (2, None)], "doc_id bigint, text string")
    rows = neardup.classes(docs).collect()
    assert sorted(((r.class_id, r.class_size) for r in rows), key=str) == sorted([(1, 3)] * 3 + [(None, 1), (None, 1), (2, 1)], key=str)
    assert sorted(map(str, (r.doc_id for r in neardup.keep_one(docs).collect()))) == ["1", "2", "None", "None"]


def family(n, pairs):
    """Texts round one template with a mutual similarity of about 0.76, each with words of its own, and near copies (0.82) of the last `pairs` of them."""
    core = prose(350, "template")
    docs = [core + " " + prose(50, f"own{i}") for i in range(n)]

    def near(t, i):
        w = t.split()
        for j in range(8):
            w[40 * j + 10 + i % 20] = f"neu{i}x{j}"
        return " ".join(w)

    return docs + [near(docs[n - pairs + i], i) for i in range(pairs)]


def test_near_duplicates_in_a_family_under_the_threshold(spark):
    n, pairs = 1000, 60
    docs = family(n, pairs)
    bags = [neardup.bag(t, 5) for t in docs]
    assert all(0.7 < neardup.similarity(bags[0], b) < 0.79 for b in bags[1:n]) and max(neardup.similarity(bags[0], b) for b in bags[n:]) < 0.8
    assert all(0.8 <= neardup.similarity(bags[n - pairs + i], bags[n + i]) < 0.83 for i in range(pairs))
    rows = neardup.classes(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == {i: i if i < n else i - pairs for i in range(n + pairs)}


def test_rare_pairs_lose_none():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(8)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    texts += [t + " " + rng.choice(words) for t in texts[:60]] + [t + " " + t for t in texts[:60]]
    bags = [neardup.bag(t, 2) for t in texts]
    n, coded = len(texts), neardup.Bags.of(bags)
    found = neardup.rare_pairs(coded, np.arange(n), 0.8)
    got = {(i, j) for j in range(n) for i in range(j) if found[i, j] or found[j, i]}
    want = {(i, j) for j in range(n) for i in range(j) if neardup.similarity(bags[i], bags[j]) >= 0.8}
    assert len(want) > 50 and want <= got < {(i, j) for j in range(n) for i in range(j)}
    left = set(neardup.bounded(coded, np.triu(found | found.T), 0.8))
    assert want <= left < got
    kind = np.arange(n) % 3
    assert (neardup.rare_pairs(coded, kind, 0.8) <= (kind[:, None] != kind[None])).all()
    none = neardup.Bags.of([])
    assert neardup.rare_pairs(none, np.empty(0), 0.8).shape == (0, 0) and not list(neardup.bounded(none, np.zeros((0, 0), bool), 0.8))


def test_large_buckets_in_several_blocks(spark):
    """The same classes if a bucket's texts need many tiles."""
    docs = spark.createDataFrame(list(enumerate(family(150, 20))), "doc_id bigint, text string")
    rows = neardup.classes(docs, p=neardup.NearDup(block_texts=40, block_bytes=50_000)).collect()
    assert {r.doc_id: r.class_id for r in rows} == {i: i if i < 150 else i - 20 for i in range(170)}


# --- fingerprints -------------------------------------------------------------------


def test_imatch(spark):
    texts = [prose(80, i) for i in range(60)] + [prose(80, 1), "", None, "!!!", prose(5000, "l")]
    docs = spark.createDataFrame([(i * 7 % 101, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    lex = imatch.lexicon(docs, low=0.02, high=0.5)
    held = lex.first().lex
    df: dict = {}
    for t in texts:
        for w in set(re.findall(r"[^\W_]+", (t or "").lower())):
            df[w] = df.get(w, 0) + 1
    n = sum(bool(t) for t in texts)
    assert sum(map(len, held)) == sum(max(2, 0.02 * n) <= c <= 0.5 * n for c in df.values())
    rows = {r.doc_id: r for r in imatch.fingerprint(docs, lex).collect()}
    by_text: dict = {}
    for i, t in enumerate(texts):
        by_text.setdefault(t or "", set()).add(rows[i * 7 % 101].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) >= len(by_text) - 1  # only "" and "!!!" have the same terms, none


def brute_imatch(texts, low, high):
    """Fingerprints by plain loops: the kept terms' hashes in order, and a hash for each subset of the lexicon."""
    bags = [{w for w in re.findall(r"[^\W_]+", (t or "").lower())} for t in texts]
    n, df = sum(bool(t) for t in texts), {}
    for b in bags:
        for w in b:
            df[w] = df.get(w, 0) + 1
    return [frozenset(w for w in b if max(2, low * n) <= df[w] <= max(high * n, 2)) for b in bags]


def test_fingerprints_are_those_of_the_kept_terms(spark):
    """Texts have equal fingerprints just if their kept terms are equal, and the likeness is the share of equal subset hashes, which falls with the terms that differ."""
    base = prose(150, 5).split()
    texts = [" ".join(base), " ".join(reversed(base)), " ".join(base).upper() + "!", " ".join(base[:140]), " ".join(base[:60])] + [prose(80, i) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lex = imatch.lexicon(docs, low=0.02, high=0.6)
    kept = brute_imatch(texts, 0.02, 0.6)
    rows = [r for r in sorted(imatch.fingerprint(docs, lex).collect(), key=lambda r: r.doc_id)]
    for i in range(len(texts)):
        for j in range(i):
            if kept[i] and kept[j]:
                assert (rows[i].fingerprint_subsets == rows[j].fingerprint_subsets) >= (kept[i] == kept[j])
    assert rows[0].fingerprint == rows[1].fingerprint == rows[2].fingerprint

    def like(i, j):
        both = [(x, y) for x, y in zip(rows[i].fingerprint_subsets, rows[j].fingerprint_subsets, strict=True) if not x == y == imatch.EMPTY]
        return sum(x == y for x, y in both) / len(both)

    got = {r.doc_id: r.like for r in imatch.fingerprint(docs, lex).crossJoin(F.broadcast(imatch.fingerprint(docs.where("doc_id = 0"), lex).select(F.col("fingerprint").alias("f"), F.col("fingerprint_subsets").alias("s")))).select("doc_id", imatch.likeness(F.col("fingerprint_subsets"), F.col("s"), F.col("fingerprint"), F.col("f")).alias("like")).collect()}
    assert all(got[i] == pytest.approx(1.0 if rows[i].fingerprint == rows[0].fingerprint else like(0, i)) for i in got)
    assert 1 == got[2] > got[3] >= got[4]


def test_next_rows(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 5)
    ids = random.Random(2).sample(range(10_000), 83) + [None, 77_777, 77_777]
    docs = spark.createDataFrame([(i, f"t{i}{k}") for k, i in enumerate(ids)], "doc_id bigint, text string").repartition(5)
    rows = imatch.with_next(docs, "doc_id", "text", lambda d: d.withColumn("n", F.length("text"))).collect()
    nxt = {r.text: r.next_text for r in rows}
    seen, at = [], min((r for r in rows if r.doc_id is None), key=lambda r: r.text).text
    for _ in rows:
        seen.append(at)
        at = nxt[at]
    assert at == seen[0] and len(set(seen)) == len(rows)  # one ring
    order = [next(r.doc_id for r in rows if r.text == t) for t in seen]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    named = docs.where("doc_id is not null").select(F.lpad(F.col("doc_id").cast("string"), 9, "é").alias("doc_id"), "text", F.lit(1).alias("_range")).dropDuplicates(["doc_id"])
    rows = imatch.with_next(named, "doc_id", "text", lambda d: d.withColumn("n", F.length("text"))).collect()
    want = sorted(rows, key=lambda r: r.doc_id)
    assert [r.next_text for r in want] == [r.text for r in want[1:] + want[:1]] and rows[0].__fields__[2] == "_range" and len(rows) == 84
    alone = imatch.with_next(docs.orderBy("text").limit(1), "doc_id", "text", lambda d: d.withColumn("n", F.length("text"))).first()
    assert alone.next_text == alone.text
    assert imatch.with_next(docs.limit(0), "doc_id", "text", lambda d: d.withColumn("n", F.length("text"))).count() == 0


# --- licences -----------------------------------------------------------------------


def brute_licence(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for p, label in license.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


LICENCES = [
    "Under the MIT License, or the mit  license.", "GNU General Public License v2; CC BY 4.0", "the apache. license", "Apache_License", "mit licenses", "cc by cc by", "", None, "!!",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "XGNU General Public License", "©mit license mit License", "gnu general public general public license",
    "Redistribution and use in source and binary forms", "use in source and binary forms", "KMIT License", "word " * 30_000 + "MIT LICENSE",
]


def test_licences_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(LICENCES)] + [(0, LICENCES[0], "x")], "doc_id bigint, text string, labels string")
    rows = license.scan(docs, license.frequencies(docs)).collect()
    assert len(rows) == len(LICENCES) + 1
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licence(LICENCES[r.doc_id]), r.doc_id
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in rows}
    assert by[9].labels == "mit" and by[9].n_base == 0 and by[13].labels == "bsd" and by[0].score == 1.0
    odd = spark.createDataFrame([(1, "All rights reserved. MIT License", 1, 2)], "doc_id bigint, text string, _w int, _found int")
    one = license.scan(odd, {})
    assert one.columns[:4] == odd.columns and one.first().labels == "mit"  # three words alone are no notice
    more = license.SENTENCES[1][0].replace("this list", "THE LIST,").replace("disclaimer", "x")
    half = spark.createDataFrame([(1, more), (2, "source code must retain the above copyright notice")], "doc_id bigint, text string")
    assert {r.doc_id: (r.labels, round(r.score, 3)) for r in license.scan(half, {}).collect()} == {1: ("bsd", 0.889), 2: ("", 0.0)}
    assert license.scan(docs.limit(0), {}).count() == 0 and license.frequencies(docs.limit(0))["mit"] == 0


# --- fixity -------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", ""), (3, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").select(fixity.record(F.col("url"), F.col("html"), F.col("page_id")).alias("r"))
    data = b"".join(r.r.encode() for r in df.collect())
    found = list(fixity.read_records(data))
    assert [(h["warc-target-uri"], p.decode()) for _, _, h, p in found] == [("http://a/", "<p>é</p>"), ("http://b/", ""), ("", "")]
    assert sum(n for _, n, _, _ in found) == len(data) and [o for o, *_ in found][0] == 0
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "y.warc").write_bytes(data[:-30])
    back = fixity.read_warc(spark, str(tmp_path / "*")).orderBy("file", "ordinal").collect()
    assert [r.ordinal for r in back if r.file.endswith("gz")] == [0, 1, 2] and back[0].payload == "<p>é</p>".encode()
    assert list(fixity.read_records(b"junk")) == []


def leaves(spark, rows):
    return spark.createDataFrame([(s, o, 10 * o, 10, d) for s, o, d in rows], "shard bigint, ordinal bigint, offset bigint, length bigint, digest string")


def test_audit_descends_only_where_it_must(spark):
    rows = [(s, o, f"d{s}-{o}") for s in range(20) for o in range(300)]
    a = leaves(spark, rows)
    found, compared = fixity.audit(a, a, 300, 20)
    assert found.count() == 0 and compared[0] == 1 and sum(compared[1:]) == 0
    bad = {(3, 7), (3, 8), (19, 299)}
    b = leaves(spark, [(s, o, "x" if (s, o) in bad else d) for s, o, d in rows if (s, o) != (5, 299)] + [(6, 300, "new")])
    found, compared = fixity.audit(a, b, 301, 20)
    assert {(r.shard, r.ordinal, r.status) for r in found.collect()} == {(s, o, "corrupt") for s, o in bad} | {(5, 299, "missing"), (6, 300, "extra")}
    assert sum(compared) < 200
    one = leaves(spark, [(0, 0, "a")])
    assert fixity.audit(one, leaves(spark, [(0, 0, "b")]), 1, 1)[0].first().status == "corrupt"
    empty = leaves(spark, []) if False else one.limit(0)
    assert fixity.audit(empty, empty, 1, 1)[0].count() == 0 and fixity.audit(one, empty, 1, 1)[0].first().status == "missing"


def test_audit_of_records_lost_and_added_within_shards(spark):
    rows = [(i, f"http://{i}/", f"<p>{i}</p>") for i in range(200)] + [(None, "x", "n"), (50, "http://50/", "again"), (50, "http://50/", "again"), (70, "http://70/", "twin")]
    changed = [(i, u, "#" + h if i in (30, 31) else h) for i, u, h in rows if i not in (3, 20, 110) and h not in ("<p>70</p>", "n")] + [(1000 + i, "new", "new") for i in range(5)] + [(-1, "first", "first")]
    made = [fixity.manifest(spark.createDataFrame(r, "id bigint, url string, html string"), "id", "url", "html", 3, ["id"]) for r in (rows, changed)]
    found = fixity.audited(*made, 3, "id").collect()
    assert sum(r.status == "ok" for r in found) == len(rows) - 7 and len(found) == len(rows) + 6
    want = [(i, "missing") for i in (None, 3, 20, 70, 110)] + [(i, "corrupt") for i in (30, 31)] + [(i, "extra") for i in (-1, 1000, 1001, 1002, 1003, 1004)]
    assert sorted((r.id, r.status) for r in found if r.status != "ok" and r.id is not None) == sorted(x for x in want if x[0] is not None)
    assert [r.status for r in found if r.id is None] == ["missing"]


@needs_tables
def test_fixity_query(spark):
    import zlib

    rows = queries.op6_fixity(spark, SF).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    crc = {i: zlib.crc32(str(i).encode()) for i in pages}
    added = {-1 - i for i in pages if crc[i] % 103 == 11}
    assert sorted(r.page_id for r in rows) == sorted([*pages, *added])
    for r in rows:
        own = pages[r.page_id if r.page_id >= 0 else -1 - r.page_id]
        rec = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:{r.page_id}>\r\nWARC-Target-URI: {own.url}\r\nContent-Type: text/html\r\nContent-Length: {len(own.html.encode())}\r\n\r\n{own.html}\r\n\r\n".encode()
        assert r.sha256 == hashlib.sha256(rec).hexdigest() and r.length == len(rec)
        assert r.status == ("extra" if r.page_id < 0 else "missing" if crc[r.page_id] % 101 == 7 else "corrupt" if crc[r.page_id] % 97 == 5 else "ok")
    assert {r.status for r in rows} >= {"ok", "corrupt"}


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = c.execute(queries.ORACLE[name])
    names = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, found.fetchall()))


# --- packing ------------------------------------------------------------------------


def check_packing(rows, limit):
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
    return len(by)


def test_packing(spark):
    docs = spark.createDataFrame([(i, prose(random.Random(i).randint(1, 120), i)) for i in range(400)] + [(400, None), (401, ""), (5, "ba"), (5, "ba"), (None, "ko"), (402, prose(3000, "x"))], "doc_id bigint, text string")
    rows = packing.pack(docs, limit=256).collect()
    encode = packing.encoder(packing.default_tokenizer())
    want = sorted(str((r.doc_id, *p)) for r in docs.collect() for p in packing.cut([*encode(r.text or ""), 2], 256))
    assert sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows) == want
    n = check_packing(rows, 256)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 256) + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_genetic_steps():
    rng, size = np.random.default_rng(1), [int(x) for x in np.random.default_rng(2).integers(1, 100, 200)]
    a, b = ([], []), ([], [])
    packing.best_fit(list(range(200)), size, *a, 100)
    for i in range(200):  # a poor parent: a bin an item
        b[0].append([i])
        b[1].append(size[i])
    for one, two in ((a, b), (b, a)):
        bins, fill = packing.cross(one, two, size, 100, rng)
        assert sorted(i for x in bins for i in x) == list(range(200)) and fill == [sum(size[i] for i in x) for x in bins] and max(fill) <= 100
    bins, fill = packing.evolve(size, 100, [b], rng)
    assert len(fill) <= len(a[1]) and sorted(i for x in bins for i in x) == list(range(200))


# --- queries and the pipeline -------------------------------------------------------


@needs_tables
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    final = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len({r.doc_id for r in final}) < docs.count()
    check_packing(final, 1024)
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = docs.where(F.col("doc_id").isin([r.doc_id for r in final])).collect()
    assert not any(b in d.text for b in bench for d in left)
    assert len({d.text for d in left}) == len(left)


@needs_tables
@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:4], ids=lambda s: s[0])
def test_stages_bear_odd_rows(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10_001, "", "en", None, 0), (10_001, "", "en", None, 0)], docs.schema)
    out = stage[1](spark, docs.unionByName(odd).withColumn("extra", F.lit(1)), SF)
    assert out.columns == [*docs.columns, "extra"] and out.count() > 100
    stage[1](spark, docs.limit(0), SF).collect()


@needs_tables
def test_fingerprint_query(spark):
    rows = queries.op5_imatch(spark, SF).collect()
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()))
    got = {r.doc_id: r for r in rows}
    for k, (i, t) in enumerate(docs):
        nxt, half = docs[(k + 1) % len(docs)][1], len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[i].n_chars == len(t)
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    assert sum(r.near_edited for r in rows) > 5 * sum(r.near_next for r in rows)
