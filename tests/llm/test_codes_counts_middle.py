"""Vector codes, token counts and fill-in-middle against plain loops."""

import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import fim, queries, tokencount, vectorcode

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TEXTS = [None, "", "\n", "one line", "a\nb\n\nc", "é😀\r\nx y\x00z\n\nlast", "has <M> in it\nb\n", "<S", "<|endoftext|> and\n<|endoftext|>", "<", "<\n<S\nP>\n" * 5, "  two  spaces\tand 1234567 digits\n" * 400, "x" * 200_000]


def documents(spark):
    """Odd texts, each twice, with ids that repeat and a null one, beside columns named as results are."""
    rows = [(i % 11 if i else None, t, -7.0, "kept") for i, t in enumerate(TEXTS * 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n double, extra string").withColumns({c: F.lit("own") for c in ("form", "output", "n_tokens", "over_limit", "digest", "version")})


# --- fill-in-middle -----------------------------------------------------------------


def plain_middle(doc_id, text, rate, spm):
    text = text or ""
    units = re.findall(fim.LINES, text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if h4 % 100 < spm:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 0), (0, 50)])
def test_fill_in_middle_against_a_plain_loop(spark, rate, spm):
    docs = documents(spark)
    got = fim.transform(docs, rate=rate, spm=spm)
    assert sorted(got.columns) == sorted([*(c for c in docs.columns if c not in fim.FIELDS), *fim.FIELDS])
    rows = got.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle(r.doc_id, r.text, rate, spm)
        assert r.again == (r.text or "") and r.extra == "kept" and r.n_tokens == "own"
    assert {r.form for r in rows} == ({"plain"} if not rate else {"plain", "psm", "spm"} if spm else {"plain", "psm"})
    assert fim.transform(docs.limit(0)).collect() == []


def test_units_of_another_pattern(spark):
    rows = spark.createDataFrame([("a bb  c",), ("",)], "t string").select(fim.unit_ends(F.col("t"), r"\S+\s*").alias("e")).collect()
    assert [r.e for r in rows] == [[2, 6, 7], []]


@needs_tables
def test_fill_in_middle_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_fill_in_middle(spark, SF).collect()
    assert len(rows) == len(texts)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in rows:
        n, form, a, b, out = plain_middle(r.doc_id, texts[r.doc_id], 100, 50)
        assert tuple(r) == (r.doc_id, n, form, a, b, sha(out), sha(texts[r.doc_id] or ""))


# --- token counts -------------------------------------------------------------------


def tokens(path, text):
    if path.endswith(".model"):
        import sentencepiece

        return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, tmp_path, name):
    import public_tokenizers

    path, docs = str(public_tokenizers.path(name)), documents(spark)
    want = {t: tokens(path, t or "") for t in TEXTS}
    rows = tokencount.counts(docs, str(tmp_path / "cache"), tokenizer=path, limit=5).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), want[r.text], want[r.text] > 5)
        assert (r.extra, r.form, r.digest, r.version) == ("kept", "own", "own", "own")
    assert tokencount.counts(docs.limit(0), str(tmp_path / "none"), tokenizer=path).collect() == [] and not (tmp_path / "none").exists()


def test_only_distinct_misses_are_encoded(spark, tmp_path, monkeypatch):
    cache, path = str(tmp_path / "cache"), tokencount.default_tokenizer()
    asked, encoded = [], tokencount.encoded
    monkeypatch.setattr(tokencount, "encoded", lambda texts, p: asked.append(sorted(r.text for r in texts.collect())) or encoded(texts, p))
    docs = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    tokencount.fill(docs("a", "a", "b b", None, ""), cache)
    tokencount.fill(docs("b b", "c", "c", "a"), cache)
    tokencount.fill(docs("a", "c"), cache)
    assert asked == [["", "a", "b b"], ["c"]]
    kept = tokencount.stored(spark, cache, tokencount.version_digest(path))
    assert kept.count() == 4 and sum(len(os.listdir(tmp_path / "cache" / x)) > 0 for x in os.listdir(cache)) == 1
    # another version shares the folder and none of the counts; a row that two jobs appended counts once
    other = str(__import__("public_tokenizers").path("word_bpe_49k.json"))
    assert tokencount.counts(docs("a", "c d"), cache, tokenizer=other).count() == 2 and asked[2] == ["a", "c d"]
    kept.write.mode("append").parquet(f"{cache}/version={tokencount.version_digest(path)}")
    assert tokencount.counts(docs("a", "a"), cache).select("n_tokens").collect() == [(1,), (1,)] and len(asked) == 3


def test_few_and_many_misses_are_counted_alike(spark, tmp_path):
    docs = documents(spark)
    by = [sorted(map(str, tokencount.counts(docs, str(tmp_path / str(few)), few=few).collect())) for few in (0, 100)]
    assert by[0] == by[1]


def test_a_stored_count_is_what_comes_out(spark, tmp_path):
    """The cache is read, not passed by."""
    cache = str(tmp_path / "cache")
    row = (hashlib.sha256(b"a").digest(), 77)
    spark.createDataFrame([(bytearray(row[0]), row[1])], tokencount.SCHEMA).write.parquet(f"{cache}/version={tokencount.version_digest(tokencount.default_tokenizer())}")
    rows = tokencount.counts(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string"), cache).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [77, 1]


@needs_tables
def test_token_count_query(spark):
    path = tokencount.default_tokenizer()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op12_token_counts(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = tokens(path, texts[r.doc_id])
        assert tuple(r) == (r.doc_id, len(texts[r.doc_id].encode()), n, n > 1024)


# --- vector codes -------------------------------------------------------------------


def plain_codes(vectors, parts, entries, rounds):
    """Codebooks and (code, error) of each vector, with Python's own whole numbers; vectors in order of id."""
    ints = [[math.floor(256 * x) for x in v] for v in vectors]
    w = len(ints[0]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in ints]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def nearest(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(v[p], books[p])[0] for v in cut]
            books[p] = [[sum(col) // len(col) for col in zip(*held, strict=True)] if (held := [v[p] for v, e in zip(cut, own, strict=True) if e == k]) else c for k, c in enumerate(books[p])]
    at = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    return books, [("".join(f"{e:02x}" for e, _ in a), sum(d for _, d in a)) for a in at]


def vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in v] for v in rng.normal(size=(n, dim)).round(1)]  # one decimal, so that distances tie


@pytest.mark.parametrize("n, parts, dim, entries, rounds", [(150, 4, 8, 10, 2), (6, 2, 2, 64, 3), (1, 1, 3, 2, 1), (40, 16, 64, 64, 2)])
def test_codes_against_a_plain_loop(spark, n, parts, dim, entries, rounds):
    held = vectors(n, dim)
    held[n // 2] = held[0]  # a copy under another id
    rows = [(i * 3 - 50, v, i % 3 or None, "kept", -1.0) for i, v in enumerate(held)]
    bad = [(-90, None, 1), (-91, [None] + held[0][1:], 1), (-92, [float("nan")] * dim, 1), (-93, [float("inf")] + held[0][1:], 2), (-94, [float("-inf")] + held[0][1:], 2)]
    df = spark.createDataFrame([*rows, *((*b, "kept", -1.0) for b in bad)], "vec_id bigint, embedding array<float>, label int, extra string, error double").repartition(5)
    books = vectorcode.fit(df, parts=parts, entries=entries, rounds=rounds)
    want_books, want = plain_codes(held, parts, entries, rounds)
    assert books.entries.tolist() == want_books
    assert books.digest() == hashlib.sha256(",".join(str(x) for b in want_books for e in b for x in e).encode()).hexdigest()
    got = vectorcode.with_label_error(vectorcode.encode(df, books)).collect()
    codes = {i * 3 - 50: c for i, c in enumerate(want)}
    labels = {}
    for i, (_, e) in enumerate(want):
        labels[i % 3 or None] = labels.get(i % 3 or None, 0) + e
    assert {r.vec_id: (r.code, r.error, r.label_error, r.extra) for r in got} == {k: (*c, labels[(k + 50) // 3 % 3 or None], "kept") for k, c in codes.items()} and len(got) == n


def test_codes_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<double>, label string"
    empty = spark.createDataFrame([(1, None, "a")], schema)
    books = vectorcode.fit(empty)
    assert books.entries.size == 0 and vectorcode.with_label_error(vectorcode.encode(empty, books)).collect() == []
    twins = spark.createDataFrame([(None, [0.5] * 16, None), (3, [0.25] * 16, None), (3, [0.25] * 16, None), (3, [-0.001] * 16, "a")], schema)
    books = vectorcode.fit(twins, rounds=0)  # of one id in order of components, null ids last
    assert books.entries[0, :, 0].tolist() == [-1, 64, 64, 128]
    assert sorted(r.code[:2] for r in vectorcode.encode(twins, books).collect()) == ["00", "01", "01", "03"]
    for v in ([1.0] * 15, [1e12] * 16):
        with pytest.raises(Exception, match="divide|too large"):
            vectorcode.fit(spark.createDataFrame([(1, v, "a")], schema))
    with pytest.raises(Exception, match="components"):
        vectorcode.encode(spark.createDataFrame([(1, [1.0] * 32, "a")], schema), books).collect()


def test_distances_are_exact():
    rng = random.Random(5)
    x, c = ([[rng.randrange(-(1 << 28), 1 << 28) for _ in range(4)] for _ in range(20)] for _ in "xc")
    got = vectorcode.distances(np.array(x, np.int64), np.array(c, np.int64))
    assert got.tolist() == [[sum((a - b) ** 2 for a, b in zip(u, v, strict=True)) for v in c] for u in x]
