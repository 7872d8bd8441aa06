"""Token offsets, streamed windows and packed chunks, against the tokenizer on whole texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexspark.functions import tokens
from lexspark.operators import chunking as C

P = pytest.importorskip("public_tokenizers")
NAMES = [tokens.WORDS, str(P.path("byte_bpe_50k.json")), str(P.path("word_bpe_49k.json"))]
TEXTS = ["", " ", "one", "제1조(목적) 이 법은  근로\n\n조건을 정한다.\n", "don't 12,345 ½ é😀 x_1\t\t y \n \n z", "a" * 3000, "  lead\n", "tail  "]


@pytest.mark.parametrize("name", NAMES, ids=["words", "bytes", "lower"])
def test_offsets_are_the_tokenizers(spark, name):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string").select("i", tokens.offsets(F.col("t"), name).alias("o"), tokens.count(F.col("t"), name).alias("n")).collect()
    for r in rows:
        text = (TEXTS[r.i] if r.i < len(TEXTS) else None) or ""
        if name == tokens.WORDS:
            assert [text[a:b] for a, b in r.o] == text.split()
        else:
            from tokenizers import Tokenizer

            assert [tuple(x) for x in r.o] == Tokenizer.from_file(name).encode(text, add_special_tokens=False).offsets
        assert r.n == len(r.o)


@pytest.mark.parametrize("name", NAMES, ids=["words", "bytes", "lower"])
def test_a_stream_of_parts_is_the_whole(name):
    rng = random.Random(6)
    for _ in range(60):
        parts = [rng.choice([*TEXTS, "\n\n", "x", "법 제", "1조"]) for _ in range(rng.randint(1, 9))]
        s = tokens.Stream(name)
        got = [x for p in parts for x in s.add(p)] + s.add("", last=True)
        assert got == tokens.opened(name)("".join(parts))


def naive_packed(header, blocks, limit, spans):
    parts, cur = [], []
    for b in blocks:
        if cur and len(spans("\n".join([header, *cur, b]))) > limit:
            parts.append(cur)
            cur = []
        cur.append(b)
    return [*parts, cur]


@pytest.mark.parametrize("name", NAMES, ids=["words", "bytes", "lower"])
def test_packing_against_counting_anew(name):
    rng, spans = random.Random(7), tokens.opened(name)
    for _ in range(80):
        blocks = [rng.choice(["① 근로시간은 40시간", "word " * rng.randint(1, 30), "tight", "", " 가. x", "1. item\n  나. y"]) for _ in range(rng.randint(0, 14))]
        limit = rng.choice([5, 20, 60])
        assert C.packed("[h > 제1조]", blocks, limit, spans) == naive_packed("[h > 제1조]", blocks, limit, spans)


def naive_windows(arts, size, overlap, spans):
    text, places = "", []
    for name, t in arts:
        places.append((len(text), len(text) + len(t) + 2, name))
        text += t + "\n\n"
    o = spans(text)
    out = []
    for i, t0 in enumerate(range(0, max(len(o) - overlap, 1), size - overlap) if o else []):
        a, b = o[t0][0], o[min(t0 + size, len(o)) - 1][1]
        out.append((i, a, b, text[a:b].strip(), [n for s, e, n in places if s < b and e > a]))
    return out


@pytest.mark.parametrize("name", NAMES, ids=["words", "bytes", "lower"])
@pytest.mark.parametrize("size, overlap", [(7, 3), (5, 0), (40, 39), (10_000, 64)])
def test_windows_against_the_whole_text(spark, name, size, overlap):
    rng = random.Random(8)
    laws = {k: [(f"{k}#{i}", rng.choice([*TEXTS[:5], "법 제5조 " * rng.randint(1, 9)])) for i in range(rng.randint(1, 25))] for k in ("가법", "나법", "다법")} | {"empty": [("e#0", "")]}
    rows = [(law, i, name_, t, "extra") for law, arts in laws.items() for i, (name_, t) in enumerate(arts)]
    rng.shuffle(rows)
    got = {}
    for r in C.fixed_chunks(spark.createDataFrame(rows, "law string, pos int, article_id string, text string, other string"), size, overlap, name).collect():
        got.setdefault(r.law, []).append((int(r.chunk_id.split(":")[2]), r.start, r.stop, r.text, list(r.article_ids)))
    want = {law: naive_windows(arts, size, overlap, tokens.opened(name)) for law, arts in laws.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_a_law_of_many_lines(spark):
    """Ten times the lines take about ten times as long, and the function holds a few windows."""
    took = []
    for n in (10_000, 100_000):
        law = spark.range(n).select(F.lit("law").alias("law"), F.col("id").alias("pos"), F.col("id").cast("string").alias("article_id"), F.concat(F.lit("line "), "id", F.lit(" of a long law")).alias("text"))
        began = time.time()
        assert C.fixed_chunks(law, 512, 64).count() == -(-(n * 6 - 64) // 448)
        took.append(time.time() - began)
    assert took[1] < 25 * took[0] + 5
    blocks = [f"line {i} of a long article" for i in range(100_000)]
    began = time.time()
    assert sum(map(len, C.packed("[h]", blocks, 512, tokens.opened(NAMES[1])))) == 100_000 and time.time() - began < 60


def test_groups(spark):
    rows = spark.createDataFrame([([5, 5, 5, 20, 1],), ([],), (None,), ([100_000] * 3,)], "x array<bigint>").select(C.greedy_groups(F.col("x"), 10).alias("g"), C.greedy_groups(F.col("x"), 10, 2, 1).alias("h")).collect()
    assert [r.g for r in rows] == [[0, 0, 1, 2, 3], [], None, [0, 1, 2]]
    assert rows[0].h == [0, 1, 2, 3, 4]
