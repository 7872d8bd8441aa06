"""Language, toxicity, quality, extraction, decontamination and tokens: the pure parts and their DataFrame forms."""

import os
import random
import re
from collections import Counter
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import decontam, html, lid, packing, quality, toxicity
from lexspark.llm.common import borrowed, held_out, mix, shingle_hashes, word_hashes

WORDS = {"en": "the and that with from this have which their would other about".split(), "de": "der und nicht eine werden auch sich über nach können würde noch".split()}


def prose(lang, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)) + "."


def odd_rows(spark):
    """Null text, empty text, a long text, repeated rows, and a column named like a result."""
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 !! 34", None), (4, prose("en", 4000, 1), "x"), (4, prose("en", 4000, 1), "x"), (None, "the and that with", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string")


def test_word_hashes():
    h, at = word_hashes(b"ab, cd  ab")
    assert list(at) == [0, 4, 8] and h[0] == h[2] != h[1]
    assert len(word_hashes(b"")[0]) == len(word_hashes(b" .,")[0]) == 0
    assert len(shingle_hashes("a b c")) == 1 and len(shingle_hashes("a b c d e f")) == 2 and len(shingle_hashes(None)) == 0
    assert shingle_hashes("A b c d e")[0] == shingle_hashes("a, b c d e!")[0]
    assert len(set(mix(np.arange(1000, dtype=np.uint64)).tolist())) == 1000


def test_held_out(spark):
    import zlib

    got = {r.i: r.h for r in spark.range(50).select(F.col("id").alias("i"), held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


def test_language(spark):
    docs = spark.createDataFrame([(i, prose(lang, 60, i), lang) for i in range(40) for lang in ("de", "en")], "doc_id bigint, text string, lang string")
    model = lid.fit(docs)
    assert model.langs == ("de", "en")
    new = spark.createDataFrame([(i, prose(lang, 40, 1000 + i), lang) for i in range(20) for lang in ("de", "en")], "doc_id bigint, text string, lang string")
    assert lid.predict(new, model).where("lang_pred = lang and not rejected and score > 0").count() == 40
    rows = lid.predict(odd_rows(spark), model).collect()
    assert [r.lang_pred for r in rows] == ["und", "und", "und", "en", "en", "en"] and rows[0].rejected and isinstance(rows[3].score, float)
    assert rows[3] == rows[4]
    assert lid.predict(docs.limit(0), model).count() == 0 and lid.fit(docs.limit(0)).langs == ()
    assert lid.classify(lid.LanguageModel((), ()), "text")[0] == "und"


def test_toxicity(spark):
    rng = random.Random(5)
    sample = []
    for i in range(300):
        bad = i % 3 == 0
        parts = [prose("en", 8, rng.random()) for _ in range(6)]
        if bad:
            parts[rng.randrange(6)] = f"the nastyword{rng.choice('abc')} and that."
        sample.append((" ".join(parts), int(bad)))
    model = toxicity.fit(sample)
    p, where = toxicity.noisy_or(model, "the and that. you are nastyworda with this. from the.")
    assert p > 0.7 and len(where) == 1 and where[0][:2] == (13, 43)
    assert toxicity.noisy_or(model, prose("en", 500, 3))[0] < 0.1
    low = [toxicity.sentence_scores(model, "the. nastyworda.")]
    assert len(low[0]) == 1
    rows = toxicity.score(odd_rows(spark), model).collect()
    assert [r.predicted for r in rows] == [0] * 6 and rows[0].score == 0.0 and rows[3] == rows[4]
    assert toxicity.fit([("a", 1)]).weights == {} and toxicity.fit([]).weights == {}
    assert toxicity.score(odd_rows(spark).limit(0), model).count() == 0


def test_noisy_or_is_one_minus_the_product():
    model = toxicity.ToxicityModel(-2.0, {"bad": 3.0, "worse": 4.0})
    s = lambda z: 1 / (1 + np.exp(-z))
    assert toxicity.noisy_or(model, "bad. fine. worse.")[0] == pytest.approx(1 - (1 - s(1.0)) * (1 - s(2.0)))


def test_quality(spark):
    good = lambda i: (i, ". ".join(prose("en", 9, i * 50 + k).capitalize() for k in range(8)), "web", "en")
    junk = lambda i: (i, "BUY NOW!!! $$$ " * (20 + i % 7), "spam", "en")
    rows = [(good if i % 3 else junk)(i) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").withColumn("n_chars", F.length("text"))
    labels = docs.where("doc_id < 150").select("doc_id", (F.col("source") == "web").cast("int").alias("quality"))
    model = quality.fit(docs, labels)
    assert model.rounds and model.rounds[0] > 0  # the views told each other something
    assert quality.score(docs, model).where("accepted = (source = 'web')").count() == 240
    out = quality.score(odd_rows(spark), model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out) and out[3] == out[4]
    blank = quality.fit(docs, labels.limit(0))
    assert blank.text is None and quality.score(docs, blank).where("score = 0.5 and accepted").count() == 240


def two_views(n, seed, noise=0.12):
    """Rows whose two views each tell the kind, with errors of their own."""
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.6).astype(float)
    view = lambda k: np.stack([np.where(rng.random(n) < noise, 1 - y, y) for _ in range(k)], 1) + rng.normal(0, 0.05, (n, k))
    return view(3), view(2), y


def plain_loop(t, m, y, t_free, m_free, ids, rounds, most, confident):
    """Co-training in plain loops over all rows: what each view is told in each round."""
    held = np.arange(len(y)) % 3 == 2
    base, told, log = y[~held], [{}, {}], []
    for _ in range(rounds):
        new = [{}, {}]
        for v, (x, free) in enumerate(((t, t_free), (m, m_free))):
            rows = sorted(told[v])
            w = quality.logistic(np.vstack([x[~held], *[free[ids.index(r)][None] for r in rows]]), np.append(base, [told[v][r] for r in rows]), np.append(np.ones(len(base)), np.full(len(rows), 0.5)))
            z = quality.logit(w, x[held])[:, None]
            c = quality.logistic(z, y[held], l2=0.1)
            p_held, p = quality.sure(quality.logit(c, z)), quality.sure(quality.logit(c, quality.logit(w, free)[:, None]))
            for kind in (0, 1):
                side, seen = (p if kind else 1 - p).round(9), p_held if kind else 1 - p_held
                least = 2.0
                for n in range(1, len(seen) + 1):
                    top = sorted(range(len(seen)), key=lambda i: -seen[i])[:n]
                    if (sum(y[held][top] == kind) + 1) / (n + 2) >= confident:
                        least = seen[top[-1]]
                quota = max(1, int(most * (base.mean() if kind else 1 - base.mean())))
                for i in sorted((i for i in range(len(ids)) if side[i] >= least and ids[i] not in told[1 - v]), key=lambda i: (-side[i], ids[i]))[:quota]:
                    new[1 - v][ids[i]] = kind
        for v in (0, 1):
            told[v] |= new[v]
        log.append((len(new[0]), len(new[1])))
    return log


def test_co_training_against_a_plain_loop(spark):
    t, m, y = two_views(90, 1)
    t_free, m_free, _ = two_views(400, 2)
    ids = list(range(400))

    def ask(q):
        return [(v, kind, i, t_free[i], m_free[i]) for v, kind, _, i in q.wanted(t_free, m_free, np.array(ids))]

    model = quality.co_train(t, m, y, ask, rounds=3, most=40, confident=0.8)
    assert model.exchanged == plain_loop(t, m, y, t_free, m_free, ids, 3, 40, 0.8)
    assert all(a > 0 and b > 0 for a, b in model.exchanged) and len(model.exchanged) == 3  # both views teach, in every round
    new_t, new_m, new_y = two_views(500, 3)
    scores = model.scores(new_t, new_m)
    assert ((scores[0] > 0.5) == new_y).mean() > 0.9


def test_all_unlabelled_rows_are_asked(spark):
    """Over Spark partitions the surest rows are those of one batch of all."""

    def kept(seed, n):
        t, m, y = two_views(n, seed)
        return np.pad(t.astype(np.float16), ((0, 0), (0, quality.N_TEXT - 3))), np.pad((m > 0.5).astype(np.uint8), ((0, 0), (0, quality.N_META - 2))), y

    t, m, y = kept(1, 90)
    t_free, m_free, _ = kept(2, 300)
    rows = spark.createDataFrame([(i, t_free[i].tobytes(), m_free[i].tobytes()) for i in range(300)], "rid bigint, t binary, m binary").repartition(5)
    t, m, t_free, m_free = (x.astype(float) for x in (t, m, t_free, m_free))
    ask = lambda q: [(v, kind, i, t_free[i], m_free[i]) for v, kind, _, i in q.wanted(t_free, m_free, np.arange(300))]
    one, other = (quality.co_train(t, m, y, a, rounds=2, most=40, confident=0.8) for a in (ask, quality.asked_of(rows.unionByName(rows))))
    assert one.exchanged == other.exchanged and min(one.exchanged[0]) > 0 and np.allclose(one.text, other.text) and np.allclose(one.stack, other.stack)


def test_the_surest_are_ranked_before_the_shuffle(spark):
    found = spark.createDataFrame([(v, k, c / 10, 10 * v + c) for v in (0, 1) for k in (0, 1) for c in range(6)], "view int, kind int, confidence double, rid bigint")
    best = quality.surest(found, (4, 2))
    assert sorted((r.view, r.kind, r.rid) for r in best.collect()) == [(v, k, 10 * v + c) for v in (0, 1) for k in (0, 1) for c in range(6 - (4, 2)[k], 6)]
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()


def test_borrowed_tables_go(spark):
    with borrowed(spark.range(5)) as t:
        path = urlparse(t.inputFiles()[0]).path
        assert t.count() == 5 and os.path.exists(path)
    assert not os.path.exists(os.path.dirname(path))


PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var a = "</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav><div class="cookie-notice"><p>We use cookies here.</p></div>
<article><h1>A  title &amp; more</h1><p>First <b>bold</b> paragraph&nbsp;of the text, which is long enough.<p>Second one,
with a line break.</article>
<div id="comments"><div class="comment"><p>What a nice post, thank you so much for it.</p></div></div><footer>&copy; someone</footer>"""


@pytest.fixture(scope="module")
def block_model():
    return html.fit_pages([PAGE] * 8, epochs=4, made=500)


@pytest.fixture(scope="module")
def usual_model():
    return html.fit_pages([PAGE] * 8)


def test_parse():
    blocks = html.parse(PAGE)
    assert [b.text for b in blocks][:2] == ["Home", "About us"] and blocks[0].links == 1.0
    assert "A title & more" in [b.text for b in blocks] and not any("var a" in b.text for b in blocks)
    second = next(b for b in blocks if b.text.startswith("Second"))
    assert second.text == "Second one, with a line break." and second.path.count("<p") == 1
    assert html.parse(None) == html.parse("") == [] and html.parse("a < b > c & d")[0].text
    assert html.parse("<p>open <b>never closed <i>x")[0].text == "open never closed x"
    assert html.parse("<script>never closed") == [] and html.parse("<!-- never closed") == []
    assert len(html.parse("<div>" * 3000 + "deep")) == 1


def test_main_text(spark, block_model):
    want = "A title & more First bold paragraph of the text, which is long enough. Second one, with a line break."
    pages = spark.createDataFrame([(1, PAGE, "t"), (1, PAGE, "t"), (2, None, "t"), (3, "", "t"), (4, "<html><body></body></html>", "t")], "page_id bigint, html string, text string")
    rows = html.extract(pages, block_model).orderBy("page_id").collect()
    assert [r.text for r in rows] == [want, want, "", "", ""] and rows[0].n_chars == len(want)
    assert html.extract(pages.limit(0), block_model).count() == 0


def test_labeller_on_new_layouts(block_model):
    rng = np.random.default_rng(11)
    made = [html.generated("some words of a made up page to be read".split(), rng) for _ in range(150)]
    right = np.concatenate([(p >= 0.5) == np.array(y, bool) for p, (_, y) in zip(block_model.label([html.vectors(b) for b, _ in made]), made, strict=True)])
    assert right.mean() > 0.95


def hand_labelled():
    """(page, main text) of layouts that no generated page has in this form."""
    line = lambda k, n=28: " ".join("a small boat crossed the wide lake before noon while two men watched it from an old stone pier and said nothing".split()[(k + i) % 21] for i in range(n)).capitalize() + "."
    a, b, c, d = (line(k, n) for k, n in ((0, 30), (4, 24), (9, 40), (13, 9)))
    yield f"<body><div class='site-header'><span>Daily Lake</span><div class='menu-main'><a href=/>Start</a><a href=/w>World</a></div></div><div class='story-body'><h1>Boat crosses lake</h1><div class='share-buttons'><a href=#>Tweet</a></div><p>{a}</p><h2>Later</h2><p>{b}</p><ol><li>first point</li><li>second point</li></ol></div><div class='footer-links'><a href=/i>Imprint</a></div></body>", f"Boat crosses lake {a} Later {b} first point second point"
    yield f"<body><ul id=nav><li><a href=/>Home</a><li><a href=/x>X</a></ul><div id=main><h2>Post</h2>{a}<br><br>{b}<br>{c}</div><div id=comments><h3>2 comments</h3><ol><li>{d}<li>{line(3)}</ol><form><textarea>x</textarea><input type=submit></form></div></body>", f"Post {a} {b} {c}"
    yield f"<body><main><section class='hero'><h1>Guide to lakes</h1></section><section class='content'><p>{a}</p><p>{c}</p><dl><dt>pier</dt><dd>{d}</dd></dl></section></main><aside><h3>Popular</h3><ul><li><a href=/1>{d}</a></li></ul></aside><footer><p>© 2011 {d}</p></footer></body>", f"Guide to lakes {a} {c} pier {d}"
    yield f"<body><div role=navigation><a href=/>Top</a></div><div role=main><p>{c}</p><p>{b}</p></div><div role=complementary><p>{a}</p></div><div role=contentinfo>{d}</div></body>", f"{c} {b}"
    yield f"<body><div class=wrapper><div class=ad-slot><p>{d}</p></div><div class=article__body><p>{a}</p><div class=ad-slot>{d}</div><p>{b}</p></div><div class='gdpr-consent'><p>{line(2, 18)}</p><button>OK</button></div></div></body>", f"{a} {b}"
    yield f"<body><article><h1>One</h1>" + "".join(f"<p>{line(k, 12)}</p>" for k in range(60)) + "</article><div class='related-list'><a href=/q>Another story of lakes</a></div></body>", "One " + " ".join(line(k, 12) for k in range(60))
    yield f"<body><article><h1>Two</h1><p>{d}</p></article><div class='replies'>" + "".join(f"<div class='reply-box'><b>ann</b> {line(k, 33)}</div>" for k in range(25)) + "</div></body>", f"Two {d}"
    yield f"<h3>Notes</h3><p>{a}<p>{b}<hr><p>{c}", f"Notes {a} {b} {c}"


def test_main_text_of_hand_labelled_pages(usual_model):
    """Word F1 over whole texts."""
    both = got_n = want_n = 0
    for page, want in hand_labelled():
        got, own = (Counter(t.split()) for t in (html.main_text(usual_model, [page])[0], want))
        both, got_n, want_n = both + (got & own).total(), got_n + got.total(), want_n + own.total()
    assert 2 * both / (got_n + want_n) > 0.9


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    model = html.BlockModel.fresh(3, rng)
    model.weights = [w.astype(np.float64) + 0.01 for w in model.weights]
    pages = [rng.normal(size=(n, html.DIM)).astype(np.float32) for n in (4, 2)]
    labels = [np.array([1, 0, 1, 1.0]), np.array([0, 1.0])]

    def loss():
        p, (_, _, mask, _, *_) = model.forward(pages)
        y = np.zeros_like(p)
        for j, own in enumerate(labels):
            y[: len(own), j] = own
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    grads = model.step(pages, labels)
    for k, at in ((0, (5, 2)), (1, (1, 4)), (2, (3,)), (3, (7, 9)), (4, (2, 2)), (6, (1,)), (7, (0,))):
        old, eps = model.weights[k][at], 1e-3
        model.weights[k][at] = old + eps
        up = loss()
        model.weights[k][at] = old - eps
        down = loss()
        model.weights[k][at] = old
        assert grads[k][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=2e-4)


def brute_distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, d in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (c != d)))
        prev = cur
    return min(prev)


def test_myers():
    rng = random.Random(2)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 70))) for _ in "xy")
        assert decontam.myers(p, t)[0] == brute_distance(p, t)
        d, a, b = decontam.located(p, t)
        assert brute_distance(p, t[a:b]) == d or d == len(p)
    assert decontam.pieces("abcdefg", 2) == [(0, "ab"), (2, "cde"), (5, "fg")]


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    item = lambda i: prose("en", 25, f"item{i}")
    items = [(i, item(i)) for i in range(12)] + [(90, None), (91, "short"), (12, item(3))]

    def edited(text, k):
        s = list(text)
        for _ in range(k):
            s[rng.randrange(len(s))] = rng.choice(["", "x", "yz"])
        return "".join(s)

    docs = [(i, prose("de", 30, i) + " " + edited(item(i % 12), i % 9).upper() + "\n\n" + prose("de", 10, i)) for i in range(60)]
    docs += [(104, "a SHORT one, short."), (105, "shorts and shorty ashort"), (106, "(short)"), (100, None), (101, ""), (102, prose("de", 5000, 8)), (103, f"{item(0)} und {item(0)}"), (103, f"{item(0)} und {item(0)}")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.distance, r.n_places) for r in decontam.find(d, b).collect())
    want = set()
    for i, t in docs:
        for j, x in items:
            if x:
                n = decontam.normal(x)
                low = decontam.normal(t or "")
                if len(n) < 20:  # only exactly, and on word borders
                    if re.search(rf"(?<!\w){re.escape(n)}(?!\w)", low):
                        want.add((i, j, 0))
                    continue
                dist = brute_distance(n, low)
                if dist <= int(len(n) * 0.05):
                    want.add((i, j, dist))
    assert {g[:3] for g in got} == want and len(want) > 30
    assert [g for g in got if g[0] == 103] == [(103, 0, 0, 2)] * 2
    assert decontam.mark(d, b).where("size(_leaks) > 0").select("doc_id").distinct().count() == len({w[0] for w in want})
    several = decontam.find(d, b, block_chars=300)
    assert sorted((r.doc_id, r.item_id, r.distance, r.n_places) for r in several.collect()) == got
    assert decontam.find(d.limit(0), b).count() == decontam.find(d, b.limit(0)).count() == 0


def test_short_items_and_items_of_other_ids(spark):
    docs = spark.createDataFrame([(1, "So: What is 2 +  2? Four."), (2, "what is 2 + 21")], "doc_id bigint, text string").withColumn("m", F.lit(0)).withColumn("_leaks", F.lit(0))
    long = prose("en", 20, "long")
    items = spark.createDataFrame([("a", "What is 2 + 2"), (None, "what is 2"), (None, long), ("c", " "), ("d", None)], "item_id string, text string")
    assert sorted((r.doc_id, str(r.item_id)) for r in decontam.find(docs, items).collect()) == [(1, "None"), (1, "a"), (2, "None")]
    marked = decontam.mark(docs, items)
    assert marked.columns == docs.columns and sorted(len(r["_leaks"]) for r in marked.collect()) == [1, 2]
    assert [str(r.item_id) for r in decontam.find(spark.createDataFrame([(1, f"x {long} y")], "doc_id bigint, text string"), items).collect()] == ["None"]


def test_letters_count_alike_in_either_case():
    model = toxicity.ToxicityModel(-2.0, {"nasty": 7.0})
    plain, other = toxicity.noisy_or(model, "You are nasty."), toxicity.noisy_or(model, "İ You are NASTY.")
    assert plain[0] == other[0] > 0.9 and other[1][0][:2] == (0, 16)


def test_language_has_one_rule_for_all_lengths(spark):
    docs = spark.createDataFrame([(i, prose(lang, 60, i), lang) for i in range(40) for lang in ("de", "en")], "doc_id bigint, text string, lang string")
    model = lid.fit(docs)
    text = prose("de", 2000, 5)
    assert all(lid.classify(model, text[:n])[0] == "de" and not lid.classify(model, text[:n])[3] for n in [*range(40, 400, 7), lid.BLOCK - 1, lid.BLOCK, lid.BLOCK + 1, len(text)])


def test_late_blocks_are_trained_on():
    """Blocks after the first window count: the comments of long pages are left out only if training saw them."""
    seen = []
    real, html.teacher = html.teacher, lambda b: seen.append(b.text) or 1
    try:
        html.fit_pages(["<p>" + "</p><p>".join(f"b{i}" for i in range(50)) + "</p>"], hidden=2, epochs=1, made=0, window=20)
    finally:
        html.teacher = real
    assert seen == [f"b{i}" for i in range(50)]


def test_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    slow = Tokenizer.from_file(path)
    encode = packing.encoder(path)
    texts = ["", " ", "Don't  stop 123 über\n\n naïve…", "ñandú ß ①② 中文 😀", "a" * 500, prose("de", 300, 1), "<|endoftext|> x", "a<|endoftext|>b <|endoftext|>", "\t\tx\r\n y "]
    assert encode("<|endoftext|> x")[0] == slow.token_to_id("<|endoftext|>")
    assert [encode(t) for t in texts] == [slow.encode(t, add_special_tokens=False).ids for t in texts]


def test_cut():
    import zlib

    ids = list(range(2500))
    got = packing.cut(ids, 1024)
    assert [g[:3] for g in got] == [(0, 0, 452), (1, 452, 1024), (2, 1476, 1024)]
    assert got[0][3] == zlib.crc32(np.array(ids[:452], "<u4").tobytes())
    assert [g[:3] for g in packing.cut([7], 4)] == [(0, 0, 1)] and [g[2] for g in packing.cut(list(range(8)), 4)] == [4, 4]


def test_a_rare_language_leaves_the_others_dictionaries_whole(spark):
    words = {"aa": "the house stands near river water and", "bb": "das haus steht neben dem fluss wasser und"}
    rows = []
    for k, v in words.items():
        for i in range(60):
            rng = random.Random(f"{k}{i}")
            rows.append((len(rows), " ".join(rng.choice(v.split()) for _ in range(60)), k))
    schema = "doc_id bigint, text string, lang string"
    usual = lid.fit(spark.createDataFrame(rows, schema))
    rare = lid.fit(spark.createDataFrame([*rows, (999, "qoro zvelti mip ukranto beshi dolla wemm", "zz")], schema))
    assert rare.langs == ("aa", "bb", "zz") and rare.dictionaries[:2] == usual.dictionaries and len(usual.dictionaries[0]) > 10_000
    assert all(lid.classify(rare, t)[0] == k and not lid.classify(rare, t)[3] for _, t, k in rows)
