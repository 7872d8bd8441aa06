"""Hand-computed cases of text, retrieval, citation, metric and statistic operators."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from lexspark import schemas
from lexspark.functions import external
from lexspark.functions import text as X
from lexspark.operators import citations, expand, metrics, retrieval, sampling, stats
from lexspark.plans import evaluate
from lexspark.sources import cache, jsonl, reports, rest


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(c.alias("x")).first().x


def test_bigrams(spark):
    assert one(spark, X.bigrams("t"), t="통상임금을 산정") == ["통상", "상임", "임금", "금을", "산정"]
    assert one(spark, X.bigrams("t"), t="법 , 및") == ["법", "및"]
    assert one(spark, X.bigrams("t"), t="①항") == ["①항"]
    assert one(spark, X.bigram_set("t"), t="a b a b") == ["ab", "ba"]


def test_text(spark):
    assert one(spark, X.strip("t"), t="　a b ") == "a b"
    assert one(spark, X.clean_markup("t"), t="가<br/>나\n \n\n다　라") == "가\n나\n다 라"
    assert one(spark, X.iso_date("t"), t="20270610") == "2027-06-10" and one(spark, X.iso_date("t"), t="2027.6") == "2027.6"
    assert one(spark, X.amendment_dates("t"), t="글 <개정 2021. 3. 5., 2020. 12. 1.> [신설 2021.3.5]") == ["2020-12-01", "2021-03-05"]
    assert one(spark, X.cue("t"), t="제5조에도 불구하고 준용한다") == "exception"
    assert one(spark, X.sentences("t"), t="정한다. 다만 없다. 끝") == ["정한다.", "다만 없다.", "끝"]
    assert one(spark, X.truncated("t", 6), t="간다. 본다. 온다.") == "간다. …(이하 생략)"
    assert one(spark, X.truncated("t", 60), t="간다.") == "간다."
    assert one(spark, X.json_object("t"), t='x {"a": {"b": 1}} y') == '{"a": {"b": 1}}' and one(spark, X.json_object("t"), t="none") is None
    assert one(spark, X.numbered("t"), t="43의2") == "제43조의2"
    assert one(spark, X.url_part("t"), t="a b/c가") == "a%20b/c%EA%B0%80"


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "통상임금 산정"), (2, "임금 지급 임금 지급 방법과 시기 그리고 예외"), (3, "휴일")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(0, "통상임금")], "query_id bigint, query string")
    got = {r.doc_id: r.score for r in retrieval.bm25(docs, asked).collect()}
    assert set(got) == {1, 2} and got[1] > got[2]


def ranking(spark, ids):
    return spark.createDataFrame([(0, d, i) for i, d in enumerate(ids, 1)], "query_id bigint, doc_id bigint, rank int")


def test_rrf(spark):
    fused = retrieval.rrf([(ranking(spark, [1, 2, 3]), 1.0), (ranking(spark, [3, 4, 5]), 1.0)])
    rows = fused.orderBy(F.desc("fused"), "doc_id").collect()
    assert [r.doc_id for r in rows] == [3, 1, 2, 4, 5]
    assert rows[0].fused == pytest.approx(1 / 63 + 1 / 61)


@settings(max_examples=5, deadline=None)
@given(st.permutations(range(6)))
def test_rrf_does_not_mind_order(spark, order):
    a, b = ranking(spark, list(order)), ranking(spark, list(range(6)))
    one_way = {r.doc_id: round(r.fused, 12) for r in retrieval.rrf([(a, 1.0), (b, 0.5)]).collect()}
    other = {r.doc_id: round(r.fused, 12) for r in retrieval.rrf([(b, 0.5), (a, 1.0)]).collect()}
    assert one_way == other


def test_dense_ties_and_tags(spark):
    e = spark.createDataFrame([(i, [1.0, 0.0] if i < 3 else [0.0, 1.0], i % 2) for i in range(6)], "vec_id bigint, embedding array<float>, label int")
    q = e.where("vec_id = 2").select(F.col("vec_id").alias("query_id"), "embedding", F.array("label").alias("tags"))
    assert [r.vec_id for r in retrieval.scored(e, q, 2).orderBy("rank").collect()] == [0, 1]
    assert [r.vec_id for r in retrieval.scored(e, q, 2, tag="label", never="tags").orderBy("rank").collect()] == [1, 3]
    assert [r.vec_id for r in retrieval.scored(e, q, 1, tag="label", only="tags").collect()] == [0]
    assert retrieval.scored(e, q.limit(0), 2).count() == 0


def test_linked_cases(spark):
    blocks = spark.createDataFrame([(1, 0, 1, ["x"], False), (1, 0, 2, ["y"], False), (1, 1, 1, ["z"], True)], "query_id bigint, stage int, pos int, article_ids array<string>, linked boolean")
    nodes = spark.createDataFrame([("x", ["A", "C"]), ("y", ["B", "D", "C"]), ("z", ["E"])], "article_id string, precedents array<string>")
    scores = spark.createDataFrame([(1, n, s) for n, s in zip("ABCDE", (0.6, 0.7, 0.8, 0.4, 0.99), strict=True)], "query_id bigint, id string, score double")
    rows = expand.linked_cases(blocks, nodes, scores).orderBy("rank").collect()
    assert [r.id for r in rows] == ["C", "B", "A", "D"] and rows[0].referenced == ["x", "y"]
    cases = spark.createDataFrame([(c, f"text {c}", "") for c in "ABCDE"], "id string, text string, holding string")
    kept = lambda tau, n: [b.article_ids[0] for b in expand.case_blocks(expand.linked_cases(blocks, nodes, scores), cases, tau, n).orderBy("pos").collect()]
    assert kept(0.54, 2) == ["C", "B"] and kept(0.75, 2) == ["C"]


def test_siblings(spark):
    chunks = spark.createDataFrame([("a1", ["a"], "h\n1", 1, 2), ("a2", ["a"], "h\n2", 2, 2), ("b", ["b"], "b", 1, 1)], "chunk_id string, article_ids array<string>, text string, part int, parts int")
    hits = spark.createDataFrame([(1, "b", 0.9, 1), (1, "a1", 0.8, 2)], "query_id bigint, chunk_id string, score double, rank int")
    rows = expand.hit_blocks(hits, chunks).unionByName(expand.sibling_blocks(hits, chunks)).orderBy("stage", "pos").collect()
    assert [r.chunk_id for r in rows] == ["b", "a1", "a2"] and [r.via for r in rows] == ["search", "search", "sibling"]


def test_links_share_one_cap(spark):
    blocks = spark.createDataFrame([(1, 0, 1, "c", ["x"], "t", 0.9, False, "search", [])], "query_id bigint, stage int, pos int, chunk_id string, article_ids array<string>, text string, score double, linked boolean, via string, referenced array<string>")
    nodes = spark.createDataFrame([("x", ["p"], ["k1", "k2", "k3"])], "article_id string, parent_provisions array<string>, implementing_provisions array<string>")
    texts = spark.createDataFrame([(a, a) for a in ("p", "k1", "k2", "k3")], "article_id string, text string")
    got = lambda k: [r.article_ids[0] for r in expand.link_blocks(blocks, nodes, texts, k).orderBy("pos").collect()]
    assert got(1) == ["p", "k1", "k2"] and got(5) == ["p", "k1", "k2", "k3"]  # fewer hits than top_k leave room


def test_finalized(spark):
    b = spark.createDataFrame([(q, "S1", "c", ["법#5"], "제목\n근로시간은 40시간이다.\n휴일", "search", "in_force", []) for q in (1, 2, 3)], "query_id bigint, source string, chunk_id string, article_ids array<string>, text string, via string, status string, status_notes array<string>")
    a = spark.createDataFrame([(1, " [정보 부족] 없음 [S1]"), (2, "40시간입니다. [S1] 그렇다. [S9]"), (3, "모른다 [S9]")], "query_id bigint, answer string")
    got = {r.query_id: r for r in citations.finalized(a, b).collect()}
    assert got[1].refusal_reason == "model_declined" and got[3].refusal_reason == "no_valid_citation"
    assert got[2].status == "answered" and [c.source for c in got[2].citations] == ["S1"]
    assert got[2].citations[0].quote == "근로시간은 40시간이다." and got[2].citations[0].article == "제5조"


def confusion(spark, tp, a_only, b_only, tn):
    rows = [(True, True)] * tp + [(True, False)] * a_only + [(False, True)] * b_only + [(False, False)] * tn
    return stats.confusion(spark.createDataFrame(rows, "a boolean, b boolean"), "a", "b")


def test_kappa(spark):
    assert stats.kappa(confusion(spark, 20, 5, 10, 15)).first().kappa == pytest.approx(0.4)
    assert stats.kappa(confusion(spark, 2, 0, 0, 0)).first().kappa is None
    r = confusion(spark, 1, 1, 1, 1).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall) == (1, 1, 1, 1, 0.5, 0.5)


def test_bootstrap(spark):
    rows = [(f"i{k:02}", float(k % 2), float((k % 3) == 0)) for k in range(30)]
    p = spark.createDataFrame(rows, "id string, a double, b double").withColumn("delta", F.col("b") - F.col("a")).withColumn("m", F.lit("x"))
    got = stats.seeded_bootstrap(p, ["m"], 200).first()
    rng, pairs, means = random.Random(0), [(a, b) for _, a, b in rows], []
    for _ in range(200):
        s = [pairs[rng.randrange(30)] for _ in pairs]
        means.append(sum(y for _, y in s) / 30 - sum(x for x, _ in s) / 30)
    means.sort()
    assert (got.n, got.lo, got.hi) == (30, pytest.approx(means[5]), pytest.approx(means[195]))
    chosen = stats.seeded_bootstrap(p, ["m"], 200, drawn="choice").first()
    assert chosen.lo < chosen.hi and stats.seeded_bootstrap(p.limit(3), ["m"], 50).first().lo is None
    h = stats.hash_bootstrap(p, 100).first()
    assert h.n == 30 and h.lo < h.hi


def test_verdict(spark):
    v = lambda d, noise, lo, hi, **k: one(spark, stats.verdict(*map(F.lit, (d, noise, lo, hi)), **k))
    assert v(0.1, 0.03, 0.02, 0.2) == "better" and v(-0.1, 0.03, -0.2, -0.02) == "worse"
    assert v(0.1, 0.03, -0.02, 0.2) == "insignificant" and v(0.02, 0.03, 0.01, 0.2) == "insignificant"
    assert v(0.1, 0.03, 0.02, 0.2, lower_is_better=True) == "worse"
    none = F.lit(None).cast("double")
    assert one(spark, stats.verdict(F.lit(0.1), F.lit(0.03), none, none)) == "better"
    assert one(spark, stats.verdict(F.lit(0.1), F.lit(0.03), none, none, needs_interval=True)) == "insignificant"


def test_item_scores(spark, tmp_path):
    gold = [
        {"id": "g1", "level": "L1", "expected_status": "answered", "gold_evidence": ["법#5"], "key_points": ["a", "b"]},
        {"id": "g2", "level": "OOS", "expected_status": "insufficient_context", "gold_evidence": [], "key_points": []},
        {"id": "g3", "level": "L2", "expected_status": "answered", "gold_evidence": ["법#5", "법#6"], "key_points": ["a"]},
    ]
    hit = lambda a, rank, linked=False: {"rank": rank, "chunk_id": a, "article_ids": [a], "score": 0.5, "linked": linked, "via": "search"}
    pred = [
        {"id": "g1", "status": "answered", "citations": [{"source": "S1", "article_ids": ["법#5"]}, {"source": "S2", "article_ids": ["법#9"]}], "retrieval": [hit("법#9", 1), hit("법#5", 2)], "meta": {"cost_krw": 1.5, "latency_ms": 10}},
        {"id": "g2", "status": "answered", "citations": [], "retrieval": [], "meta": {}},
        {"id": "g3", "status": "insufficient_context", "citations": [], "retrieval": [hit("법#5", 1), hit("법#6", 2, True)], "meta": {"refusal_reason": "model_declined"}},
    ]
    judged = [
        {"id": "g1", "grade": {"key_points": [{"index": 1, "key_point": "a", "asserted": True}, {"index": 2, "key_point": "gone", "asserted": False}], "temporal_error": False}, "grounding": {"claims": [], "n_claims": 4, "n_unsupported": 1}},
        {"id": "g2", "grade": {"key_points": [], "asserts_conclusion": False}},
    ]
    for name, rows in (("gold", gold), ("predictions", pred), ("judgments", judged)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    read = lambda k: jsonl.read(spark, k, str(tmp_path / f"{k}.jsonl"))
    s = evaluate.scores(read("gold"), read("predictions"), read("judgments")).cache()
    got = {r.id: r for r in s.collect()}
    a, b, c = got["g1"], got["g2"], got["g3"]
    assert (a.m1_recall_any, a.m1_recall_all, a.m1_rr, a.m3_citation_precision, a.m3_citation_recall) == (True, True, 0.5, 0.5, 1.0)
    assert (a.m4_kp_coverage, a.m4_complete, a.m5_unsupported_rate, a.m6_temporal_error, a.m0_correct) == (1.0, True, 0.25, False, True)  # a point that left the gold set doesn't count
    assert (b.m2_correct_status, b.refusal_mode, b.m0_correct, b.m1_rr) == (True, "hedged", True, None)
    assert (c.m1_recall_all, c.m1_with_links_any, c.m3_citation_precision, c.m3_citation_recall, c.m4_kp_coverage, c.m4_complete, c.m0_correct) == (False, True, None, 0.0, 0.0, False, False)
    r = {(x.scope, x.value): x for x in metrics.report(s).collect()}
    assert r["overall", None].n == 3 and r["overall", None].M0_accuracy == pytest.approx(2 / 3) and r["level", "L1"].M1_mrr == 0.5
    assert r["overall", None].latency_ms_p50 == 0 and r["overall", None].M3_citation_precision_n == 1
    assert [x.id for x in metrics.failing(s).orderBy("id").collect()] == ["g1", "g3"]
    text = reports.markdown(metrics.long_form(metrics.report(s)))
    assert "| M0_accuracy | 0.667 (3) |" in text
    runs = s.withColumn("run", F.lit("r1")).unionByName(s.withColumn("run", F.lit("r2")))
    floor = evaluate.noise(runs)
    assert {x.metric: x.range for x in floor.collect()}["M0_accuracy"] == 0.0
    assert evaluate.compared(runs, s, floor, 20).where("metric = 'M0_accuracy'").first().verdict == "insignificant"


def test_consensus(spark):
    rows = [("1", "a", True), ("1", "b", True), ("2", "a", True), ("2", "b", False), ("3", "a", None), ("3", "b", True)]
    got = {r.id: r.correct for r in stats.consensus(spark.createDataFrame(rows, "id string, judge string, met boolean"), ["id"], ["a", "b"]).collect()}
    assert got == {"1": True, "2": False, "3": False}


def test_upper_median(spark):
    assert spark.createDataFrame([("a", x) for x in (4, 1, 3, 2)], "g string, x int").transform(lambda d: metrics.upper_medians(d, ["g"], "x", "m")).first().m == 3


def test_upper_medians_of_large_and_odd_groups(spark, monkeypatch):
    """Many rows, skewed values, ties, nulls as values and as a group; also where the bracket is narrow."""
    rng = random.Random(3)
    rows = [("skew", int(rng.paretovariate(0.5))) for _ in range(20_001)] + [("ties", 7) for _ in range(9000)] + [(None, rng.choice([None, -1, 2])) for _ in range(7000)] + [("two", 1), ("two", 5), ("one", None)]
    df = spark.createDataFrame(rows, "g string, x bigint").repartition(7)
    want = {}
    for g, x in rows:
        want.setdefault(g, []).append(x or 0)
    want = {g: sorted(x)[len(x) // 2] for g, x in want.items()}
    for small in (metrics.SMALL, 1200, 10**9):
        monkeypatch.setattr(metrics, "SMALL", small)
        got = metrics.upper_medians(df, ["g"], "x", "m")
        assert {r.g: r.m for r in got.collect()} == want
    assert metrics.upper_medians(df.limit(0), ["g"], "x").collect() == []
    scores = entry_point.queries()["score_costs"](spark, "/root/testdata/sf0.001")
    assert "collect_list(coalesce(latency" not in scores._jdf.queryExecution().optimizedPlan().toString()


def test_calls_and_caches(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id bigint, prompt string")
    held = spark.createDataFrame([], "key string, response string")

    def factory():
        def call(p):
            if p == "b":
                raise ValueError("no")
            return p.upper()

        return call

    answers, fresh = external.cached_calls(jobs, held, factory)
    got = {r.id: (r.response, r.error) for r in answers.collect()}
    assert got[1] == ("A", None) and got[3][0] == "A" and got[2] == (None, "ValueError: no")
    cache.append(fresh, str(tmp_path / "c"))
    kept = spark.read.parquet(str(tmp_path / "c"))
    assert kept.count() == 1 and cache.remaining(jobs.withColumn("key", X.request_hash(F.col("prompt"))), kept, ["key"]).count() == 1
    with pytest.raises(external.BudgetError):
        external.cached_calls(jobs, held, factory, budget=0.5, price=1.0)


def test_rest(spark):
    data = [{"id": i} for i in range(250)]

    def transport(options):
        def get(endpoint, params):
            if params["query"] == "one":
                return 200, json.dumps({"R": {"law": {"id": "x"}}}).encode()
            a = (params["page"] - 1) * 100
            return 200, json.dumps({"R": {"law": data[a : a + 100]}}).encode()

        return get

    rest.register(spark, transport)
    df = spark.read.format("rest_search").option("queries", json.dumps(["many", "one"])).load()
    assert {r["query"]: r.n for r in df.groupBy("query").agg(F.count("*").alias("n")).collect()} == {"many": 250, "one": 1}
    calls = []

    def failing(endpoint, params):
        calls.append(1)
        return (500, b"") if len(calls) < 3 else (200, b"{}")

    assert rest.fetched(failing, "x", {}, wait=0) == b"{}" and len(calls) == 3
    with pytest.raises(rest.RestError):
        rest.fetched(lambda e, p: (200, rest.REJECTED.encode()), "x", {})


def test_search_results(spark):
    rows = spark.createDataFrame([("법", "m1", "현행", "2020", 0), ("법", "m1", "현행", "2020", 1), ("법", "m2", "시행예정", "2019", 2), ("법 시행령", "m3", "현행", "2020", 3), ("법", "m4", "폐지", "2018", 4)], "name string, mst string, status string, effective string, pos int")
    assert [r.mst for r in rest.versions(rows, "법").collect()] == ["m2", "m1"]
    with pytest.raises(Exception, match="in force"):
        rest.versions(rows.where("mst = 'm2'"), "법").collect()
    cases = spark.createDataFrame([("a", "대법원", "2021.01.02"), ("b", "대법원", "2022.01.02"), ("c", "고등법원", "2023.01.02"), ("d", "대법원", "2019.01.02")], "id string, court string, decided string")
    assert [r.id for r in rest.newest(cases, "대법원", "20200101").collect()] == ["b", "a"]
    found = spark.createDataFrame([("big", "x", "3"), ("big", "y", "2"), ("big", "z", "1"), ("small", "q", "0"), ("small", "x", "3")], "query string, id string, decided string")
    held = spark.createDataFrame([("y",)], "id string")
    assert [r.id for r in rest.bulk_order(found, held, 4).collect()] == ["x", "q", "z"]


def test_failing_service(spark):
    def factory():
        def call(p):
            raise OSError("down")

        return call

    jobs = spark.createDataFrame([(i, "p") for i in range(5)], "id bigint, prompt string").coalesce(1)
    got = [r.error for r in external.called(jobs, factory, ["id"], most_errors=2).collect()]
    assert got.count("OSError: down") == 2 and sum(e.startswith("not called") for e in got) == 3


def test_called_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def factory():
        def call(p):
            with open(log, "a") as f:
                f.write("x")
            return '{"a": 1}' if open(log).read().count("x") % 2 == 0 else '{"a": '  # cut short every other time

        return call

    jobs = spark.createDataFrame([(i, "p") for i in range(6)], "id bigint, prompt string").coalesce(1)
    got = external.called_once(jobs, factory, ["id"], tries=2, check=external.whole_json)
    assert [r.response for r in got.collect()] == ['{"a": 1}'] * 6 and got.where("error is null").count() == 6
    assert len(open(log).read()) == 12
    answers, fresh = external.cached_calls(jobs, spark.createDataFrame([], "key string, response string"), factory)
    assert answers.count() == 6 and fresh.count() == 1 and len(open(log).read()) == 13

    def down():
        def call(p):
            with open(log, "a") as f:
                f.write("y")
            raise OSError("down")

        return call

    many = spark.createDataFrame([(i, "p") for i in range(2000)], "id bigint, prompt string").repartition(8)
    errors = [r.error for r in external.called_once(many, down, ["id"], most_errors=3).collect()]
    assert len(errors) == 2000 and open(log).read().count("y") < 200 and errors.count(external.NOT_CALLED) > 1800
    with pytest.raises(external.BudgetError):
        external.called_once(many, lambda: str, ["id"], budget=100.0, price=1.0)


def test_judgments(spark):
    answers = spark.createDataFrame([(1, "answered", "The cap is 52 hours. It rained. [S1]", None), (2, "error", None, "down")], "id bigint, status string, answer string, error string")
    gold = spark.createDataFrame([(1, ["52 hours", "overtime"]), (2, ["x"])], "id bigint, key_points array<string>")
    contexts = spark.createDataFrame([(1, "Article 1. The cap is 52 hours."), (2, "")], "id bigint, context string")
    rows = {r.id: r for r in evaluate.judged(answers, gold, contexts).collect()}
    points = json.loads(rows[1].key_points_judgment.removeprefix("verdict: "))
    assert [k["asserted"] for k in points["key_points"]] == [True, False]
    assert [c["supported"] for c in json.loads(rows[1].grounding_judgment)["claims"]] == [True, False]
    assert rows[2].key_points_judgment is None and rows[2].error == "down" and rows[2].grounding_error is None


def test_bm25_counts_without_cutting(spark):
    docs = spark.createDataFrame([(1, "aaa aa a b"), (2, "Straße a_b aaaa"), (3, ""), (4, None), (5, "한국 국한 a. x+y")], "doc_id bigint, text string")
    few = spark.createDataFrame([(0, "aa a ab 한국 +"), (1, "b Stra")], "query_id bigint, query string")
    got = sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in retrieval.bm25(docs, few).collect())
    old, retrieval.FEW_BIGRAMS = retrieval.FEW_BIGRAMS, 0
    try:
        want = sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in retrieval.bm25(docs, few).collect())
    finally:
        retrieval.FEW_BIGRAMS = old
    assert got == want and len(got) > 4


def test_reports(spark):
    assert list(reports.events(iter("ab"), {"status": "x"}, refused=True)) == ['event: final\ndata: {"status": "x"}\n\n']
    assert len(list(reports.events(iter("ab"), {}))) == 3
    df = spark.createDataFrame([(1, "</script>")], "id int, t string").agg(reports.payload("id", "t").alias("x"))
    assert reports.page("<s>/*DATA*/</s>", df.first().x) == '<s>[{"id":1,"t":"<\\/script>"}]</s>'


def test_samples(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    assert sampling.stratified(df, "g", "id", 5).groupBy("g").count().where("count = 5").count() == 3
    assert 150 < sampling.fraction(df, "id", 0.2).count() < 250
    assert sampling.one_of_each(df, "g", "id").count() == 3
    pairs = spark.createDataFrame([("p", "q", ["a", "b"])], "id string, query string, positives array<string>")
    neg = spark.createDataFrame([("p", "n")], "id string, negative string")
    assert sampling.training_rows(pairs, neg).count() == 2


def test_judges(spark):
    prompt = json.dumps({"answer": "하루 8시간", "key_points": ["8 시간", "10시간"]}, ensure_ascii=False)
    raw = external.literal_judge()(prompt)
    kp = spark.createDataFrame([(raw,)], "t string").select(F.from_json(X.json_object("t"), "key_points array<struct<index:int, asserted:boolean>>")["key_points"].alias("k"))
    m = F.map_from_entries(F.transform("k", lambda x: F.struct(x["index"], x["asserted"])))
    assert kp.select(X.aligned(m, F.lit(3)).alias("x")).first().x == [True, False, False]
