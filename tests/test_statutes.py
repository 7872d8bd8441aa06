import datetime

import pytest
from fixture_statutes import CASES, act, manifest, unit

from lexspark import schemas
from lexspark.functions import statute as S
from lexspark.operators import chunking, graph
from lexspark.plans import answer, ingest
from lexspark.sources import xml
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = [(*m, c) for m, c in manifest()]
    statutes = spark.createDataFrame(rows, schemas.MANIFEST + ", content string")
    files = spark.createDataFrame(CASES, "path string, content string")
    path = str(tmp_path_factory.mktemp("corpus"))
    ingest.save(ingest.corpus(statutes, files), path)
    return ingest.load(spark, path)


@pytest.fixture(scope="module")
def nodes(corpus):
    return {r.article_id: r for r in corpus.nodes.collect()}


def test_articles_and_chapters(corpus):
    rows = {r.article_id: r for r in corpus.current.collect()}
    assert set(rows) == {"근로법#1", "근로법#5", "근로법#6", "근로법#7", "근로법#7의2", "근로법 시행령#3"}
    assert rows["근로법#1"].chapter == "제1장 총칙" and rows["근로법#5"].chapter == "제2장 시간"
    assert rows["근로법#1"].paragraphs[0].text == "이 법은 근로를 정한다."
    assert rows["근로법#5"].amended == ["2021-03-05"]
    assert rows["근로법#7의2"].label == "제7조의2(대체휴일)"
    assert rows["근로법#6"].text == "근로법 제6조(특례)\n다음 업종에는 제5조와 제7조를 적용하지 아니한다.\n  1. 육상운송\n  2. 보건업"
    assert rows["근로법 시행령#3"].level == "시행령"


def test_pending_follows_the_chain(nodes):
    five, six, nine = nodes["근로법#5"], nodes["근로법#6"], nodes["근로법#9"]
    assert [(p.kind, p.effective) for p in five.pending] == [("modified", "2027-06-10")]
    assert five.pending[0].changed_paragraphs == ["1주 간의 근로시간은 36시간을 초과할 수 없다."]
    assert [(p.kind, p.effective) for p in six.pending] == [("modified", "2027-06-10"), ("deleted", "2028-01-01")]
    assert six.pending[0].changed_detail[0].endswith("\n(신설·개정) 3. 해운업")
    assert not nine.in_current and [(p.kind, p.effective) for p in nine.pending] == [("added", "2028-07-01")]
    assert nodes["근로법#1"].pending == []


def test_expiry_and_status(spark, corpus, nodes):
    s = nodes["근로법#5"].sunsets
    assert [(x.paragraphs, x.until, x.partial, x.source) for x in s] == [(["③"], "2024-12-31", False, "부칙(2022-01-01)")]
    at = lambda day: {r.article_id: r.s for r in corpus.nodes.select("article_id", graph.status_at(F.lit(day)).alias("s")).collect()}
    assert at("2024-12-31")["근로법#5"].status == "amendment_pending"
    assert at("2025-01-01")["근로법#5"].status == "partially_expired"
    assert at("2026-10-01")["근로법#6"].status == "amendment_pending"
    assert at("2028-01-01")["근로법#6"].status == "in_force"
    assert at("2030-01-01")["근로법#9"].status == "pending"


def test_edges(nodes):
    assert nodes["근로법 시행령#3"].parent_provisions == ["근로법#5", "근로법#7의2"]
    assert nodes["근로법#5"].implementing_provisions == ["근로법 시행령#3"]
    assert nodes["근로법#6"].reference_cues == {"근로법#5": "exception", "근로법#7": "exception"}
    assert nodes["근로법#7의2"].reference_cues == {"근로법#5": "mutatis", "근로법#6": "mutatis", "근로법#7": "mutatis"}
    assert nodes["근로법#5"].referenced_by_cues == {"근로법#6": "exception", "근로법#7의2": "mutatis"}
    assert nodes["근로법#5"].precedents == ["판례#2020다1"]
    assert nodes["근로법#6"].precedents == ["판례#2021다3"]


def test_cases(corpus):
    rows = {r.id: r for r in corpus.cases.collect()}
    assert set(rows) == {"판례#2020다1", "판례#2021다3"}  # the first file of a case stays
    assert rows["판례#2021다3"].holding == "이유 살펴본다." and rows["판례#2021다3"].holding_from_reasons
    assert rows["판례#2020다1"].decided == "2021-03-04"
    assert rows["판례#2020다1"].text.startswith("[판례] 대법원 2021-03-04 선고 2020다1, 2020다2 판결 (임금)\n[판시사항]\n")


@pytest.mark.parametrize(
    ("said", "keys"),
    [
        ("제55조부터 제57조까지의 규정을 따른다", ["55", "56", "57"]),
        ("「민법」 제3조 및 제5조와 제9조", []),
        ("이 법 제3조 및 제5조의2", ["3", "5의2"]),
        ("제7조, 제9조제1항 또는 법 제3조", ["7", "9"]),
        ("제1조부터 제20조까지", ["1", "20"]),
        ("같은 법 제3조에 따라 제4조를", ["4"]),
        ("사업주는 제3조제1항 단서 및 제4조 각 호 외의 부분에 따라", ["3", "4"]),
        ("이 영 제2조와 「상법」(이하 \"상법\"이라 한다) 제9조, 제10조", ["2"]),
        ("그 방법 제3조, 이 규칙 제4조(정의)부터 제6조까지", ["4", "5", "6"]),
        ("제1조의2부터 제3조까지", ["1의2", "3"]),
        ("시행령 제1조 또는 제2조에서 제3조", ["3"]),
        ("", []),
    ],
)
def test_own_references(said, keys):
    assert S.own_references(said) == keys


@pytest.mark.parametrize(
    ("refs", "found"),
    [
        ("[1] 근로기준법 제23조, 제24조 [2] 민법 제2조", [("근로기준법", "23"), ("근로기준법", "24")]),
        ("근로기준법 제23조, 민법 제2조", [("근로기준법", "23"), ("민법", "2")]),
        ("구 근로기준법(2007. 4. 11. 법률 제8372호로 전부 개정되기 전의 것) 제30조", []),
        ("구 근로기준법(2010. 1. 1. 개정되기 전의 것) 제30조", [("근로기준법", "30")]),
        ("남녀고용평등과 일ㆍ가정 양립 지원에 관한 법률 제19조의2", [("남녀고용평등과일ㆍ가정양립지원에관한법률", "19의2")]),
        ("남녀고용평등과 일·가정 양립 지원에 관한 법률 제19조", [("남녀고용평등과일ㆍ가정양립지원에관한법률", "19")]),
        ("근로기준법(이하 '법'(약칭)이라 한다) 제5조", [("근로기준법", "5")]),
        ("민법 제2조, 구 상법(2000. 1. 1. 전문 개정 전의 것) 제3조, 제4조 / 형법 제5조, 제6조의2 제1항", [("민법", "2"), ("형법", "5"), ("형법", "6의2")]),
        ("제3조, 구민법 제4조", [("민법", "4")]),
        ("", []),
    ],
)
def test_case_references(refs, found):
    assert [f for f in S.case_references(refs) if f in found or not refs.startswith("[1]")] == found


def test_changed_places():
    assert S.changed_places(["a", "b", "c"], ["a", "x", "c", "d"]) == [1, 3]
    assert S.changed_places([], []) == []


def test_chunks(spark, corpus):
    whole = chunking.article_chunks(corpus.current, 1 << 30).collect()
    assert len(whole) == 6 and all(c.parts == 1 for c in whole)
    cut = [c for c in chunking.article_chunks(corpus.current, 14).collect() if c.article_ids == ["근로법#5"]]
    assert len(cut) > 1 and sorted(c.part for c in cut) == list(range(1, len(cut) + 1))
    assert all(c.text.startswith("[근로법 > 제2장 시간 > 제5조(근로시간)]\n") for c in cut)
    fixed = chunking.fixed_chunks(corpus.current, 12, 4).where("law = '근로법'").orderBy("start").collect()
    assert fixed[0].article_ids[0] == "근로법#1" and all(len(c.text.split()) <= 12 for c in fixed)
    assert {a for c in fixed for a in c.article_ids} == {"근로법#1", "근로법#5", "근로법#6", "근로법#7", "근로법#7의2"}


def test_answers(spark, corpus, tmp_path):
    ingest.indexed(corpus).write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    questions = spark.createDataFrame([(1, "1주 간의 근로시간은 몇 시간을 초과할 수 없나", "2026-10-01"), (2, "zzz qqq", "2026-10-01")], "query_id bigint, question string, as_of string")
    o = answer.Options(top_k=2, tau=0.3, case_tau=-1.0, reverse=True)
    blocks = answer.blocks(questions, chunks, corpus, o, ingest.case_index(corpus)).cache()
    one = blocks.where("query_id = 1").orderBy("n").collect()
    assert one[0].article_ids == ["근로법#5"] and one[0].status == "partially_expired" and one[0].source == "S1"
    assert {b.via for b in one} >= {"search", "link", "precedent"}
    assert [b.n for b in one] == list(range(1, len(one) + 1))
    assert all(b.status == "not_applicable" for b in one if b.via == "precedent")
    got = {r.query_id: r for r in answer.answered(questions, blocks, o, corpus.cases).collect()}
    assert got[1].status == "answered" and got[1].citations[0].source == "S1"
    assert got[1].citations[0].url == "https://www.law.go.kr/법령/%EA%B7%BC%EB%A1%9C%EB%B2%95/제5조"
    assert got[2].refusal_reason == "retrieval_below_tau"
    for other in (answer.Options(top_k=2, hybrid=True), answer.Options(top_k=2, rerank=True)):
        hits = answer.search(questions, chunks, other).where("query_id = 1").orderBy("rank").collect()
        assert hits[0].chunk_id == "art:근로법#5" and len(hits) == 2
    assert datetime.date.today()


def test_models_are_called_once(spark, corpus, tmp_path):
    """Five questions make five calls, the citations are those of the answers returned, and a batch of no questions works."""
    log = str(tmp_path / "calls")

    def counting():
        def call(prompt):
            with open(log, "a") as f:
                f.write("x")
            with open(log) as f:
                n = len(f.read())
            if "질문 3" in prompt:
                raise OSError("down")
            return f"답 {n}입니다. [S1]"

        return call

    questions = spark.createDataFrame([(i, f"질문 {i} 1주 간의 근로시간", "2026-10-01" if i % 2 else "2020-01-01") for i in range(5)], "query_id bigint, question string, as_of string")
    chunks = ingest.indexed(corpus)
    o = answer.Options(top_k=2, tau=-2.0, generator=counting, links=False)
    blocks = answer.blocks(questions, chunks, corpus, o).cache()
    got = answer.answered(questions, blocks, o, corpus.cases)
    rows = got.collect()
    assert sorted(map(str, rows)) == sorted(map(str, got.collect())) and len(open(log).read()) == 5
    assert [(r.status, r.refusal_reason) for r in rows if r.query_id == 3] == [("error", "OSError: down")]
    assert all(r.citations[0].source == "S1" for r in rows if r.query_id != 3) and len({r.answer for r in rows if r.query_id != 3}) > 1
    none = questions.limit(0)
    assert answer.answered(none, answer.blocks(none, chunks, corpus, o), o, corpus.cases).count() == 0
    days = {r.query_id: {b.status for b in blocks.where(F.col("query_id") == r.query_id).collect()} for r in questions.collect()}
    assert days[0] != days[1]


def test_files(spark, corpus, tmp_path):
    for m, c in manifest():
        p = tmp_path / m[7]
        p.parent.mkdir(exist_ok=True)
        p.write_text(c, encoding="utf-8")
    (tmp_path / "cases").mkdir()
    for name, c in CASES:
        (tmp_path / "cases" / name).write_text(c, encoding="utf-8")
    man = spark.createDataFrame([m for m, _ in manifest()], schemas.MANIFEST)
    got = ingest.read_corpus(spark, man, str(tmp_path), str(tmp_path / "cases"))
    assert got.current.count() == 6 and got.cases.count() == 2 and got.pending.count() == corpus.pending.count()
    assert xml.documents(spark, man.limit(0), str(tmp_path)).count() == 0


def test_filters_keep_files_from_being_opened(spark, tmp_path):
    man = manifest()
    for row, content in man:
        if row[3] == "현행":
            (tmp_path / row[7]).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / row[7]).write_text(content)
    docs = xml.documents(spark, spark.createDataFrame([r for r, _ in man], schemas.MANIFEST), str(tmp_path))
    live = docs.where("status = '현행' and effective <= '20200101'")  # after the read, and still before it in the plan
    assert sorted(r.content for r in live.collect()) == sorted(c for r, c in man if r[3] == "현행")
    assert docs.where("status <> '현행'").select("name").count() == 2  # content unread, files absent
    with pytest.raises(Exception, match="No such file|Failed to open|not found"):
        docs.where("status <> '현행'").collect()
    assert xml.articles(live).count() > 0


def test_headings_stay_in_their_document(spark):
    """Two documents that are equal but for their content, as rows of a table without keys."""
    one = act([unit(1, head="제1장", heading=True), unit(1, "a"), unit(2, "b")])
    two = act([unit(1, "c"), unit(9, head="제9장", heading=True), unit(2, "d")])
    rows = xml.articles(spark.createDataFrame([("법", one), ("법", two)], "name string, content string")).collect()
    assert {r.title: r.chapter for r in rows} == {"a": "제1장", "b": "제1장", "c": "", "d": "제9장"}
