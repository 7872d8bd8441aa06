"""Item reports, blind cards, tags and temporal texts on hand-made cases."""


from lexspark.functions import text as X
from lexspark.plans import review

ITEM = "id string, as_of string, gold_evidence array<string>, key_point_literals array<array<string>>"
NODE = "article_id string, in_current boolean, pending array<struct<kind: string, effective: string, promulgated: string, changed_paragraphs: array<string>, new_text: string>>, sunsets array<struct<paragraphs: array<string>, until: string, partial: boolean, source: string, clause: string>>, implementing_provisions array<string>, referenced_by_cues map<string, string>"
NODES = [
    ("가법#1", True, [], [], ["가법 시행령#3"], {"가법#2": "exception"}),
    ("가법#2", True, [("개정", "2027-01-01", "2026-06-01", ["② 바뀐다"], None)], [], [], {"가법#1": "plain"}),
    ("가법#5", True, [], [([], "2024-12-31", False, "부칙", "clause")], [], {}),
    ("가법 시행령#3", True, [], [], [], {}),
    ("나법#9", False, [], [], [], {}),
]


def tags(spark, evidence, literals=(), as_of="2026-10-01", texts=(), chunks=()):
    items = spark.createDataFrame([("q", as_of, evidence, [list(x) for x in literals]), ("none", as_of, [], None)], ITEM)
    got = review.item_tags(items, spark.createDataFrame(NODES, NODE), spark.createDataFrame(list(chunks), "article_ids array<string>, chunk_id string, text string"), spark.createDataFrame(list(texts), "article_id string, text string"))
    rows = {r.id: r.tags for r in got.collect()}
    assert rows["none"] == []
    return rows["q"]


def test_tags(spark):
    assert tags(spark, ["가법#1"]) == []
    assert tags(spark, ["가법#1", "가법#2"]) == ["exception", "temporal"]
    assert tags(spark, ["가법#2"], as_of="2027-02-01") == []
    assert tags(spark, ["가법#1", "가법 시행령#3"]) == ["delegation"]
    assert tags(spark, ["가법#5", "판례#2020다1"]) == ["temporal", "precedent"]
    assert tags(spark, ["나법#9", "없는법#1"]) == ["temporal"]
    law = ("나법#4", "「가법」 제1조에도 불구하고 다음에 따른다.")
    assert tags(spark, ["가법#1", "나법#4"], texts=[law]) == ["exception"]
    assert tags(spark, ["가법#1", "나법#4"], texts=[("나법#4", "「가법」 제1조의2에도 불구하고")]) == []
    assert tags(spark, ["가법#1", "나법#4"], texts=[("나법#4", "「가법」 제1조를 「다법」에도 불구하고")]) == []
    parts = [(["가법#1"], "c1", "첫 내용"), (["가법#1"], "c2", "둘 내용"), (["가법#1"], "c3", "셋")]
    assert tags(spark, ["가법#1"], [("첫  내용", "x"), ("둘",)], chunks=parts) == ["split"]
    assert tags(spark, ["가법#1"], [("첫 내용",)], chunks=parts) == []


def test_item_report(spark):
    gold = spark.createDataFrame([("q", "L1", "?", ["b", "a", "c", "d"])], "id string, level string, question string, gold_evidence array<string>")
    hits = [(1, ["a", "x"], False), (2, ["b"], True), (3, ["a"], True)]
    p = spark.createDataFrame([("q", "answered", hits)], "id string, status string, retrieval array<struct<rank: int, article_ids: array<string>, linked: boolean>>")
    s = spark.createDataFrame([("q", "dev", True)], "id string, split string, m0_correct boolean")
    runs = spark.createDataFrame([("r2", "q", False), ("r1", "q", True), ("r3", "q", None)], "run string, id string, m0_correct boolean")
    r = review.item_report(gold, p, s, runs).first()
    assert (r.gold, r.found_search, r.found_link, r.missing) == (["a", "b", "c", "d"], ["a"], ["b"], ["c", "d"])
    assert [tuple(x) for x in r.retrieved] == [(1, "a, x", True), (2, "b", True), (3, "a", True)] and r.stability == [True, False, None] and r.split == "dev"


def test_blind_cards(spark):
    rows = [("r1", "q", 1, True, True), ("r2", "q", 1, False, False), ("r1", "q", 2, True, False), ("r2", "q", 2, True, True), ("r1", "q", 3, True, None), ("r2", "q", 3, True, True)]
    got = {r.point: (r.run, r.verdict) for r in review.blind_cards(spark.createDataFrame(rows, "run string, id string, point int, a boolean, b boolean"), ["a", "b"]).collect()}
    assert set(got) == {1, 3} and got[3] == ("r2", True) and got[1] in {("r1", True), ("r2", False)}


def test_temporal_text(spark):
    rows = {r.article_id: r.t for r in spark.createDataFrame(NODES, NODE).select("article_id", review.temporal_text().alias("t")).collect()}
    assert rows["가법#1"] == "" and rows["가법#2"] == "② 바뀐다\n\n2027-01-01\n2026-06-01" and rows["가법#5"] == "clause\n2024-12-31"


def test_short_laws(spark):
    names = ["근로자퇴직급여 보장법#3", "파견근로자 보호 등에 관한 법률 시행령#1의2", "최저임금법 시행규칙", "모르는 법#1"]
    assert [r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select(X.short_law("n").alias("s")).collect()] == ["퇴직급여법", "파견법 시행령", "최저임금법 시행규칙", None]


def test_tags_over_a_node_that_all_refer_to(spark):
    """The node's many edges are met as rows; none of its items gets the whole map."""
    n = 300
    hub = ("가법#0", True, [], [], [f"가법#{i}" for i in range(2, n, 3)], {f"가법#{i}": "exception" if i % 2 else "plain" for i in range(1, n)})
    items = spark.createDataFrame([(str(i), "2026-10-01", ["가법#0", f"가법#{i}", None], None) for i in range(1, n)], ITEM)
    none = spark.createDataFrame([], "article_ids array<string>, chunk_id string, text string"), spark.createDataFrame([], "article_id string, text string")
    got = review.item_tags(items, spark.createDataFrame([hub], NODE), *none)
    assert {r.id: r.tags for r in got.collect()} == {str(i): ["exception"] * (i % 2) + ["delegation"] * (i % 3 == 2) for i in range(1, n)}
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "gold_evidence" in x]
    assert joins and not any("referenced_by_cues" in x or "implementing_provisions" in x for x in joins)
