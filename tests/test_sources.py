"""Keyed JSON lines and the graph as one object, against Python's json."""

import json
import random

import pytest

from lexspark.sources import graphjson as G
from lexspark.sources import jsonl


def test_the_last_line_of_a_key_wins(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for f in range(3):
        rows = [{"id": f"i{rng.randrange(300)}", "query": f"{f}.{i} " + "x" * rng.randrange(80)} for i in range(1500)]
        (tmp_path / f"{f}.jsonl").write_text("\n".join(json.dumps(r) if r["query"] else "" for r in rows) + "\n\n  \n")
        want |= {r["id"]: r["query"] for r in rows}
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")  # a file in several tasks
    try:
        got = jsonl.read_keyed(spark, "pairs", str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 6
        rows = got.collect()
        assert {r.id: r.query for r in rows} == want and len(rows) == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "a.jsonl").write_text('{"id": "a", "query": "1"}\nno json\n{"query": "2"}\n{"query": "3"}\n')
    assert sorted((r.id or "", r.query) for r in jsonl.read_keyed(spark, "pairs", str(tmp_path / "odd")).collect()) == [("", "3"), ("a", "1")]


def feed(text, step):
    at = 0

    def more(_):
        nonlocal at
        at += step
        return text[at - step : at]

    return more


@pytest.mark.parametrize("step", [1, 3, 1000])
@pytest.mark.parametrize("indent", [None, 1])
def test_members_of_a_stream(step, indent):
    graph = {"built_at": "x", "n": 12, "other": {"a": [1, {"b": "}"}]}, "nodes": {'k"\\ {': {"v": ["}", None, 1.5e3, True]}, "": {}, "제1조": {"m": {"a": "é😀"}}}, "precedents": {"p": {}}}
    for ascii in (True, False):
        text = json.dumps(graph, indent=indent, ensure_ascii=ascii)
        for section in ("nodes", "precedents"):
            assert {k: json.loads(v) for k, v in G.members(feed(text, step), section)} == graph[section]
    assert list(G.members(feed("{}", step), "nodes")) == []
    with pytest.raises(ValueError):
        list(G.members(feed('{"nodes": {"a": {', step), "nodes"))


def test_graph_round_trip(spark, tmp_path):
    value = "law string, label string, pending array<struct<kind: string>>, cues map<string, string>"
    rows = [(f"법#{i}" if i else 'odd "key" \\ \n', "법", None if i % 3 else "l", [("개정",)] * (i % 2), {"b": "plain", "a": "x"} if i % 4 == 0 else {}) for i in range(200)]
    nodes = spark.createDataFrame(rows, f"article_id string, {value}").repartition(4)
    cases = spark.createDataFrame([("p1", "t"), ("p2", None)], "id string, title string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        G.write(str(tmp_path / "g"), "2020-01-01", nodes, cases)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(p for p in (tmp_path / "g").iterdir() if p.name.startswith("part-"))
    whole = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 1 and whole["built_at"] == "2020-01-01" and whole["precedents"] == {"p1": {"title": "t"}, "p2": {"title": None}}
    assert {k: (v["law"], v["label"], [(p["kind"],) for p in v["pending"]], v["cues"]) for k, v in whole["nodes"].items()} == {k: tuple(v) for k, *v in rows}
    (tmp_path / "one.json").write_text(json.dumps(whole, ensure_ascii=False))
    for read, path in ((G.read, "g"), (G.read_object, "one.json")):
        got = read(spark, str(tmp_path / path), "nodes", value).collect()
        assert sorted(map(str, got)) == sorted(map(str, nodes.collect()))
        assert sorted((r.id, r.title) for r in read(spark, str(tmp_path / path), "precedents", "title string", "id").collect()) == [("p1", "t"), ("p2", None)]
    G.write(str(tmp_path / "none"), "x", nodes.limit(0), cases.limit(0))
    assert G.read(spark, str(tmp_path / "none"), "nodes", value).collect() == []
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*")))) == {"built_at": "x", "nodes": {}, "precedents": {}}
