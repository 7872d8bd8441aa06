"""Each query against its SQL on the smallest tables, and the shape of some plans."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from lexspark import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = entry_point.queries()[name](spark, DIR)
    r = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    assert rows([tuple(x) for x in df.collect()], df.columns) == rows(r.fetchall(), names)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    q = entry_point.queries()
    assert "WindowGroupLimit" in plan(q["topk_per_group"](spark, DIR))
    assert "NestedLoop" not in plan(q["interval_overlap_join"](spark, DIR))
    assert "NestedLoop" not in plan(q["leakage_guard"](spark, DIR))
    p = plan(q["metrics_grouping_sets"](spark, DIR))
    assert p.count("Expand") == 1
    assert "ReadSchema: struct<lang:string>" in plan(spark.read.parquet(f"{DIR}/documents.parquet").select("lang"))


def test_tables_that_grow_are_not_broadcast(spark):
    """Of the graph and its items, only the fifty cases go out through the driver."""
    q = entry_point.queries()
    sent = lambda name: plan(q[name](spark, DIR)).count("BroadcastExchange")
    assert {name: sent(name) for name in ("item_tags", "temporal_facts", "graph_nodes", "graph_node_stats")} == {"item_tags": 0, "temporal_facts": 0, "graph_nodes": 1, "graph_node_stats": 1}
