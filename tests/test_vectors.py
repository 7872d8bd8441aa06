"""The vector index against a plain loop: exact results, recall, what is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.sources import vectors as V

DIM = 8


def clustered(n, seed=3):
    """Unit vectors round a few directions, a third of them copies of one."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, DIM))
    x = centres[rng.integers(0, 12, n)] + 0.2 * rng.normal(size=(n, DIM))
    x[: n // 3] = x[0]
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(float).tolist()


def brute(rows, queries, k):
    x, ids = np.array([v for _, v in rows if v is not None]), [i for i, v in rows if v is not None]
    out = {}
    for q, v in queries:
        s = x @ np.array(v)
        out[q] = [(ids[j], round(float(s[j]), 9)) for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:k]]
    return out


def listed(hits, id="vec_id"):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r[id], round(r.score, 9)))
    return out


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [*enumerate(clustered(600)), (900, None)]
    path = str(tmp_path_factory.mktemp("index"))
    df = spark.createDataFrame([(i, v, f"text {i}") for i, v in rows], "vec_id bigint, embedding array<float>, text string")
    V.write(df, path, "whole", "hash", "query: ", sample=200)
    return rows, V.read(spark, path, "whole"), path


def test_exact_search(spark, index, monkeypatch):
    rows, ix, _ = index
    assert ix.rows.count() == len(rows) and ix.counts.sum() == 600 and (ix.model, ix.query_prefix) == ("hash", "query: ")
    asked = [(i, v) for i, v in rows if v is not None and i % 7 == 0] + [(5000, [-x for x in rows[0][1]])]
    q = spark.createDataFrame([*asked, (5001, None)], "query_id bigint, embedding array<double>")
    want = brute(rows, asked, 5)
    assert listed(V.search(ix, q, 5, 1, exact=True)) == want
    assert listed(V.search(ix, q, 5, ix.cells)) == want
    monkeypatch.setattr(V, "GROUP_VECTORS", 50)  # a cell over many groups, on both sides
    monkeypatch.setattr(V, "GROUP_QUERIES", 9)
    assert listed(V.search(ix, q, 5, 1, exact=True, few=3)) == want
    few = {k: set(x) for k, x in listed(V.search(ix, q, 5, 2)).items()}
    assert {k: set(x) for k, x in listed(V.search(ix, q, 5, 2, few=3)).items()} == few
    assert sum(len(few[k] & set(x)) for k, x in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_cells_prune_what_is_read(spark, index):
    rows, ix, _ = index
    q = spark.createDataFrame([(1, rows[-2][1])], "query_id bigint, embedding array<double>")
    plan = V.search(ix, q, 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_measured_probes_reach_the_target(spark, index):
    rows, ix, _ = index
    n = V.probes_for(ix, 5, 0.95, sample=100)
    assert 1 <= n <= ix.cells
    q = spark.createDataFrame([(i, v) for i, v in rows[1:600:3]], "query_id bigint, embedding array<double>")
    got = V.recall(V.search(ix, q, 5, n), V.search(ix, q, 5, ix.cells)).agg(F.avg("recall")).head()[0]
    assert got >= 0.85


def test_a_hot_cell_is_several_files(spark, tmp_path):
    """Half of the rows are one vector; no single task need write them."""
    one = spark.range(4000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 2 == 0, F.array(*[F.lit(0.5)] * 4)).otherwise(F.array(*[F.rand(1) for _ in range(4)])).alias("embedding"))
    V.write(one, str(tmp_path), "hot", "m", cells=4)
    ix = V.read(spark, str(tmp_path), "hot")
    assert ix.counts.sum() == 4000 and ix.counts.max() >= 2000
    hit = V.search(ix, spark.createDataFrame([(1, [0.5] * 4)], "query_id bigint, embedding array<double>"), 3, 1, exact=True)
    assert hit.count() == 3


def test_text_ids_replacing_and_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    rows = [(f"c{i:03}", v) for i, v in enumerate(clustered(90, 4))]
    V.write(spark.createDataFrame(rows[:40], "chunk_id string, v array<double>"), path, "a", "m", id="chunk_id", vector="v")
    V.write(spark.createDataFrame(rows, "chunk_id string, v array<double>"), path, "a", "m2", id="chunk_id", vector="v", cells=3)
    ix = V.read(spark, path, "a")
    assert ix.model == "m2" and ix.cells == 3 and ix.rows.count() == 90
    q = spark.createDataFrame([("q", rows[80][1]), ("r", rows[1][1])], "query_id string, embedding array<double>")
    want = brute(rows, [("q", rows[80][1]), ("r", rows[1][1])], 4)
    for few in (10, 1):
        assert listed(V.search(ix, q, 4, 1, exact=True, few=few), "chunk_id") == want
    V.write(spark.createDataFrame([], "chunk_id string, v array<double>"), path, "none", "m", id="chunk_id", vector="v")
    assert V.search(V.read(spark, path, "none"), q, 4, 1).collect() == []
    assert V.search(ix, q.limit(0), 4, 1, exact=True).collect() == []


def test_cells_are_means():
    x = np.array([[0.0, 0], [0, 1], [10, 0], [10, 1], [5, 5]])
    c = V.fit_cells(x, 3)
    at, far = V.nearest_cells(x, c)
    assert len({*at.tolist()}) == 3 and far.max() <= 0.51
    assert V.fit_cells(np.empty((0, 0)), 4).shape == (0, 0) and len(V.fit_cells(x, 9)) == 5


def test_a_group_of_copies_gives_each_query_k_rows_by_id():
    x = np.repeat(np.eye(4), 2000, axis=0)
    ids = np.arange(8000)[::-1].copy()
    q, known = np.eye(4)[[0, 3] * 300] + 0.0, np.arange(600)
    who, found, score = V._best(q, known, x, ids, 3)
    assert len(who) == 1800 and (score == 1).all()
    assert found.reshape(600, 3)[:2].tolist() == [[6000, 6001, 6002], [0, 1, 2]]
    assert all((b - a) * 8000 <= V.SLICE_SCORES for a, b in V._parts(600, 8000))
