"""Dense search by slices: bounded scores at a time, and the same rows as a plain loop."""

import numpy as np
import pyarrow as pa
import pytest

from lexspark.operators import retrieval as R


def test_slices_hold_bounded_scores():
    b = pa.record_batch([pa.array(range(10_000))], names=["id"])
    for queries in (1, 700, R.QUERY_BLOCK, 10 * R.SLICE_SCORES):
        parts = [(a, p.num_rows) for a, p in R._slices(b.slice(0, 3000), queries)]
        assert sum(n for _, n in parts) == 3000 and [a for a, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)])[:-1])
        assert all(n == 1 or n * queries <= R.SLICE_SCORES for _, n in parts)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_best_so_far(k):
    """Many ties, rows that are no hits, and merges in between."""
    rng = np.random.default_rng(k)
    s = rng.integers(0, 6, (7, 400)).astype(float)
    s[rng.random(s.shape) < 0.1] = -np.inf
    s[2], s[3, 5] = -np.inf, np.nan
    ids = rng.permutation(400)
    best = R.Best(7, k)
    for a in range(0, 400, 33):
        best.add(s[:, a : a + 33].copy(), ids[a : a + 33])
        if a % 2:
            best.merge()
            assert len(best.held[0]) <= 7 * k
    got = list(zip(*(x.tolist() for x in best.merge()), strict=True))
    want = [(i, d, x) for i in range(7) for d, x in sorted([(int(d), float(x)) for d, x in zip(ids, s[i], strict=True) if np.isfinite(x)], key=lambda r: (-r[1], r[0]))[:k]]
    assert got == want


def test_copies_of_a_vector_rank_by_id(spark):
    """Rows of a product may differ in the last digit by where they stand; copies mustn't."""
    v = np.random.default_rng(5).normal(size=(40, 24)).astype(np.float32)
    rows = [(i, v[i % 7].tolist()) for i in range(3000)]
    asked = spark.createDataFrame([(9000 + i, v[i].tolist()) for i in range(40)], "query_id bigint, embedding array<float>")
    got = R.scored(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5), asked, 6)
    x = np.array([r[1] for r in rows])
    score = np.round(np.array([v[i].astype(float) for i in range(40)]) @ x[:7].T, 9)
    want = {9000 + i: sorted(range(3000), key=lambda j: (-score[i, j % 7], j))[:6] for i in range(40)}
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == want
