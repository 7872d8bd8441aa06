"""The overlap join against a plain loop, and one key with very many intervals."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.operators import chunking as C


def test_overlaps_against_a_plain_loop(spark, monkeypatch):
    rng = random.Random(4)
    some = lambda n, most: [(rng.choice(["a", "b", None, "c"]), i, a, a + rng.choice([0, 1, 5, rng.randrange(most)])) for i in range(n) for a in [rng.randrange(-50, 300)]]
    w, s = some(80, 90), some(120, 400) + [("only", 999, 0, 9)]
    windows = spark.createDataFrame(w, "k string, w int, start int, stop int").repartition(3)
    spans = spark.createDataFrame(s, "k string, s int, start bigint, stop bigint").repartition(3)
    want = sorted((k, i, a, b, j, c, d) for k, i, a, b in w for q, j, c, d in s if k and k == q and b > a and d > c and c < b and d > a)
    for lengths in (256, 1, 0.05):
        monkeypatch.setattr(C, "BIN_LENGTHS", lengths)
        got = C.overlapping(windows, spans, "k")
        assert got.columns == ["k", "w", "start", "stop", "s", "s_start", "s_stop"]
        assert sorted((r.k, r.w, r.start, r.stop, r.s, r.s_start, r.s_stop) for r in got.collect()) == want
    assert C.overlapping(windows.limit(0), spans, "k").collect() == []


def test_sweep():
    rng = np.random.default_rng(1)
    w, s = (np.sort(rng.integers(0, 60, (2, 50)), axis=0) for _ in "ws")
    i, j = C.sweep(w, s, 10, 40)
    want = {(a, b) for a in range(50) for b in range(50) if w[0, a] < s[1, b] and s[0, b] < w[1, a] and w[0, a] < w[1, a] and s[0, b] < s[1, b] and 10 <= max(w[0, a], s[0, b]) < 40}
    got = list(zip(i.tolist(), j.tolist(), strict=True))
    valid = [(a, b) for a, b in got if w[0, a] < w[1, a] and s[0, b] < s[1, b]]
    assert set(valid) == want and len(valid) == len(want)


@pytest.mark.parametrize("burst", [False, True])
def test_one_key_with_a_million_spans(spark, burst):
    """Short spans and windows, all of one key; with a burst half of them crowd where few overlap, and one interval covers all."""
    n, apart = 1_000_000, F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") * 40) if burst else F.col("id") * 10
    spans = spark.range(n).select(F.lit("k").alias("k"), apart.alias("start"), (apart + 1).alias("stop"), "id")
    if burst:
        spans = spans.unionByName(spark.range(1).select(F.lit("k").alias("k"), F.lit(0).cast("bigint").alias("start"), F.lit(40 * n).cast("bigint").alias("stop"), F.lit(-1).cast("bigint").alias("id")))
    windows = spark.range(n // 10).select(F.lit("k").alias("k"), (F.col("id") * 100).alias("start"), (F.col("id") * 100 + 15).alias("stop"), F.col("id").alias("w"))
    starts = np.concatenate([np.arange(0, n, 2), np.arange(1, n, 2) * 40]) if burst else np.arange(n) * 10
    starts.sort()
    at = np.arange(n // 10) * 100
    want = int((np.searchsorted(starts, at + 15) - np.searchsorted(starts, at)).sum()) + (n // 10 if burst else 0)
    assert C.overlapping(windows, spans, "k").count() == want
