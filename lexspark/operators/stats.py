"""Statistics of repeated and paired runs.

Runs are rows (run, id, ...). The bootstrap has two forms: one that draws indices by a hash
of (resample, position), which any SQL engine can repeat, and one with a seeded generator
for figures that must equal earlier published ones.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOWER_IS_BETTER = ("M2_over_refusal", "M5_unsupported_rate", "M6_temporal_error")
NOISE_M0 = 0.030
ENOUGH = 5


def noise_floor(runs: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Mean, least, greatest, range and population deviation of each metric over runs."""
    return runs.groupBy(metric).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), (F.max(value) - F.min(value)).alias("range"), F.stddev_pop(value).alias("std"))


def unstable(runs: DataFrame, signature: list[str], key: str = "id") -> DataFrame:
    """Keys whose signature differs between runs; a missing value is a value."""
    return runs.groupBy(key).agg(F.size(F.collect_set(F.to_json(F.struct(*signature), {"ignoreNullFields": "false"}))).alias("n")).where("n > 1").select(key)


def item_means(runs: DataFrame, fields: list[str], key: str = "id", strict: int | None = None) -> DataFrame:
    """Mean of each field by key over runs; with `strict`, only where all so many runs have a value."""
    mean = lambda f: F.avg(F.col(f).cast("double"))
    return runs.groupBy(key).agg(*[(mean(f) if strict is None else F.when(F.count(f) == strict, mean(f))).alias(f) for f in fields])


def paired(a: DataFrame, b: DataFrame, field: str, key: str = "id") -> DataFrame:
    """(key, a, b, delta) of the keys that have the field in both."""
    pick = lambda d, n: d.select(key, F.col(field).cast("double").alias(n)).where(F.col(n).isNotNull())
    return pick(a, "a").join(pick(b, "b"), key).withColumn("delta", F.col("b") - F.col("a"))


def gained_lost(pairs: DataFrame, key: str = "id", by: float = 0.5) -> DataFrame:
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col(key).cast("string")))), ",")
    return pairs.agg(names(F.col("delta") >= by).alias("gained"), names(F.col("delta") <= -by).alias("lost"))


def hash_index(resample: Column, position: Column, n: Column) -> Column:
    """A draw from 0..n-1 by the md5 of `resample:position`."""
    digest = F.md5(F.concat_ws(":", resample.cast("string"), position.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n


def hash_bootstrap(pairs: DataFrame, resamples: int, key: str = "id", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """One row (n, lo, hi): the interval of the mean delta over resamples, by sorted index. The deltas of one comparison (an evaluation set, not a corpus) travel as one array; resamples are dealt over the tasks."""
    held = pairs.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct(key, "delta"))), lambda x: x["delta"]).alias("d"))
    rows = held.select("d", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).repartition("b")
    n = F.size("d")
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, k: s + F.element_at("d", (hash_index(F.col("b"), k, n) + 1).cast("int")))
    means = rows.where(n >= ENOUGH).select(n.alias("n"), (total / n).alias("m"))
    at = lambda q: F.element_at(F.sort_array(F.collect_list("m")), int(q * resamples) + 1)
    return means.groupBy("n").agg(at(low).alias("lo"), at(high).alias("hi"))


def seeded_bootstrap(pairs: DataFrame, by: list[str], resamples: int = 2000, seed: int = 0, drawn: str = "randrange", order: str = "id") -> DataFrame:
    """(by, n, lo, hi) with a seeded generator, each comparison on its own. `randrange` resamples pairs and reads indices n*0.025 and n*0.975; `choice` resamples deltas and reads n*0.025 and n*0.975 - 1."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        rng, rows = random.Random(seed), list(zip(frame["a"], frame["b"], strict=True))
        head = [frame[c].iloc[0] for c in by]
        if len(rows) < ENOUGH and drawn == "randrange":
            return pd.DataFrame([[*head, len(rows), None, None]], columns=[*by, "n", "lo", "hi"])
        deltas = []
        for _ in range(resamples):
            if drawn == "randrange":
                got = [rows[rng.randrange(len(rows))] for _ in rows]
                deltas.append(sum(y for _, y in got) / len(got) - sum(x for x, _ in got) / len(got))
            else:
                diff = [y - x for x, y in rows]
                deltas.append(sum(rng.choice(diff) for _ in diff) / len(diff))
        deltas.sort()
        last = int(resamples * 0.975) - (drawn == "choice")
        return pd.DataFrame([[*head, len(rows), deltas[int(resamples * 0.025)], deltas[last]]], columns=[*by, "n", "lo", "hi"])

    kinds = dict(pairs.dtypes)
    return pairs.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", n bigint, lo double, hi double")


def excludes_zero(lo: Column, hi: Column) -> Column:
    return (lo > 0) | (hi < 0)


def verdict(delta: Column, noise: Column, lo: Column, hi: Column, lower_is_better: Column | bool = False, needs_interval: bool = False) -> Column:
    """better, worse or insignificant: beyond the noise range, and the interval (if there is one, or always) without zero."""
    lower = lower_is_better if isinstance(lower_is_better, Column) else F.lit(lower_is_better)
    inside = F.coalesce(excludes_zero(lo, hi), F.lit(not needs_interval))
    clear = F.coalesce(F.abs(delta) > noise, F.lit(False)) & inside & (delta != 0)
    better = F.when(lower, delta < 0).otherwise(delta > 0)
    return F.when(~clear, "insignificant").when(better, "better").otherwise("worse")


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts, agreement, precision and recall of b against a; rows with a missing rating are left out."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("boolean").alias("a"), F.col(b).cast("boolean").alias("b"))
    c = both.agg(F.count_if(F.expr("a and b")).alias("tp"), F.count_if(F.expr("not a and b")).alias("fp"), F.count_if(F.expr("a and not b")).alias("fn"), F.count_if(F.expr("not a and not b")).alias("tn"), F.count("*").alias("n"))
    ratio = lambda x, y: F.when(y > 0, x / y)
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    return c.select("*", ratio(tp + tn, n).alias("agreement"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))


def kappa(c: DataFrame) -> DataFrame:
    """Cohen's kappa of a confusion row; null without rows or where chance alone agrees always."""
    n = F.col("n").cast("double")
    po = (F.col("tp") + F.col("tn")) / n
    pe = ((F.col("tp") + F.col("fn")) * (F.col("tp") + F.col("fp")) + (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn"))) / (n * n)
    return c.withColumn("kappa", F.when((n > 0) & (pe < 1), (po - pe) / (1 - pe)))


def flips(runs: DataFrame, key: list[str], value: str) -> DataFrame:
    """How many keys rated in every run changed between runs."""
    total = runs.select("run").distinct().count()
    per = runs.groupBy(*key).agg(F.count(value).alias("c"), F.countDistinct(value).alias("d")).where(F.col("c") == total)
    return per.agg(F.count("*").alias("n"), F.count_if(F.expr("d > 1")).alias("flipped"), F.avg((F.col("d") > 1).cast("double")).alias("flip_rate"))


def pairwise(runs: DataFrame, key: list[str], value: str) -> DataFrame:
    """Agreement of each two runs on the keys that both rated: run_a, run_b, n, agreed, agreement."""
    pick = lambda s: runs.where(F.col(value).isNotNull()).select(*key, F.col("run").alias(f"run_{s}"), F.col(value).alias(f"v_{s}"))
    both = pick("a").join(pick("b"), key).where("run_a < run_b")
    return both.groupBy("run_a", "run_b").agg(F.count("*").alias("n"), F.count_if(F.expr("v_a = v_b")).alias("agreed")).withColumn("agreement", F.col("agreed") / F.col("n"))


def consensus(verdicts: DataFrame, key: list[str], judges: list[str]) -> DataFrame:
    """Correct where each judge found every point met; a missing verdict makes that judge's item null, and null counts as false. verdicts: key, judge, met."""
    per = verdicts.groupBy(*key, "judge").agg(F.when(F.count_if(F.col("met").isNull()) == 0, F.bool_and("met")).alias("all_met"))
    wide = per.groupBy(*key).pivot("judge", judges).agg(F.first("all_met"))
    both = F.lit(True)
    for j in judges:
        both = both & F.coalesce(F.col(f"`{j}`"), F.lit(False))
    return wide.withColumn("correct", both)


def aligned_ratings(labels: DataFrame, judged: DataFrame, key: str = "item") -> DataFrame:
    """Two raters' arrays side by side by position: key, pos, human, judge. Positions that only one has are null on the other side."""
    both = labels.join(judged, key)
    zipped = F.posexplode(F.arrays_zip(F.col("human"), F.col("judge"))).alias("pos", "z")
    return both.select(key, zipped).select(key, "pos", "z.human", "z.judge")


def minimal_effect(run_values: DataFrame, half_widths: DataFrame) -> DataFrame:
    """max(range over runs, mean half width of the intervals between runs of one configuration)."""
    r = run_values.agg((F.max("value") - F.min("value")).alias("range"), F.min("n").alias("n"))
    h = half_widths.agg(F.avg((F.col("hi") - F.col("lo")) / 2).alias("half"))
    enough = F.col("n") >= ENOUGH
    return r.join(h, F.lit(True)).select("n", F.when(enough, F.col("range")).alias("range"), F.when(enough, F.col("half")).alias("half"), F.when(enough, F.greatest("range", "half")).alias("mde"))


def ordinal(runs: DataFrame, by: str, order: list[str]) -> DataFrame:
    return runs.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
