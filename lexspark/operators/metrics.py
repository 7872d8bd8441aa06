"""Scores of predicted answers, and their aggregates.

Refusals count as 0 where a metric is a recall and as missing where it is a precision.
Means skip missing values and report how many there were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: metric -> (score column, population); the population is a predicate over score rows.
MEANS = {
    "M0_accuracy": ("m0_correct", "true"),
    "M1_recall_any": ("m1_recall_any", "true"),
    "M1_recall_all": ("m1_recall_all", "true"),
    "M1_mrr": ("m1_rr", "true"),
    "M1_with_links_any": ("m1_with_links_any", "true"),
    "M2_oos_refusal": ("m2_correct_status", "expected <> 'answered' and level = 'OOS'"),
    "M2_l5b_no_assertion": ("status <> 'answered' or coalesce(soft_refusal_ok, false)", "expected <> 'answered' and level = 'L5b'"),
    "M2_over_refusal": ("status <> 'answered'", "expected = 'answered'"),
    "M3_citation_precision": ("m3_citation_precision", "true"),
    "M3_citation_recall": ("m3_citation_recall", "true"),
    "M4_kp_coverage": ("m4_kp_coverage", "true"),
    "M4_all_kp": ("m4_all_kp", "true"),
    "M4_complete": ("m4_complete", "true"),
    "M5_unsupported_rate": ("m5_unsupported_rate", "true"),
    "M6_temporal_error": ("m6_temporal_error", "true"),
}


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def item_scores(gold: DataFrame, predictions: DataFrame, judgments: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """A score row for each gold item with a prediction; the judgment and the split may be missing."""
    j = gold.join(predictions.select("id", F.col("status").alias("p_status"), "citations", "retrieval", "meta"), "id").join(judgments.select("id", "grade", "grounding"), "id", "left")
    j = j.join(splits, "id", "left") if splits is not None else j.withColumn("split", F.lit(None).cast("string"))
    none = F.array().cast("array<string>")
    gold_set = F.array_distinct(F.coalesce("gold_evidence", none))
    j = j.withColumn("_g", gold_set)
    ids = lambda xs: F.flatten(F.transform(xs, lambda r: r["article_ids"]))
    searched = F.filter("retrieval", lambda r: ~r["linked"])
    hit_ranks = F.transform(F.filter(searched, lambda r: F.arrays_overlap(r["article_ids"], F.col("_g"))), lambda r: r["rank"])
    j = j.withColumns({"_ranks": hit_ranks, "_found": F.array_intersect("_g", ids(searched)), "_any": F.array_intersect("_g", ids(F.col("retrieval"))), "_cited": F.array_distinct(F.coalesce(ids(F.col("citations")), none))})
    has = F.size("_g") > 0
    expected = F.col("expected_status") == "answered"
    answered = F.col("p_status") == "answered"
    hedged = F.coalesce(~F.col("grade.asserts_conclusion"), F.lit(False))
    common = F.size(F.array_intersect("_cited", "_g"))
    judged = answered & F.col("grade").isNotNull()
    points = F.coalesce("grade.key_points", F.array().cast("array<struct<index: int, key_point: string, asserted: boolean, quote: string>>"))
    j = j.withColumn("_kp", points)
    # points no longer in the gold set don't count, unless none is
    live = F.filter("_kp", lambda k: F.array_contains("key_points", k["key_point"]))
    j = j.withColumn("_kp", F.when(F.size(live) > 0, live).otherwise(F.col("_kp")))
    scored = judged & (F.size("_kp") > 0) & expected
    n_true = F.size(F.filter("_kp", lambda k: k["asserted"]))
    all_kp = F.when(scored, n_true == F.size("_kp"))
    coverage = F.when(scored, n_true / F.size("_kp")).when(expected & ~answered & (F.size("key_points") > 0), 0.0)
    complete = F.when(expected, F.coalesce(all_kp, F.lit(False)))
    correct_status = F.when(expected, answered).otherwise(~answered | hedged)
    mode = F.when(~expected, F.when(~answered, F.when(F.col("meta.refusal_reason") == "retrieval_below_tau", "gate").otherwise("declined")).otherwise(F.when(hedged, "hedged").otherwise("asserted")))
    return j.select(
        "id", "level", "split", F.col("expected_status").alias("expected"), F.col("p_status").alias("status"), F.col("meta.refusal_reason").alias("refusal_reason"), mode.alias("refusal_mode"),
        F.when(expected, complete).otherwise(correct_status).alias("m0_correct"),
        F.when(has, F.size("_ranks") > 0).alias("m1_recall_any"),
        F.when(has, F.size("_found") == F.size("_g")).alias("m1_recall_all"),
        F.when(has, F.coalesce(1.0 / F.array_min("_ranks"), F.lit(0.0))).alias("m1_rr"),
        F.when(has, F.size("_any") > 0).alias("m1_with_links_any"),
        correct_status.alias("m2_correct_status"),
        F.when(answered & has, share(common, F.size("_cited"))).alias("m3_citation_precision"),
        F.when(expected & has, F.when(answered, common / F.size("_g")).otherwise(0.0)).alias("m3_citation_recall"),
        coverage.alias("m4_kp_coverage"), all_kp.alias("m4_all_kp"), complete.alias("m4_complete"),
        F.when(judged & (F.col("grounding.n_claims") > 0), F.col("grounding.n_unsupported") / F.col("grounding.n_claims")).alias("m5_unsupported_rate"),
        F.when(judged, F.col("grade.temporal_error")).alias("m6_temporal_error"),
        F.when(judged, ~F.col("grade.asserts_conclusion")).alias("soft_refusal_ok"),
        F.coalesce("meta.cost_krw", F.lit(0.0)).alias("cost_krw"), F.col("meta.latency_ms").alias("latency_ms"),
    )


def _mean(expression: str, population: str) -> Column:
    return F.avg(F.expr(f"case when {population} then cast(({expression}) as double) end"))


def _count(expression: str, population: str) -> Column:
    return F.count(F.expr(f"case when {population} then cast(({expression}) as double) end"))


#: Accuracy of the rank sketch, the share of rows on each side of the middle that the bracket takes in, and rows up to which it takes in all.
SKETCH, SIDE, SMALL = 10_000, 0.001, 5000


def upper_medians(rows: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """(by, name): each group's middle value, the upper of two; a null value counts as 0.

    Values are counted ahead of the shuffle. A sketch, which merges, gives each group a bracket that holds the middle for sure, as it errs by less than the bracket's width; only the bracket's distinct values are then put in order. So no array or sorted run holds a group."""
    v = F.coalesce(F.col(value), F.lit(0))
    counted = rows.select(*by, v.alias("_v")).groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    cut = F.percentile_approx("_v", [0.5 - SIDE, 0.5 + SIDE], SKETCH)
    bracket = rows.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], v.alias("_v")).groupBy(*[f"_by{i}" for i in range(len(by))]).agg(F.count("*").alias("_n"), cut.alias("_cut"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    low = F.when(F.col("_n") <= SMALL, F.col("_min")).otherwise(F.get("_cut", F.lit(0)))
    high = F.when(F.col("_n") <= SMALL, F.col("_max")).otherwise(F.get("_cut", F.lit(1)))
    bracket = bracket.select(*[f"_by{i}" for i in range(len(by))], "_n", low.alias("_low"), high.alias("_high"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    near = counted.join(bracket, same).where(F.col("_v") <= F.col("_high"))
    # what lies below the bracket is one row a group
    near = near.withColumn("_v", F.when(F.col("_v") >= F.col("_low"), F.col("_v"))).groupBy(*by, "_v", "_n").agg(F.sum("_c").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("_v")))
    return near.withColumn("_upto", upto).where(F.col("_upto") > F.floor(F.col("_n") / 2)).groupBy(*by).agg(F.min("_v").alias(name))


def bundle(groups: list[str] | None = None):
    """Aggregates of the metric table: value and n of each mean, and cost."""
    out = [F.count("*").alias("n")]
    for name, (expression, population) in MEANS.items():
        out += [_mean(expression, population).alias(name), _count(expression, population).alias(f"{name}_n")]
    return [*out, F.sum("cost_krw").alias("cost_krw")]


def report(scores: DataFrame) -> DataFrame:
    """Overall, by level and by split: scope, value, metrics in one pass over the scores, and the median latency."""
    sets = scores.groupingSets([[], ["level"], ["split"]], "level", "split").agg(F.grouping_id().alias("_g"), *bundle())
    # grouping_id has a bit for each column that is not grouped by: 3 overall, 1 by level, 2 by split
    scope = F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "level").otherwise("split")
    value = F.when(F.col("_g") == 1, F.col("level")).when(F.col("_g") == 2, F.col("split"))
    table = sets.select(scope.alias("scope"), value.alias("value"), *[c for c in sets.columns if c not in ("level", "split", "_g")])
    scopes = F.array(*[F.struct(F.lit(name).alias("scope"), v.cast("string").alias("value")) for name, v in (("overall", F.lit(None)), ("level", F.col("level")), ("split", F.col("split")))])
    each = scores.select(F.explode(scopes).alias("s"), "latency_ms").select("s.scope", "s.value", "latency_ms")
    middle = upper_medians(each, ["scope", "value"], "latency_ms", "latency_ms_p50").withColumnsRenamed({"scope": "_scope", "value": "_value"})
    return table.join(middle, (F.col("scope") == F.col("_scope")) & F.col("value").eqNullSafe(F.col("_value")), "left").drop("_scope", "_value")


def failing(scores: DataFrame) -> DataFrame:
    """Items with any sign of failure; a missing metric is no sign."""
    no = lambda c: F.coalesce(~F.col(c), F.lit(False))
    bad = ~F.col("m2_correct_status") | no("m1_recall_any") | no("m4_all_kp") | F.coalesce(F.col("m5_unsupported_rate") > 0, F.lit(False)) | F.coalesce("m6_temporal_error", F.lit(False))
    return scores.where(bad)


def long_form(report_rows: DataFrame) -> DataFrame:
    """(scope, value, metric, mean, n) rows of a report."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("mean"), F.col(f"{m}_n").alias("n")) for m in MEANS])
    return report_rows.select("scope", "value", F.explode(pairs).alias("m")).select("scope", "value", "m.*")
