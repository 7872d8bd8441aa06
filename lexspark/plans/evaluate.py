"""From gold items, predictions and judgments to reports and comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import external
from lexspark.operators import metrics, stats

# Metric -> the item field by which two runs are paired
ITEM_FIELDS = {"M0_accuracy": "m0_correct", "M1_recall_any": "m1_recall_any", "M1_recall_all": "m1_recall_all", "M1_mrr": "m1_rr", "M3_citation_precision": "m3_citation_precision", "M3_citation_recall": "m3_citation_recall", "M4_kp_coverage": "m4_kp_coverage", "M4_all_kp": "m4_all_kp", "M4_complete": "m4_complete", "M5_unsupported_rate": "m5_unsupported_rate", "M6_temporal_error": "m6_temporal_error"}


def scores(gold: DataFrame, predictions: DataFrame, judgments: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    return metrics.item_scores(gold, predictions, judgments, splits)


def long_items(rows: DataFrame) -> DataFrame:
    """(id, metric, value) of the paired fields; other columns named `run`, `level` and `split` stay."""
    kept = [c for c in ("run", "id", "level", "split") if c in rows.columns]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f).cast("double").alias("value")) for m, f in ITEM_FIELDS.items()])
    return rows.select(*kept, F.explode(pairs).alias("p")).select(*kept, "p.*").where("value is not null")


def noise(run_scores: DataFrame, digits: int = 3) -> DataFrame:
    """The noise floor over runs (column `run`) of one configuration, from rounded run means."""
    means = long_items(run_scores).groupBy("run", "metric").agg(F.round(F.avg("value"), digits).alias("value"))
    return stats.noise_floor(means)


def compared(base: DataFrame, experiment: DataFrame, floor: DataFrame, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """A row for each metric: base, exp, delta, noise range, interval, verdict. `base` may have several runs; items are averaged over them first."""
    a = long_items(base).groupBy("id", "metric").agg(F.avg("value").alias("a"))
    b = long_items(experiment).groupBy("id", "metric").agg(F.avg("value").alias("b"))
    pairs = a.join(b, ["id", "metric"])
    ci = stats.seeded_bootstrap(pairs, ["metric"], resamples, seed)
    means = a.groupBy("metric").agg(F.avg("a").alias("base")).join(b.groupBy("metric").agg(F.avg("b").alias("exp")), "metric")
    rows = means.join(ci, "metric", "left").join(floor.select("metric", F.col("range").alias("noise_range")), "metric", "left").withColumn("delta", F.col("exp") - F.col("base"))
    return rows.withColumn("verdict", stats.verdict(F.col("delta"), F.col("noise_range"), F.col("lo"), F.col("hi"), F.col("metric").isin(*stats.LOWER_IS_BETTER)))


def official(scores_rows: DataFrame, verdicts: DataFrame, judges: list[str]) -> DataFrame:
    """Scores with m0 replaced by the judges' consensus where there are verdicts (id, judge, met), and the rule's value where the item was refused."""
    agreed = stats.consensus(verdicts, ["id"], judges).select("id", "correct")
    return scores_rows.join(agreed, "id", "left").withColumn("m0_official", F.coalesce("correct", F.col("m0_correct") & (F.col("status") != "answered"), F.lit(False))).drop("correct")


def judged(answers: DataFrame, gold: DataFrame, contexts: DataFrame, key_points: Callable = external.literal_judge, grounding: Callable = external.grounding_judge, tries: int = 2) -> DataFrame:
    """A row for each item (id, answer, status, error): its answer, the judgment of its key points and that of its grounding, each called once and asked again if its JSON was cut short. An item without an answer isn't judged; errors are recorded and end nothing."""
    due = answers.where("status = 'answered'")
    asked = lambda **p: F.to_json(F.struct(*[c.alias(k) for k, c in p.items()]))
    points = due.join(gold.select("id", "key_points"), "id").select("id", asked(answer=F.col("answer"), key_points=F.col("key_points")).alias("prompt"))
    claims = due.join(contexts.select("id", "context"), "id").select("id", asked(answer=F.col("answer"), context=F.col("context")).alias("prompt"))
    out = answers
    for name, jobs, judge in (("key_points", points, key_points), ("grounding", claims, grounding)):
        got = external.called_once(jobs, judge, ["id"], tries=tries, check=external.whole_json)
        out = out.join(got.select("id", F.col("response").alias(f"{name}_judgment"), F.col("error").alias(f"{name}_error")), "id", "left")
    return out


def judge_prompt(question: Column, articles: Column, limit: int = 1500) -> Column:
    """What a judge of training pairs is shown: the question and each article's first `limit` characters."""
    cut = F.transform(articles, lambda t: F.left(t, F.lit(limit)))
    return F.concat(F.lit("[질문]\n"), question, F.lit("\n\n[조문]\n"), F.array_join(cut, "\n\n"))
