"""Samples that repeat, leakage guards and hard negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, key: Column) -> Column:
    """A sort key that is random in the seed and the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each stratum without replacement."""
    w = Window.partitionBy(stratum).orderBy(draw(seed, F.col(key)), F.col(key))
    return df.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def fraction(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """The rows whose draw falls under the share: no sort, no count."""
    return df.where(F.conv(F.substring(draw(seed, F.col(key)), 1, 8), 16, 10).cast("bigint") < int(share * 2**32))


def one_of_each(df: DataFrame, group: str, key: str, seed: int = 42) -> DataFrame:
    """One random row of each group, as an aggregate."""
    own = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(F.col(group).alias("_g")).agg(F.min_by(own, F.struct(draw(seed, F.col(key)), F.col(key))).alias("r")).select("r.*")


def overlap_guard(rows: DataFrame, gold: DataFrame, row_id: str, gold_id: str, tokens: str = "tokens") -> DataFrame:
    """For each row its nearest gold item by share of the gold item's distinct tokens: (row_id, nearest, overlap). The tokens join, so rows and items without a common token never meet; the gold side is a bounded evaluation set."""
    g = gold.select(gold_id, F.size(F.array_distinct(tokens)).alias("_n"), F.explode(F.array_distinct(tokens)).alias("t"))
    r = rows.select(row_id, F.explode(F.array_distinct(tokens)).alias("t"))
    per = r.join(g, "t").groupBy(row_id, gold_id, "_n").agg(F.count("*").alias("c")).withColumn("overlap", F.col("c") / F.col("_n"))
    best = F.max(F.struct("overlap", (-F.col(gold_id)).alias("k")))
    return per.groupBy(row_id).agg(best.alias("b")).select(row_id, (-F.col("b.k")).alias("nearest"), F.col("b.overlap").alias("overlap"))


def training_rows(pairs: DataFrame, negatives: DataFrame) -> DataFrame:
    """Each positive of a pair with the pair's hard negative: id, query, positive, negative."""
    return pairs.select("id", "query", F.explode("positives").alias("positive")).join(negatives.select("id", "negative"), "id", "left")
