"""Evaluation against labels: confusion counts and pairwise grouping quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, predicted: Column, gold: Column) -> DataFrame:
    """Counts, and precision and recall that are null where undefined."""
    m = rows.select(predicted.alias("p"), gold.alias("q"))
    n = m.agg(*[F.count(F.when((F.col("p") == p) & (F.col("q") == q), 1)).alias(name) for name, p, q in (("tp", True, True), ("fp", True, False), ("fn", False, True), ("tn", False, False))])
    return n.select("*", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision_"), F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall_"))


def pairwise(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Pairs inside groups by counting, never by listing them: n (n - 1) / 2 per gold
    group, per predicted group, and per intersection of the two."""

    def pairs(*keys: str) -> DataFrame:
        n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
        return n.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("x"))

    one = lambda df, name: df.withColumnRenamed("x", name)
    out = one(pairs(gold), "gold_pairs").crossJoin(one(pairs(predicted), "predicted_pairs"))  # single rows
    return out.crossJoin(one(pairs(gold, predicted), "shared_pairs"))
