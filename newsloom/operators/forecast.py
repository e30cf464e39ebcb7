"""Baseline forecast: features, chronological split, balanced logistic regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ("return_1", "return_5", "trend", "volatility", "volume_ratio")


def scaled(rows: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Median imputation, then standardisation by the population deviation."""
    median = rows.agg(*[F.median(c).alias("m_" + c) for c in features])
    filled = rows.crossJoin(F.broadcast(median))  # one row of medians
    filled = filled.select(*[c for c in rows.columns if c not in features], *[F.coalesce(c, "m_" + c).alias(c) for c in features])
    stats = filled.agg(*[F.avg(c).alias("a_" + c) for c in features], *[F.stddev_pop(c).alias("s_" + c) for c in features])
    out = filled.crossJoin(F.broadcast(stats))  # one row of moments
    return out.select(*[c for c in rows.columns if c not in features], *[F.coalesce(F.try_divide(F.col(c) - F.col("a_" + c), F.col("s_" + c)), F.lit(0.0)).alias(c) for c in features])


def baseline(split: DataFrame) -> DataFrame:
    """Accuracy and AUC of a balanced L2 logistic regression on the validation part,
    beside the majority class of the training part."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(scaled(split)).withColumn("target", F.col("target").cast("double"))
    train = rows.where("part = 'train'")
    n, up = train.agg(F.count("*"), F.sum("target")).first()
    up = max(float(up or 0), 1e-9)
    weighted = train.withColumn("w", F.when(F.col("target") == 1, n / (2 * up)).otherwise(n / (2 * max(n - up, 1e-9))))
    model = LogisticRegression(featuresCol="x", labelCol="target", weightCol="w", regParam=1.0 / max(n, 1), standardization=False).fit(weighted)
    scored = model.transform(rows.where("part = 'validation'")).withColumn("p", vector_to_array("probability")[1])
    ranked = scored.withColumn("r", F.rank().over(Window.partitionBy(F.lit(1)).orderBy("p")) + (F.count("*").over(Window.partitionBy("p")) - 1) / 2)  # the validation tail of a price history
    ups, downs = F.sum("target"), F.sum(1 - F.col("target"))
    majority = 1.0 if up / max(n, 1) >= 0.5 else 0.0
    return ranked.agg(
        F.count("*").alias("n"),
        F.round(F.avg(((F.col("p") >= 0.5) == (F.col("target") == 1)).cast("double")), 4).alias("accuracy"),
        F.round(F.avg((F.col("target") == majority).cast("double")), 4).alias("majority_accuracy"),
        F.round(F.try_divide(F.sum(F.when(F.col("target") == 1, F.col("r"))) - ups * (ups + 1) / 2, ups * downs), 4).alias("auc"),
    )
