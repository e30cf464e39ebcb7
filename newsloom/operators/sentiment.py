"""Daily sentiment: weighted means by day, then calendar and row windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import maths


def article_weight(as_of: Column, half_life_hours: float) -> Column:
    """relevance x classifier confidence x half-life decay of the age."""
    sure = maths.confidence(F.col("positive"), F.col("negative"), F.col("neutral"))
    return F.col("relevance") * sure * maths.half_life_weight(maths.age_hours(as_of, F.col("published_at")), half_life_hours)


def daily(articles: DataFrame, as_of: str, half_life_hours: float = 24.0) -> DataFrame:
    """One row per (ticker, UTC date) with a positive total weight.

    score and shares are weighted means, disagreement the weighted population standard
    deviation (second moment around the mean: the day's totals are joined back, one
    small row per day, rather than subtracting large squares). article_count counts
    every row of the day. moving_average_7d is the plain mean over the seven calendar
    days up to the date, trend_3 the weighted mean of the last three kept dates.
    """
    w = article_weight(F.lit(as_of).cast("timestamp"), half_life_hours)
    rows = articles.withColumn("date", F.to_date("published_at")).withColumn("w", w)
    keys = ["ticker", "date"]
    mean = rows.groupBy(*keys).agg(
        F.sum("w").alias("aggregate_weight"),
        F.try_divide(F.sum(F.col("w") * F.col("sentiment_score")), F.sum("w")).alias("score"),
        F.try_divide(F.sum(F.col("w") * F.col("positive")), F.sum("w")).alias("positive_share"),
        F.try_divide(F.sum(F.col("w") * F.col("negative")), F.sum("w")).alias("negative_share"),
        F.count("*").alias("article_count"),
    ).where("aggregate_weight > 0")
    spread = rows.join(mean.select(*keys, "score", "aggregate_weight"), keys).groupBy(*keys).agg(
        F.sqrt(F.sum(F.col("w") * F.pow(F.col("sentiment_score") - F.col("score"), 2)) / F.first("aggregate_weight")).alias("disagreement")
    )
    return with_windows(mean.join(spread, keys))


def with_windows(days: DataFrame) -> DataFrame:
    w = Window.partitionBy("ticker")
    week = w.orderBy(F.unix_date("date")).rangeBetween(-6, 0)
    three = w.orderBy("date").rowsBetween(-2, 0)
    return days.withColumn("moving_average_7d", F.avg("score").over(week)).withColumn(
        "trend_3", F.sum(F.col("score") * F.col("aggregate_weight")).over(three) / F.sum("aggregate_weight").over(three)
    )


def replace_window(stored: DataFrame, fresh: DataFrame, since: str) -> DataFrame:
    """Rows dated from ``since`` are replaced by the fresh ones; older rows stay."""
    return stored.where(F.col("date") < F.lit(since).cast("date")).unionByName(fresh.where(F.col("date") >= F.lit(since).cast("date")))


def aligned_to_sessions(days: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sentiment of day d lands on the first session after d: summed by article count,
    the last moving average wins. Sessions are (date, idx)."""
    from newsloom.operators.asof import next_session

    placed = next_session(days, sessions)
    return placed.groupBy("ticker", "session").agg(
        (F.sum(F.col("score") * F.col("article_count")) / F.sum("article_count")).alias("score"),
        F.max_by("moving_average_7d", "date").alias("moving_average_7d"),
        F.sum("article_count").alias("article_count"),
    )


def market_summary(articles: DataFrame) -> DataFrame:
    """Counts by ticker and label of the strongest probability."""
    label = maths.argmax_label(F.col("positive"), F.col("negative"), F.col("neutral"))
    return articles.withColumn("label", label).groupBy("ticker", "label").agg(F.count("*").alias("n"), F.avg("sentiment_score").alias("mean_score"))
