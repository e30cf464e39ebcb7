"""Time buckets and fetch windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def months(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Calendar months clipped to [start, end], only those of positive width."""
    one = spark.range(1).select(F.explode(F.expr(f"sequence(trunc(date'{start}', 'MM'), date'{end}', interval 1 month)")).alias("m"))
    lo, hi = F.greatest(F.col("m"), F.lit(start).cast("date")), F.least(F.add_months("m", 1), F.lit(end).cast("date"))
    return one.select(lo.alias("lo"), hi.alias("hi")).where("lo < hi")


def fixed(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """Windows of a fixed width aligned to the newest end, oldest first."""
    one = spark.range(1).select(F.explode(F.expr(f"sequence(timestamp'{end}', timestamp'{start}', interval -{days} days)")).alias("hi"))
    lo = F.greatest(F.col("hi") - F.expr(f"interval {days} days"), F.lit(start).cast("timestamp"))
    return one.select(lo.alias("lo"), "hi").where("lo < hi")


def fetch_window(through: Column, now: Column, overlap_hours: int = 48, lookback_days: int = 14) -> tuple[Column, Column]:
    """(start, gap): the watermark less the overlap, not before the lookback; gap says
    that the watermark is older than that."""
    floor = now - F.expr(f"interval {lookback_days} days")
    start = F.greatest(F.coalesce(through - F.expr(f"interval {overlap_hours} hours"), floor), floor)
    return start, F.coalesce(through < floor, F.lit(False))
