"""Ordering, numbering and rolling operators.

A window without a partition key would send a table to one task; ``numbered`` and
``with_previous`` number rows over range partitions instead, so a calendar or a price
history of any length stays spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: str, name: str, buckets: int = 64) -> DataFrame:
    """Rows numbered from 0 by a unique orderable column, through counts per coarse
    slice of it: only slice counts (at most ``buckets``) meet in one task."""
    edges = df.agg(F.percentile_approx(F.col(order).cast("timestamp").cast("long") if dict(df.dtypes)[order] == "date" else F.col(order).cast("double"), [k / buckets for k in range(1, buckets)], 1000)).first()[0]
    key = F.col(order).cast("timestamp").cast("long") if dict(df.dtypes)[order] == "date" else F.col(order).cast("double")
    cuts = sorted(set(edges or []))
    slice_no = F.aggregate(F.array(*[F.lit(c) for c in cuts]), F.lit(0), lambda a, c: a + F.when(c < key, 1).otherwise(0)) if cuts else F.lit(0)
    own = df.withColumn("_s", slice_no)
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    base = own.groupBy("_s").agg(F.count("*").alias("_c")).withColumn("_base", F.coalesce(F.sum("_c").over(before), F.lit(0))).select("_s", "_base")
    row = F.row_number().over(Window.partitionBy("_s").orderBy(order)) - 1
    return own.withColumn("_r", row).join(F.broadcast(base), "_s").withColumn(name, (F.col("_base") + F.col("_r")).cast("bigint")).drop("_s", "_r", "_base")  # at most ``buckets`` rows


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def newest_valid(df: DataFrame, keys: list[str], valid: Column, order: list[Column]) -> DataFrame:
    """The newest valid row of each key: validity first, so an older valid row can win."""
    return top_per(df.where(valid), keys, order, 1)


def round_robin(df: DataFrame, group: list[str], within: list[Column], then: list[Column], limit: int | None = None) -> DataFrame:
    """The best of every group first, then the second best of each, and so on."""
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(*group).orderBy(*within)))
    out = ranked.orderBy("turn", *then)
    return out.limit(limit) if limit is not None else out


def price_features(prices: DataFrame, key: list[str], order: str = "date") -> DataFrame:
    """Returns over 1 and 5 rows, 5/20 mean ratio, 10-row annualised volatility, volume
    over its 5-row mean, and the 5-row-ahead label; null until a frame is full. Of
    duplicate dates the last by ``arrival`` (where there is such a column) stays."""
    w = Window.partitionBy(*key).orderBy(order)

    def full(n: int, c: Column, f) -> Column:
        frame = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count(c).over(frame) == n, f(c).over(frame))

    one = F.try_divide(F.col("close"), F.lag("close", 1).over(w)) - 1
    out = prices.withColumn("return_1", one).withColumn("return_5", F.try_divide(F.col("close"), F.lag("close", 5).over(w)) - 1)
    return (
        out.withColumn("trend", F.try_divide(full(5, F.col("close"), F.avg), full(20, F.col("close"), F.avg)) - 1)
        .withColumn("volatility", full(10, F.col("return_1"), F.stddev_samp) * F.sqrt(F.lit(252.0)))
        .withColumn("volume_ratio", F.try_divide(F.col("volume"), F.nullif(full(5, F.col("volume"), F.avg), F.lit(0.0))))
        .withColumn("ahead", F.try_divide(F.lead("close", 5).over(w), F.col("close")) - 1)
        .withColumn("target", F.when(F.col("ahead").isNotNull(), (F.col("ahead") > 0).cast("int")))
        .withColumn("row", F.row_number().over(w))
        .drop("ahead")
    )


def keep_last(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    return top_per(df, keys, [F.desc(arrival)], 1)


def exclusive(df: DataFrame, keys: list[str], idx: str, gap: int) -> DataFrame:
    """Greedy exclusivity: in order of idx keep a row if no kept row of its keys lies
    fewer than ``gap`` before it; others name the row that suppressed them.

    The rule depends on what was kept before, so it folds over the sorted indexes of
    a key; one index per row is held, and a key has one row per session at most.
    """
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<struct<idx:bigint,kept:boolean,by:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        ok = acc["last"].isNull() | (x - acc["last"] >= gap)
        row = F.struct(x.alias("idx"), ok.alias("kept"), F.when(~ok, acc["last"]).alias("by"))
        return F.struct(F.when(ok, x).otherwise(acc["last"]).alias("last"), F.concat(acc["out"], F.array(row)).alias("out"))

    sorted_idx = df.groupBy(*keys).agg(F.sort_array(F.collect_set(F.col(idx).cast("bigint"))).alias("_i"))
    folded = sorted_idx.select(*keys, F.explode(F.aggregate("_i", start, step, lambda a: a["out"])).alias("_e"))
    return folded.select(*keys, F.col("_e.idx").alias(idx), F.col("_e.kept").alias("kept"), F.col("_e.by").alias("suppressed_by"))


def rate_limited(df: DataFrame, keys: list[str], at: str, limit: int, seconds: int) -> DataFrame:
    """Sliding rate limit: accept a request if fewer than ``limit`` accepted ones lie
    in the last ``seconds``; only accepted ones count. Times are long seconds."""
    start = F.struct(F.array().cast("array<bigint>").alias("live"), F.array().cast("array<struct<at:bigint,ok:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        live = F.filter(acc["live"], lambda t: t > x - seconds)
        ok = F.size(live) < limit
        return F.struct(F.when(ok, F.concat(live, F.array(x))).otherwise(live).alias("live"), F.concat(acc["out"], F.array(F.struct(x.alias("at"), ok.alias("ok")))).alias("out"))

    folded = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(at).cast("bigint"))).alias("_t"))
    out = folded.select(*keys, F.explode(F.aggregate("_t", start, step, lambda a: a["out"])).alias("_e"))
    return out.select(*keys, F.col("_e.at").alias(at), F.col("_e.ok").alias("accepted"))
