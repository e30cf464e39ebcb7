"""Vector tables for the search operators: validity, dealing into blocks, top-k."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = "query_id bigint, vec_id bigint, score {}"


def usable(df: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part: not null, every
    component a finite number, of the commonest length, nonzero if asked; a null
    vec_id takes no part, and of rows that share one the least vector stays."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = df.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    out = out.where(~F.coalesce(bad, F.lit(True)))
    if nonzero:
        out = out.where(F.exists("v", lambda x: x != 0))
    common = out.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return out.join(F.broadcast(common.select("n")), F.size("v") == F.col("n")).groupBy("vec_id").agg(F.min("v").alias("v"))


def is_query() -> Column:
    return F.col("vec_id") % 50 == 0


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def deal(rows: DataFrame, sizes: DataFrame, keys: list[str], own: str, other: str) -> DataFrame:
    """Adds block numbers: ``own`` by a hash of vec_id, and a copy of the row for each
    ``other`` block, where ``sizes`` has the number of blocks of each (_own, _other)."""
    out = rows.join(sizes, keys)
    return out.withColumn(own, F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("_" + own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_" + other) - 1))).drop("_" + own, "_" + other)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Per row of scores the columns of its k best, ties to the smaller id."""
    n = scores.shape[1]
    if n <= k:
        return np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(scores), k), np.int64)
    for r in range(len(scores)):
        at = np.flatnonzero(scores[r] >= kth[r])
        out[r] = at[np.lexsort((ids[at], -scores[r, at]))[:k]]
    return out


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, from a few per block."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
