"""Shared plumbing of the training-data operators: tables, scratch tables, hashes.

Scratch tables live under ``spark.checkpoint.dir`` (the folder every executor
shares); a folder of our own is set only where that setting is absent, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import send_package

#: Largest side, in rows of at most some hundred bytes (keys and ids), that is sent to
#: every executor: 64 MB.
BROADCAST_ROWS = 400_000

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    send_package(spark)
    # whole texts are long rows: fewer of them per Arrow batch bound the memory of a task
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, as the session names it."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="newsloom-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/newsloom/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through a written table: survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table; call only when no open DataFrame reads one."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the counted size is under the bound."""
    return F.broadcast(df) if rows <= limit else df


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the undirected edge list (a, b); root is
    the least node of its connected component.

    Alternating large-star and small-star rounds, each a grouped minimum over the
    edge list (hot hubs are pre-aggregated), each written to a shared table; the
    number of rounds is logarithmic in the longest path.
    """
    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u")
        e = durable(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(own.select("u", F.col("m").alias("v"))).distinct(),
            name,
        )
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
