"""Session helpers: a tuned builder, and sending the package to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def build(name: str = "newsloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC; everything else is
    left to the cluster."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return b.config(map=conf).getOrCreate()


def written(df: DataFrame, name: str = "core") -> DataFrame:
    """The rows as a written table in the folder that the cluster shares: they are worked
    out once, and the loss of an executor costs none of them. Outside a cluster a folder
    of our own serves where none is set."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="newsloom-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/newsloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def send_package(spark: SparkSession) -> None:
    """Python workers import the package from a zip that Spark distributes, wherever
    the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="newsloom-"), "newsloom_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("newsloom", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _sent.add(sc.applicationId)
