"""Sources and sinks: every reader takes a path that Spark can open and a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEMO = "published_hours_ago double, title string, source string, url string"
PRICES = "date date, close double, volume double"
REQUEST = "ticker string, kind string, requested_at timestamp"
#: Fixed value: the shape of a request key.
REQUEST_KEY = r"([a-z_]+)/([A-Z][A-Z0-9.-]{0,9})\.json$"


def demo_articles(spark: SparkSession, path: str, as_of: str, company: str, symbol: str) -> DataFrame:
    """A JSON template list: relative hours become instants, placeholders the names,
    every row is marked as demo."""
    rows = spark.read.schema(DEMO).option("multiLine", True).json(path)
    at = F.timestamp_micros(F.unix_micros(F.lit(as_of).cast("timestamp")) - (F.col("published_hours_ago") * 3.6e9).cast("bigint"))
    return rows.select(
        F.replace("title", F.lit("{company}"), F.lit(company)).alias("title"), "source",
        F.replace("url", F.lit("{symbol}"), F.lit(symbol)).alias("url"), at.alias("published_at"), F.lit(True).alias("is_demo"),
    )


def price_history(spark: SparkSession, path: str, least: int = 150) -> DataFrame:
    """CSV bars: a null close drops the row, a null volume is 0; too few bars raise."""
    rows = spark.read.schema(PRICES).option("header", True).csv(path).where("close is not null").withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    if rows.limit(least).count() < least:
        raise ValueError(f"fewer than {least} bars")
    return rows


def tab_separated(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Headerless TSV with a fixed number of columns; rows of another width go."""
    rows = spark.read.text(path).select(F.split("value", "\t", -1).alias("c")).where(F.size("c") == columns)
    return rows.select(*[F.col("c")[i].alias(f"c{i}") for i in range(columns)])


def requests(spark: SparkSession, folder: str, limit: int = 2000) -> DataFrame:
    """A folder of JSON requests whose file names follow the key grammar, in key order,
    at most ``limit`` of them."""
    rows = spark.read.schema(REQUEST).option("recursiveFileLookup", True).json(folder).withColumn("path", F.col("_metadata.file_path"))
    ok = rows.where(F.col("path").rlike(REQUEST_KEY))
    key = F.concat_ws("/", F.regexp_extract("path", REQUEST_KEY, 1), F.regexp_extract("path", REQUEST_KEY, 2))
    return ok.withColumn("key", key).orderBy("key").limit(limit)


def cached_json(spark: SparkSession, path: str, schema: str, now: Column, ttl_hours: int, stale_allowed: bool) -> DataFrame:
    """Rows of a cache file younger than its time to live, or any when stale is fine."""
    rows = spark.read.schema(schema).json(path).withColumn("_at", F.col("_metadata.file_modification_time"))
    fresh = F.col("_at") >= now - F.expr(f"interval {ttl_hours} hours")
    return rows.where(F.lit(stale_allowed) | fresh).drop("_at")


def with_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """The primary's rows, or the secondary's where it has none."""
    return secondary if primary.isEmpty() else primary


def verified(spark: SparkSession, manifest: str, folder: str) -> DataFrame:
    """Files of a snapshot whose SHA-256 equals the manifest's (name, sha256)."""
    want = spark.read.schema("name string, sha256 string").json(manifest)
    have = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return want.join(have, "name", "left").select("name", F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)).alias("valid"))


def snapshot(df: DataFrame, folder: str, key: str) -> DataFrame:
    """Writes a consistent copy and returns its row counts per key, read back."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.parquet(folder).groupBy(key).agg(F.count("*").alias("n"))


def publish(df: DataFrame, root: str, stamp: str) -> str:
    """Content-addressed version: the stamp and a digest of the rows, whatever their
    order; writing the same rows again writes the same version."""
    rows = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)]).cast("decimal(38,0)")
    total, n = df.agg(F.sum(rows), F.count("*")).first()
    name = f"{stamp}-{(int(total or 0) * 1_000_003 + n) % 16**12:012x}"
    df.write.mode("overwrite").parquet(f"{root}/{name}")
    return name


def report(df: DataFrame, path: str) -> None:
    """A JSON report as one file of lines."""
    df.coalesce(1).write.mode("overwrite").json(path)
