"""Provider payloads as tables: windowed JSON, member tables in HTML, SQLite files."""

from __future__ import annotations

import os
import sqlite3
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import formats

ARTICLES = "articles array<struct<url:string,title:string,seendate:string,domain:string>>"


def windowed_articles(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, outcome) of the payloads (window int, body string) of one fetch.

    Windows are used in order up to the first that does not parse or has no list of
    articles. Articles: window, url, title, source, published_at (null if no format
    fits). Outcome, one row: windows, failed_window, status (healthy, degraded,
    unavailable). No payloads give no articles and a degraded outcome.
    """
    p = payloads.withColumn("p", F.from_json("body", ARTICLES)).withColumn("failed", F.col("p").isNull() | F.col("p.articles").isNull())
    first = p.agg(F.count("*").alias("windows"), F.min(F.when(F.col("failed"), F.col("window"))).alias("failed_window"), F.max(F.size(F.coalesce("p.articles", F.array()))).alias("_most"))
    used = p.join(F.broadcast(first.select("failed_window")), F.col("failed_window").isNull() | (F.col("window") < F.col("failed_window")))  # one row
    rows = used.select("window", F.explode("p.articles").alias("a"))
    articles = rows.select("window", "a.url", "a.title", F.col("a.domain").alias("source"), formats.parsed_stamp(F.col("a.seendate")).alias("published_at"))
    got = used.agg(F.sum(F.size("p.articles")).alias("n"))
    status = F.when(F.coalesce("n", F.lit(0)) == 0, F.when(F.col("failed_window").isNotNull(), "unavailable").otherwise("degraded")).when(F.col("failed_window").isNotNull(), "degraded").otherwise("healthy")
    outcome = first.crossJoin(F.broadcast(got)).select("windows", "failed_window", status.alias("status"))  # a row each
    return articles, outcome


def _shown(cell: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(cell, "(?s)<[^>]*>", " "), r"\[[^\]]*\]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "&amp;", "&"), r"\s+", " "))


def member_table(pages: DataFrame, symbol_header: str, name_header: str, market: str, suffix: str = "") -> DataFrame:
    """(symbol, feed_symbol, name, market) from the table with id ``constituents`` of
    pages (html): columns are found by their headers, footnote marks go, rows without
    either value go. A page without the table or a header gives no rows; compare the
    count with the expected minimum before use."""
    rows = F.regexp_extract_all(F.regexp_extract("html", r"""(?is)<table\b[^>]*\bid=["']?constituents["']?[^>]*>(.*?)</table>""", 1), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), _shown)
    t = pages.select(F.transform(rows, cells).alias("rows")).where(F.size("rows") > 1)
    t = t.withColumn("head", F.get("rows", F.lit(0))).withColumn("s", F.array_position("head", symbol_header)).withColumn("n", F.array_position("head", name_header)).where("s > 0 and n > 0")
    body = t.select("s", "n", F.explode(F.slice("rows", F.lit(2), F.size("rows"))).alias("row"))
    out = body.select(F.get("row", (F.col("s") - 1).cast("int")).alias("symbol"), F.get("row", (F.col("n") - 1).cast("int")).alias("name")).where("symbol <> '' and name <> ''")
    feed = F.concat(F.col("symbol"), F.lit(suffix)) if suffix else F.regexp_replace("symbol", r"\.", "-")
    return out.select("symbol", feed.alias("feed_symbol"), "name", F.lit(market).alias("market"))


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """The rows of a table in SQLite files, read-only. Each file comes through Spark's
    reader and is one task's work; files are small stores, at most 2 GB each. Columns
    that a file lacks are null, others are ignored."""
    names = spark.createDataFrame([], schema).columns

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pages:
            for data in pdf["content"]:
                with tempfile.NamedTemporaryFile(suffix=".db") as f:
                    f.write(data)
                    f.flush()
                    db = sqlite3.connect(f"file:{os.path.abspath(f.name)}?mode=ro", uri=True)
                    try:
                        yield from (page.reindex(columns=names).astype(object) for page in pd.read_sql_query(f'select * from "{table}"', db, chunksize=10_000))
                    finally:
                        db.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def merged_providers(results: list[DataFrame], columns: list[str]) -> DataFrame:
    """The rows of all providers with their place in the list, before deduplication."""
    out = None
    for place, rows in enumerate(results):
        own = rows.select(*columns, F.lit(place).alias("provider_no"))
        out = own if out is None else out.unionByName(own)
    return out


def replaced(df: DataFrame, path: str) -> None:
    """Writes a cache whole: the new copy is complete before the old one goes, so a
    reader never sees part of either."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (path + ".next", path))
    fs = old.getFileSystem(conf)
    df.write.mode("overwrite").json(path + ".next")
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"could not replace {path}")
