"""Domain views over the sample tables, each once for Spark and once as SQL.

The sample tables hold no company news, so every operator runs on a deterministic
view of them. ``VIEWS`` has the SQL twin of each view for the oracle; the literals are
shared, so both sides read the same headlines and phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Headlines that the text rules are exercised with, one by doc_id modulo their count.
HEADLINES = (
    "Acme Corporation announces third quarter financial results",
    "Acme shares surge 12% after earnings beat",
    "Why Acme should buy a startup",
    "Acme Corporation acquires Globex for $3 billion",
    "Regulator opens antitrust probe into Acme Corporation",
    "Acme Corporation cuts full year guidance",
    "Globex Advisors LLC sells 1,200 shares of Acme Corporation",
    "Acme stock price prediction for next year",
    "Acme Corporation sued over patent infringement lawsuit",
    "Opinion: Acme Corporation is overvalued",
    "Acme Corporation revenue jumps 40% in fiscal 2024 results",
    "Acme Corporation names new chief executive officer",
    "Pension fund exits Acme Corporation stake",
    "Acme Corporation raises $500 million in bond sale",
    "Export control rules tighten chip shipments",
    "Acme Corporation launches cloud platform",
    "Supplier shortage hits Acme Corporation output",
    "Acme Corporation CFO sells shares under 10b5-1 plan",
    "Stocks making the biggest moves midday",
    "Acme Corporation data breach exposes accounts",
    "Globex drops 33% after weak outlook",
    "Acme Corporation files Form 10-K with the SEC",
)
#: Downside phrases that reach every theme and none.
CHANNELS = (
    "new export controls limit sales",
    "ransomware attack on suppliers",
    "antitrust regulators review pricing",
    "class action lawsuit by holders",
    "supply shortage of parts",
    "customer concentration in one region",
    "weaker demand for devices",
    "rivals cut prices",
    "guidance cut ahead",
    "capex grows faster than sales",
    "integration risk after the merger",
    "leadership departure is near",
    "inflation lifts costs",
    "the weather was fine",
)
EVENT_TYPES = ("earnings", "acquisition", "investment", "regulation", "litigation", "product_launch", "partnership", "management_change", "supply_disruption", "contract_award", "contract_loss", "financing", "analyst_or_guidance_change", "macroeconomic_exposure", "other", "uncertain")
DIRECTIONS = ("positive", "negative", "mixed", "neutral", "uncertain")
HORIZONS = ("immediate", "days", "weeks", "months", "long_term", "uncertain")
PUBLISHERS = ("Reuters", "The Register", "Acme Blog", "SEC", "Daily Post", "Seeking Alpha", "Bloomberg", "Nvidia Newsroom", "CNBC TV18", "Motley Fool", "unknown source", "Tom's Hardware")

AS_OF = "2024-01-31 00:00:00"


def quoted(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def pick(words: tuple[str, ...], number: Column) -> Column:
    """words[number mod their count]; one literal array, so no branch per word."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(number, F.lit(len(words))) + 1).cast("int"))


def _sql_pick(words: tuple[str, ...], number: str) -> str:
    return f"({quoted(words)})[CAST(({number}) % {len(words)} AS INTEGER) + 1]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    polarity = (k - 50) / 50
    e = table(spark, sf_dir, "events").withColumn("p", polarity)
    return e.select(
        F.col("event_id").alias("article_id"),
        F.concat(F.lit("T"), F.col("user_id") % 5).alias("ticker"),
        F.concat(F.lit("src"), F.col("user_id") % 20).alias("source"),
        F.col("ts").cast("timestamp").alias("published_at"),
        F.greatest("p", F.lit(0.0)).alias("positive"),
        F.greatest(-F.col("p"), F.lit(0.0)).alias("negative"),
        (1 - F.abs("p")).alias("neutral"),
        F.col("p").alias("sentiment_score"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("relevance"),
        F.col("event_type").alias("state"),
    )


def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("article_id"),
        F.concat(F.lit("T"), F.col("doc_id") % 3).alias("ticker"),
        pick(HEADLINES, F.col("doc_id")).alias("title"),
        pick(PUBLISHERS, F.expr("doc_id div 7")).alias("source"),
        F.concat(F.lit("https://news.example.com/"), F.expr("doc_id div 2"), F.lit("?utm_source=x")).alias("url"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 2220).alias("published_at"),
        (F.col("doc_id") % 101 / 100).alias("relevance"),
        (F.col("doc_id") % 29 == 0).alias("is_demo"),
    )


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = headline(spark, sf_dir)
    i = F.col("article_id")
    return h.select(
        "*",
        pick(EVENT_TYPES, i).alias("event_type"),
        pick(DIRECTIONS, F.expr("article_id div 3")).alias("direction"),
        pick(HORIZONS, F.expr("article_id div 5")).alias("time_horizon"),
        ((i * 7 % 21) * 5 / 100).alias("magnitude"),
        ((i * 11 % 21) * 5 / 100).alias("confidence"),
        ((i * 13 % 21) * 5 / 100).alias("evidence_strength"),
        F.pmod(i, F.lit(4)).cast("int").alias("claims_corroborated"),
        F.when(i % 9 == 0, 1).otherwise(0).alias("claims_contradicted"),
        F.array(pick(CHANNELS, i), pick(CHANNELS, F.expr("article_id div 2"))).alias("channels"),
    )


def price(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("date", F.col("o_orderdate").cast("date"))
    out = o.groupBy("date").agg(F.avg(F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))).alias("close"), F.avg("o_totalprice").alias("benchmark"), F.count("*").cast("double").alias("volume"))
    return out.where("close is not null")


def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trading calendar: sessions numbered from 0, each with its close."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    number = F.row_number().over(Window.orderBy("date")) - 1  # a dimension: one row per trading day
    return days.withColumn("idx", number.cast("bigint")).withColumn("close_at", F.expr("cast(date as timestamp) + interval 16 hours"))


def session_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("article_id"),
        F.concat(F.lit("S"), F.col("l_suppkey") % 4).alias("ticker"),
        F.col("l_suppkey").cast("string").alias("source"),
        (F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + F.col("l_partkey") % 24 * 3600).alias("published_s"),
        ((F.col("l_discount") - 0.05) / 0.05).alias("polarity"),
        (F.col("l_linenumber") == 7).alias("date_only"),
    )


def reaction_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of the event study: lines of an order share addresses in threes, titles
    and publishers repeat, some rows are demos, lack a time or have impossible shares."""
    li = table(spark, sf_dir, "lineitem")
    p = (F.col("l_discount") - 0.05) / 0.05
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("article_id"),
        F.concat(F.lit("S"), F.col("l_suppkey") % 4).alias("ticker"),
        pick(HEADLINES, F.col("l_partkey")).alias("title"),
        pick(PUBLISHERS, F.expr("l_suppkey div 4")).alias("source"),
        F.concat(F.lit("https://news.example.com/"), F.col("l_orderkey"), F.lit("/"), F.expr("l_linenumber div 3"), F.lit("?utm_source=x")).alias("url"),
        F.when(F.col("l_tax") != 0.07, F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + F.col("l_partkey") % 24 * 3600).alias("published_s"),
        (F.col("l_linenumber") == 7).alias("date_only"),
        (F.col("l_orderkey") % 29 == 0).alias("is_demo"),
        F.when(F.col("l_quantity") == 13, 2.0).otherwise(F.greatest(p, F.lit(0.0))).alias("positive"),
        F.greatest(-p, F.lit(0.0)).alias("negative"),
        (1 - F.abs(p)).alias("neutral"),
    )


_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
VIEWS = {
    "v_scored_article": f"""SELECT event_id AS article_id, 'T' || (user_id % 5) AS ticker, 'src' || (user_id % 20) AS source, ts AS published_at,
      greatest(({_K} - 50) / 50, 0.0) AS positive, greatest(-({_K} - 50) / 50, 0.0) AS negative, 1 - abs(({_K} - 50) / 50) AS neutral,
      ({_K} - 50) / 50 AS sentiment_score, least(value / 500, 1.0) AS relevance, event_type AS state FROM events""",
    "v_headline": f"""SELECT doc_id AS article_id, 'T' || (doc_id % 3) AS ticker, {_sql_pick(HEADLINES, 'doc_id')} AS title, {_sql_pick(PUBLISHERS, 'doc_id // 7')} AS source,
      'https://news.example.com/' || (doc_id // 2) || '?utm_source=x' AS url, epoch_ms((1704067200 + doc_id * 2220) * 1000) AS published_at, (doc_id % 101) / 100.0::DOUBLE AS relevance, doc_id % 29 = 0 AS is_demo FROM documents""",
    "v_analysis": f"""SELECT *, {_sql_pick(EVENT_TYPES, 'article_id')} AS event_type, {_sql_pick(DIRECTIONS, 'article_id // 3')} AS direction, {_sql_pick(HORIZONS, 'article_id // 5')} AS time_horizon,
      ((article_id * 7 % 21) * 5)::DOUBLE / 100 AS magnitude, ((article_id * 11 % 21) * 5)::DOUBLE / 100 AS confidence, ((article_id * 13 % 21) * 5)::DOUBLE / 100 AS evidence_strength,
      CAST(article_id % 4 AS INTEGER) AS claims_corroborated, CASE WHEN article_id % 9 = 0 THEN 1 ELSE 0 END AS claims_contradicted,
      [{_sql_pick(CHANNELS, 'article_id')}, {_sql_pick(CHANNELS, 'article_id // 2')}] AS channels FROM v_headline""",
    "v_price": "SELECT * FROM (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) FILTER (o_orderstatus <> 'F') AS close, avg(o_totalprice) AS benchmark, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1) WHERE close IS NOT NULL",
    "v_session": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, CAST(date AS TIMESTAMP) + INTERVAL 16 HOUR AS close_at FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)",
    "v_session_article": """SELECT l_orderkey || '-' || l_linenumber AS article_id, 'S' || (l_suppkey % 4) AS ticker, CAST(l_suppkey AS VARCHAR) AS source,
      CAST(epoch(l_shipdate) AS BIGINT) + l_partkey % 24 * 3600 AS published_s, (l_discount - 0.05) / 0.05 AS polarity, l_linenumber = 7 AS date_only FROM lineitem""",
    "v_reaction_article": f"""SELECT l_orderkey || '-' || l_linenumber AS article_id, 'S' || (l_suppkey % 4) AS ticker, {_sql_pick(HEADLINES, 'l_partkey')} AS title, {_sql_pick(PUBLISHERS, 'l_suppkey // 4')} AS source,
      'https://news.example.com/' || l_orderkey || '/' || (l_linenumber // 3) AS address, CASE WHEN l_tax <> 0.07 THEN CAST(epoch(l_shipdate) AS BIGINT) + l_partkey % 24 * 3600 END AS published_s,
      (l_discount - 0.05) / 0.05 AS polarity, l_linenumber = 7 AS date_only, l_orderkey % 29 = 0 AS is_demo, l_quantity <> 13 AS valid FROM lineitem""",
}
_NEEDS = {"v_analysis": ("v_headline",)}


def with_views(sql: str) -> str:
    """The SQL with the views that it names defined in front."""
    used: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            need(other)
        if name not in used:
            used.append(name)

    for name in VIEWS:
        if name in sql:
            need(name)
    if not used:
        return sql
    head = ", ".join(f"{name} AS ({VIEWS[name]})" for name in used)
    text = sql.strip()
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {text[14:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {head}, {text[5:]}"
    return f"WITH {head} {text}"
