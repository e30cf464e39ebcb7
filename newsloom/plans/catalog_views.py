"""Queries of the views over the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import adapters as A
from newsloom.operators import reaction, views
from newsloom.plans.catalog import _SIGNALS, _second, _signals, query, r6
from newsloom.plans.catalog_ops import _CORROBORATED, _assessed

_HAS = "(SELECT DISTINCT article_id FROM v_scored_article WHERE relevance > 0.5 AND state = 'view')"


@query(f"SELECT a.article_id, source, CASE WHEN positive >= negative AND positive >= neutral THEN 'positive' WHEN negative >= neutral THEN 'negative' ELSE 'neutral' END AS label, h.article_id IS NOT NULL AS has_compatible_analysis FROM v_scored_article a LEFT JOIN {_HAS} h USING (article_id)")
def prj3_news_rows(spark, sf_dir):
    a = A.scored_article(spark, sf_dir)
    v = views.news_rows(a, a.where("relevance > 0.5 and state = 'view'"))
    return v.select("article_id", "row.source", "row.label", "has_compatible_analysis")


@query(_CORROBORATED + """SELECT article_id, CASE WHEN mag >= 0.8 THEN 'High' WHEN mag >= 0.55 THEN 'Medium' ELSE 'Low' END AS band, CAST(round_even(mag * 100, 0) AS INTEGER) AS impact_score, CASE external WHEN 0 THEN 'None found' WHEN 1 THEN '1 external source' ELSE external || ' external sources' END AS metric,
CAST(total - corroborated - contradicted AS INTEGER) AS unresolved FROM (SELECT *, ((article_id * 7 % 21) * 5)::DOUBLE / 100 AS mag FROM r)""")
def cmp8_development_cards(spark, sf_dir):
    a = _assessed(spark, sf_dir).withColumn("magnitude", ((F.col("article_id") * 7 % 21) * 5).cast("double") / 100)
    c = views.cards(a)
    band = F.when(F.col("impact_score") >= 80, "High").when(F.col("impact_score") >= 55, "Medium").otherwise("Low")
    return c.select("article_id", band.alias("band"), "impact_score", "metric", "corroboration.unresolved")


@query("""SELECT article_id, CAST(row_number() OVER (PARTITION BY ticker ORDER BY relevance DESC, article_id) AS INTEGER) AS rank, CASE WHEN i >= 70 THEN 'Severe' WHEN i >= 50 THEN 'Elevated' WHEN i >= 30 THEN 'Moderate' ELSE 'Watch' END AS band,
CASE WHEN length(t) > 180 THEN rtrim(left(t, 180)) || '…' ELSE t END AS shown FROM (SELECT *, article_id * 7 % 101 AS i, repeat(title || ' ', CAST(article_id % 7 AS INTEGER)) || title AS t FROM v_headline)""")
def prj5_risk_rows(spark, sf_dir):
    h = A.headline(spark, sf_dir).withColumn("concern_index", F.col("article_id") * 7 % 101)
    h = h.withColumn("summary", F.concat(F.repeat(F.concat("title", F.lit(" ")), F.pmod("article_id", F.lit(7)).cast("int")), "title"))
    return views.risk_rows(h, ["ticker"], [F.desc("relevance"), F.col("article_id")]).select("article_id", "rank", "band", "shown")


@query("""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(c_custkey AS VARCHAR) AS symbol, CASE WHEN n = 1 THEN '1 article' WHEN n > 1 THEN n || ' articles' WHEN c_acctbal < 0 THEN 'requested' ELSE 'not covered' END AS label FROM customer LEFT JOIN n ON o_custkey = c_custkey""")
def prj8_search_labels(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    members = c.select(F.col("c_custkey").cast("string").alias("symbol"))
    n = A.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("symbol")).agg(F.count("*").alias("n"))
    return views.search_labels(members, n, c.where("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("symbol")))


@query("SELECT article_id, CAST(row_number() OVER (PARTITION BY ticker ORDER BY published_at, article_id) AS INTEGER) AS place FROM v_scored_article WHERE state IN ('view', 'click')")
def mis7_ordered_lists(spark, sf_dir):
    return views.in_order(A.scored_article(spark, sf_dir), ["view", "click"], ["published_at", "article_id"]).select("article_id", "place")


_NOW = 1706659200


@query(f"""SELECT article_id, CASE WHEN due AND article_id % 5 <> 0 AND article_id % 7 <> 0 THEN CASE WHEN article_id % 4 = 0 THEN 'changed' ELSE 'current' END END AS evidence, CASE WHEN due AND article_id % 5 <> 0 AND article_id % 7 <> 0 THEN {_NOW} ELSE checked END AS checked_s
FROM (SELECT article_id, CASE WHEN article_id % 3 <> 0 THEN article_id END AS checked, article_id % 3 = 0 OR epoch(published_at) >= {_NOW} - 20 * 86400 AS due FROM v_headline)""")
def mis23_evidence_checks(spark, sf_dir):
    h = A.headline(spark, sf_dir)
    jobs = h.select("article_id", _second("published_at").alias("published_s"), F.when(F.col("article_id") % 3 != 0, F.col("article_id")).alias("checked_s"))
    stored = h.where("article_id % 5 <> 0").select("article_id", F.lit("f").alias("fingerprint"))
    current = h.where("article_id % 7 <> 0").select("article_id", F.when(F.col("article_id") % 4 == 0, "g").otherwise("f").alias("fingerprint"))
    return views.evidence_checked(jobs, stored, current, F.lit(_NOW).cast("bigint"), 20 * 86400)


@query("""WITH k AS (SELECT 'C' || (o_custkey % 5) AS ticker, CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS score FROM orders GROUP BY 1, 2)
SELECT ticker, CAST(date AS VARCHAR) AS date, score FROM k WHERE date BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'""")
def mis28_observed_only(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), F.col("o_custkey") % 5).alias("ticker"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("score"), "o_orderkey")
    v = views.observed_only(o, F.lit("1995-01-01").cast("date"), F.lit("1996-06-30").cast("date"), "o_orderkey")
    return v.select("ticker", F.col("date").cast("string").alias("date"), "score")


@query("""WITH e AS (SELECT 'C' || (o_custkey % 7) AS ticker, o_custkey AS c, CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS idx, o_totalprice AS value, o_orderkey % 3 > 0 AS exact_timing, o_orderkey FROM orders),
d AS (SELECT ticker, idx, avg(value) AS value, max(CAST(exact_timing AS INTEGER)) = 1 AS exact_timing, count(*) AS articles FROM e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY idx) AS r, count(*) OVER (PARTITION BY ticker) AS n FROM d)
SELECT ticker, count(*) AS resolved, round(avg(CAST(NOT exact_timing AS INTEGER)), 6) AS lagged_share, round(avg(value) FILTER (idx < 1200), 4) AS mean_before, round(avg(value) FILTER (idx >= 1200), 4) AS mean_from,
  CASE WHEN count(*) >= 2 THEN max(idx) FILTER (r = n // 2) < 1200 AND max(idx) FILTER (r = n // 2 + 1) >= 1200 END AS straddles, median(articles) AS median_articles FROM r GROUP BY 1""")
def mis41_lineage(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    e = o.select(F.concat(F.lit("C"), F.col("o_custkey") % 7).alias("ticker"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("idx"), "o_totalprice", (F.col("o_orderkey") % 3 > 0).alias("x"))
    d = e.groupBy("ticker", "idx").agg(F.avg("o_totalprice").alias("value"), (F.max(F.col("x").cast("int")) == 1).alias("exact_timing"), F.count("*").alias("articles"))
    v = views.lineage(d, 1200)
    return v.select("ticker", "resolved", r6("lagged_share").alias("lagged_share"), F.round("mean_before", 4).alias("mean_before"), F.round("mean_from", 4).alias("mean_from"), "straddles", "median_articles")


@query(_SIGNALS.rstrip() + """, x AS (SELECT s.*, t.tau, CASE WHEN signal >= t.tau THEN 'positive' WHEN signal <= -t.tau THEN 'negative' END AS regime FROM signals s, (SELECT unnest([0.2, 0.4]) AS tau) t)
SELECT ticker, CAST(tau AS DOUBLE) AS tau, regime, count(*) AS tail_sessions, count(*) FILTER (sources >= 3) AS with_3_sources FROM x WHERE regime IS NOT NULL GROUP BY 1, 2, 3""")
def agg24_readiness(spark, sf_dir):
    return views.readiness(_signals(spark, sf_dir), (0.2, 0.4), 2406).select("ticker", "tau", "regime", "tail_sessions", "with_3_sources")


@query("""SELECT article_id, ticker, title, source, event_type, magnitude, CAST(article_id % 2 = 0 AS BOOLEAN) AS material, 'r' || (article_id % 3) AS reason, CAST(article_id // 4 AS BIGINT) AS group_id FROM v_analysis""")
def prj4_gold_round_trip(spark, sf_dir):
    a = A.analysis(spark, sf_dir)
    i = F.col("article_id")
    labelled = a.select("*", (i % 2 == 0).alias("material"), F.concat(F.lit("r"), i % 3).alias("reason"), F.expr("article_id div 4").alias("group_id"))
    return views.from_gold(views.gold_records(labelled)).select("article_id", "ticker", "title", "source", "event_type", "magnitude", "material", "reason", "group_id")


@query("""WITH r AS (SELECT doc_id // 2 * 2 AS article_id, doc_id, CASE WHEN doc_id % 10 < 4 THEN doc_id % 2 = 0 END AS m FROM documents WHERE doc_id % 2 = 0 OR doc_id % 10 = 7)
SELECT article_id, CASE WHEN count(*) > 1 THEN 'duplicate_id' ELSE 'unlabelled' END AS fault FROM r GROUP BY 1 HAVING count(*) > 1 OR max(CAST(m IS NULL AS INTEGER)) = 1""")
def mis35_gold_faults(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").where("doc_id % 2 = 0 or doc_id % 10 = 7")
    r = d.select(F.expr("doc_id div 2 * 2").alias("article_id"), F.struct(F.when(F.col("doc_id") % 10 < 4, F.col("doc_id") % 2 == 0).alias("material")).alias("label"))
    return views.gold_faults(r)


@query(None)
def top15_spaced_sample(spark, sf_dir):
    s = A.session(spark, sf_dir).select(F.lit("all").alias("k"), "idx")
    return views.spaced_sample(s, ["k"], "idx", reaction.GAP, 7)
