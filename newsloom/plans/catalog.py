"""The query catalogue: one entry per operator, each with its SQL twin where SQL can
say the same. Queries run over whole tables; names start with the operator's id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom import adapters as A
from newsloom.functions import maths, rules, text
from newsloom.operators import asof, grouping, reaction, risk, sentiment, store, windows
from newsloom.session import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

COMPANY = ("Acme Corporation", "ACME")
NAMES = rules.names_of(*COMPANY)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = A.with_views(sql)
        return f

    return add


def r6(c) -> F.Column:
    """Six decimals, never minus zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def _now() -> F.Column:
    return F.lit(A.AS_OF).cast("timestamp")


def _second(c: str) -> F.Column:
    return F.unix_timestamp(c)


# --- daily sentiment ------------------------------------------------------------------

_DAILY = f"""
WITH w AS (
  SELECT *, CAST(published_at AS DATE) AS d, relevance
    * greatest(least(1 + (CASE WHEN positive > 0 THEN positive * ln(positive) ELSE 0 END + CASE WHEN negative > 0 THEN negative * ln(negative) ELSE 0 END + CASE WHEN neutral > 0 THEN neutral * ln(neutral) ELSE 0 END) / ln(3), 1.0), 0.0)
    * exp(-ln(2) / 24 * greatest((epoch_us(TIMESTAMP '{A.AS_OF}') - epoch_us(published_at)) / 3.6e9, 0)) AS w FROM v_scored_article
), m AS (
  SELECT ticker, d, sum(w) AS aw, sum(w * sentiment_score) / sum(w) AS score, sum(w * positive) / sum(w) AS positive_share, sum(w * negative) / sum(w) AS negative_share, count(*) AS article_count
  FROM w GROUP BY 1, 2 HAVING sum(w) > 0
), s AS (
  SELECT m.ticker, m.d, sqrt(sum(w.w * (w.sentiment_score - m.score) ** 2) / any_value(m.aw)) AS disagreement FROM w JOIN m USING (ticker, d) GROUP BY 1, 2
), daily AS (
  SELECT m.*, s.disagreement,
    avg(score) OVER (PARTITION BY ticker ORDER BY d RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS ma7,
    sum(score * aw) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / sum(aw) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS trend_3
  FROM m JOIN s USING (ticker, d)
)
"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.daily(A.scored_article(spark, sf_dir), A.AS_OF)


@query(_DAILY + "SELECT ticker, CAST(d AS VARCHAR) AS date, round(score, 6) AS score, round(positive_share, 6) AS positive_share, round(negative_share, 6) AS negative_share, article_count, round(ma7, 6) AS moving_average_7d, round(trend_3, 6) AS trend_3 FROM daily")
def agg3_daily_sentiment(spark, sf_dir):
    d = _daily(spark, sf_dir)
    return d.select("ticker", F.col("date").cast("string").alias("date"), r6("score").alias("score"), r6("positive_share").alias("positive_share"), r6("negative_share").alias("negative_share"), "article_count", r6("moving_average_7d").alias("moving_average_7d"), r6("trend_3").alias("trend_3"))


@query(_DAILY + "SELECT ticker, CAST(d AS VARCHAR) AS date, round(disagreement, 6) AS disagreement FROM daily")
def agg4_disagreement(spark, sf_dir):
    return _daily(spark, sf_dir).select("ticker", F.col("date").cast("string").alias("date"), r6("disagreement").alias("disagreement"))


@query("SELECT article_id, round(greatest(least(1 + (CASE WHEN positive > 0 THEN positive * ln(positive) ELSE 0 END + CASE WHEN negative > 0 THEN negative * ln(negative) ELSE 0 END + CASE WHEN neutral > 0 THEN neutral * ln(neutral) ELSE 0 END) / ln(3), 1.0), 0.0), 6) AS confidence FROM v_scored_article")
def mth1_confidence(spark, sf_dir):
    a = A.scored_article(spark, sf_dir)
    return a.select("article_id", r6(maths.confidence(F.col("positive"), F.col("negative"), F.col("neutral"))).alias("confidence"))


@query("SELECT article_id, round(greatest(least(positive - negative, 1.0), -1.0), 6) AS polarity, CASE WHEN positive >= negative AND positive >= neutral THEN 'positive' WHEN negative >= neutral THEN 'negative' ELSE 'neutral' END AS label FROM v_scored_article")
def mth2_polarity(spark, sf_dir):
    a = A.scored_article(spark, sf_dir)
    return a.select("article_id", r6(maths.polarity(F.col("positive"), F.col("negative"))).alias("polarity"), maths.argmax_label(F.col("positive"), F.col("negative"), F.col("neutral")).alias("label"))


@query("SELECT ticker, count(*) AS n FROM v_scored_article GROUP BY 1")
def agg1_counts_by_ticker(spark, sf_dir):
    return A.scored_article(spark, sf_dir).groupBy("ticker").agg(F.count("*").alias("n"))


@query("SELECT ticker, count(*) AS n, count(*) FILTER (is_demo) AS demo, CAST(min(epoch(published_at)) AS BIGINT) AS first_s, CAST(max(epoch(published_at)) AS BIGINT) AS last_s FROM v_headline GROUP BY 1")
def agg21_coverage_span(spark, sf_dir):
    h = A.headline(spark, sf_dir)
    return h.groupBy("ticker").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_demo"), 1)).alias("demo"), F.min(_second("published_at")).alias("first_s"), F.max(_second("published_at")).alias("last_s"))


@query("SELECT state, count(*) AS n, count(*) FILTER (relevance >= 0.5) AS relevant, count(*) FILTER (sentiment_score < 0) AS negative, round(avg(sentiment_score), 6) AS mean_score FROM v_scored_article GROUP BY 1")
def agg2_state_summary(spark, sf_dir):
    a = A.scored_article(spark, sf_dir)
    return a.groupBy("state").agg(F.count("*").alias("n"), F.count(F.when(F.col("relevance") >= 0.5, 1)).alias("relevant"), F.count(F.when(F.col("sentiment_score") < 0, 1)).alias("negative"), r6(F.avg("sentiment_score")).alias("mean_score"))


@query("WITH l AS (SELECT ticker, sentiment_score, CASE WHEN positive >= negative AND positive >= neutral THEN 'positive' WHEN negative >= neutral THEN 'negative' ELSE 'neutral' END AS label FROM v_scored_article) SELECT ticker, label, count(*) AS n, round(avg(sentiment_score), 6) AS mean_score FROM l GROUP BY 1, 2")
def mdl5_label_summary(spark, sf_dir):
    return sentiment.market_summary(A.scored_article(spark, sf_dir)).select("ticker", "label", "n", r6("mean_score").alias("mean_score"))


# --- filters and ladders --------------------------------------------------------------


@query("SELECT article_id FROM v_scored_article WHERE ticker = 'T1' AND published_at >= TIMESTAMP '2024-01-15 00:00:00'")
def fil1_ticker_since(spark, sf_dir):
    return A.scored_article(spark, sf_dir).where((F.col("ticker") == "T1") & (F.col("published_at") >= F.lit("2024-01-15").cast("timestamp"))).select("article_id")


@query("SELECT ticker, article_id FROM (SELECT *, bool_or(NOT is_demo) OVER (PARTITION BY ticker) AS real_rows FROM v_headline) WHERE NOT is_demo OR NOT real_rows")
def fil2_real_else_demo(spark, sf_dir):
    h = A.headline(spark, sf_dir)
    has = h.groupBy("ticker").agg(F.max((~F.col("is_demo")).cast("int")).alias("_real"))
    return h.join(has, "ticker").where(~F.col("is_demo") | (F.col("_real") == 0)).select("ticker", "article_id")


@query("SELECT article_id FROM v_scored_article WHERE published_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'")
def fil3_closed_window(spark, sf_dir):
    return A.scored_article(spark, sf_dir).where(F.col("published_at").between(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))).select("article_id")


_LADDER = "CASE WHEN is_demo THEN 'demo' WHEN published_at < TIMESTAMP '2024-01-05 00:00:00' THEN 'date' WHEN url = '' THEN 'url' WHEN relevance < 0.35 THEN 'irrelevant' ELSE 'kept' END"


@query(f"SELECT {_LADDER} AS reason, count(*) AS n FROM v_headline GROUP BY 1")
def fil4_reject_ladder(spark, sf_dir):
    h = A.headline(spark, sf_dir)
    reason = F.when(F.col("is_demo"), "demo").when(F.col("published_at") < F.lit("2024-01-05").cast("timestamp"), "date").when(F.col("url") == "", "url").when(F.col("relevance") < 0.35, "irrelevant").otherwise("kept")
    return h.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (relevance >= 0.35) AS recent, count(*) FILTER (relevance >= 0.5) AS historical, count(*) AS considered FROM v_headline")
def fil5_relevance_floor(spark, sf_dir):
    return A.headline(spark, sf_dir).agg(F.count(F.when(F.col("relevance") >= 0.35, 1)).alias("recent"), F.count(F.when(F.col("relevance") >= 0.5, 1)).alias("historical"), F.count("*").alias("considered"))


@query("SELECT article_id FROM v_analysis WHERE event_type <> 'uncertain' AND magnitude >= 0.30 AND confidence >= 0.65")
def fil6_meaningful(spark, sf_dir):
    return A.analysis(spark, sf_dir).where(risk.meaningful(F.col("event_type"), F.col("magnitude"), F.col("confidence"))).select("article_id")


@query("SELECT a.article_id FROM v_scored_article a WHERE a.relevance >= 0 AND isfinite(a.positive) AND a.positive BETWEEN 0 AND 1 AND a.negative BETWEEN 0 AND 1 AND a.neutral BETWEEN 0 AND 1 AND abs(a.positive + a.negative + a.neutral - 1) <= 0.02")
def fil9_valid_sentiment(spark, sf_dir):
    a = A.scored_article(spark, sf_dir)
    return a.where(maths.valid_probabilities(F.col("positive"), F.col("negative"), F.col("neutral"))).select("article_id")


@query("SELECT count(*) AS considered, count(*) FILTER (good) AS kept, 0 AS invalid, count(*) FILTER (NOT good) AS off_calendar, max(idx) - min(idx) + 1 - count(idx) AS gaps FROM (SELECT s.idx, s.idx IS NOT NULL AS good FROM v_price p LEFT JOIN v_session s USING (date))")
def fil10_price_quality(spark, sf_dir):
    q = reaction.price_quality(A.price(spark, sf_dir), A.session(spark, sf_dir))
    return q.select("considered", "kept", F.col("invalid").cast("int").alias("invalid"), "off_calendar", "gaps")


_JOBS = "WITH jobs AS (SELECT event_id AS job_id, event_type AS kind, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'retry' WHEN 2 THEN 'running' ELSE 'analyzed' END AS state, ts AS due_at FROM events)"


def _jobs(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    state = F.when(F.col("event_id") % 4 == 0, "pending").when(F.col("event_id") % 4 == 1, "retry").when(F.col("event_id") % 4 == 2, "running").otherwise("analyzed")
    at = F.col("ts").cast("timestamp")
    return e.select(F.col("event_id").alias("job_id"), F.col("event_type").alias("kind"), state.alias("state"), at.alias("next_attempt_at"), at.alias("lease_expires_at"), (F.col("event_id") % 3).alias("attempts"), F.lit("other").alias("lease_owner"), (F.col("event_id") % 7).alias("tokens"), (F.col("event_id") % 5).cast("int").alias("failure_count"))


_MID = "TIMESTAMP '2024-01-16 00:00:00'"


def _mid():
    return F.lit("2024-01-16").cast("timestamp")


@query(_JOBS + f" SELECT job_id FROM jobs WHERE state = 'pending' OR (state IN ('retry', 'running') AND due_at <= {_MID})")
def fil11_due_jobs(spark, sf_dir):
    return store.due(_jobs(spark, sf_dir), _mid()).select("job_id")


@query("SELECT article_id FROM v_headline WHERE source IN ('Reuters', 'Bloomberg') AND published_at BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'")
def fil12_browser_filter(spark, sf_dir):
    return A.headline(spark, sf_dir).where(F.col("source").isin("Reuters", "Bloomberg") & F.col("published_at").between(F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))).select("article_id")


@query("SELECT c_custkey, CASE WHEN lower(c_name) = 'customer#000000100' THEN 0 WHEN starts_with(lower(c_name), 'customer#0000001') THEN 1 ELSE 2 END AS rank FROM customer WHERE contains(lower(c_name), '0001')")
def fil13_member_search(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").withColumn("n", F.lower("c_name")).where(F.col("n").contains("0001"))
    return c.select("c_custkey", F.when(F.col("n") == "customer#000000100", 0).when(F.col("n").startswith("customer#0000001"), 1).otherwise(2).alias("rank"))


# --- joins ----------------------------------------------------------------------------


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def jn1_inner_scored(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id").join(A.table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT h.article_id, l.quality, CAST(epoch(h.published_at) AS BIGINT) AS published_s FROM v_headline h JOIN labels l ON l.doc_id = h.article_id ORDER BY published_s DESC")
def jn2_analyses_newest_first(spark, sf_dir):
    h, lab = A.headline(spark, sf_dir), A.table(spark, sf_dir, "labels")
    return h.join(lab, h.article_id == lab.doc_id).select("article_id", "quality", _second("published_at").alias("published_s")).orderBy(F.desc("published_s"))


@query("SELECT h.ticker, l.toxic, count(*) AS n FROM v_headline h JOIN labels l ON l.doc_id = h.article_id GROUP BY 1, 2")
def jn3_roles_by_ticker(spark, sf_dir):
    h, lab = A.headline(spark, sf_dir), A.table(spark, sf_dir, "labels")
    return h.join(lab, h.article_id == lab.doc_id).groupBy("ticker", "toxic").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id)")
def jn4_anti_unlabelled(spark, sf_dir):
    done = A.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return A.table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@query("SELECT doc_id FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l USING (doc_id)")
def jn5_semi_due(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id").join(A.table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS has_analysis FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn7_flag(spark, sf_dir):
    lab = A.table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("f"))
    return A.table(spark, sf_dir, "documents").join(lab, "doc_id", "left").select("doc_id", F.col("f").isNotNull().alias("has_analysis"))


_KEYED = """
WITH k AS (SELECT article_id, published_s, trim(regexp_replace(lower(title), '[^a-z0-9$]+', ' ', 'g')) AS title_key, trim(regexp_replace(lower(source), '[^a-z0-9$]+', ' ', 'g')) AS source_key, article_id // 2 AS canonical, article_id % 50 AS provider_id, article_id % 3 = 0 AS stored
  FROM (SELECT *, CAST(epoch(published_at) AS BIGINT) AS published_s FROM v_headline))
"""


@query(_KEYED + """, s AS (SELECT * FROM k WHERE stored), b AS (SELECT * FROM k WHERE NOT stored)
SELECT article_id FROM b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.canonical = b.canonical) AND NOT EXISTS (SELECT 1 FROM s WHERE s.title_key = b.title_key AND s.source_key = b.source_key AND abs(s.published_s - b.published_s) <= 21600)""")
def jn6_new_vs_stored(spark, sf_dir):
    k = grouping.with_title_keys(A.headline(spark, sf_dir)).withColumn("provider_id", F.lit(None).cast("string"))
    return store.unstored(k.where("article_id % 3 <> 0"), k.where("article_id % 3 = 0")).select("article_id")


@query("""SELECT a.article_id, s.idx, CAST(s.date AS VARCHAR) AS session FROM v_session_article a LEFT JOIN (
  SELECT idx, date, CAST(epoch(close_at) AS BIGINT) AS hi, coalesce(lag(CAST(epoch(close_at) AS BIGINT)) OVER (ORDER BY idx), CAST(epoch(date) AS BIGINT)) AS lo FROM v_session) s
  ON a.published_s >= s.lo AND a.published_s < s.hi""")
def jn8_session_asof(spark, sf_dir):
    out = asof.session_of(A.session_article(spark, sf_dir), A.session(spark, sf_dir), F.col("published_s"))
    return out.select("article_id", "idx", F.col("session").cast("string").alias("session"))


@query("""SELECT a.article_id, s.idx FROM (SELECT *, CASE WHEN date_only THEN (published_s // 86400 + 1) * 86400 ELSE published_s END AS at FROM v_session_article) a LEFT JOIN (
  SELECT idx, CAST(epoch(close_at) AS BIGINT) AS hi, coalesce(lag(CAST(epoch(close_at) AS BIGINT)) OVER (ORDER BY idx), CAST(epoch(date) AS BIGINT)) AS lo FROM v_session) s ON a.at >= s.lo AND a.at < s.hi""")
def jn9_date_only(spark, sf_dir):
    return asof.session_of(A.session_article(spark, sf_dir), A.session(spark, sf_dir), F.col("published_s"), F.col("date_only")).select("article_id", "idx")


_SHIFTED = "(SELECT CAST(o_orderdate AS DATE) + 7700 AS d FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1)"


@query(_DAILY + """, cal AS (SELECT DISTINCT CAST(ts AS DATE) + 2 AS s FROM events)
, placed AS (SELECT daily.*, (SELECT min(s) FROM cal WHERE s > daily.d) AS session FROM daily)
SELECT ticker, CAST(session AS VARCHAR) AS session, round(sum(score * article_count) / sum(article_count), 6) AS score, round(max_by(ma7, d), 6) AS moving_average_7d, CAST(sum(article_count) AS BIGINT) AS article_count FROM placed WHERE session IS NOT NULL GROUP BY 1, 2""")
def jn10_next_session_sentiment(spark, sf_dir):
    cal = A.table(spark, sf_dir, "events").select(F.date_add(F.col("ts").cast("date"), 2).alias("date")).distinct()
    out = sentiment.aligned_to_sessions(_daily(spark, sf_dir), windows.numbered(cal, "date", "idx"))
    return out.select("ticker", F.col("session").cast("string").alias("session"), r6("score").alias("score"), r6("moving_average_7d").alias("moving_average_7d"), "article_count")


@query("""WITH m AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem), c AS (SELECT d, close, date, row_number() OVER (PARTITION BY d ORDER BY abs(date - d), date) AS r FROM m JOIN v_price ON abs(date - d) <= 3)
SELECT CAST(d AS VARCHAR) AS date, round(close, 6) AS close, CAST(date AS VARCHAR) AS nearest_date FROM c WHERE r = 1""")
def jn11_nearest_close(spark, sf_dir):
    marks = A.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d")).distinct()
    out = asof.nearest(marks, "d", A.price(spark, sf_dir), "date", "close", [], 3)
    return out.select(F.col("d").cast("string").alias("date"), r6("close").alias("close"), F.col("nearest_date").cast("string").alias("nearest_date"))


@query("""WITH s AS (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(coalesce(p.date, s.date) AS VARCHAR) AS date, round(p.close, 6) AS close, s.n FROM v_price p FULL JOIN s ON p.date = s.date""")
def jn12_full_outer(spark, sf_dir):
    s = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.count("*").alias("n"))
    return A.price(spark, sf_dir).select("date", "close").join(s, "date", "full").select(F.col("date").cast("string").alias("date"), r6("close").alias("close"), "n")


@query("""WITH s AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_discount) AS x FROM lineitem GROUP BY 1)
SELECT CAST(p.date AS VARCHAR) AS date, round(coalesce(s.x, 0), 6) AS x FROM v_price p LEFT JOIN s ON p.date = s.date""")
def jn13_left_fill_zero(spark, sf_dir):
    s = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.avg("l_discount").alias("x"))
    return A.price(spark, sf_dir).join(s, "date", "left").select(F.col("date").cast("string").alias("date"), r6(F.coalesce("x", F.lit(0.0))).alias("x"))


_PATHS = """
WITH p AS (SELECT s.idx, p.close, p.benchmark FROM v_price p JOIN v_session s USING (date)),
b AS (SELECT idx FROM v_session),
paths AS (SELECT b.idx, h.h, t.close / z.close - 1 AS raw_return, (t.close / z.close - 1) - (t.benchmark / z.benchmark - 1) AS adjusted_return
  FROM b JOIN p z ON z.idx = b.idx - 1 CROSS JOIN (SELECT unnest(range(11)) AS h) h JOIN p t ON t.idx = b.idx + h.h)
"""


def _paths(spark, sf_dir):
    s = A.session(spark, sf_dir)
    p = reaction.aligned_prices(A.price(spark, sf_dir), s)
    return reaction.forward_paths(s, p)


@query(_PATHS + "SELECT idx, CAST(h AS INTEGER) AS h, round(raw_return, 6) AS raw_return, round(adjusted_return, 6) AS adjusted_return FROM paths")
def jn14_forward_returns(spark, sf_dir):
    return _paths(spark, sf_dir).select("idx", "h", r6("raw_return").alias("raw_return"), r6("adjusted_return").alias("adjusted_return"))


@query(_PATHS + "SELECT idx, count(*) = 11 AS resolved, round(sum(adjusted_return) FILTER (h <= 5), 6) AS sum_5 FROM paths GROUP BY 1")
def win15_paths(spark, sf_dir):
    c = reaction.complete_paths(_paths(spark, sf_dir))
    five = F.aggregate(F.filter(F.slice("path", 1, 6), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
    none = F.forall(F.slice("path", 1, 6), lambda x: x.isNull())
    return c.select("idx", "resolved", r6(F.when(~none, five)).alias("sum_5"))


@query(_PATHS + ", st AS (SELECT idx, abs(raw_return - coalesce(lag(raw_return) OVER (PARTITION BY idx ORDER BY h), 0)) AS s FROM paths) SELECT idx, round(max(s), 6) AS largest_step, max(s) > 0.25 AS extreme FROM st GROUP BY 1")
def win16_extreme_moves(spark, sf_dir):
    return reaction.extreme_moves(_paths(spark, sf_dir)).select("idx", r6("largest_step").alias("largest_step"), "extreme")


@query("""WITH h AS (SELECT article_id, ticker, CAST(epoch(published_at) AS BIGINT) AS s FROM v_headline WHERE NOT is_demo)
SELECT p.article_id, count(*) AS pool, CAST(min(abs(c.s - p.s)) AS BIGINT) AS nearest_s FROM h p JOIN h c ON c.ticker = p.ticker AND c.article_id <> p.article_id AND c.s BETWEEN p.s - 30 * 86400 AND p.s + 14 * 86400 GROUP BY 1""")
def jn15_evidence_pool(spark, sf_dir):
    """Pools of all articles as differences of running counts by ticker and day, so no
    pair of articles is a row. One row per article_id is taken as given."""
    day, back, ahead = 86400, 30 * 86400, 14 * 86400
    h = A.headline(spark, sf_dir).where("not is_demo and article_id is not null and ticker is not null").select("article_id", "ticker", _second("published_at").alias("s"))
    mark = lambda at, own, sign: F.struct(at.alias("at"), F.lit(own).alias("own"), F.lit(sign).alias("sign"))
    marks = h.select("article_id", "ticker", F.inline(F.array(mark(F.col("s"), 1, 0), mark(F.col("s") + ahead, 0, 1), mark(F.col("s") - back - 1, 0, -1)))).withColumn("_b", F.floor(F.col("at") / day))
    own = F.when(F.col("own") == 1, F.col("at"))
    days = marks.groupBy("ticker", "_b").agg(F.sum("own").alias("n"), F.min(own).alias("lo"), F.max(own).alias("hi"))
    earlier = Window.partitionBy("ticker").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("ticker").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("ticker", "_b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.max("hi").over(earlier).alias("last"), F.min("lo").over(later).alias("next"))
    # articles of a second come before the bounds that fall on it
    within = Window.partitionBy("ticker", "_b").orderBy("at", F.desc("own")).rowsBetween(Window.unboundedPreceding, 0)
    beside = Window.partitionBy("ticker", "_b", "own").orderBy("at", "article_id")
    marks = marks.withColumn("run", F.sum("own").over(within)).withColumn("p", F.lag("at").over(beside)).withColumn("q", F.lead("at").over(beside)).join(days, ["ticker", "_b"])
    p, q = F.col("at") - F.coalesce("p", "last"), F.coalesce("q", "next") - F.col("at")
    nearest = F.when(F.col("own") == 1, F.least(F.when(p <= back, p), F.when(q <= ahead, q)))
    out = marks.groupBy("article_id").agg((F.sum(F.col("sign") * (F.col("before") + F.col("run"))) - 1).alias("pool"), F.min(nearest).alias("nearest_s"))
    return out.where("pool > 0")


@query("SELECT article_id, len(list_filter(ids, lambda x: x % 2 = 0)) AS cited FROM (SELECT article_id, [article_id, article_id + 1, article_id // 2] AS ids FROM v_headline)")
def jn16_cited_references(spark, sf_dir):
    ids = F.array(F.col("article_id"), F.col("article_id") + 1, F.expr("article_id div 2"))
    return A.headline(spark, sf_dir).select("article_id", F.size(F.filter(ids, lambda x: x % 2 == 0)).cast("bigint").alias("cited"))


@query("""WITH a AS (SELECT doc_id, quality AS x FROM labels WHERE doc_id % 2 = 0), b AS (SELECT doc_id, toxic AS x FROM labels WHERE doc_id % 3 = 0)
SELECT CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'absent' WHEN a.x <> b.x THEN 'changed' ELSE 'same' END AS state, count(*) AS n FROM a FULL JOIN b USING (doc_id) GROUP BY 1""")
def jn19_store_comparison(spark, sf_dir):
    lab = A.table(spark, sf_dir, "labels")
    a = lab.where("doc_id % 2 = 0").select("doc_id", F.col("quality").alias("xa"), F.lit(1).alias("a"))
    b = lab.where("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("xb"), F.lit(1).alias("b"))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "absent").when(F.col("xa") != F.col("xb"), "changed").otherwise("same")
    return a.join(b, "doc_id", "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT a.title) AS titles FROM (SELECT title FROM v_headline WHERE article_id % 2 = 0) a SEMI JOIN (SELECT title FROM v_headline WHERE article_id % 2 = 1) b USING (title)")
def jn20_title_overlap(spark, sf_dir):
    h = A.headline(spark, sf_dir)
    return h.where("article_id % 2 = 0").select("title").join(h.where("article_id % 2 = 1").select("title").distinct(), "title", "left_semi").agg(F.count_distinct("title").alias("titles"))


@query("SELECT c_custkey FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000007') OR lower(c_name) = lower('customer#000000009')")
def jn21_member_resolve(spark, sf_dir):
    return A.table(spark, sf_dir, "customer").where(F.lower("c_name").isin("customer#000000007", "customer#000000009")).select("c_custkey")


# --- event study ----------------------------------------------------------------------

_SIGNALS = """
WITH cal AS (SELECT idx, CAST(epoch(close_at) AS BIGINT) AS hi, coalesce(lag(CAST(epoch(close_at) AS BIGINT)) OVER (ORDER BY idx), CAST(epoch(date) AS BIGINT)) AS lo FROM v_session),
timed AS (SELECT *, CASE WHEN date_only THEN (published_s // 86400 + 1) * 86400 ELSE published_s END AS at, CASE WHEN date_only THEN 2 * (published_s // 86400 + 1) * 86400 - 1 ELSE 2 * published_s END AS place
  FROM v_reaction_article WHERE NOT is_demo AND valid AND published_s IS NOT NULL),
placed AS (SELECT a.*, cal.idx, row_number() OVER (PARTITION BY ticker, address ORDER BY place, article_id) AS copy FROM timed a JOIN cal ON a.at >= cal.lo AND a.at < cal.hi),
told AS (SELECT *, row_number() OVER (PARTITION BY ticker, idx, title ORDER BY place, article_id) AS again FROM placed WHERE copy = 1),
signals AS (SELECT ticker, idx, round(greatest(least(avg(polarity), 1.0), -1.0), 9) AS signal, count(*) AS articles, count(DISTINCT CASE WHEN source IN ('Nvidia Newsroom') THEN 'official' ELSE lower(source) END) AS sources, avg(CAST(date_only AS INTEGER)) AS date_only_share FROM told WHERE again = 1 GROUP BY 1, 2),
tau AS (SELECT ticker, count(*) AS covered, greatest(round(quantile_cont(signal, 0.85), 2), 0.20) AS tp, greatest(round(-quantile_cont(signal, 0.15), 2), 0.20) AS tn FROM signals WHERE sources >= 3 GROUP BY 1)
"""


def _signals(spark, sf_dir):
    # nine decimals: sums in another order must not move a signal over a threshold
    s = reaction.session_signals(A.reaction_article(spark, sf_dir), A.session(spark, sf_dir)).withColumn("signal", F.round("signal", 9))
    # a row per company and session, which thresholds and events read several times
    return written(s.select("ticker", "idx", "signal", "articles", "sources", "date_only_share"), "signals")


@query(_SIGNALS + "SELECT ticker, idx, round(signal, 6) AS signal, articles, sources, round(date_only_share, 6) AS date_only_share FROM signals")
def agg5_session_signal(spark, sf_dir):
    return _signals(spark, sf_dir).select("ticker", "idx", r6("signal").alias("signal"), "articles", "sources", r6("date_only_share").alias("date_only_share"))


@query(_SIGNALS.rstrip() + """, seen AS (SELECT t.*, cal.idx FROM timed t LEFT JOIN cal ON t.at >= cal.lo AND t.at < cal.hi),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker, address, idx IS NULL ORDER BY place, article_id) AS nth, min(place) FILTER (idx IS NOT NULL) OVER (PARTITION BY ticker, address) AS kept_at FROM seen),
titled AS (SELECT *, row_number() OVER (PARTITION BY ticker, idx, title, nth ORDER BY place, article_id) AS again FROM ranked),
fates AS (SELECT ticker, CASE WHEN idx IS NULL AND kept_at < place THEN 'copy' WHEN idx IS NULL THEN 'outside' WHEN nth > 1 THEN 'copy' WHEN again > 1 THEN 'title' ELSE 'eligible' END AS fate FROM titled
  UNION ALL SELECT ticker, CASE WHEN is_demo THEN 'demo' WHEN NOT valid THEN 'invalid' ELSE 'unusable' END FROM v_reaction_article WHERE is_demo OR NOT valid OR published_s IS NULL)
SELECT ticker, count(*) AS considered, count(*) FILTER (fate = 'demo') AS demo, count(*) FILTER (fate = 'invalid') AS invalid_sentiment, count(*) FILTER (fate = 'unusable') AS unusable_timestamp,
  count(*) FILTER (fate = 'copy') AS canonical_duplicates, count(*) FILTER (fate = 'outside') AS outside_calendar, count(*) FILTER (fate = 'title') AS title_duplicates, count(*) FILTER (fate = 'eligible') AS eligible FROM fates GROUP BY 1""")
def set4_signal_counters(spark, sf_dir):
    return reaction.signal_counters(A.reaction_article(spark, sf_dir), A.session(spark, sf_dir))


@query(_SIGNALS + "SELECT ticker, round(quantile_cont(signal, 0.85), 6) AS q85, round(quantile_cont(signal, 0.15), 6) AS q15 FROM signals GROUP BY 1")
def agg6_quantiles(spark, sf_dir):
    return _signals(spark, sf_dir).groupBy("ticker").agg(r6(F.percentile("signal", 0.85)).alias("q85"), r6(F.percentile("signal", 0.15)).alias("q15"))


@query(_SIGNALS + "SELECT ticker, any_value(covered) AS covered, any_value(tp) AS tau_positive, any_value(tn) AS tau_negative, round(avg(CAST(signal >= tp AS INTEGER)), 6) AS positive_share, round(avg(CAST(signal <= -tn AS INTEGER)), 6) AS negative_share FROM signals JOIN tau USING (ticker) WHERE sources >= 3 GROUP BY 1")
def agg7_thresholds(spark, sf_dir):
    return reaction.thresholds(_signals(spark, sf_dir), ["ticker"]).select("ticker", "covered", "tau_positive", "tau_negative", r6("positive_share").alias("positive_share"), r6("negative_share").alias("negative_share"))


@query(_SIGNALS + "SELECT ticker, max(idx) - min(idx) AS span, round(count(DISTINCT idx) / (max(idx) - min(idx) + 1), 6) AS density, count(*) FILTER (sources >= 3) AS covered, max(idx) - min(idx) >= 126 AND count(DISTINCT idx) / (max(idx) - min(idx) + 1) >= 0.5 AND count(*) FILTER (sources >= 3) >= 63 AS sufficient FROM signals GROUP BY 1")
def agg11_history(spark, sf_dir):
    return reaction.history(_signals(spark, sf_dir), ["ticker"]).select("ticker", "span", r6("density").alias("density"), "covered", "sufficient")


@query(_SIGNALS + "SELECT ticker, sum(articles) AS articles, round(sum(articles * date_only_share) / sum(articles), 6) AS date_only_share, round(avg(CAST(sources >= 3 AS INTEGER)), 6) AS covered_share FROM signals GROUP BY 1")
def agg12_quality(spark, sf_dir):
    return _signals(spark, sf_dir).groupBy("ticker").agg(F.sum("articles").cast("decimal(38,0)").alias("articles"), r6(F.sum(F.col("articles") * F.col("date_only_share")) / F.sum("articles")).alias("date_only_share"), r6(F.avg((F.col("sources") >= 3).cast("double"))).alias("covered_share"))


@query(_SIGNALS.replace("WITH", "WITH RECURSIVE", 1) + """, q AS (SELECT ticker, idx, CASE WHEN signal >= tp THEN 'positive' WHEN signal <= -tn THEN 'negative' END AS regime FROM signals JOIN tau USING (ticker) WHERE sources >= 3),
o AS (SELECT *, row_number() OVER (PARTITION BY ticker, regime ORDER BY idx) AS r FROM q WHERE regime IS NOT NULL),
walk AS (SELECT ticker, regime, idx, r, true AS kept, idx AS last FROM o WHERE r = 1
  UNION ALL SELECT o.ticker, o.regime, o.idx, o.r, o.idx - walk.last >= 5, CASE WHEN o.idx - walk.last >= 5 THEN o.idx ELSE walk.last END FROM walk JOIN o ON o.ticker = walk.ticker AND o.regime = walk.regime AND o.r = walk.r + 1)
SELECT ticker, regime, idx, kept, CASE WHEN NOT kept THEN last END AS suppressed_by FROM walk""")
def win11_exclusive_events(spark, sf_dir):
    s = _signals(spark, sf_dir)
    return reaction.events(s, reaction.thresholds(s, ["ticker"])).select("ticker", "regime", "idx", "kept", "suppressed_by")


@query(_SIGNALS + "SELECT CASE WHEN sources >= 3 AND signal >= tp THEN 'positive' WHEN sources >= 3 AND signal <= -tn THEN 'negative' ELSE 'none' END AS regime, count(*) AS n FROM signals JOIN tau USING (ticker) GROUP BY 1")
def cls24_regimes(spark, sf_dir):
    s = _signals(spark, sf_dir)
    m = s.join(reaction.thresholds(s, ["ticker"]), "ticker")
    return m.groupBy(F.coalesce(reaction.regime(F.col("signal"), F.col("sources"), F.col("tau_positive"), F.col("tau_negative")), F.lit("none")).alias("regime")).agg(F.count("*").alias("n"))


@query(_PATHS + "SELECT CAST(h AS INTEGER) AS h, count(*) AS n, round(avg(adjusted_return), 6) AS mean, round(median(adjusted_return), 6) AS median, round(avg(CAST(adjusted_return > 0 AS INTEGER)), 6) AS share_positive FROM paths GROUP BY 1")
def agg8_return_summary(spark, sf_dir):
    s = reaction.return_summary(_paths(spark, sf_dir), ["h"], "adjusted_return")
    return s.select("h", "n", r6("mean").alias("mean"), r6("median").alias("median"), r6("share_positive").alias("share_positive"))


@query(_PATHS + ", x AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY idx) AS r, count(*) OVER (PARTITION BY h) AS n FROM paths) SELECT CAST(h AS INTEGER) AS h, round(avg(adjusted_return) FILTER (r <= n // 2), 6) AS first_half, round(avg(adjusted_return) FILTER (r > n // 2), 6) AS second_half FROM x GROUP BY 1")
def agg9_split_half(spark, sf_dir):
    return reaction.split_half(_paths(spark, sf_dir), ["h"], "idx", "adjusted_return").select("h", r6("first_half").alias("first_half"), r6("second_half").alias("second_half"))


@query(_PATHS + """, y AS (SELECT h, rank() OVER (PARTITION BY h ORDER BY raw_return) + (count(*) OVER (PARTITION BY h, raw_return) - 1) / 2 AS a, rank() OVER (PARTITION BY h ORDER BY adjusted_return) + (count(*) OVER (PARTITION BY h, adjusted_return) - 1) / 2 AS b FROM paths)
SELECT CAST(h AS INTEGER) AS h, count(*) AS n, CASE WHEN count(*) >= 100 THEN round(corr(a, b), 6) END AS rho FROM y GROUP BY 1""")
def agg10_spearman(spark, sf_dir):
    return reaction.spearman(_paths(spark, sf_dir), ["h"], "raw_return", "adjusted_return").select("h", "n", r6("rho").alias("rho"))


@query(None)
def num1_student_t(spark, sf_dir):
    return reaction.intervals(_paths(spark, sf_dir), ["h"], "adjusted_return").select("h", "n", r6("low").alias("low"), r6("high").alias("high"))


@query(None)
def num2_percentile_bootstrap(spark, sf_dir):
    return reaction.intervals(_paths(spark, sf_dir), ["h"], "adjusted_return", "percentile").select("h", "n", r6("low").alias("low"), r6("high").alias("high"))


@query(None)
def num3_bootstrap_t(spark, sf_dir):
    return reaction.intervals(_paths(spark, sf_dir), ["h"], "adjusted_return", "bootstrap_t").select("h", "n", r6("low").alias("low"), r6("high").alias("high"))


@query(None)
def num4_bca(spark, sf_dir):
    return reaction.intervals(_paths(spark, sf_dir), ["h"], "adjusted_return", "bca").select("h", "n", r6("low").alias("low"), r6("high").alias("high"))


@query(None)
def cls26_evidence_state(spark, sf_dir):
    p = _paths(spark, sf_dir)
    m = reaction.return_summary(p, ["h"], "adjusted_return").join(reaction.split_half(p, ["h"], "idx", "adjusted_return"), "h").join(reaction.intervals(p, ["h"], "adjusted_return").select("h", "low", "high"), "h")
    return m.select("h", "n", reaction.evidence_state(F.col("n"), F.col("low"), F.col("high"), F.col("mean"), F.col("median"), F.col("first_half"), F.col("second_half")).alias("state"))


@query(None)
def mdl6_null_simulation(spark, sf_dir):
    return reaction.null_simulation(spark, 400, 20).agg(F.count("*").alias("trials"), r6(F.avg(F.col("excludes_zero").cast("double"))).alias("false_exclusion"))


# --- window features and price history ------------------------------------------------

_FEATURES = """
WITH k AS (SELECT l_suppkey % 20 AS sym, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS close, CAST(count(*) AS DOUBLE) AS volume FROM lineitem GROUP BY 1, 2),
o AS (SELECT *, close / lag(close, 1) OVER w - 1 AS return_1, close / lag(close, 5) OVER w - 1 AS return_5, row_number() OVER w AS n, lead(close, 5) OVER w / close - 1 AS ahead FROM k WINDOW w AS (PARTITION BY sym ORDER BY date)),
f AS (SELECT *, CASE WHEN n >= 20 THEN avg(close) OVER (PARTITION BY sym ORDER BY date ROWS 4 PRECEDING) / avg(close) OVER (PARTITION BY sym ORDER BY date ROWS 19 PRECEDING) - 1 END AS trend,
  CASE WHEN n >= 11 THEN stddev_samp(return_1) OVER (PARTITION BY sym ORDER BY date ROWS 9 PRECEDING) * sqrt(252) END AS volatility,
  CASE WHEN n >= 5 THEN volume / avg(volume) OVER (PARTITION BY sym ORDER BY date ROWS 4 PRECEDING) END AS volume_ratio, CASE WHEN ahead IS NOT NULL THEN CAST(ahead > 0 AS INTEGER) END AS target FROM o)
"""


def _features(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem")
    k = li.groupBy((F.col("l_suppkey") % 20).alias("sym"), F.col("l_shipdate").cast("date").alias("date")).agg(F.avg("l_extendedprice").alias("close"), F.count("*").cast("double").alias("volume"))
    return windows.price_features(k, ["sym"])


@query(_FEATURES + "SELECT sym, CAST(date AS VARCHAR) AS date, round(return_1, 5) AS return_1, round(return_5, 5) AS return_5, round(trend, 5) AS trend, round(volatility, 5) AS volatility, round(volume_ratio, 5) AS volume_ratio FROM f")
def win3_features(spark, sf_dir):
    f = _features(spark, sf_dir)
    return f.select("sym", F.col("date").cast("string").alias("date"), *[(F.round(c, 5) + 0.0).alias(c) for c in ("return_1", "return_5", "trend", "volatility", "volume_ratio")])


@query(_FEATURES + "SELECT sym, count(*) AS labelled, CAST(sum(target) AS BIGINT) AS up FROM f WHERE n > 19 AND target IS NOT NULL GROUP BY 1")
def win7_target(spark, sf_dir):
    return _features(spark, sf_dir).where("row > 19 and target is not null").groupBy("sym").agg(F.count("*").alias("labelled"), F.sum("target").alias("up"))


_SPLIT = _FEATURES + ", s AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY date) AS i, count(*) OVER (PARTITION BY sym) AS m FROM f WHERE n > 19 AND target IS NOT NULL), z AS (SELECT *, greatest(30, CAST(round_even(0.2 * m, 0) AS BIGINT)) AS v FROM s)"


def _split(spark, sf_dir):
    w = Window.partitionBy("sym")
    s = _features(spark, sf_dir).where("row > 19 and target is not null").withColumn("i", F.row_number().over(w.orderBy("date"))).withColumn("m", F.count("*").over(w))
    v = F.greatest(F.lit(30), F.bround(0.2 * F.col("m")).cast("bigint"))
    return s.withColumn("part", F.when(F.col("i") > F.col("m") - v, "validation").when(F.col("i") > F.col("m") - v - 5, "purged").otherwise("train"))


@query(_SPLIT + " SELECT sym, CASE WHEN i > m - v THEN 'validation' WHEN i > m - v - 5 THEN 'purged' ELSE 'train' END AS part, count(*) AS n, round(avg(target), 6) AS up_share FROM z GROUP BY 1, 2")
def mdl2_split(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("sym", "part").agg(F.count("*").alias("n"), r6(F.avg("target")).alias("up_share"))


@query(_SPLIT + """, t AS (SELECT *, rank() OVER (PARTITION BY sym ORDER BY round(return_5, 9)) + (count(*) OVER (PARTITION BY sym, round(return_5, 9)) - 1) / 2 AS r FROM z WHERE i > m - v)
SELECT sym, round((sum(r) FILTER (target = 1) - count(*) FILTER (target = 1) * (count(*) FILTER (target = 1) + 1) / 2) / nullif(count(*) FILTER (target = 1) * count(*) FILTER (target = 0), 0), 6) AS auc, round(avg(CAST((return_5 > 0) = (target = 1) AS INTEGER)), 6) AS momentum_accuracy FROM t GROUP BY 1""")
def mdl4_auc(spark, sf_dir):
    t = _split(spark, sf_dir).where("part = 'validation'").withColumn("x", F.round("return_5", 9))
    t = t.withColumn("r", F.rank().over(Window.partitionBy("sym").orderBy("x")) + (F.count("*").over(Window.partitionBy("sym", "x")) - 1) / 2)
    up, down = F.count(F.when(F.col("target") == 1, 1)), F.count(F.when(F.col("target") == 0, 1))
    auc = F.try_divide(F.sum(F.when(F.col("target") == 1, F.col("r"))) - up * (up + 1) / 2, up * down)
    return t.groupBy("sym").agg(r6(auc).alias("auc"), r6(F.avg(((F.col("return_5") > 0) == (F.col("target") == 1)).cast("double"))).alias("momentum_accuracy"))


@query(None)
def mdl3_logistic(spark, sf_dir):
    from newsloom.operators import forecast

    return forecast.baseline(_split(spark, sf_dir))


# --- top-k, versions, round robin -----------------------------------------------------


@query("SELECT article_id, CAST(epoch(published_at) AS BIGINT) AS s FROM v_headline ORDER BY published_at DESC, article_id LIMIT 25")
def top1_latest(spark, sf_dir):
    return A.headline(spark, sf_dir).orderBy(F.desc("published_at"), "article_id").limit(25).select("article_id", _second("published_at").alias("s"))


@query(_DAILY + ", l AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS r FROM daily) SELECT ticker, CAST(d AS VARCHAR) AS date, round(score, 6) AS score FROM l WHERE r <= 10")
def top2_last_dates(spark, sf_dir):
    d = windows.top_per(_daily(spark, sf_dir), ["ticker"], [F.desc("date")], 10)
    return d.select("ticker", F.col("date").cast("string").alias("date"), r6("score").alias("score"))


_CARDS = "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY magnitude DESC, confidence DESC, evidence_strength DESC, published_at DESC, article_id) AS r FROM v_analysis WHERE event_type <> 'uncertain' AND magnitude >= 0.30 AND confidence >= 0.65"


@query(f"SELECT ticker, CAST(r AS INTEGER) AS place, article_id, CASE WHEN magnitude >= 0.80 THEN 'High' WHEN magnitude >= 0.55 THEN 'Medium' ELSE 'Low' END AS impact FROM ({_CARDS}) WHERE r <= 4")
def top3_cards(spark, sf_dir):
    a = A.analysis(spark, sf_dir).where(risk.meaningful(F.col("event_type"), F.col("magnitude"), F.col("confidence")))
    w = Window.partitionBy("ticker").orderBy(F.desc("magnitude"), F.desc("confidence"), F.desc("evidence_strength"), F.desc("published_at"), "article_id")
    return a.withColumn("place", F.row_number().over(w)).where("place <= 4").select("ticker", "place", "article_id", maths.impact_label(F.col("magnitude")).alias("impact"))


@query(f"SELECT ticker, article_id, CAST(CAST(published_at AS DATE) AS VARCHAR) AS date FROM ({_CARDS}) WHERE r <= 8")
def top4_markers(spark, sf_dir):
    a = A.analysis(spark, sf_dir).where(risk.meaningful(F.col("event_type"), F.col("magnitude"), F.col("confidence")))
    top = windows.top_per(a, ["ticker"], [F.desc("magnitude"), F.desc("confidence"), F.desc("evidence_strength"), F.desc("published_at"), F.col("article_id")], 8)
    return top.select("ticker", "article_id", F.to_date("published_at").cast("string").alias("date"))


@query("SELECT ticker, article_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker, CAST(published_at AS DATE) ORDER BY published_at, article_id) AS r FROM v_scored_article) WHERE r <= 6")
def top14_sample(spark, sf_dir):
    return windows.top_per(A.scored_article(spark, sf_dir).withColumn("d", F.to_date("published_at")), ["ticker", "d"], [F.col("published_at"), F.col("article_id")], 6).select("ticker", "article_id")


@query("SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_name = 'Customer#000000010' THEN 0 WHEN starts_with(c_name, 'Customer#00000001') THEN 1 ELSE 2 END, c_name) AS place FROM customer QUALIFY place <= 20")
def top10_search_rank(spark, sf_dir):
    rank = F.when(F.col("c_name") == "Customer#000000010", 0).when(F.col("c_name").startswith("Customer#00000001"), 1).otherwise(2)
    c = A.table(spark, sf_dir, "customer").orderBy(rank, "c_name").limit(20)
    return c.withColumn("place", F.row_number().over(Window.orderBy(rank, "c_name"))).select("c_custkey", "place")  # twenty rows


@query("SELECT article_id, CAST(r AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY relevance DESC, article_id) AS r FROM v_headline) ORDER BY r, ticker LIMIT 60")
def win13_round_robin(spark, sf_dir):
    return windows.round_robin(A.headline(spark, sf_dir), ["ticker"], [F.desc("relevance"), F.col("article_id")], [F.col("ticker")], 60).select("article_id", "turn")


@query("SELECT article_id FROM (SELECT *, CAST(published_at AS DATE) AS d, row_number() OVER (PARTITION BY CAST(published_at AS DATE) ORDER BY relevance DESC, published_at DESC, article_id) AS r FROM v_headline) ORDER BY r, d DESC LIMIT 40")
def win9_cap_by_date(spark, sf_dir):
    h = A.headline(spark, sf_dir).withColumn("d", F.to_date("published_at"))
    return windows.round_robin(h, ["d"], [F.desc("relevance"), F.desc("published_at"), F.col("article_id")], [F.desc("d")], 40).select("article_id")


@query("SELECT ticker, CAST(row_number() OVER (ORDER BY CASE WHEN ticker = 'T2' THEN NULL ELSE last END NULLS FIRST, ticker) AS INTEGER) AS place FROM (SELECT ticker, max(published_at) AS last FROM v_scored_article GROUP BY 1)")
def win14_cycle_order(spark, sf_dir):
    last = A.scored_article(spark, sf_dir).groupBy("ticker").agg(F.max("published_at").alias("last"))
    last = last.withColumn("last", F.when(F.col("ticker") != "T2", F.col("last")))
    return last.select("ticker", F.row_number().over(Window.orderBy(F.asc_nulls_first("last"), "ticker")).alias("place"))  # one row per company


@query("SELECT source, article_id FROM (SELECT *, row_number() OVER (PARTITION BY source, title ORDER BY published_at DESC, article_id) AS r FROM v_headline WHERE relevance >= 0.2) WHERE r = 1")
def win8_newest_version(spark, sf_dir):
    return windows.newest_valid(A.headline(spark, sf_dir), ["source", "title"], F.col("relevance") >= 0.2, [F.desc("published_at"), F.col("article_id")]).select("source", "article_id")


@query("SELECT source, article_id FROM (SELECT *, row_number() OVER (PARTITION BY source, CAST(published_at AS DATE) ORDER BY article_id DESC) AS r FROM v_headline) WHERE r = 1")
def set10_keep_last(spark, sf_dir):
    return windows.keep_last(A.headline(spark, sf_dir).withColumn("d", F.to_date("published_at")), ["source", "d"], "article_id").select("source", "article_id")


@query(None)
def win17_rate_limit(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    return windows.rate_limited(e, ["user_id"], "s", 2, 86_400).groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("accepted"), 1)).alias("accepted"))


# --- text, URLs, hashes ---------------------------------------------------------------

_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9$]+', ' ', 'g'))"


@query(f"SELECT article_id, {_NORM.format('title')} AS key, {_NORM.format('source')} AS source_key FROM v_headline")
def str1_normalize(spark, sf_dir):
    return A.headline(spark, sf_dir).select("article_id", text.normalize_text(F.col("title")).alias("key"), text.normalize_text(F.col("source")).alias("source_key"))


@query(f"SELECT article_id, {_NORM.format('title')} AS key FROM v_headline")
def str2_title_key(spark, sf_dir):
    h = A.headline(spark, sf_dir).withColumn("t", F.concat_ws(" - ", "title", "source"))
    return h.select("article_id", text.normalize_title(F.col("t"), F.col("source")).alias("key"))


@query("SELECT article_id, title FROM v_headline")
def str3_strip_publisher(spark, sf_dir):
    h = A.headline(spark, sf_dir).withColumn("t", F.concat_ws(" - ", "title", "source"))
    return h.select("article_id", text.strip_publisher(F.col("t"), F.col("source")).alias("title"))


_STOP = ", ".join(f"'{w}'" for w in text.TITLE_STOPWORDS)
_STEM = "CASE WHEN t LIKE '%ing' AND length(t) >= 7 THEN left(t, length(t) - 3) WHEN t LIKE '%ed' AND length(t) >= 6 THEN left(t, length(t) - 2) WHEN t LIKE '%es' AND length(t) >= 6 THEN left(t, length(t) - 2) WHEN t LIKE '%s' AND length(t) >= 5 THEN left(t, length(t) - 1) ELSE t END"
_TERMS = f"(SELECT article_id, string_agg(DISTINCT t, ' ' ORDER BY t) AS terms FROM (SELECT article_id, {_STEM} AS t FROM (SELECT article_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]{{3,}}')) AS t FROM v_headline) WHERE t NOT IN ({_STOP})) GROUP BY 1)"


@query(f"SELECT article_id, terms FROM {_TERMS}")
def str4_terms(spark, sf_dir):
    return A.headline(spark, sf_dir).select("article_id", F.array_join(F.array_sort(text.title_terms(F.col("title"))), " ").alias("terms"))


_STEM2 = "CASE WHEN t LIKE '%sses' AND length(t) > 5 THEN left(t, length(t) - 2) WHEN t LIKE '%s' AND t NOT LIKE '%ss' AND length(t) > 4 THEN left(t, length(t) - 1) WHEN t LIKE '%ing' AND length(t) >= 7 THEN left(t, length(t) - 3) WHEN t LIKE '%ed' AND length(t) >= 6 THEN left(t, length(t) - 2) ELSE t END"


@query(f"SELECT article_id, string_agg(DISTINCT t, ' ' ORDER BY t) AS terms FROM (SELECT article_id, {_STEM2} AS t FROM (SELECT article_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]{{3,}}')) AS t FROM v_headline) WHERE t NOT IN ({_STOP})) GROUP BY 1")
def str5_selector_terms(spark, sf_dir):
    return A.headline(spark, sf_dir).select("article_id", F.array_join(F.array_sort(text.selector_terms(F.col("title"))), " ").alias("terms"))


@query("SELECT article_id, CASE WHEN length(title) > 30 THEN rtrim(left(title, 27)) || '...' ELSE title END AS title FROM v_headline")
def str11_truncate(spark, sf_dir):
    return A.headline(spark, sf_dir).select("article_id", text.truncated(F.col("title"), 30, "...").alias("title"))


@query("SELECT article_id % 5 AS k, (article_id % 5) || ' report' || CASE WHEN article_id % 5 = 1 THEN '' ELSE 's' END AS label, count(*) AS n FROM v_headline GROUP BY 1, 2")
def str12_plural(spark, sf_dir):
    h = A.headline(spark, sf_dir).withColumn("k", F.col("article_id") % 5)
    return h.groupBy("k", text.plural(F.col("k"), "report").alias("label")).agg(F.count("*").alias("n"))


@query(f"SELECT article_id, contains(' ' || {_NORM.format('title')} || ' ', ' acme corporation ') AS mentioned FROM v_headline")
def str14_mentions(spark, sf_dir):
    return A.headline(spark, sf_dir).select("article_id", text.mentions(F.col("title"), F.lit("Acme Corporation")).alias("mentioned"))


@query(None)
def str13_html_to_text(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", F.length(text.html_to_text(F.col("html"))).alias("chars"), F.sha2(text.html_to_text(F.col("html")), 256).alias("digest"))


@query("SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host FROM pages")
def url3_host(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", text.host(F.col("url")).alias("host"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
q AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) AS net, rtrim(regexp_replace(regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', ''), '\?.*$', ''), '/') AS path, regexp_extract(u, '\?(.*)$', 1) AS query FROM p),
k AS (SELECT *, list_transform(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref')), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END) AS kept FROM q)
SELECT page_id, scheme || '://' || net || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM k""")
def url1_canonical(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", text.normalize_url(F.col("url")).alias("url"))


@query("SELECT article_id, split_part('https://news.example.com/rss/articles/' || article_id || '?hl=en', '?', 1)[39:] AS id FROM v_headline")
def url2_rss_id(spark, sf_dir):
    u = F.concat(F.lit("https://news.example.com/rss/articles/"), F.col("article_id"), F.lit("?hl=en"))
    return A.headline(spark, sf_dir).select("article_id", text.rss_id(u).alias("id"))


@query(f"SELECT article_id, sha256(lower(ticker) || '|' || {_NORM.format('title')} || '|' || {_NORM.format('source')} || '|' || strftime(published_at, '%Y-%m-%dT%H:%M:%S') || '+00:00') AS fingerprint FROM v_headline")
def hsh1_fingerprint(spark, sf_dir):
    return A.headline(spark, sf_dir).select("article_id", text.fingerprint(F.col("title"), F.col("ticker"), F.col("source"), F.col("published_at")).alias("fingerprint"))


@query("""WITH e AS (SELECT article_id, list_prepend(article_id, coalesce(list(article_id) OVER (PARTITION BY ticker, source ORDER BY article_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), [])) AS ids FROM v_headline)
SELECT article_id, left(sha256(array_to_string(ids, '|')), 32) AS fingerprint FROM e""")
def hsh2_evidence_fingerprint(spark, sf_dir):
    """Each article with up to five earlier ones of its company and source as evidence."""
    before = Window.partitionBy("ticker", "source").orderBy("article_id").rowsBetween(-5, -1)
    ids = F.concat(F.array("article_id"), F.collect_list("article_id").over(before))
    e = A.headline(spark, sf_dir).select("article_id", ids.alias("ids"))
    return e.select("article_id", text.evidence_fingerprint(F.transform("ids", lambda x: x.cast("string"))).alias("fingerprint"))


# --- dates and numbers ----------------------------------------------------------------


@query(f"SELECT article_id, round(greatest((epoch_us(TIMESTAMP '{A.AS_OF}') - epoch_us(published_at)) / 3.6e9, 0), 6) AS hours FROM v_headline")
def dat2_age(spark, sf_dir):
    return A.headline(spark, sf_dir).select("article_id", r6(maths.age_hours(_now(), F.col("published_at"))).alias("hours"))


@query("SELECT article_id, strftime(published_at, '%H:%M:%S') = '00:00:00' OR strftime(timezone('America/Los_Angeles', timezone('UTC', published_at)), '%H:%M:%S') = '00:00:00' AS date_only FROM v_headline")
def dat4_placeholder(spark, sf_dir):
    return A.headline(spark, sf_dir).select("article_id", rules.placeholder_stamp(F.col("published_at")).alias("date_only"))


@query("""WITH l AS (SELECT max(date) AS m FROM v_price), t AS (SELECT unnest([1, 3, 6, 12]) AS months)
SELECT CAST(months AS INTEGER) AS months, count(date) AS n, round(avg(close), 6) AS mean FROM t CROSS JOIN l JOIN v_price ON date >= CAST(m - to_months(CAST(months AS INTEGER)) AS DATE) GROUP BY 1""")
def dat6_timeframes(spark, sf_dir):
    p = A.price(spark, sf_dir)
    last = p.agg(F.max("date").alias("m")).withColumn("months", F.explode(F.array(*[F.lit(k) for k in (1, 3, 6, 12)])))
    spans = last.select("months", F.add_months("m", -F.col("months")).alias("since"))
    return p.join(F.broadcast(spans), F.col("date") >= F.col("since")).groupBy("months").agg(F.count("*").alias("n"), r6(F.avg("close")).alias("mean"))  # four spans


@query("SELECT CAST(d AS VARCHAR) AS window_start, count(v.article_id) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-26', INTERVAL 5 DAY)) AS w) CROSS JOIN LATERAL (SELECT CAST(w AS DATE) AS d) LEFT JOIN v_scored_article v ON v.published_at >= w AND v.published_at < w + INTERVAL 5 DAY GROUP BY 1")
def dat7_windows(spark, sf_dir):
    a = A.scored_article(spark, sf_dir)
    n = a.groupBy((F.floor(F.datediff(F.to_date("published_at"), F.lit("2024-01-01").cast("date")) / 5) * 5).cast("int").alias("k")).agg(F.count("*").alias("n"))
    starts = spark.sql("select explode(sequence(0, 25, 5)) as k")
    out = starts.join(n, "k", "left")
    return out.select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("k")).cast("string").alias("window_start"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT CAST(CAST(greatest(m, DATE '2023-11-10') AS DATE) AS VARCHAR) AS lo, CAST(CAST(least(m + INTERVAL 1 MONTH, DATE '2024-01-31') AS DATE) AS VARCHAR) AS hi FROM (SELECT unnest(generate_series(DATE '2023-11-01', DATE '2024-01-31', INTERVAL 1 MONTH)) AS m)")
def dat8_month_buckets(spark, sf_dir):
    from newsloom.operators.buckets import months

    return months(spark, "2023-11-10", "2024-01-31").select(F.col("lo").cast("string").alias("lo"), F.col("hi").cast("string").alias("hi"))


@query(f"SELECT article_id, round(pow(0.5, greatest((epoch_us(TIMESTAMP '{A.AS_OF}') - epoch_us(published_at)) / 8.64e10, 0) / CASE time_horizon WHEN 'immediate' THEN 1 WHEN 'days' THEN 7 WHEN 'weeks' THEN 28 WHEN 'months' THEN 120 WHEN 'long_term' THEN 365 ELSE 30 END), 6) AS decay FROM v_analysis")
def mth3_decay(spark, sf_dir):
    a = A.analysis(spark, sf_dir)
    return a.select("article_id", r6(maths.horizon_decay(maths.age_hours(_now(), F.col("published_at")) / 24, F.col("time_horizon"))).alias("decay"))


_STATE = "CASE WHEN claims_contradicted > 0 THEN 'contradicted' WHEN claims_corroborated > 0 THEN 'corroborated' ELSE 'neutral' END"
_SUPPORT = f"greatest(least(0.55 * confidence + 0.45 * greatest(least(evidence_strength - CASE WHEN {_STATE} = 'corroborated' THEN 0.15 ELSE 0 END, 1), 0) + CASE {_STATE} WHEN 'corroborated' THEN 0.10 WHEN 'contradicted' THEN -0.15 ELSE 0 END, 1), 0)"


@query(f"SELECT article_id, {_STATE} AS state, round({_SUPPORT}, 6) AS support FROM v_analysis")
def mth4_support(spark, sf_dir):
    a = A.analysis(spark, sf_dir).withColumn("state", risk.claim_state(F.col("claims_corroborated"), F.col("claims_contradicted")))
    return a.select("article_id", "state", r6(risk.support(F.col("confidence"), F.col("evidence_strength"), F.col("state"))).alias("support"))


@query("SELECT article_id, CASE WHEN magnitude >= 0.80 THEN 'High' WHEN magnitude >= 0.55 THEN 'Medium' ELSE 'Low' END AS impact, CASE WHEN relevance >= 0.85 THEN 2 WHEN relevance >= 0.70 THEN 1 ELSE 0 END AS band FROM v_analysis")
def mth8_labels(spark, sf_dir):
    return A.analysis(spark, sf_dir).select("article_id", maths.impact_label(F.col("magnitude")).alias("impact"), maths.relevance_band(F.col("relevance")).alias("band"))


@query("SELECT article_id, round(exp(a) / (exp(a) + exp(b) + 1), 6) AS p FROM (SELECT article_id, magnitude AS a, confidence AS b FROM v_analysis)")
def mth9_softmax(spark, sf_dir):
    a = A.analysis(spark, sf_dir)
    return a.select("article_id", r6(F.element_at(maths.softmax(F.array("magnitude", "confidence", F.lit(0.0))), 1)).alias("p"))


# --- paths from every session ---------------------------------------------------------
