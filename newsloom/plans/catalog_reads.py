"""The query catalogue, third part: stored reads, contracts, calendars, daily means,
baselines and short summaries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom import adapters as A
from newsloom.operators import windows
from newsloom.plans.catalog import query, r6

#: Ranks of the sample's states; a state that is not listed has rank -1.
STATES = ("click", "view", "signup", "purchase")
_DAILY = "d AS (SELECT ticker, CAST(published_at AS DATE) AS day, avg(sentiment_score) AS s, count(*) AS n FROM v_scored_article GROUP BY 1, 2)"


def _daily(spark, sf_dir) -> DataFrame:
    a = A.scored_article(spark, sf_dir)
    return a.groupBy("ticker", F.to_date("published_at").alias("day")).agg(F.avg("sentiment_score").alias("s"), F.count("*").alias("n"))


def _week() -> Window:
    """The seven calendar days that end with the row's own; days without rows do not count."""
    return Window.partitionBy("ticker").orderBy(F.unix_date("day")).rangeBetween(-6, 0)


# --- daily means ----------------------------------------------------------------------


@query(f"WITH {_DAILY} SELECT ticker, strftime(day, '%Y-%m-%d') AS day, round(avg(s) OVER (PARTITION BY ticker ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 6) AS mean_7d FROM d")
def win1_calendar_mean(spark, sf_dir):
    return _daily(spark, sf_dir).select("ticker", F.date_format("day", "yyyy-MM-dd").alias("day"), r6(F.avg("s").over(_week())).alias("mean_7d"))


@query(f"WITH {_DAILY} SELECT ticker, strftime(day, '%Y-%m-%d') AS day, round(sum(s * n) OVER w / sum(n) OVER w, 6) AS mean_3 FROM d WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def win2_observation_mean(spark, sf_dir):
    w = Window.partitionBy("ticker").orderBy("day").rowsBetween(-2, 0)
    return _daily(spark, sf_dir).select("ticker", F.date_format("day", "yyyy-MM-dd").alias("day"), r6(F.sum(F.col("s") * F.col("n")).over(w) / F.sum("n").over(w)).alias("mean_3"))


@query(f"""WITH {_DAILY}, m AS (SELECT *, avg(s) OVER (PARTITION BY ticker ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS ma FROM d)
SELECT ticker, strftime(date_trunc('week', day), '%Y-%m-%d') AS aligned, round(sum(s * n) / sum(n), 6) AS score, round(max_by(ma, day), 6) AS last_mean, CAST(sum(n) AS BIGINT) AS articles FROM m GROUP BY 1, 2""")
def agg25_aligned_sentiment(spark, sf_dir):
    m = _daily(spark, sf_dir).withColumn("ma", F.avg("s").over(_week()))
    out = m.groupBy("ticker", F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("aligned"))
    return out.agg(r6(F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("score"), r6(F.max_by("ma", "day")).alias("last_mean"), F.sum("n").alias("articles"))


@query("SELECT ticker, strftime(min(published_at), '%Y-%m-%d') || ' to ' || strftime(max(published_at), '%Y-%m-%d') || ', ' || (date_diff('day', CAST(min(published_at) AS DATE), CAST(max(published_at) AS DATE)) + 1 - count(DISTINCT CAST(published_at AS DATE))) || ' days without articles' AS note FROM v_scored_article GROUP BY ticker")
def mis27_coverage_note(spark, sf_dir):
    a = A.scored_article(spark, sf_dir).withColumn("day", F.to_date("published_at"))
    g = a.groupBy("ticker").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.count_distinct("day").alias("n"))
    gaps = F.date_diff("b", "a") + 1 - F.col("n")
    return g.select("ticker", F.concat(F.date_format("a", "yyyy-MM-dd"), F.lit(" to "), F.date_format("b", "yyyy-MM-dd"), F.lit(", "), gaps.cast("string"), F.lit(" days without articles")).alias("note"))


# --- prices ---------------------------------------------------------------------------


@query("""WITH own AS (SELECT DISTINCT o_custkey AS series, CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT series, CAST(max(idx) - min(idx) + 1 - count(*) AS BIGINT) AS gaps, count(*) AS observed FROM own JOIN v_session USING (date) GROUP BY 1""")
def agg13_price_gaps(spark, sf_dir):
    own = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderdate").cast("date").alias("date")).distinct()
    return own.join(A.session(spark, sf_dir), "date").groupBy("series").agg((F.max("idx") - F.min("idx") + 1 - F.count("*")).alias("gaps"), F.count("*").alias("observed"))


@query("""WITH x AS (SELECT o_custkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
SELECT o_custkey AS series, count(*) AS bars, round(max(abs(o_totalprice / before - 1)), 4) AS max_move, round(min(o_totalprice), 2) AS low, round(max(o_totalprice), 2) AS high FROM x GROUP BY 1""")
def mis38_price_summary(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = A.table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.lag("o_totalprice").over(w).alias("before"))
    move = F.abs(F.try_divide("o_totalprice", "before") - 1)
    return x.groupBy(F.col("o_custkey").alias("series")).agg(F.count("*").alias("bars"), F.round(F.max(move), 4).alias("max_move"), F.round(F.min("o_totalprice"), 2).alias("low"), F.round(F.max("o_totalprice"), 2).alias("high"))


@query("""WITH b AS (SELECT CAST(min(published_at) AS DATE) - 14 AS a, CAST(max(published_at) AS DATE) + 35 AS z FROM v_headline)
SELECT strftime(a, '%Y-%m-%d') AS first_day, strftime(z, '%Y-%m-%d') AS last_day FROM b""")
def mis13_calendar_range(spark, sf_dir):
    b = A.headline(spark, sf_dir).agg(F.to_date(F.min("published_at")).alias("a"), F.to_date(F.max("published_at")).alias("z"))
    return b.select(F.date_format(F.date_sub("a", 14), "yyyy-MM-dd").alias("first_day"), F.date_format(F.date_add("z", 35), "yyyy-MM-dd").alias("last_day"))


# --- contracts and stored reads -------------------------------------------------------

_VERSIONS = "v AS (SELECT article_id, CASE WHEN article_id % 5 = 0 THEN NULL ELSE 'p' || (article_id % 3) END AS prompt, 's' || (article_id % 2) AS schema, CASE WHEN article_id % 7 = 0 THEN 'old' ELSE 'm1' END AS model FROM v_headline)"


def _versions(spark, sf_dir) -> DataFrame:
    i = F.col("article_id")
    return A.headline(spark, sf_dir).select("article_id", F.when(i % 5 != 0, F.concat(F.lit("p"), i % 3)).alias("prompt"), F.concat(F.lit("s"), i % 2).alias("schema"), F.when(i % 7 == 0, "old").otherwise("m1").alias("model"))


def _display(prompt: str | None, schema: str) -> F.Column:
    return F.col("prompt").eqNullSafe(F.lit(prompt)) & F.col("schema").eqNullSafe(F.lit(schema))


@query(f"WITH {_VERSIONS} SELECT article_id, prompt IS NOT DISTINCT FROM NULL AND schema IS NOT DISTINCT FROM 's1' AS display, prompt IS NOT DISTINCT FROM 'p1' AND schema IS NOT DISTINCT FROM 's1' AND model IS NOT DISTINCT FROM 'm1' AS contract FROM v")
def fil7_compatible(spark, sf_dir):
    return _versions(spark, sf_dir).select("article_id", _display(None, "s1").alias("display"), (_display("p1", "s1") & F.col("model").eqNullSafe(F.lit("m1"))).alias("contract"))


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 4 = 0 THEN '{"k": ' WHEN event_id % 9 = 0 THEN '{"j": 1}' ELSE props END AS payload FROM events),
p AS (SELECT *, CASE WHEN json_valid(payload) THEN CAST(json_extract_string(payload, '$.k') AS BIGINT) END AS k FROM e)
SELECT user_id, event_id, k FROM p WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def fil8_schema_valid(spark, sf_dir):
    i = F.col("event_id")
    payload = F.when(i % 4 == 0, '{"k": ').when(i % 9 == 0, '{"j": 1}').otherwise(F.col("props"))
    e = A.table(spark, sf_dir, "events").withColumn("k", F.from_json(payload, "k bigint")["k"])
    return windows.newest_valid(e, ["user_id"], F.col("k").isNotNull(), [F.col("ts").desc(), i.desc()]).select("user_id", "event_id", "k")


@query(f"WITH {_VERSIONS} SELECT article_id % 50 AS subject, max(article_id) AS article_id FROM v WHERE model = 'm1' AND schema = 's1' GROUP BY 1")
def mis8_newest_under_contract(spark, sf_dir):
    v = _versions(spark, sf_dir).where("model = 'm1' and schema = 's1'")
    return v.groupBy((F.col("article_id") % 50).alias("subject")).agg(F.max("article_id").alias("article_id"))


@query("SELECT article_id FROM v_headline WHERE article_id IN (SELECT article_id FROM v_scored_article WHERE relevance >= 0.1)")
def mis3_scored_ids(spark, sf_dir):
    scored = A.scored_article(spark, sf_dir).where("relevance >= 0.1")
    return A.headline(spark, sf_dir).join(scored, "article_id", "left_semi").select("article_id")


@query("SELECT article_id, source, url, lower(title) AS title_key FROM v_headline WHERE ticker = 'T1' AND published_at >= TIMESTAMP '2024-01-05 00:00:00'")
def mis4_dedupe_keys(spark, sf_dir):
    h = A.headline(spark, sf_dir).where((F.col("ticker") == "T1") & (F.col("published_at") >= F.timestamp_seconds(F.lit(1704412800))))
    return h.select("article_id", "source", "url", F.lower("title").alias("title_key"))


@query("SELECT article_id FROM v_headline WHERE ticker = 'T2' AND NOT is_demo AND article_id <> 5 ORDER BY published_at DESC, article_id LIMIT 25")
def mis5_comparison_rows(spark, sf_dir):
    h = A.headline(spark, sf_dir).where("ticker = 'T2' and not is_demo and article_id <> 5")
    return h.orderBy(F.desc("published_at"), "article_id").limit(25).select("article_id")


@query("SELECT article_id, ticker, title FROM v_headline WHERE article_id = 42")
def mis6_point_lookup(spark, sf_dir):
    return A.headline(spark, sf_dir).where("article_id = 42").select("article_id", "ticker", "title")


# --- ranks, orders and sets -----------------------------------------------------------


@query("SELECT state, " + "CASE state " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STATES)) + " ELSE -1 END AS rank, count(*) AS n FROM v_scored_article GROUP BY 1, 2")
def map1_state_rank(spark, sf_dir):
    ranks = F.create_map(*[F.lit(x) for pair in zip(STATES, range(len(STATES))) for x in pair])
    s = A.scored_article(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))
    return s.select("state", F.coalesce(F.try_element_at(ranks, "state"), F.lit(-1)).alias("rank"), "n")


@query("SELECT article_id, CAST(row_number() OVER (PARTITION BY ticker ORDER BY magnitude DESC, evidence_strength DESC, published_at DESC, article_id) AS INTEGER) AS turn FROM v_analysis WHERE time_horizon IS NOT NULL AND magnitude < 0.5")
def top13_stale_backlog(spark, sf_dir):
    w = Window.partitionBy("ticker").orderBy(F.desc("magnitude"), F.desc("evidence_strength"), F.desc("published_at"), "article_id")
    return A.analysis(spark, sf_dir).where("time_horizon is not null and magnitude < 0.5").select("article_id", F.row_number().over(w).alias("turn"))


@query("SELECT article_id, CAST(row_number() OVER (PARTITION BY ticker ORDER BY article_id % 6 = 0 DESC, published_at DESC, article_id) AS INTEGER) AS turn FROM v_headline")
def top12_role_order(spark, sf_dir):
    w = Window.partitionBy("ticker").orderBy(F.desc(F.col("article_id") % 6 == 0), F.desc("published_at"), "article_id")
    return A.headline(spark, sf_dir).select("article_id", F.row_number().over(w).alias("turn"))


@query("""WITH want AS (SELECT DISTINCT ticker FROM v_scored_article), have AS (SELECT DISTINCT ticker FROM v_headline WHERE NOT is_demo)
SELECT coalesce(want.ticker, have.ticker) AS ticker, CASE WHEN have.ticker IS NULL THEN 'not covered' WHEN want.ticker IS NULL THEN 'left out' ELSE 'in' END AS scope FROM want FULL JOIN have ON want.ticker = have.ticker""")
def set11_role_scope(spark, sf_dir):
    want = A.scored_article(spark, sf_dir).select("ticker").distinct().withColumn("w", F.lit(True))
    have = A.headline(spark, sf_dir).where("not is_demo").select("ticker").distinct().withColumn("h", F.lit(True))
    scope = F.when(F.col("h").isNull(), "not covered").when(F.col("w").isNull(), "left out").otherwise("in")
    return want.join(have, "ticker", "full_outer").select("ticker", scope.alias("scope"))


@query("""WITH g AS (SELECT *, count(*) FILTER (magnitude >= 0.3 AND confidence >= 0.65) OVER (PARTITION BY ticker) AS n, row_number() OVER (PARTITION BY ticker ORDER BY magnitude DESC, confidence DESC, article_id) AS r FROM v_analysis)
SELECT article_id, magnitude >= 0.3 AND confidence >= 0.65 AS by_floor, r <= n AS by_top FROM g""")
def mis34_gold_baselines(spark, sf_dir):
    own, order = Window.partitionBy("ticker"), Window.partitionBy("ticker").orderBy(F.desc("magnitude"), F.desc("confidence"), "article_id")
    floor = (F.col("magnitude") >= 0.3) & (F.col("confidence") >= 0.65)
    g = A.analysis(spark, sf_dir).select("article_id", floor.alias("by_floor"), F.count_if(floor).over(own).alias("n"), F.row_number().over(order).alias("r"))
    return g.select("article_id", "by_floor", (F.col("r") <= F.col("n")).alias("by_top"))


@query("SELECT article_id, len(list_distinct(channels)) AS channels, list_contains(channels, channels[2]) AND channels[1] <> channels[2] AS mixed FROM v_analysis")
def arr1_channel_sets(spark, sf_dir):
    c = F.col("channels")
    mixed = F.array_contains(c, F.element_at(c, 2)) & (F.element_at(c, 1) != F.element_at(c, 2))
    return A.analysis(spark, sf_dir).select("article_id", F.size(F.array_distinct(c)).cast("bigint").alias("channels"), mixed.alias("mixed"))


# --- times ----------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unusable' WHEN event_id % 5 = 1 THEN 'date_only' ELSE 'full' END AS quality,
CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS day FROM events""")
def dat5_timestamp_quality(spark, sf_dir):
    """Three provider formats and a broken one are parsed; a plain date is date_only."""
    i, ts = F.col("event_id") % 5, F.col("ts")
    stamp = F.when(i == 0, F.lit("soon")).when(i == 1, F.date_format(ts, "yyyy-MM-dd")).when(i == 2, F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")).when(i == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    e = A.table(spark, sf_dir, "events").select("event_id", stamp.alias("stamp"))
    full = F.coalesce(*[F.try_to_timestamp("stamp", F.lit(f)) for f in ("yyyyMMdd'T'HHmmss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")])
    plain = F.try_to_timestamp("stamp", F.lit("yyyy-MM-dd"))
    quality = F.when(full.isNotNull(), "full").when(plain.isNotNull(), "date_only").otherwise("unusable")
    return e.select("event_id", quality.alias("quality"), F.date_format(F.coalesce(full, plain), "yyyy-MM-dd").alias("day"))


@query("SELECT article_id, CASE WHEN published_at >= TIMESTAMP '2024-01-10 00:00:00' THEN 'new' ELSE 'backfill' END AS lane FROM v_headline")
def mis18_live_window(spark, sf_dir):
    since = F.timestamp_seconds(F.lit(1704844800))
    return A.headline(spark, sf_dir).select("article_id", F.when(F.col("published_at") >= since, "new").otherwise("backfill").alias("lane"))
