"""The query catalogue, second half: rules, grouping, risk, merges, evaluation,
projections and the batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom import adapters as A
from newsloom.functions import maths, rules, text
from newsloom.operators import buckets, grouping, risk, store, windows
from newsloom.plans.catalog import NAMES, _jobs, _JOBS, _mid, _MID, _now, _TERMS, COMPANY, query, r6
from newsloom.streaming import incremental

# --- rules ----------------------------------------------------------------------------


def _title(expr):
    return A.headline, expr


def _hit(patterns: tuple[str, ...], column: str = "title") -> str:
    both = "|".join(f"(?:{p})" for p in patterns).replace("'", "''")
    return f"regexp_matches({column}, '(?i){both}')"


_CLASS = f"""CASE WHEN lower(source) IN ('nvidia newsroom', 'nvidia blog') THEN 'official_company' WHEN lower(source) = 'sec' THEN 'regulatory_or_filing'
 WHEN {_hit((r'\breuters\b|\bbloomberg\b|\bcnbc\b',), 'source')} THEN 'major_financial_news' WHEN lower(source) IN ('the register', 'tom''s hardware') THEN 'industry_specialist'
 WHEN {_hit(('opinion|motley fool|seeking alpha|price prediction',), "source || ' ' || title")} THEN 'commentary_or_opinion' WHEN source = 'unknown source' THEN 'unknown' ELSE 'general_news' END"""


@query(f"SELECT article_id, {_CLASS} AS source_class FROM v_headline")
def cls1_source_class(spark, sf_dir):
    return A.headline(spark, sf_dir).select("article_id", rules.source_class(F.col("source"), F.col("url"), F.col("title")).alias("source_class"))


@query(f"SELECT article_id, CASE WHEN {_CLASS} = 'official_company' THEN 'official-company' ELSE trim(regexp_replace(lower(source), '[^a-z0-9$]+', ' ', 'g')) END AS organisation FROM v_headline")
def cls2_organisation(spark, sf_dir):
    return A.headline(spark, sf_dir).select("article_id", rules.organisation(F.col("source"), F.col("url"), F.col("title")).alias("organisation"))


@query("""WITH t AS (SELECT article_id, lower(title) AS t FROM v_headline), f AS (SELECT *, regexp_matches(t, 'shares|stock|earnings|revenue|profit|market|investor|company|chip|gpu|software') AS fin FROM t),
s AS (SELECT *, CASE WHEN contains(t, 'acme corporation') THEN 0.85::DOUBLE WHEN regexp_matches(t, '\\bacme\\b') THEN 0.7::DOUBLE ELSE 0::DOUBLE END AS base FROM f)
SELECT article_id, round(CASE WHEN base > 0 AND fin THEN least(base + 0.1::DOUBLE, 1.0::DOUBLE) ELSE base END, 6) AS relevance FROM s""".replace("\\\\", "\\"))
def cls3_relevance(spark, sf_dir):
    return A.headline(spark, sf_dir).select("article_id", r6(rules.relevance(F.col("title"), *COMPANY)).alias("relevance"))


@query(f"SELECT article_id FROM v_headline WHERE {_hit(rules.DISCLOSURE)}")
def cls4_disclosure(spark, sf_dir):
    return A.headline(spark, sf_dir).where(rules.hit(F.col("title"), rules.DISCLOSURE)).select("article_id")


@query(f"SELECT article_id FROM v_headline WHERE {_hit(rules.ACTION)}")
def cls5_action(spark, sf_dir):
    return A.headline(spark, sf_dir).where(rules.hit(F.col("title"), rules.ACTION)).select("article_id")


@query(f"SELECT article_id, {_hit(rules.COMMENTARY_GUARD)} AS commentary, {_hit(rules.MARKET_MOVE)} AS market_move FROM v_headline")
def cls6_guards(spark, sf_dir):
    return A.headline(spark, sf_dir).select("article_id", rules.hit(F.col("title"), rules.COMMENTARY_GUARD).alias("commentary"), rules.hit(F.col("title"), rules.MARKET_MOVE).alias("market_move"))


@query(None)
def cls7_percent_move(spark, sf_dir):
    return A.headline(spark, sf_dir).select("article_id", rules.percent_move(F.col("title")).alias("percent_move"))


@query(f"SELECT article_id, {_hit(rules.PREDICTION)} AS prediction, {_hit(rules.REACTION_ONLY)} AS reaction_only FROM v_headline")
def cls8_prediction(spark, sf_dir):
    return A.headline(spark, sf_dir).select("article_id", rules.hit(F.col("title"), rules.PREDICTION).alias("prediction"), rules.hit(F.col("title"), rules.REACTION_ONLY).alias("reaction_only"))


@query(f"SELECT article_id FROM v_headline WHERE {_hit(rules.DISPOSAL)}")
def cls9_stake_disposal(spark, sf_dir):
    return A.headline(spark, sf_dir).where(rules.hit(F.col("title"), rules.DISPOSAL)).select("article_id")


@query(None)
def cls10_external_holding(spark, sf_dir):
    return A.headline(spark, sf_dir).where(rules.external_holding(F.col("title"), *COMPANY)).select("article_id")


@query(None)
def cls12_planned_sale(spark, sf_dir):
    return A.headline(spark, sf_dir).where(rules.planned_insider_sale(F.col("title"), NAMES)).select("article_id")


@query(None)
def cls13_appointment(spark, sf_dir):
    t = F.when(F.col("article_id") % 2 == 0, F.lit("Globex appoints Acme CFO as new chief executive")).otherwise(F.col("title"))
    return A.headline(spark, sf_dir).select("article_id", rules.third_party_appointment(t, NAMES).alias("third_party"))


_THEME = "CASE " + " ".join(f"WHEN {_hit(p, 'phrase')} THEN '{n}'" for n, p in rules.THEMES) + " ELSE 'unmapped' END"


@query(f"WITH c AS (SELECT article_id, unnest(channels) AS phrase FROM v_analysis) SELECT {_THEME} AS theme, count(*) AS n FROM c GROUP BY 1")
def cls14_theme(spark, sf_dir):
    c = A.analysis(spark, sf_dir).select(F.explode("channels").alias("phrase"))
    return c.groupBy(rules.theme(F.col("phrase")).alias("theme")).agg(F.count("*").alias("n"))


_REALIZED = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.REALIZED.items()) + " END"


@query(f"SELECT article_id, CASE WHEN event_type = 'regulation' AND {_hit(rules.CYBER_INCIDENT)} THEN 'cybersecurity' ELSE {_REALIZED} END AS theme FROM v_analysis")
def cls15_realized_theme(spark, sf_dir):
    return A.analysis(spark, sf_dir).select("article_id", rules.realized_theme(F.col("event_type"), F.col("title")).alias("theme"))


@query(f"SELECT article_id FROM v_headline WHERE NOT ({_hit(rules.COMMENTARY_GUARD)} OR {_hit(rules.MARKET_MOVE)} OR {_hit(rules.DISPOSAL)}) AND ({_hit(rules.DISCLOSURE)} OR {_hit(rules.ACTION)})")
def mis1_priority_signal(spark, sf_dir):
    return A.headline(spark, sf_dir).where(rules.priority_signal(F.col("title"))).select("article_id")


@query("SELECT name, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS name FROM documents WHERE regexp_matches(text, '{p}')" for k, p in rules.LEAKS.items()) + ") GROUP BY 1")
def cls30_secret_shapes(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("text")
    found = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in rules.LEAKS.items()]), lambda x: x.isNotNull())
    return d.select(F.explode(found).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


# --- materiality and risk -------------------------------------------------------------


def _assessed(spark, sf_dir):
    a = A.analysis(spark, sf_dir).withColumn("external_support", F.col("claims_corroborated") >= 2)
    return risk.assess(a, NAMES)


@query(None)
def cls18_materiality(spark, sf_dir):
    return _assessed(spark, sf_dir).select("article_id", "failed_condition", "tier", "source_class", "rescued")


@query(None)
def agg16_rejection_histogram(spark, sf_dir):
    return risk.rejections(_assessed(spark, sf_dir))


@query("SELECT event_type, CASE WHEN event_type IN ('earnings', 'regulation', 'litigation', 'acquisition', 'analyst_or_guidance_change') THEN 1 WHEN event_type IN ('product_launch', 'partnership', 'other', 'uncertain') THEN 3 ELSE 2 END AS tier, count(*) AS n FROM v_analysis GROUP BY 1, 2")
def cls19_tier(spark, sf_dir):
    return A.analysis(spark, sf_dir).groupBy("event_type", risk.tier(F.col("event_type"), F.lit(False)).alias("tier")).agg(F.count("*").alias("n"))


@query(None)
def cmp3_developments(spark, sf_dir):
    a = _assessed(spark, sf_dir)
    out = risk.developments(a, risk.material_groups(a, " ".join(COMPANY)))
    return out.select("ticker", "place", "article_id", "group_id", "reports", "publishers", "tier")


@query(None)
def set6_components(spark, sf_dir):
    return risk.material_groups(_assessed(spark, sf_dir), " ".join(COMPANY))


_SIGNAL = f"""
WITH m AS (SELECT *, CASE WHEN claims_contradicted > 0 THEN 'contradicted' WHEN claims_corroborated > 0 THEN 'corroborated' ELSE 'neutral' END AS st FROM v_analysis WHERE event_type <> 'uncertain' AND magnitude >= 0.30 AND confidence >= 0.65 AND direction <> 'uncertain'),
parts AS (SELECT *, {_REALIZED.replace('END', 'END')} AS theme, 1.0 AS factor, 'realized' AS kind FROM m WHERE direction = 'negative' AND NOT (event_type = 'regulation' AND {_hit(rules.CYBER_INCIDENT)})
  UNION ALL SELECT *, 'cybersecurity', 1.0, 'realized' FROM m WHERE direction = 'negative' AND event_type = 'regulation' AND {_hit(rules.CYBER_INCIDENT)}
  UNION ALL SELECT * EXCLUDE (phrase), {_THEME}, CASE direction WHEN 'negative' THEN 0.85 WHEN 'mixed' THEN 0.70 ELSE 0.60 END, 'channel' FROM (SELECT *, unnest(list_distinct(channels)) AS phrase FROM m))
SELECT article_id, theme, kind, round(greatest(least(magnitude * factor, 1), 0)
  * greatest(least(0.55 * confidence + 0.45 * greatest(least(evidence_strength - CASE WHEN st = 'corroborated' THEN 0.15 ELSE 0 END, 1), 0) + CASE st WHEN 'corroborated' THEN 0.10 WHEN 'contradicted' THEN -0.15 ELSE 0 END, 1), 0)
  * pow(0.5, greatest((epoch_us(TIMESTAMP '{A.AS_OF}') - epoch_us(published_at)) / 8.64e10, 0) / CASE time_horizon WHEN 'immediate' THEN 1 WHEN 'days' THEN 7 WHEN 'weeks' THEN 28 WHEN 'months' THEN 120 WHEN 'long_term' THEN 365 ELSE 30 END), 5) AS score
FROM parts WHERE theme IS NOT NULL AND theme <> 'unmapped'
"""


def _risk_signals(spark, sf_dir):
    return risk.signals(A.analysis(spark, sf_dir), A.AS_OF, NAMES)


@query(_SIGNAL)
def cmp1_risk_signals(spark, sf_dir):
    return _risk_signals(spark, sf_dir).select("article_id", "theme", "kind", (F.round("score", 5) + 0.0).alias("score"))


@query(None)
def cmp2_risk_ranking(spark, sf_dir):
    return risk.ranked(_risk_signals(spark, sf_dir))


@query("SELECT article_id, CASE WHEN s >= 70 THEN 'Severe' WHEN s >= 50 THEN 'Elevated' WHEN s >= 30 THEN 'Moderate' ELSE 'Watch' END AS band FROM (SELECT article_id, article_id % 101 AS s FROM v_analysis)")
def cls27_risk_band(spark, sf_dir):
    return A.analysis(spark, sf_dir).select("article_id", maths.risk_band(F.col("article_id") % 101).alias("band"))


# --- de-duplication and candidates ----------------------------------------------------


def _keyed(spark, sf_dir):
    h = grouping.with_title_keys(A.headline(spark, sf_dir))
    return h.withColumn("provider_id", F.when(F.col("article_id") % 11 == 0, F.concat(F.lit("p"), F.expr("article_id div 22"))))


@query(None)
def set2_dedup(spark, sf_dir):
    k = _keyed(spark, sf_dir).select("article_id", "ticker", "provider_id", "url", "canonical_url", "title_key", "source_key", "published_s", "relevance")
    return grouping.dedup_counts(grouping.tiered_dedup(k, ["ticker"]))


@query("""WITH k AS (SELECT article_id, trim(regexp_replace(lower(title), '[^a-z0-9$]+', ' ', 'g')) AS t, trim(regexp_replace(lower(source), '[^a-z0-9$]+', ' ', 'g')) AS s, CAST(epoch(published_at) AS BIGINT) // 10 AS at FROM v_headline)
SELECT x.article_id AS a, y.article_id AS b FROM k x JOIN k y ON x.t = y.t AND x.s = y.s AND x.article_id < y.article_id AND abs(x.at - y.at) <= 21600""")
def set3_near_title(spark, sf_dir):
    k = _keyed(spark, sf_dir).withColumn("published_s", F.expr("published_s div 10"))
    return grouping.near_title_pairs(k)


@query(f"""WITH t AS (SELECT h.article_id, ticker, CAST(epoch(published_at) AS BIGINT) AS s, string_split(terms, ' ') AS terms FROM v_headline h JOIN {_TERMS} USING (article_id))
SELECT x.article_id AS a, y.article_id AS b FROM t x JOIN t y ON x.ticker = y.ticker AND x.article_id < y.article_id AND abs(x.s - y.s) <= 172800 AND len(list_intersect(x.terms, y.terms)) >= 0.75 * least(len(x.terms), len(y.terms)) AND len(list_intersect(x.terms, y.terms)) > 0""")
def jn17_similar_pairs(spark, sf_dir):
    h = A.headline(spark, sf_dir).withColumn("terms", text.title_terms(F.col("title"))).withColumn("published_s", F.unix_timestamp("published_at"))
    return grouping.similar_pairs(h, ["ticker"], "terms", 48 * 3600, 0.75)


@query(None)
def set5_first_match(spark, sf_dir):
    s = _risk_signals(spark, sf_dir).select("article_id", "ticker", "theme", F.round("score", 9).alias("score"), text.title_terms(F.col("title")).alias("terms"), F.unix_timestamp("published_at").alias("published_s"))
    return grouping.first_match_groups(s, ["ticker", "theme"]).groupBy("ticker", "theme").agg(F.count("*").alias("signals"), (F.max("group_no") + 1).alias("groups"))


def _ladder(title):
    return (
        F.when(F.col("is_demo"), "demo").when(F.col("relevance") < 0.5, "low_relevance").when(rules.external_holding(title, *COMPANY), "holding")
        .when(rules.hit(title, rules.PREDICTION), "prediction").when(rules.hit(title, rules.REACTION_ONLY), "market_reaction").when(rules.planned_insider_sale(title, NAMES), "insider_sale").otherwise("eligible")
    )


@query(None)
def cls20_candidate_ladder(spark, sf_dir):
    return A.headline(spark, sf_dir).groupBy(_ladder(F.col("title")).alias("reason")).agg(F.count("*").alias("n"))


def _ranked(spark, sf_dir):
    h = A.headline(spark, sf_dir).withColumn("reason", _ladder(F.col("title"))).where("reason = 'eligible'")
    cls = rules.source_class(F.col("source"), F.col("url"), F.col("title"))
    h = h.withColumn("source_class", cls).withColumn("priority", rules.priority_signal(F.col("title")))
    day = F.to_date("published_at").cast("string")
    w = Window.partitionBy("ticker", "bucket").orderBy(F.desc(maths.mapped(F.col("source_class"), rules.SOURCE_RANK, 1)), F.desc("priority"), F.desc(maths.relevance_band(F.col("relevance"))), F.desc("published_at"), F.desc("relevance"), "article_id")
    return h.withColumn("bucket", day).withColumn("rank", F.row_number().over(w))


@query(None)
def top8_rank_key(spark, sf_dir):
    return _ranked(spark, sf_dir).select("ticker", "bucket", "rank", "article_id")


@query(None)
def top7_candidates(spark, sf_dir):
    r = _ranked(spark, sf_dir).select("article_id", "ticker", "bucket", "rank", text.normalize_text(F.col("source")).alias("publisher"), (F.col("source_class") == "official_company").alias("official"), "priority", text.selector_terms(F.col("title")).alias("terms"), F.unix_timestamp("published_at").alias("published_s"))
    return grouping.select_candidates(r, ["ticker", "bucket"], 5, bonus=2).where("pick is not null").select("ticker", "bucket", "pick", "article_id")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY ticker, source ORDER BY relevance DESC, article_id) AS n FROM v_headline WHERE NOT is_demo), o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY CASE WHEN n = 1 THEN 0 ELSE 1 END, relevance DESC, article_id) AS place FROM r)
SELECT ticker, CAST(place AS INTEGER) AS place, article_id FROM o WHERE place <= 5""")
def top9_diverse_evidence(spark, sf_dir):
    h = A.headline(spark, sf_dir).where("not is_demo")
    r = h.withColumn("n", F.row_number().over(Window.partitionBy("ticker", "source").orderBy(F.desc("relevance"), "article_id")))
    w = Window.partitionBy("ticker").orderBy(F.when(F.col("n") == 1, 0).otherwise(1), F.desc("relevance"), "article_id")
    return r.withColumn("place", F.row_number().over(w)).where("place <= 5").select("ticker", "place", "article_id")


# --- merges and job states ------------------------------------------------------------


def _batches(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    rows = e.select(
        (F.col("event_id") % 500).cast("string").alias("fingerprint"), F.concat(F.lit("T"), F.col("event_id") % 7).alias("ticker"), F.concat(F.lit("n"), F.col("event_id") % 11).alias("normalized_title"),
        F.concat(F.lit("t"), F.col("event_id") % 13).alias("title"), F.concat(F.lit("s"), F.col("event_id") % 17).alias("source"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("published_at"),
        F.round(F.col("value") / 500, 4).alias("relevance"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), "event_id")).alias("snippet"), (F.col("event_id") % 2 == 0).alias("is_demo"), F.col("event_id").alias("seq"),
    )
    middle = F.col("seq") % 2 == 0
    return rows.where(middle), rows.where(~middle)


@query("""SELECT CAST(event_id % 500 AS VARCHAR) AS fingerprint, 'T' || (min(event_id) % 7) AS ticker, 'n' || (min(event_id) % 11) AS normalized_title, 't' || (max(event_id) % 13) AS title, 's' || (max(event_id) % 17) AS source,
  CAST(floor(max(epoch(ts))) AS BIGINT) AS published_at, round(max(value / 500), 4) AS relevance, 'x' || max(event_id) FILTER (event_id % 3 = 0) AS snippet, bool_and(event_id % 2 = 0) AS is_demo, max(event_id) AS seq FROM events GROUP BY event_id % 500""")
def ups1_article_merge(spark, sf_dir):
    return store.merge_articles(*_batches(spark, sf_dir))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def ups2_replace_latest(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("user_id", "event_id")
    old = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    new = e.where("event_id % 2 = 1").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return store.replace_rows(old, new, ["user_id"])


@query("SELECT CAST(d AS VARCHAR) AS date, CASE WHEN d >= DATE '2024-01-20' THEN 2 ELSE 1 END AS version, n FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)")
def ups3_replace_window(spark, sf_dir):
    from newsloom.operators.sentiment import replace_window

    days = A.table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("date")).agg(F.count("*").alias("n"))
    out = replace_window(days.withColumn("version", F.lit(1)), days.withColumn("version", F.lit(2)), "2024-01-20")
    return out.select(F.col("date").cast("string").alias("date"), "version", "n")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'old' ELSE 'new' END AS version FROM documents")
def ups4_append_missing(spark, sf_dir):
    old = A.table(spark, sf_dir, "labels").select("doc_id", F.lit("old").alias("version"))
    return store.append_missing(old, A.table(spark, sf_dir, "documents").select("doc_id", F.lit("new").alias("version")), ["doc_id"])


@query("""WITH e AS (SELECT 'T' || (user_id % 5) AS ticker, event_type AS provider, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_id FROM events),
a AS (SELECT ticker, provider, max(s) AS through, max(s) AS success_at, 3 AS failures FROM e WHERE event_id % 2 = 0 AND ticker <> 'T4' GROUP BY 1, 2),
b AS (SELECT ticker, provider, min(s) AS through, max(s) AS attempt_at, CASE ticker WHEN 'T0' THEN 'failed' WHEN 'T1' THEN 'partial' ELSE 'ok' END AS status FROM e WHERE event_id % 2 = 1 AND ticker <> 'T3' GROUP BY 1, 2)
SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.provider, b.provider) AS provider, greatest(a.through, b.through) AS through, coalesce(CASE WHEN b.status = 'ok' THEN b.attempt_at END, a.success_at) AS success_at,
  CAST(CASE WHEN b.status IS NULL THEN a.failures WHEN b.status = 'failed' THEN coalesce(a.failures, 0) + 1 ELSE 0 END AS INTEGER) AS failures, coalesce(b.status, 'idle') AS status FROM a FULL JOIN b ON a.ticker = b.ticker AND a.provider = b.provider""")
def ups5_watermark_merge(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select(F.concat(F.lit("T"), F.col("user_id") % 5).alias("ticker"), F.col("event_type").alias("provider"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"), "event_id")
    a = e.where("event_id % 2 = 0 and ticker <> 'T4'").groupBy("ticker", "provider").agg(F.max("s").alias("through"), F.max("s").alias("success_at"), F.lit(3).alias("failures"))
    b = e.where("event_id % 2 = 1 and ticker <> 'T3'").groupBy("ticker", "provider").agg(F.min("s").alias("through"), F.max("s").alias("attempt_at"))
    b = b.withColumn("status", F.when(F.col("ticker") == "T0", "failed").when(F.col("ticker") == "T1", "partial").otherwise("ok"))
    return store.merge_watermarks(a, b)


@query(_JOBS + f" SELECT job_id, CASE WHEN state = 'pending' OR (state IN ('retry', 'running') AND due_at <= {_MID}) THEN 'running' ELSE state END AS state, CASE WHEN state = 'pending' OR (state IN ('retry', 'running') AND due_at <= {_MID}) THEN 'me' ELSE 'other' END AS lease_owner FROM jobs")
def ups7_claim(spark, sf_dir):
    return store.claim(_jobs(spark, sf_dir), _mid(), "me").select("job_id", "state", "lease_owner")


@query(_JOBS + " SELECT job_id, CASE WHEN job_id % 6 = 0 THEN 'analyzed' ELSE state END AS state, job_id % 7 + CASE WHEN job_id % 2 = 0 THEN 10 ELSE 0 END AS tokens FROM jobs")
def ups8_finish(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).withColumn("lease_owner", F.when(F.col("job_id") % 3 == 0, "me").otherwise("other"))
    done = jobs.where("job_id % 2 = 0").select("job_id", F.lit("analyzed").alias("outcome"), F.lit(10).alias("spent"))
    return store.finish(jobs, done, "me").select("job_id", "state", "tokens")


@query(_JOBS + " SELECT job_id, CASE WHEN job_id % 2 = 1 THEN state WHEN job_id % 5 + 1 >= CASE WHEN job_id % 4 = 0 THEN 2 ELSE 4 END THEN 'failed' ELSE 'retry' END AS state, CAST(job_id % 5 + CASE WHEN job_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS failure_count FROM jobs")
def ups10_retry_policy(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).withColumn("failure_kind", F.when(F.col("job_id") % 2 == 0, F.when(F.col("job_id") % 4 == 0, "invalid").otherwise("transient")))
    return store.after_failure(jobs, _now()).select("job_id", "state", "failure_count")


@query("SELECT article_id, CASE WHEN article_id IN (SELECT doc_id FROM labels) THEN 'analyzed' WHEN is_demo THEN 'skipped:demo' WHEN published_at < TIMESTAMP '2024-01-03 00:00:00' THEN 'baseline' WHEN relevance < 0.5 THEN 'skipped:low_relevance' ELSE 'pending' END AS state FROM v_headline")
def ups11_reconcile(spark, sf_dir):
    done = A.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"))
    return store.reconcile(A.headline(spark, sf_dir), done, F.lit("2024-01-03").cast("timestamp"), F.when(F.col("relevance") < 0.5, F.lit("low_relevance")))


@query(None)
def cmp9_budgeted(spark, sf_dir):
    o = A.table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, "cached").when(F.col("event_id") % 5 == 0, "failed").otherwise("ok").alias("outcome"))
    return store.budgeted(o, ["user_id"], "event_id", 10).groupBy("user_id").agg(F.count(F.when(F.col("ran"), 1)).alias("ran"), F.count("*").alias("n"))


# --- evaluation -----------------------------------------------------------------------


@query("SELECT count(*) FILTER (p AND q) AS tp, count(*) FILTER (p AND NOT q) AS fp, count(*) FILTER (NOT p AND q) AS fn, count(*) FILTER (NOT p AND NOT q) AS tn, round(count(*) FILTER (p AND q) / nullif(count(*) FILTER (p), 0), 6) AS precision_, round(count(*) FILTER (p AND q) / nullif(count(*) FILTER (q), 0), 6) AS recall_ FROM (SELECT n_chars > 1500 AS p, quality = 1 AS q FROM documents JOIN labels USING (doc_id))")
def agg18_confusion(spark, sf_dir):
    from newsloom.operators import evaluate

    m = A.table(spark, sf_dir, "documents").join(A.table(spark, sf_dir, "labels"), "doc_id")
    return evaluate.confusion(m, F.col("n_chars") > 1500, F.col("quality") == 1)


_PAIRS = "WITH g AS (SELECT doc_id, quality * 10 + doc_id % 40 AS gold, doc_id % 40 AS pred FROM labels), gp AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gold = b.gold AND a.doc_id < b.doc_id), pp AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.pred = b.pred AND a.doc_id < b.doc_id)"


@query(_PAIRS + " SELECT (SELECT count(*) FROM gp) AS gold_pairs, (SELECT count(*) FROM pp) AS predicted_pairs, (SELECT count(*) FROM gp JOIN pp USING (a, b)) AS shared_pairs")
def agg19_pairwise_pr(spark, sf_dir):
    from newsloom.operators import evaluate

    g = A.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 10 + F.col("doc_id") % 40).alias("gold"), (F.col("doc_id") % 40).alias("pred"))
    return evaluate.pairwise(g, "gold", "pred")


@query("SELECT event_type, direction, count(*) AS n, round(avg(magnitude), 6) AS mean_magnitude, GROUPING(event_type, direction) AS level FROM v_analysis GROUP BY GROUPING SETS ((event_type), (direction), (event_type, direction), ())")
def agg20_audit(spark, sf_dir):
    a = A.analysis(spark, sf_dir)
    a.createOrReplaceTempView("nl_analysis")
    return spark.sql("SELECT event_type, direction, count(*) AS n, round(avg(magnitude), 6) AS mean_magnitude, grouping_id(event_type, direction) AS level FROM nl_analysis GROUP BY GROUPING SETS ((event_type), (direction), (event_type, direction), ())")


@query("WITH d AS (SELECT CAST(published_at AS DATE) AS d, count(DISTINCT source) AS publishers FROM v_headline GROUP BY 1) SELECT count(*) AS days, count(*) FILTER (publishers >= 3) AS covered_days, max(publishers) AS most FROM d")
def agg22_probe_summary(spark, sf_dir):
    d = A.headline(spark, sf_dir).groupBy(F.to_date("published_at").alias("d")).agg(F.count_distinct("source").alias("publishers"))
    return d.agg(F.count("*").alias("days"), F.count(F.when(F.col("publishers") >= 3, 1)).alias("covered_days"), F.max("publishers").alias("most"))


@query("SELECT count(*) FILTER (published_at >= TIMESTAMP '2024-01-10 00:00:00') AS after_boundary, CAST(min(epoch(published_at)) AS BIGINT) AS earliest_s FROM v_headline")
def agg26_earliest(spark, sf_dir):
    return A.headline(spark, sf_dir).agg(F.count(F.when(F.col("published_at") >= F.lit("2024-01-10").cast("timestamp"), 1)).alias("after_boundary"), F.min(F.unix_timestamp("published_at")).alias("earliest_s"))


@query("SELECT h.ticker, count(*) FILTER (l.quality = 1) AS principal, count(*) FILTER (l.quality = 0) AS mentioned, count(*) FILTER (l.doc_id IS NULL) AS unlabelled FROM v_headline h LEFT JOIN labels l ON l.doc_id = h.article_id GROUP BY 1")
def agg27_role_counts(spark, sf_dir):
    h, lab = A.headline(spark, sf_dir), A.table(spark, sf_dir, "labels")
    one = lambda c: F.count(F.when(c, 1))
    return h.join(lab, h.article_id == lab.doc_id, "left").groupBy("ticker").agg(one(F.col("quality") == 1).alias("principal"), one(F.col("quality") == 0).alias("mentioned"), one(F.col("doc_id").isNull()).alias("unlabelled"))


@query("SELECT CAST(sum(n) AS BIGINT) AS considered, max(rank) AS worst FROM (SELECT event_type, count(*) AS n, CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 1 ELSE 0 END AS rank FROM events GROUP BY 1)")
def agg17_merge_counters(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    rank = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "click", 1).otherwise(0)
    return e.agg(F.sum("n").alias("considered"), F.max(rank).alias("worst"))


@query("SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1 UNION ALL (SELECT doc_id FROM labels WHERE quality = 0 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1)")
def set7_set_operations(spark, sf_dir):
    lab = A.table(spark, sf_dir, "labels")
    ids = lambda c: lab.where(c).select("doc_id")
    return ids("quality = 1").intersect(ids("toxic = 1")).unionAll(ids("quality = 0").subtract(ids("toxic = 1")))


@query("SELECT article_id, array_to_string(list_sort(list_distinct(channels)), '|') AS channels FROM v_analysis")
def set8_ordered_unique(spark, sf_dir):
    return A.analysis(spark, sf_dir).select("article_id", F.array_join(F.array_sort(F.array_distinct("channels")), "|").alias("channels"))


@query("SELECT article_id, CASE WHEN article_id % 4 = 0 THEN 'new' ELSE 'old' END AS version FROM v_headline")
def set9_marker_replace(spark, sf_dir):
    h = A.headline(spark, sf_dir).select("article_id")
    return store.replace_rows(h.withColumn("version", F.lit("old")), h.where("article_id % 4 = 0").withColumn("version", F.lit("new")), ["article_id"])


@query("SELECT article_id, title, CAST(CAST(published_at AS DATE) AS VARCHAR) AS date, CASE WHEN magnitude >= 0.80 THEN 'High' WHEN magnitude >= 0.55 THEN 'Medium' ELSE 'Low' END AS impact, CASE WHEN claims_corroborated = 1 THEN '1 claim' ELSE claims_corroborated || ' claims' END AS support FROM v_analysis")
def prj1_chart_event(spark, sf_dir):
    return A.analysis(spark, sf_dir).select("article_id", "title", F.to_date("published_at").cast("string").alias("date"), maths.impact_label(F.col("magnitude")).alias("impact"), text.plural(F.col("claims_corroborated"), "claim").alias("support"))


@query("SELECT ticker, count(*) AS articles, array_to_string(list_sort(list_distinct(array_agg(source))), ', ') AS sources FROM v_headline GROUP BY 1")
def prj2_overview(spark, sf_dir):
    return A.headline(spark, sf_dir).groupBy("ticker").agg(F.count("*").alias("articles"), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))


# --- streaming twins and windows ------------------------------------------------------


def _events(spark, sf_dir):
    return A.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_tumbling(spark, sf_dir):
    t = incremental.tumbling(_events(spark, sf_dir))
    return t.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS d FROM events) GROUP BY 1")
def ext_sliding(spark, sf_dir):
    return incremental.sliding(_events(spark, sf_dir)).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_session(spark, sf_dir):
    return incremental.sessions(_events(spark, sf_dir)).select("user_id", F.unix_timestamp("start").alias("start_s"), "n")


@query("SELECT ticker, CAST(d AS VARCHAR) AS date, count(*) AS n FROM (SELECT DISTINCT ticker, article_id, CAST(published_at AS DATE) AS d FROM v_scored_article) GROUP BY 1, 2")
def stm9_incremental_daily(spark, sf_dir):
    a = A.scored_article(spark, sf_dir).withColumn("date", F.to_date("published_at"))
    late = a.where("article_id % 10 = 0")
    rows = a.unionByName(late).dropDuplicates(["article_id"])
    return rows.groupBy("ticker", F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"))


@query("SELECT ticker, CAST(floor(epoch(greatest(t - INTERVAL 48 HOUR, TIMESTAMP '2024-01-17 00:00:00'))) AS BIGINT) AS start_s, t < TIMESTAMP '2024-01-17 00:00:00' AS gap FROM (SELECT ticker, max(published_at) AS t FROM v_scored_article GROUP BY 1)")
def dat9_fetch_window(spark, sf_dir):
    w = A.scored_article(spark, sf_dir).groupBy("ticker").agg(F.max("published_at").alias("t"))
    start, gap = buckets.fetch_window(F.col("t"), _now())
    return w.select("ticker", F.unix_timestamp(start).alias("start_s"), gap.alias("gap"))


@query("SELECT article_id FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY published_at, article_id) AS r FROM v_headline) WHERE r = 1")
def win10_keep_first(spark, sf_dir):
    return windows.top_per(A.headline(spark, sf_dir), ["title"], [F.col("published_at"), F.col("article_id")], 1).select("article_id")
