"""Queries of the claim, coverage, role, order and format operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom import adapters as A
from newsloom.functions import formats, rules
from newsloom.operators import claims, coverage, reaction
from newsloom.plans.catalog import COMPANY, _SIGNALS, _TERMS, _second, _signals, query, r6
from newsloom.plans.catalog_more import _CLASS, _hit
from newsloom.session import written
from newsloom.sources import feeds

STATUS = ("corroborated", "contradicted", "unsupported", "uncertain")
STEPS = (1, 2, 3)


def _assessed(spark, sf_dir):
    """Headlines with three assessments each and six comparison articles."""
    i = F.col("article_id")
    assessments = F.array(*[
        F.struct(F.concat(F.lit("claim_"), (i * j % 4 + 1).cast("string")).alias("claim_id"), A.pick(STATUS, F.expr(f"article_id div {j}")).alias("status"),
                 F.when((i + j) % 3 != 0, F.array(i + j, i - j)).otherwise(F.expr("cast(array() as array<bigint>)")).alias("cited"))
        for j in STEPS
    ])
    near = F.filter(F.transform(F.array(*[F.lit(k) for k in (-3, -2, -1, 1, 2, 3)]), lambda k: i + k), lambda x: (x >= 0) & ((x != i + 3) | (i % 5 != 0)))
    evidence = F.transform(near, lambda x: F.struct(
        x.alias("article_id"), A.pick(A.PUBLISHERS, F.floor(x / 7)).alias("source"), F.lit("https://news.example.com/x").alias("url"), A.pick(A.HEADLINES, x).alias("title"), (F.lit(1704067200) + x * 2220).alias("published_s")))
    return A.headline(spark, sf_dir).withColumn("published_s", _second("published_at")).withColumn("assessments", assessments).withColumn("evidence", evidence).withColumn("claims", (i % 4).cast("int"))


_ASSESSED = f"""a AS (SELECT article_id, article_id % 4 AS claims, j, 'claim_' || (article_id * j % 4 + 1) AS claim_id, article_id * j % 4 + 1 AS number, {A._sql_pick(STATUS, 'article_id // j')} AS status,
  CASE WHEN (article_id + j) % 3 <> 0 THEN [article_id + j, article_id - j] ELSE [] END AS cited FROM v_headline, (SELECT unnest([1, 2, 3]) AS j)),
e AS (SELECT article_id, article_id + k AS other FROM v_headline, (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS k) WHERE article_id + k >= 0 AND (k <> 3 OR article_id % 5 <> 0))"""


@query(f"""WITH {_ASSESSED}, own AS (SELECT article_id, list(other) AS ids FROM e GROUP BY 1),
w AS (SELECT a.*, row_number() OVER (PARTITION BY a.article_id, claim_id ORDER BY j) AS nth, len(list_filter(cited, lambda x: NOT list_contains(own.ids, x))) AS foreign_n FROM a JOIN own USING (article_id)),
x AS (SELECT article_id, j, CASE WHEN number > claims OR nth > 1 THEN 'unknown_or_repeated_claim' WHEN foreign_n > 0 THEN 'citation_not_supplied' WHEN status IN ('corroborated', 'contradicted') AND len(cited) = 0 THEN 'decision_without_citation' END AS error FROM w)
SELECT article_id, arg_min(error, j) FILTER (error IS NOT NULL) AS error FROM x GROUP BY 1""")
def cls32_claim_errors(spark, sf_dir):
    a = _assessed(spark, sf_dir)
    return a.select("article_id", claims.claim_error(F.col("claims"), F.col("assessments"), F.transform("evidence", lambda e: e["article_id"])).alias("error"))


_TERM_LISTS = f"t AS (SELECT article_id, string_split(terms, ' ') AS terms FROM {_TERMS})"
_ORG = f"CASE WHEN {_CLASS} = 'official_company' THEN 'official-company' ELSE trim(regexp_replace(lower(source), '[^a-z0-9$]+', ' ', 'g')) END"
_CORROBORATED = f"""WITH {_ASSESSED}, {_TERM_LISTS.replace('t AS', 'tl AS', 1)},
heads AS (SELECT DISTINCT title, terms FROM v_headline JOIN tl USING (article_id)),
every AS (SELECT n AS article_id, {A._sql_pick(A.HEADLINES, 'n')} AS title, {A._sql_pick(A.PUBLISHERS, 'n // 7')} AS source FROM (SELECT unnest(range(0, (SELECT max(article_id) + 4 FROM v_headline))) AS n)),
orgs AS (SELECT article_id, {_ORG} AS org, {_CLASS} AS class, title FROM every),
cites AS (SELECT DISTINCT article_id, unnest(cited) AS other FROM a WHERE status = 'corroborated'),
s AS (SELECT c.article_id, c.other FROM cites c JOIN e USING (article_id, other)),
m AS (SELECT s.article_id, s.other, o.org, o.org <> p.org AND NOT (len(list_intersect(hp.terms, ho.terms)) >= 0.75 * least(len(hp.terms), len(ho.terms))) AS is_external
  FROM s JOIN orgs o ON o.article_id = s.other JOIN orgs p ON p.article_id = s.article_id JOIN heads hp ON hp.title = p.title JOIN heads ho ON ho.title = o.title),
c AS (SELECT article_id, count(*) AS total, count(*) FILTER (status = 'corroborated' AND len(cited) > 0) AS corroborated, count(*) FILTER (status = 'contradicted' AND len(cited) > 0) AS contradicted FROM a GROUP BY 1),
f AS (SELECT article_id, count(*) AS supporting, count(DISTINCT org) FILTER (is_external) AS external FROM m GROUP BY 1),
r AS (SELECT c.*, coalesce(supporting, 0) AS supporting, coalesce(external, 0) AS external, class = 'official_company' AS is_official FROM c JOIN orgs USING (article_id) LEFT JOIN f USING (article_id))
"""


@query(_CORROBORATED + "SELECT article_id, CAST(total AS INTEGER) AS total, CAST(corroborated AS INTEGER) AS corroborated, CAST(contradicted AS INTEGER) AS contradicted, CAST(total - corroborated - contradicted AS INTEGER) AS unresolved, CAST(supporting AS INTEGER) AS supporting, CAST(external AS INTEGER) AS external, is_official FROM r")
def agg14_corroboration(spark, sf_dir):
    return claims.corroboration(_assessed(spark, sf_dir)).select("article_id", "total", "corroborated", "contradicted", "unresolved", "supporting", "external", "is_official")


@query(_CORROBORATED + """SELECT article_id, CASE WHEN corroborated = 0 THEN 'No external corroboration found' WHEN external = 0 AND is_official THEN 'Supported only by the company''s own channels' WHEN external = 0 THEN 'Supported only by the same publisher'
  ELSE corroborated || CASE WHEN corroborated = 1 THEN ' claim corroborated' ELSE ' claims corroborated' END || ' · ' || external || CASE WHEN external = 1 THEN ' external source' ELSE ' external sources' END END AS label,
  CASE WHEN contradicted > 0 THEN 'Conflicting evidence on ' || contradicted || ' of ' || total || ' claims' END AS conflict FROM r""")
def prj7_corroboration_labels(spark, sf_dir):
    c = claims.corroboration(_assessed(spark, sf_dir))
    return c.select("article_id", claims.corroboration_label(F.col("corroborated"), F.col("external"), F.col("is_official")).alias("label"), claims.contradiction_label(F.col("contradicted"), F.col("total")).alias("conflict"))


@query(f"""WITH tl AS (SELECT article_id, string_split(terms, ' ') AS terms FROM {_TERMS})
SELECT a.article_id, len(list_intersect(x.terms, y.terms)) >= 0.75 * least(len(x.terms), len(y.terms)) AS restates FROM v_headline a JOIN v_headline b ON b.article_id = a.article_id + 22 JOIN tl x ON x.article_id = a.article_id JOIN tl y ON y.article_id = b.article_id
UNION ALL SELECT a.article_id, len(list_intersect(x.terms, y.terms)) >= 0.75 * least(len(x.terms), len(y.terms)) FROM v_headline a JOIN v_headline b ON b.article_id = a.article_id + 3 JOIN tl x ON x.article_id = a.article_id JOIN tl y ON y.article_id = b.article_id""")
def cls23_restates(spark, sf_dir):
    h = A.headline(spark, sf_dir).select("article_id", "title", _second("published_at").alias("s"))
    other = h.select(F.col("article_id").alias("o"), F.col("title").alias("ot"), F.col("s").alias("os"))
    ahead = lambda k: h.join(other, F.col("o") == F.col("article_id") + k).select("article_id", claims.restates(F.col("title"), F.col("s"), F.col("ot"), F.col("os")).alias("restates"))
    return ahead(22).unionAll(ahead(3))


@query("""WITH p AS (SELECT article_id, ticker, unnest(['T0', 'T' || (article_id % 4), 'T' || ((article_id + 1) % 5)]) AS x FROM v_headline)
SELECT article_id, CAST(count(DISTINCT x) FILTER (x <> ticker AND x <> 'T4') AS INTEGER) AS related FROM p GROUP BY 1""")
def cls33_related_companies(spark, sf_dir):
    i = F.col("article_id")
    proposed = F.array(F.lower("ticker"), F.lit("t0"), F.concat(F.lit("t"), i % 4), F.concat(F.lit("T"), (i + 1) % 5), F.concat(F.lit("T"), i % 4))
    got = claims.related_companies(proposed, F.array(*[F.lit(x) for x in ("t0", "T1", "T2", "T3")]), F.col("ticker"))
    return A.headline(spark, sf_dir).select("article_id", F.size(got).alias("related"))


_GATE = "regexp_matches(title, '(?i)governments?\\b|\\bregulators?\\b|\\bregulations?\\b|antitrust') OR regexp_matches(title, '\\b(SEC|FTC|DOJ|CFIUS)\\b')"


@query(f"SELECT article_id, CASE WHEN event_type = 'regulation' AND NOT ({_GATE}) THEN 'other' ELSE event_type END AS event_type FROM v_analysis")
def cls16_regulation_gate(spark, sf_dir):
    a = A.analysis(spark, sf_dir)
    return a.select("article_id", claims.gated_type(F.col("event_type"), F.col("title")).alias("event_type"))


@query("""SELECT article_id, CASE WHEN title LIKE 'Pension fund exits%' OR title LIKE 'Globex Advisors%' THEN CASE WHEN article_id % 2 = 0 THEN 'other' ELSE event_type END ELSE event_type END AS event_type,
  CASE WHEN (title LIKE 'Pension fund exits%' OR title LIKE 'Globex Advisors%') AND article_id % 2 = 0 THEN least(magnitude, 0.1) ELSE magnitude END AS magnitude FROM v_analysis""")
def cls17_holding_normalised(spark, sf_dir):
    a = A.analysis(spark, sf_dir)
    held = F.col("title").like("Pension fund exits%") | F.col("title").like("Globex Advisors%")
    summary = F.when(held & (F.col("article_id") % 2 == 0), F.lit("A hedge fund sold 5,000 shares of Acme Corporation")).otherwise(F.lit("Acme opens an office"))
    e = a.select("article_id", "event_type", "magnitude", held.alias("external"), summary.alias("summary"), F.array(F.lit("no claim")).alias("claim_texts"))
    return claims.normalised_holding(e, *COMPANY).select("article_id", "event_type", "magnitude")


@query(f"""WITH c AS (SELECT article_id, {_CLASS} AS class FROM v_headline)
SELECT article_id, round(least(1.0, CASE class WHEN 'official_company' THEN 0.45 WHEN 'regulatory_or_filing' THEN 0.45 WHEN 'major_financial_news' THEN 0.35 WHEN 'industry_specialist' THEN 0.25 WHEN 'general_news' THEN 0.2 WHEN 'commentary_or_opinion' THEN 0.1 ELSE 0.05 END
  + 3 * 0.08 + least(len(list_distinct(['p' || (article_id % 2), 'p' || (article_id % 3), 'q'])), 3) * 0.04 + CASE WHEN article_id % 4 > 0 THEN 0.15 ELSE 0 END), 6) AS strength FROM c""")
def mth5_evidence_strength(spark, sf_dir):
    i = F.col("article_id")
    sources = F.array(F.concat(F.lit("p"), i % 2), F.concat(F.lit("P"), i % 3), F.lit("q"), F.lit("Q"))
    h = A.headline(spark, sf_dir).withColumn("class", rules.source_class(F.col("source"), F.col("url"), F.col("title")))
    return h.select("article_id", r6(claims.evidence_strength(F.col("class"), sources, F.pmod(i, F.lit(4)))).alias("strength"))


_PLAIN = "(SELECT article_id, list(DISTINCT t) AS terms FROM (SELECT article_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]{3,}')) AS t FROM v_headline) WHERE t NOT IN ('with', 'from', 'that', 'this', 'will', 'after', 'about') GROUP BY 1)"


@query(f"""WITH p AS {_PLAIN}, c AS (SELECT article_id, {_CLASS} AS class FROM v_headline)
SELECT a.article_id, round(1 + len(list_intersect(x.terms, y.terms)) / greatest(len(x.terms), 1) + 1 / (1 + abs(floor((epoch(a.published_at) - epoch(b.published_at)) / 86400))) + CASE WHEN c.class IN ('official_company', 'major_financial_news', 'regulatory_or_filing') THEN 0.2 ELSE 0 END, 6) AS score
FROM v_headline a JOIN v_headline b ON b.article_id = a.article_id + 41 JOIN p x ON x.article_id = a.article_id JOIN p y ON y.article_id = b.article_id JOIN c ON c.article_id = b.article_id""")
def mth6_evidence_score(spark, sf_dir):
    h = A.headline(spark, sf_dir)
    b = h.select(F.col("article_id").alias("o"), F.col("title").alias("ot"), F.col("published_at").alias("oa"), rules.source_class(F.col("source"), F.col("url"), F.col("title")).alias("oc"))
    j = h.join(b, F.col("o") == F.col("article_id") + 41)
    return j.select("article_id", r6(claims.evidence_score(F.col("title"), F.col("published_at"), F.col("ot"), F.col("oa"), F.col("oc"))).alias("score"))


MEMBERS = (("ACME", "Acme Corporation", ()), ("GLBX", "Globex Inc", ("Globex Advisors",)), ("SEC", "Sector Holdings plc", ()), ("T1", "Supplier shortage", ()), ("CFO", "Office Limited", ("stock price",)))


@query(r"""WITH f AS (SELECT article_id, ticker, title, ' ' || array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') || ' ' AS flat FROM v_headline),
n AS (SELECT unnest([{'s': 'ACME', 'p': 'acme corporation'}, {'s': 'ACME', 'p': 'acme'}, {'s': 'GLBX', 'p': 'globex'}, {'s': 'GLBX', 'p': 'globex inc'}, {'s': 'GLBX', 'p': 'globex advisors'}, {'s': 'T1', 'p': 'supplier shortage'}, {'s': 'CFO', 'p': 'stock price'}, {'s': 'CFO', 'p': 'office'}]) AS n)
SELECT DISTINCT article_id, n.s AS symbol FROM f, n WHERE contains(flat, ' ' || n.p || ' ') AND n.s <> ticker
UNION SELECT article_id, s FROM f, (SELECT unnest(['ACME', 'GLBX', 'SEC', 'CFO']) AS s) WHERE regexp_matches(title, '(^|[^A-Za-z0-9])' || s || '([^A-Za-z0-9]|$)')""")
def jn18_mentioned_companies(spark, sf_dir):
    companies = spark.createDataFrame([(s, n, list(a)) for s, n, a in MEMBERS], "symbol string, name string, aliases array<string>")
    return claims.mentioned_companies(A.headline(spark, sf_dir).withColumn("snippet", F.lit(None).cast("string")), companies)


# --- providers and coverage -----------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 1 THEN 'failed' WHEN event_id % 3 = 0 THEN 'partial' WHEN event_id % 2 = 0 THEN 'empty' ELSE 'ok' END AS outcome,
  greatest(CAST(floor(epoch(ts)) AS BIGINT) - 172800, 1706659200 - 20 * 86400) AS start_s, CAST(floor(epoch(ts)) AS BIGINT) - 172800 < 1706659200 - 20 * 86400 AS gap FROM events""")
def cls28_fetch_outcomes(spark, sf_dir):
    i = F.col("event_id")
    start, gap = coverage.fetch_start(_second("ts"), F.lit(1706659200).cast("bigint"), 2 * 86400, 20 * 86400)
    outcome = coverage.fetch_outcome(i % 7 == 0, F.when(i % 5 == 1, 1).otherwise(0), F.when(i % 3 == 0, 4).otherwise(0), i % 2)
    return A.table(spark, sf_dir, "events").select("event_id", outcome.alias("outcome"), start.alias("start_s"), gap.alias("gap"))


_MARKS = """m AS (SELECT 'T' || (user_id % 40) AS ticker, 'p' || (user_id % 3) AS provider, max(event_id) AS through, CAST(count(*) % 3 AS INTEGER) AS problems FROM events WHERE event_type = 'view' GROUP BY 1, 2),
r AS (SELECT 'T' || (user_id % 50) AS ticker, 'p' || (user_id % 3) AS provider, min(CASE WHEN event_id % 11 IN (0, 1) THEN 0 ELSE 1 END) AS done, max(event_id + 10) AS z FROM events WHERE event_type = 'purchase' AND value > 400 GROUP BY 1, 2)"""


@query(f"WITH {_MARKS} SELECT ticker, provider, CASE WHEN done = 1 THEN greatest(coalesce(through, z), z) ELSE through END AS through, CAST(CASE WHEN done IS NULL THEN problems WHEN done = 1 THEN 0 ELSE coalesce(problems, 0) + 1 END AS INTEGER) AS problems FROM m FULL JOIN r USING (ticker, provider)")
def stm5_watermarks(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    key = lambda n: (F.concat(F.lit("T"), F.col("user_id") % n).alias("ticker"), F.concat(F.lit("p"), F.col("user_id") % 3).alias("provider"))
    marks = e.where("event_type = 'view'").groupBy(*key(40)).agg(F.max("event_id").alias("through"), (F.count("*") % 3).alias("problems"))
    outcome = F.when(F.col("event_id") % 11 == 0, "failed").when(F.col("event_id") % 11 == 1, "partial").when(F.col("event_id") % 2 == 0, "empty").otherwise("ok")
    results = e.where("event_type = 'purchase' and value > 400").select(*key(50), outcome.alias("outcome"), (F.col("event_id") + 10).alias("window_end"))
    return coverage.advanced(marks, results)


_COVER = "c AS (SELECT 'T' || c_custkey AS ticker, c_acctbal > 5000 AS active, c_custkey * 10 AS started, 30 AS live_days, c_custkey AS updated FROM customer), w AS (SELECT DISTINCT 'T' || (o_custkey + 7) AS ticker FROM orders WHERE o_orderpriority = '1-URGENT')"


@query(f"WITH {_COVER} SELECT ticker, coalesce(active, false) OR w.ticker IS NOT NULL AS active, coalesce(started, 999) AS started, coalesce(live_days, 14) AS live_days, CASE WHEN w.ticker IS NOT NULL THEN 999 ELSE updated END AS updated FROM c FULL JOIN w USING (ticker)")
def ups6_activation(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select(F.concat(F.lit("T"), "c_custkey").alias("ticker"), (F.col("c_acctbal") > 5000).alias("active"), (F.col("c_custkey") * 10).alias("started"), F.lit(30).alias("live_days"), F.col("c_custkey").alias("updated"))
    w = A.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit(" t"), F.col("o_custkey") + 7).alias("ticker"))
    return coverage.activated(c, w, F.lit(999).cast("bigint"), 14)


@query(f"""WITH {_COVER}, q AS (SELECT o_orderkey AS key, 'T' || (o_custkey + 7) AS ticker, CAST(o_orderdate AS DATE) AS d, o_custkey % 13 <> 0 AS known FROM orders),
j AS (SELECT q.*, coalesce(c.active, false) AS on_already FROM q LEFT JOIN c USING (ticker)), f AS (SELECT ticker, min((d, key)) AS first FROM j WHERE NOT on_already AND known GROUP BY 1),
p AS (SELECT * FROM f ORDER BY first LIMIT 5)
SELECT CASE WHEN on_already THEN 'already_active' WHEN NOT known THEN 'rejected' WHEN (d, key) = p.first THEN 'activated' WHEN p.first IS NOT NULL THEN 'already_active' ELSE 'deferred' END AS fate, count(*) AS n FROM j LEFT JOIN p USING (ticker) GROUP BY 1""")
def cmp12_admission(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select(F.concat(F.lit("T"), "c_custkey").alias("ticker"), (F.col("c_acctbal") > 5000).alias("active"))
    q = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.concat(F.lit("T"), F.col("o_custkey") + 7).alias("ticker"), F.col("o_orderdate").cast("date").alias("requested_at"), (F.col("o_custkey") % 13 != 0).alias("known"))
    return coverage.admitted(q, c, 5).groupBy("fate").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT *, CASE WHEN relevance > 0.8 THEN row_number() OVER (PARTITION BY ticker, relevance > 0.8 ORDER BY relevance DESC, article_id) END AS pick FROM v_headline)
SELECT article_id, row_number() OVER (PARTITION BY ticker ORDER BY pick NULLS LAST, published_at DESC, article_id) AS place FROM p""")
def top11_processing_order(spark, sf_dir):
    w = Window.partitionBy("ticker", F.col("relevance") > 0.8).orderBy(F.desc("relevance"), "article_id")
    h = A.headline(spark, sf_dir).withColumn("pick", F.when(F.col("relevance") > 0.8, F.row_number().over(w)))
    return coverage.processing_order(h, ["ticker"], "pick").select("article_id", "place")


@query(f"""SELECT article_id, CASE WHEN is_demo THEN 'demo' WHEN relevance < 0.5 THEN 'low_relevance' WHEN title = 'Globex Advisors LLC sells 1,200 shares of Acme Corporation' THEN 'external_holding' WHEN {_hit(rules.PREDICTION)} THEN 'price_prediction'
  WHEN {_hit(rules.REACTION_ONLY)} THEN 'market_reaction_only' WHEN title LIKE '%sells shares under 10b5-1 plan' THEN 'scheduled_insider_sale' END AS reason FROM v_headline""")
def cls21_skip_reason(spark, sf_dir):
    return coverage.skip_reason(A.headline(spark, sf_dir), 0.5, *COMPANY).select("article_id", "reason")


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'US' WHEN 2 THEN 'US' WHEN 3 THEN 'LONDON' WHEN 4 THEN 'LONDON' END AS exchange, CASE WHEN c_custkey % 6 < 3 THEN 'SPY' WHEN c_custkey % 6 < 5 THEN 'CUKX.L' END AS benchmark FROM customer")
def cls31_exchange(spark, sf_dir):
    listing = A.pick((" S&P 500", "XNYS", "xnas ", "FTSE 100", "xlon", "Xetra"), F.col("c_custkey"))
    venue = coverage.exchange(listing)
    return A.table(spark, sf_dir, "customer").select("c_custkey", venue.alias("exchange"), coverage.benchmark(venue).alias("benchmark"))


# --- roles on sessions ----------------------------------------------------------------

_ROLED = _SIGNALS.rstrip() + ", rl AS (SELECT *, CASE WHEN l % 3 = 0 THEN 'principal' WHEN l % 3 = 1 THEN 'mentioned' END AS role FROM (SELECT *, CAST(split_part(article_id, '-', 2) AS INTEGER) + CAST(split_part(article_id, '-', 1) AS BIGINT) AS l FROM told WHERE again = 1))"
_ORGS = "CASE WHEN source IN ('Nvidia Newsroom') THEN 'official' ELSE lower(source) END"


def _roles(spark, sf_dir):
    n = F.col("l_linenumber") + F.col("l_orderkey")
    rows = A.table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("article_id"), F.when(n % 3 == 0, "principal").when(n % 3 == 1, "mentioned").alias("role"))
    return rows.where("role is not null").distinct()


def _members(spark, sf_dir):
    d = reaction._distinct_reports(reaction._placed(A.reaction_article(spark, sf_dir), A.session(spark, sf_dir))).where("not again")
    return d.select("ticker", "idx", "article_id", rules.organisation(F.col("source"), F.col("url"), F.col("title")).alias("organisation"))


@query(_ROLED + f""", q AS (SELECT ticker, idx, 'include' AS policy, count(DISTINCT {_ORGS}) FILTER (role = 'principal' OR role IS NULL) >= 3 AS ok FROM rl GROUP BY 1, 2
UNION ALL SELECT ticker, idx, 'exclude', count(DISTINCT {_ORGS}) FILTER (role = 'principal') >= 3 FROM rl GROUP BY 1, 2 UNION ALL SELECT ticker, idx, 'session_ineligible', count(DISTINCT {_ORGS}) FILTER (role = 'principal') >= 3 AND count(*) FILTER (role IS NULL) = 0 FROM rl GROUP BY 1, 2)
SELECT ticker, policy, count(*) AS sessions, count(*) FILTER (ok) AS qualified FROM q GROUP BY 1, 2""")
def cls29_role_eligibility(spark, sf_dir):
    members, roles = written(_members(spark, sf_dir)), _roles(spark, sf_dir)
    out = None
    for policy in coverage.POLICIES:
        own = coverage.qualifying_sessions(members, roles, policy).groupBy("ticker").agg(F.count("*").alias("sessions"), F.count(F.when(F.col("qualifies"), 1)).alias("qualified")).withColumn("policy", F.lit(policy))
        out = own if out is None else out.unionByName(own)
    return out


@query(_SIGNALS.rstrip() + " SELECT ticker, count(DISTINCT article_id) AS articles FROM told JOIN signals USING (ticker, idx) WHERE again = 1 AND signals.sources >= 3 GROUP BY 1")
def mis17_role_priority(spark, sf_dir):
    return coverage.role_priority(_signals(spark, sf_dir)).groupBy("ticker").agg(F.count("*").alias("articles"))


@query(_SIGNALS.rstrip() + """, q AS (SELECT s.*, CASE WHEN signal >= tp THEN 'positive' WHEN signal <= -tn THEN 'negative' END AS regime FROM signals s JOIN tau USING (ticker))
SELECT ticker, regime, count(*) AS tail_sessions, count(*) FILTER (sources >= 3) AS with_3_sources, count(*) FILTER (sources >= 3 AND date_only_share = 0) AS exact_timing FROM q WHERE regime IS NOT NULL GROUP BY 1, 2""")
def mis40_funnel(spark, sf_dir):
    s = written(_signals(spark, sf_dir))
    return reaction.tail_funnel(s, reaction.thresholds(s, ["ticker"]))


@query(None)
def cmp5_regime_results(spark, sf_dir):
    s = A.session(spark, sf_dir)
    signals = written(_signals(spark, sf_dir))
    out = reaction.regime_results(signals, reaction.thresholds(signals, ["ticker"]), reaction.aligned_prices(A.price(spark, sf_dir), s))
    return out.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


# --- formats --------------------------------------------------------------------------


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE epoch(date_trunc('second', ts))::BIGINT END AS at_s FROM events")
def dat3_provider_stamps(spark, sf_dir):
    t = F.col("ts").cast("timestamp")
    written = F.when(F.col("event_id") % 4 == 0, F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")).when(F.col("event_id") % 4 == 1, F.date_format(t, "yyyyMMddHHmmss")).when(F.col("event_id") % 4 == 2, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(t, "dd/MM/yyyy"))
    return A.table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(formats.parsed_stamp(written)).alias("at_s"))


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def dat1_utc_date(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", formats.utc_date(F.col("ts").cast("timestamp")).cast("string").alias("day"))


@query("SELECT article_id, CAST(('0x' || left(sha256('v1|bootstrap|' || ticker || '|h' || (article_id % 11)), 16))::UBIGINT AS VARCHAR) AS seed FROM v_headline")
def hsh3_seed(spark, sf_dir):
    return A.headline(spark, sf_dir).select("article_id", formats.seed(F.col("ticker"), F.concat(F.lit("h"), F.col("article_id") % 11)).cast("string").alias("seed"))


@query("SELECT article_id, row_number() OVER (PARTITION BY ticker ORDER BY CASE WHEN article_id % 6 = 0 THEN strftime(published_at, '%Y-%m-%d') || 'T99' ELSE strftime(published_at, '%Y-%m-%dT%H:%M:%S') END, article_id) AS place FROM v_headline")
def mis12_order_key(spark, sf_dir):
    dated = F.col("article_id") % 6 == 0
    key = formats.order_key(F.when(~dated, F.col("published_at")), F.to_date("published_at"), F.col("article_id"))
    return A.headline(spark, sf_dir).select("article_id", F.row_number().over(Window.partitionBy("ticker").orderBy(key)).alias("place"))


@query("SELECT article_id, CASE WHEN article_id % 9 = 0 THEN '–' ELSE printf('%+.1f%%', (article_id % 41 - 20) / 8 * 100) END AS share, strftime(published_at, '%-d %b %Y') AS day FROM v_headline")
def str15_display(spark, sf_dir):
    share = F.when(F.col("article_id") % 9 != 0, (F.col("article_id") % 41 - 20) / 8)
    return A.headline(spark, sf_dir).select("article_id", formats.percent(share).alias("share"), formats.short_date(F.col("published_at")).alias("day"))


@query("""WITH p AS (SELECT article_id, title, relevance, CASE WHEN article_id % 8 = 0 THEN 1.5 ELSE relevance END AS r FROM v_headline)
SELECT article_id, title AS read_title, true AS kept FROM p WHERE article_id % 5 <> 0 AND r <= 1 UNION ALL SELECT article_id, NULL, false FROM p WHERE article_id % 5 = 0 OR r > 1""")
def jsn1_payload_codec(spark, sf_dir):
    r = F.when(F.col("article_id") % 8 == 0, 1.5).otherwise(F.col("relevance"))
    written = formats.encoded(F.struct("title", r.alias("relevance")))
    broken = F.when(F.col("article_id") % 5 == 0, F.concat(F.lit("["), written)).otherwise(written)
    h = A.headline(spark, sf_dir).withColumn("payload", broken).withColumn("p", F.from_json("payload", "title string, relevance double"))
    read = formats.decoded(F.col("payload"), "title string, relevance double", {"range": F.col("p.relevance").between(0, 1)})
    return h.select("article_id", read["title"].alias("read_title"), read.isNotNull().alias("kept"))


@query("SELECT article_id, article_id % 4 <> 1 AS same FROM v_headline")
def jsn2_same_json(spark, sf_dir):
    a = F.concat(F.lit('{"a": '), F.col("article_id"), F.lit(', "b": "x"}'))
    b = F.concat(F.lit('{"b": "x", "a": '), F.col("article_id") + F.when(F.col("article_id") % 4 == 1, 1).otherwise(0), F.lit("}"))
    return A.headline(spark, sf_dir).select("article_id", formats.same_json(a, b).alias("same"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS state FROM events")
def mis9_known_values(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", formats.known(F.col("event_type"), ("view", "click")).alias("state"))


@query("""WITH b AS (SELECT ticker, min(relevance) AS lo, max(relevance) AS hi FROM v_headline GROUP BY 1), p AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) * 0.1 ELSE greatest(abs(hi) * 0.05, 1.0) END AS pad FROM b)
SELECT ticker, round(lo - pad, 6) AS first, round(lo - pad + (hi - lo + 2 * pad) * 2 / 4, 6) AS middle, round(hi + pad, 6) AS last FROM p""")
def mth10_axis_ticks(spark, sf_dir):
    b = A.headline(spark, sf_dir).groupBy("ticker").agg(formats.axis_ticks(F.min("relevance"), F.max("relevance")).alias("t"))
    return b.select("ticker", r6(F.get("t", F.lit(0))).alias("first"), r6(F.get("t", F.lit(2))).alias("middle"), r6(F.get("t", F.lit(4))).alias("last"))


# --- sources --------------------------------------------------------------------------


@query("""SELECT doc_id // 50 AS window_no, count(*) AS n, count(*) FILTER (doc_id % 9 <> 0) AS dated FROM documents WHERE doc_id // 50 < coalesce((SELECT min(doc_id // 50) FROM documents WHERE (doc_id // 50) % 13 = 12), 1000000000) GROUP BY 1""")
def src3_windowed_json(spark, sf_dir):
    d = A.headline(spark, sf_dir).withColumn("window", F.expr("cast(article_id div 50 as int)"))
    stamp = F.when(F.col("article_id") % 9 == 0, F.lit("soon")).otherwise(F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'"))
    listed = d.groupBy("window").agg(F.to_json(F.struct(F.collect_list(F.struct("url", "title", stamp.alias("seendate"), F.col("source").alias("domain"))).alias("articles"))).alias("body"))  # fifty articles a window
    broken = F.when(F.col("window") % 13 == 12, F.lit("<html>busy</html>")).otherwise(F.col("body"))
    articles, _ = feeds.windowed_articles(listed.select("window", broken.alias("body")))
    return articles.groupBy(F.col("window").cast("bigint").alias("window_no")).agg(F.count("*").alias("n"), F.count("published_at").alias("dated"))


@query("SELECT 'S.' || s_suppkey AS symbol, 'S-' || s_suppkey AS feed_symbol, s_name || ' & Co' AS name, 'S&P 500' AS market FROM supplier")
def src7_member_table(spark, sf_dir):
    row = F.concat(F.lit("<tr class=x><td><a href='#'>S."), "s_suppkey", F.lit("</a><sup>[1]</sup></td>\n<td>x</td><td> "), "s_name", F.lit(" &amp; Co [note 2]</td></tr>"))
    block = A.table(spark, sf_dir, "supplier").withColumn("page", F.expr("s_suppkey div 50")).groupBy("page").agg(F.array_join(F.collect_list(row), "\n").alias("rows"))  # fifty members a page
    html = F.concat(F.lit("<p>x</p><table id=other><tr><td>no</td></tr></table><TABLE class='w' id=\"constituents\"><tr><th>Symbol</th><th>Sector</th><th>Security</th></tr>"), "rows", F.lit("<tr><td></td><td>a</td><td>b</td></tr></table>"))
    return feeds.member_table(block.select(html.alias("html")), "Symbol", "Security", "S&P 500")


@query("""WITH u AS (SELECT article_id, url, 0 AS p, relevance, published_at FROM v_headline WHERE article_id % 3 <> 0 UNION ALL SELECT article_id, url, 1, relevance, published_at FROM v_headline WHERE article_id % 2 = 0),
k AS (SELECT url, arg_min(p, (p, -epoch_us(published_at), article_id)) AS provider_no, count(*) AS copies FROM u GROUP BY 1) SELECT provider_no, count(*) AS articles, CAST(sum(copies) AS BIGINT) AS rows FROM k GROUP BY 1""")
def set1_provider_union(spark, sf_dir):
    h = A.headline(spark, sf_dir)
    both = feeds.merged_providers([h.where("article_id % 3 <> 0"), h.where("article_id % 2 = 0")], ["article_id", "url", "published_at"])
    first = both.groupBy("url").agg(F.min_by("provider_no", F.struct("provider_no", -F.unix_micros("published_at"), "article_id")).alias("provider_no"), F.count("*").alias("copies"))
    return first.groupBy("provider_no").agg(F.count("*").alias("articles"), F.sum("copies").alias("rows"))
