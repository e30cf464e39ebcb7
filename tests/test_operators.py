"""Scalar goldens, order-dependent operators against plain versions, funnels."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsloom import adapters as A
from newsloom.functions import maths, rules, text
from newsloom.operators import grouping, reaction, risk, sentiment, store, windows
from newsloom.plans import catalog


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_daily_weights_recent_articles_more(spark):
    rows = [("T", "2024-01-01 04:00:00", 0.0, 1.0, 0.0, -1.0, 1.0), ("T", "2024-01-01 16:00:00", 1.0, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "ticker string, at string, positive double, negative double, neutral double, sentiment_score double, relevance double")
    out = sentiment.daily(df.withColumn("published_at", F.col("at").cast("timestamp")), "2024-01-01 20:00:00", 12.0).first()
    assert out["score"] == pytest.approx(1 / 3)


def test_calendar_mean_ignores_days_beyond_a_week(spark):
    days = spark.createDataFrame([("T", "2024-01-01", -1.0, 1.0), ("T", "2024-01-08", 1.0, 1.0), ("T", "2024-01-14", 0.5, 1.0)], "ticker string, d string, score double, aggregate_weight double")
    got = sentiment.with_windows(days.withColumn("date", F.col("d").cast("date"))).orderBy("date").collect()
    assert got[-1]["moving_average_7d"] == pytest.approx(0.75)


def test_exclusivity_keeps_from_the_last_kept(spark):
    df = spark.createDataFrame([("a", i) for i in (0, 2, 4, 5, 7, 10)], "k string, idx bigint")
    got = windows.exclusive(df, ["k"], "idx", 5).where("kept").orderBy("idx").collect()
    assert [r["idx"] for r in got] == [0, 5, 10]


def test_rate_limit_counts_accepted_only(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 10, 20, 59, 60, 61)], "k string, at bigint")
    got = windows.rate_limited(df, ["k"], "at", 2, 60).orderBy("at").collect()
    assert [r["accepted"] for r in got] == [True, True, False, False, True, False]


def test_numbered_matches_a_plain_count(spark):
    days = spark.range(500).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 3).cast("int")).alias("date"))
    got = windows.numbered(days, "date", "idx").orderBy("date").collect()
    assert [r["idx"] for r in got] == list(range(500))


def test_text_functions(spark):
    got = one(
        spark,
        text.normalize_text(F.lit("  Straße & Ko: $5! ")), text.normalize_title(F.lit("Acme wins - The Post"), F.lit("the post")), text.normalize_title(F.lit("Acme wins - Other"), F.lit("the post")),
        F.array_join(text.title_terms(F.lit("The raising prices and raised boxes says")), " "),
        text.normalize_url(F.lit("HTTPS://WWW.Example.com/a/b/?utm_source=x&q=&ref=1&p=2#top")), text.host(F.lit("https://user@News.Example.com:80/x")), text.truncated(F.lit("abcdef gh"), 8, "..."),
    )
    assert got[0] == "strasse ko $5"
    assert got[1] == "acme wins" and got[2] == "acme wins other"
    assert got[3] == "rais pric boxe"
    assert got[4] == "https://www.example.com/a/b?q=&p=2"
    assert got[5] == "news.example.com" and got[6] == "abcde..."


@pytest.mark.parametrize(
    "title, moved",
    [("Supermaker drops 33% after outlook", True), ("Revenue jumps 40% on demand", False), ("Revenue jumps 40% and stock falls 5%", True), ("Acme opens an office", False), ("Sales rise by 12 percent", False)],
)
def test_percent_moves(spark, title, moved):
    assert one(spark, rules.percent_move(F.lit(title)))[0] is moved


@pytest.mark.parametrize(
    "title, third",
    [("Nike appoints Acme CFO as turnaround enters next phase", True), ("Acme appoints new CFO", False), ("Acme CFO named in bribery indictment", False), ("Nike names Acme's finance chief as its new CFO", True), ("Nike hires staff", False), ("Nike appoints Acme Corporation CFO as new chief executive", False), ("Acme appoints Acme CFO as its new chief executive", False)],
)
def test_third_party_appointments(spark, title, third):
    assert one(spark, rules.third_party_appointment(F.lit(title), rules.names_of("Acme Corporation", "ACME")))[0] is third


@pytest.mark.parametrize(
    "title, holding",
    [
        ("Pension fund increases its Acme position", True), ("Hedge fund took its stake in Acme higher", True), ("Citadel investors disclosed a 5m position in Acme", True), ("Fund buys 5,301 shares of Acme", True),
        ("Kozak & Associates Inc. sells 6,908 shares of Acme Corporation", True), ("Acme shares sold by Winning Points Advisors LLC", True), ("Acme is Blue Fund's largest holding", True), ("Acme is one of the Blue Fund largest holding", True),
        ("Blue Retirement Systems invests $5 million in Acme", True), ("Acme stock position lifted by Blue Advisors", True), ("Acme acquires another company", False), ("Acme raises capital for manufacturing", False),
        ("Fund reports holding in Acme as Acme announces a product", False), ("Acme reports record revenue as investors increase Acme holdings", False), ("Acme shares acquired by Blue Capital Partners Ltd", True), (None, False),
    ],
)
def test_external_holdings(spark, title, holding):
    assert one(spark, rules.external_holding(F.lit(title).cast("string"), "Acme Corporation", "ACME"))[0] is holding


def _plain_signals(rows, days):
    """The signal chain as a walk over the rows in order; sessions are whole days."""
    seen_ids, seen_urls, by, lost = set(), set(), {}, {"canonical_duplicates": 0, "outside_calendar": 0, "title_duplicates": 0}
    for r in sorted(rows, key=lambda r: ((r["s"] // 86400 + 1) * 172800 - 1 if r["d"] else 2 * r["s"], r["id"])):
        if r["id"] in seen_ids or r["url"] in seen_urls:
            lost["canonical_duplicates"] += 1
            continue
        at = (r["s"] // 86400 + 1) * 86400 if r["d"] else r["s"]
        session = next((i for i, day in enumerate(days) if day * 86400 + 57600 > at), None)
        if session is None or at < days[0] * 86400:
            lost["outside_calendar"] += 1
            continue
        seen_ids.add(r["id"])
        seen_urls.add(r["url"])
        own = by.setdefault(session, {})
        if r["title"] in own:
            lost["title_duplicates"] += 1
        else:
            own[r["title"]] = (r["id"], r["p"])
    return {k: (sorted(i for i, _ in v.values()), sum(p for _, p in v.values()) / len(v)) for k, v in by.items()}, lost


def test_session_signals_against_a_plain_walk(spark):
    rng = random.Random(12)
    days = [100, 101, 104, 105]
    sessions = spark.createDataFrame([(i, d * 86400, d * 86400 + 57600) for i, d in enumerate(days)], "idx bigint, a bigint, z bigint").select("idx", F.timestamp_seconds("a").cast("date").alias("date"), F.timestamp_seconds("z").alias("close_at"))
    for _ in range(4):
        rows = [{"id": f"a{rng.randrange(25)}", "url": f"https://e.org/{rng.randrange(25)}", "s": rng.randrange(99 * 86400, 107 * 86400), "d": rng.random() < 0.2, "title": f"title {rng.randrange(9)}", "p": rng.choice([-1.0, 0.5, 1.0])} for _ in range(60)]
        bad = [("x", "T", "t", "s", "u", None, False, False, 1.0, 0.0, 0.0, 1), ("y", "T", "t", "s", "u", 0, False, True, 1.0, 0.0, 0.0, 1), ("z", "T", "t", "s", "u", 0, False, False, 2.0, 0.0, 0.0, 1)]
        data = [(r["id"], "T", r["title"], f"s{k}", r["url"], r["s"], r["d"], False, max(r["p"], 0.0), max(-r["p"], 0.0), 1 - abs(r["p"]), 1) for k, r in enumerate(rows)]
        df = spark.createDataFrame(data + bad, "article_id string, ticker string, title string, source string, url string, published_s bigint, date_only boolean, is_demo boolean, positive double, negative double, neutral double, reason int").repartition(3)
        want, lost = _plain_signals(rows, days)
        got = {r["idx"]: (r["article_ids"], r["signal"]) for r in reaction.session_signals(df, sessions).collect()}
        assert got.keys() == want.keys()
        for k, (ids, mean) in want.items():
            assert got[k][0] == ids and got[k][1] == pytest.approx(mean)
        c = reaction.signal_counters(df, sessions).first().asDict()
        assert {k: c[k] for k in lost} == lost and c["demo"] == c["invalid_sentiment"] == c["unusable_timestamp"] == 1
        assert c["considered"] == 63 and c["eligible"] == sum(len(i) for i, _ in want.values())
    assert reaction.session_signals(df.limit(0), sessions).count() == 0


def test_themes_first_hit_wins(spark):
    phrases = {"competition authority opens a case": "regulatory_antitrust", "ransomware attack": "cybersecurity", "new tariff on parts": "export_trade", "sunny day": "unmapped", "rivals cut prices": "competitive_pressure"}
    for phrase, theme in phrases.items():
        assert one(spark, rules.theme(F.lit(phrase)))[0] == theme


def test_band_edges(spark):
    got = one(spark, *[maths.risk_band(F.lit(x)) for x in (70, 69, 50, 49, 30, 29)])
    assert list(got) == ["Severe", "Elevated", "Elevated", "Moderate", "Moderate", "Watch"]


def test_floor_days(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    got = one(spark, maths.floor_days_apart(t("2024-01-01 00:00:00"), t("2024-01-01 12:00:00")), maths.floor_days_apart(t("2024-01-01 12:00:00"), t("2024-01-01 00:00:00")))
    assert list(got) == [1, 0]


@pytest.mark.parametrize("df, want", [(1, 12.7062), (2, 4.3027), (9, 2.2622), (19, 2.0930), (29, 2.0452), (99, 1.9842)])
def test_t_quantiles(df, want):
    assert reaction.t_quantile(0.975, df) == pytest.approx(want, abs=1e-4)


def test_intervals():
    low, high = reaction.interval(np.array([0.01, 0.02, 0.03, 0.04, 0.05]))
    assert (low, high) == (pytest.approx(0.0103676, abs=1e-6), pytest.approx(0.0496324, abs=1e-6))
    assert reaction.interval(np.array([0.5])) == (0.0, 0.5)
    assert reaction.interval(np.array([0.2, 0.2])) == (0.0, pytest.approx(0.2))
    x = np.random.default_rng(0).normal(1, 0.1, 40)
    for method in ("percentile", "bootstrap_t", "bca"):
        low, high = reaction.interval(x, method)
        assert low < x.mean() < high and (low, high) == reaction.interval(x, method)


def test_split_half_and_spearman(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate((0.01, 0.03, -0.02, -0.04, 0.09))], "k string, i int, v double")
    got = reaction.split_half(df, ["k"], "i", "v").first()
    assert (got["first_half"], got["second_half"]) == (pytest.approx(0.02), pytest.approx(0.01))
    pairs = spark.createDataFrame([("k", 0, 1), ("k", 0, 2), ("k", 1, 3), ("k", 1, 4)], "k string, x int, y int")
    assert reaction.spearman(pairs, ["k"], "x", "y", 4).first()["rho"] == pytest.approx(0.8944, abs=1e-4)
    assert reaction.spearman(pairs, ["k"], "x", "y").first()["rho"] is None


def test_half_even_rounding(spark):
    got = one(spark, reaction._round2(F.lit(2.675)), reaction._round2(F.lit(0.125)))
    assert list(got) == [2.67, 0.12]


def _reports(n, seed):
    rng = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    return [(i, "k", sorted(set(rng.sample(words, rng.randint(1, 5)))), rng.randrange(10) * 20_000, round(rng.random(), 3)) for i in range(n)]


def test_similar_pairs_against_all_pairs(spark):
    rows = _reports(60, 1)
    df = spark.createDataFrame(rows, "article_id bigint, ticker string, terms array<string>, published_s bigint, score double")
    got = {(r["a"], r["b"]) for r in grouping.similar_pairs(df, ["ticker"], "terms", 40_000, 0.75).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and abs(a[3] - b[3]) <= 40_000 and len(set(a[2]) & set(b[2])) >= max(0.75 * min(len(a[2]), len(b[2])), 1)}
    assert got == want


def test_components_do_not_depend_on_order(spark):
    rng = random.Random(2)
    pairs = [(a, b) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(60)) if a != b]
    root = list(range(80))

    def find(k):
        return k if root[k] == k else find(root[k])

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    nodes = spark.range(80).select(F.col("id").alias("article_id"))
    if spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
    for seed in (0, 1):
        random.Random(seed).shuffle(pairs)
        got = dict(map(tuple, grouping.connected(nodes, spark.createDataFrame(pairs, "a bigint, b bigint")).collect()))
        assert got == {k: find(k) for k in range(80)}


def test_first_match_groups_against_a_plain_walk(spark):
    rows = _reports(50, 3)
    df = spark.createDataFrame(rows, "article_id bigint, theme string, terms array<string>, published_s bigint, score double")
    got = {r["article_id"]: r["group_no"] for r in grouping.first_match_groups(df.repartition(5), ["theme"], 40_000).collect()}

    def same(a, b):
        x, y = set(a[2]), set(b[2])
        if abs(a[3] - b[3]) > 40_000 or len(x & y) < 0.75 * min(len(x), len(y)):
            return False
        return not (any(len(t) >= 4 for t in x - y) and any(len(t) >= 4 for t in y - x))

    groups, want = [], {}
    for r in sorted(rows, key=lambda r: (-r[4], -r[3], r[0])):
        at = next((k for k, g in enumerate(groups) if any(same(r, m) for m in g)), len(groups))
        if at == len(groups):
            groups.append([])
        groups[at].append(r)
        want[r[0]] = at
    assert got == want


def test_tiered_dedup_against_a_plain_walk(spark):
    rng = random.Random(4)
    rows = [(i, "k", f"p{rng.randrange(8)}" if rng.random() < 0.5 else None, f"u{rng.randrange(25)}", f"c{rng.randrange(20)}", f"t{rng.randrange(6)}", f"s{rng.randrange(3)}", rng.randrange(12) * 7000, round(rng.random(), 2)) for i in range(80)]
    schema = "article_id bigint, k string, provider_id string, url string, canonical_url string, title_key string, source_key string, published_s bigint, relevance double"
    got = {r["article_id"]: r["reason"] for r in grouping.tiered_dedup(spark.createDataFrame(rows, schema).repartition(4), ["k"]).collect()}

    def why(a, b):
        if (a[2] and a[2] == b[2]) or a[3] == b[3]:
            return "exact"
        if a[4] == b[4]:
            return "canonical_url"
        return "near_title" if a[5:7] == b[5:7] and abs(a[7] - b[7]) <= 6 * 3600 else None

    kept, want = [], {}
    for r in sorted(sorted(rows, key=lambda r: r[0]), key=lambda r: (r[7], r[8], r[3]), reverse=True):
        match = next((m for m in kept if why(r, m)), None)
        want[r[0]] = why(r, match) if match else None
        if match is None:
            kept.append(r)
    assert got == want
    counts = grouping.dedup_counts(grouping.tiered_dedup(spark.createDataFrame(rows, schema), ["k"])).first()
    assert counts["considered"] == counts["kept"] + counts["exact"] + counts["canonical_url"] + counts["near_title"]


def test_candidate_caps(spark):
    rows = [(i, "k", i, "p" if i < 6 else f"q{i}", False, i == 9, [f"w{i}", f"v{i}"], 0) for i in range(12)]
    df = spark.createDataFrame(rows, "article_id bigint, k string, rank int, publisher string, official boolean, priority boolean, terms array<string>, published_s bigint")
    got = grouping.select_candidates(df, ["k"], 5, publisher_cap=3, bonus=2).where("pick is not null").orderBy("pick").collect()
    assert [r["article_id"] for r in got] == [0, 1, 2, 6, 7, 9]
    with pytest.raises(ValueError):
        grouping.select_candidates(df, ["k"], 41)


def test_materiality_names_the_first_failure(spark):
    rows = [
        ("Why Acme should sell", "Reuters", "regulation", 0.9, 0.9, "days", "guard:commentary"), ("Acme opens plant", "Reuters", "uncertain", 0.9, 0.9, "days", "driver:not_meaningful"),
        ("Acme opens plant", "Reuters", "other", 0.9, 0.9, "months", "driver:event_type"), ("Acme opens plant", "Reuters", "partnership", 0.9, 0.9, "days", "durability"),
        ("Acme opens plant", "Daily Post", "regulation", 0.9, 0.9, "days", "evidence"), ("Acme opens plant", "Reuters", "regulation", 0.9, 0.9, "days", None),
        ("Acme announces quarterly financial results", "Reuters", "other", 0.9, 0.9, "days", None),
    ]
    df = spark.createDataFrame([(*r[:2], "https://x.example", *r[2:6], False, r[6]) for r in rows], "title string, source string, url string, event_type string, magnitude double, confidence double, time_horizon string, external_support boolean, want string")
    got = risk.assess(df, rules.names_of("Acme Corporation", "ACME"))
    assert got.where("not (failed_condition <=> want)").count() == 0
    assert risk.rejections(got).agg(F.sum("n")).first()[0] == 5


def test_merge_keeps_maxima_and_first_identity(spark):
    schema = "fingerprint string, ticker string, normalized_title string, title string, source string, published_at bigint, relevance double, snippet string, is_demo boolean, seq bigint"
    a = spark.createDataFrame([("f", "A", "n1", "t1", "s1", 9, 0.9, "x", True, 1)], schema)
    b = spark.createDataFrame([("f", "B", "n2", "t2", "s2", 5, 0.1, None, False, 2)], schema)
    got = store.merge_articles(a, b).first()
    assert (got["ticker"], got["normalized_title"], got["title"], got["published_at"], got["relevance"], got["snippet"], got["is_demo"]) == ("A", "n1", "t2", 9, 0.9, "x", False)


def test_catalogue_runs_on_the_smallest_tables(spark, small):
    from newsloom.plans import catalog, catalog_more  # noqa: F401

    for name in ("agg3_daily_sentiment", "jn8_session_asof", "cls18_materiality", "cmp2_risk_ranking", "ups5_watermark_merge", "win11_exclusive_events"):
        assert catalog.QUERIES[name](spark, small).count() >= 0
    assert math.isfinite(catalog.QUERIES["agg3_daily_sentiment"](spark, small).agg(F.avg("score")).first()[0])


def test_stream_equals_batch(spark, small, tmp_path):
    from newsloom.streaming import incremental

    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = incremental.tumbling(incremental.read(spark, str(tmp_path / "in"), events.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = incremental.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")))
    key = ["start", "event_type"]
    a = spark.table("tumbled").toPandas().sort_values(key).reset_index(drop=True)
    b = batch.toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_placeholders_of_the_whole_table(spark, small):
    got = catalog.QUERIES["dat4_placeholder"](spark, small)
    assert got.count() == A.headline(spark, small).count()
    at = spark.sql("select explode(array(timestamp'2024-01-10 08:00:00', timestamp'2024-07-10 07:00:00', timestamp'2024-07-10 08:00:00')) as at")
    assert [r[0] for r in at.select(rules.placeholder_stamp(F.col("at"))).collect()] == [True, True, False]


def test_evidence_of_every_article(spark, small):
    h = [(r[0], r[1], int(r[2].timestamp())) for r in A.headline(spark, small).where("not is_demo").select("article_id", "ticker", "published_at").collect()]
    want = {}
    for a, t, s in h:
        far = [abs(x - s) for b, u, x in h if b != a and u == t and s - 30 * 86400 <= x <= s + 14 * 86400]
        if far:
            want[a] = (len(far), min(far))
    got = {r[0]: (r[1], r[2]) for r in catalog.QUERIES["jn15_evidence_pool"](spark, small).collect()}
    assert got == want and any(a % 10 for a in got)
    own = {}
    for a, t, u in sorted(tuple(r) for r in A.headline(spark, small).select("article_id", "ticker", "source").collect()):
        own.setdefault((t, u), []).append(a)
    got = {r[0]: r[1] for r in catalog.QUERIES["hsh2_evidence_fingerprint"](spark, small).collect()}
    want = {a: "|".join(map(str, [a, *ids[max(0, k - 5) : k]])) for ids in own.values() for k, a in enumerate(ids)}
    assert got == {a: hashlib.sha256(x.encode()).hexdigest()[:32] for a, x in want.items()}


def test_paths_from_every_session(spark, small):
    s = [r[0] for r in A.session(spark, small).select("idx").collect()]
    priced = {r[0] for r in A.price(spark, small).join(A.session(spark, small), "date").select("idx").collect()}
    want = {(i, h) for i in s for h in range(11) if i - 1 in priced and i + h in priced}
    got = {(r["idx"], r["h"]) for r in catalog.QUERIES["jn14_forward_returns"](spark, small).where("raw_return is not null").collect()}
    assert got == want and any(i % 7 for i, _ in got)
    n = {r["h"]: r["n"] for r in catalog.QUERIES["agg8_return_summary"](spark, small).collect()}
    assert n == {h: sum(g == h for _, g in want) for h in n}
