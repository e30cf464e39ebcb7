"""Claims, coverage, roles, formats, sources and event study on small cases."""

import datetime as dt
import hashlib
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from newsloom.functions import formats
from newsloom.operators import claims, coverage, grouping, reaction, views
from newsloom.sources import feeds, readers

ASSESSED = "claims int, assessments array<struct<claim_id:string,status:string,cited:array<bigint>>>, ids array<bigint>"


@pytest.mark.parametrize(
    "assessments, error",
    [
        ([("claim_1", "corroborated", [7])], None), ([("claim_3", "uncertain", [])], "unknown_or_repeated_claim"), ([("claim_1", "uncertain", []), ("claim_1", "uncertain", [])], "unknown_or_repeated_claim"),
        ([("claim_2", "unsupported", [9])], "citation_not_supplied"), ([("claim_2", "contradicted", [])], "decision_without_citation"), ([("claim_1", "corroborated", None)], "decision_without_citation"), ([], None),
        ([("x", "uncertain", [])], "unknown_or_repeated_claim"), ([("claim_2", "contradicted", []), ("claim_9", "uncertain", [])], "decision_without_citation"), ([(None, "uncertain", [])], "unknown_or_repeated_claim"),
    ],
)
def test_claim_errors(spark, assessments, error):
    df = spark.createDataFrame([(2, assessments, [7, 8])], ASSESSED)
    assert df.select(claims.claim_error(F.col("claims"), F.col("assessments"), F.col("ids"))).first()[0] == error


def test_related_companies(spark):
    df = spark.createDataFrame([(["b", "A", "s", "B", "z"], ["a", "B"], "S")], "p array<string>, a array<string>, s string")
    assert df.select(claims.related_companies(F.col("p"), F.col("a"), F.col("s"))).first()[0] == ["B", "A"]


@pytest.mark.parametrize(
    "words, acted",
    [("Microsoft retreats in China", False), ("China eases curbs", True), ("SEC opens a case", True), ("a sec later", False), ("EU bans imports", True), ("eu bans imports", False), ("Regulator looks on", True), ("U.S. revokes a license", True), (None, False)],
)
def test_public_action(spark, words, acted):
    df = spark.createDataFrame([(words,)], "w string")
    assert df.select(claims.public_action(F.col("w"))).first()[0] is acted


def test_corroboration_leaves_out_rewrites_and_own_channels(spark):
    day = 1_700_000_000
    own = ("p", "Reuters", "u", "Acme recalls forty thousand batteries", day)
    evidence = [(1, "CNBC", "u", "Watchdog confirms battery recall at plant", day), (2, "Reuters", "u", "Other words", day), (3, "Daily", "u", "Acme recalls forty thousand batteries today", day), (4, "Late", "u", "Acme recalls forty thousand batteries", day + 3 * 86400), (5, "cnbc", "u", "More from them", day)]
    said = [("claim_1", "corroborated", [1, 2, 3, 4, 5, 77]), ("claim_2", "contradicted", [1]), ("claim_3", "corroborated", []), ("claim_4", "uncertain", None)]
    schema = "article_id string, source string, url string, title string, published_s bigint, assessments array<struct<claim_id:string,status:string,cited:array<bigint>>>, evidence array<struct<article_id:bigint,source:string,url:string,title:string,published_s:bigint>>, reason int"
    df = spark.createDataFrame([(*own, said, evidence, 1), (*own, None, None, 1)], schema)
    a, b = claims.corroboration(df).collect()
    assert (a["total"], a["corroborated"], a["contradicted"], a["unresolved"], a["supporting"], a["external"]) == (4, 1, 1, 2, 5, 2)  # CNBC and Late
    assert (b["total"], b["external"], b["supporting"]) == (0, 0, 0)


def test_mentions(spark):
    rows = [(1, "ZZ", "Acme Corporation buys MELODY", None), (2, "ZZ", "The melody of $V and nyse: q", None), (3, "MLD", "MLD rises", "Acme"), (4, "ZZ", None, None), (5, "ZZ", "acmes and vq", "")]
    a = spark.createDataFrame(rows, "article_id bigint, ticker string, title string, snippet string")
    c = spark.createDataFrame([("ACM", "Acme Corporation", None), ("MLD", "Melody Inc", ["xy"]), ("V", "Vis (US)", []), ("Q", "Queue plc", [])], "symbol string, name string, aliases array<string>")
    got = {tuple(r) for r in claims.mentioned_companies(a, c).collect()}
    assert got == {(1, "ACM"), (1, "MLD"), (2, "MLD"), (2, "V"), (2, "Q"), (3, "ACM")}
    assert claims.mentioned_companies(a.limit(0), c).count() == 0


def test_watermarks_hold_on_problems(spark):
    m = spark.createDataFrame([("A", "p", 10, 2), ("B", "p", 10, 0), ("C", "p", 10, 1), ("D", "p", 10, 0)], "ticker string, provider string, through bigint, problems int")
    r = spark.createDataFrame([("A", "p", "empty", 20), ("B", "p", "partial", 20), ("C", "p", "ok", 5), ("E", "p", "failed", 9), ("F", "p", "ok", 9), ("F", "p", "failed", 9)], "ticker string, provider string, outcome string, window_end bigint")
    got = {x["ticker"]: (x["through"], x["problems"]) for x in coverage.advanced(m, r).collect()}
    assert got == {"A": (20, 0), "B": (10, 1), "C": (10, 0), "D": (10, 0), "E": (None, 1), "F": (None, 1)}


def test_admission_under_a_cap(spark):
    q = spark.createDataFrame([("k1", "A", 1, True), ("k2", "B", 2, True), ("k3", "A", 3, True), ("k4", "C", 4, True), ("k5", "X", 0, False), ("k6", "D", 9, None), ("k7", "Z", 5, True)], "key string, ticker string, requested_at int, known boolean")
    c = spark.createDataFrame([("Z", True), ("B", False)], "ticker string, active boolean")
    got = {r["key"]: r["fate"] for r in coverage.admitted(q, c, 2).collect()}
    assert got == {"k1": "activated", "k2": "activated", "k3": "already_active", "k4": "deferred", "k5": "rejected", "k6": "rejected", "k7": "already_active"}
    again = coverage.activated(c.selectExpr("ticker", "active", "1 as started", "2 as live_days", "3 as updated"), q.select("ticker"), F.lit(50), 7)
    assert {r["ticker"]: (r["active"], r["started"], r["live_days"]) for r in again.collect()}["B"] == (True, 1, 2)


def test_roles_qualify_sessions(spark):
    m = spark.createDataFrame([("T", 1, a, o) for a, o in zip("abcde", "uvwux")] + [("T", 2, "f", "u")], "ticker string, idx int, article_id string, organisation string")
    roles = spark.createDataFrame([("a", "principal"), ("b", "principal"), ("c", "mentioned"), ("d", "principal"), ("f", None)], "article_id string, role string")
    of = lambda p: {r["idx"]: (r["organisations"], r["qualifies"]) for r in coverage.qualifying_sessions(m, roles, p).collect()}
    assert of("include") == {1: (3, True), 2: (1, False)} and of("exclude") == {1: (2, False), 2: (0, False)} and of("session_ineligible")[1] == (2, False)
    with pytest.raises(ValueError):
        coverage.qualifying_sessions(m, roles, "maybe")
    assert {r[0] for r in coverage.role_filtered(m, roles, "include").select("article_id").collect()} == set("abdef")


def test_formats(spark):
    df = spark.createDataFrame([("20240102T030405Z",), ("20240102030405",), ("2024-01-02T03:04:05Z",), ("2024-01-02",), ("20249902T030405Z",), (None,)], "v string")
    want = dt.datetime(2024, 1, 2, 3, 4, 5)
    got = [r[0] for r in df.select(F.date_format(formats.parsed_stamp(F.col("v")), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == [str(want)] * 3 + [None] * 3
    one = spark.range(1)
    assert int(one.select(formats.seed("up", "h5")).first()[0]) == int.from_bytes(hashlib.sha256(b"v1|bootstrap|up|h5").digest()[:8], "big")
    assert one.select(formats.percent(F.lit(0.125)), formats.percent(F.lit(None).cast("double"))).first()[:] == ("+12.5%", "–")
    ticks = one.select(formats.axis_ticks(F.lit(10.0), F.lit(20.0)), formats.axis_ticks(F.lit(3.0), F.lit(3.0))).first()
    assert ticks[0] == pytest.approx([9, 12, 15, 18, 21]) and ticks[1][0] < 3 < ticks[1][-1]
    assert one.select(formats.same_json(F.lit('{"a":1,"b":2}'), F.lit('{"b":2,"a":1}')), formats.same_json(F.lit("{"), F.lit('{"a":1}'))).first()[:] == (True, False)


def test_greedy_distinct_against_a_plain_walk(spark):
    import random

    rng = random.Random(3)
    for _ in range(5):
        rows = [(rng.choice("GH"), f"a{rng.randrange(12)}", rng.choice([None, *(f"u{k}" for k in range(12))]), rng.randrange(40)) for _ in range(50)]
        want, seen = [], set()
        for r in sorted(set(rows), key=lambda r: (r[0], r[3], r[1], r[2] is not None, r[2] or "")):
            keys = {(r[0], "i", r[1]), *([(r[0], "u", r[2])] if r[2] else [])}
            if not keys & seen:
                seen |= keys
                want.append(r)
        got = grouping.greedy_distinct(spark.createDataFrame(rows, "g string, i string, u string, t int").repartition(3), ["g"], ["i", "u"], ["t", "i", "u"])
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_greedy_distinct_goes_in_rounds_over_contested_rows_only(spark, monkeypatch):
    sizes, write = [], grouping.written

    def noted(df, *name):
        sizes.append((out := write(df, *name)).count())
        return out

    monkeypatch.setattr(grouping, "written", noted)
    rows = [("G", f"a{k}", f"u{k}", k) for k in range(100)] + [("G", "a7", "u200", 200), ("G", "a200", "u200", 300), (None, "a7", "u7", 5), (None, "a7", "u7", 5)]
    got = grouping.greedy_distinct(spark.createDataFrame(rows, "g string, i string, u string, t int"), ["g"], ["i", "u"], ["t", "i", "u"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([*rows[:100], rows[101], rows[102]], key=repr)
    assert max(sizes[2:]) <= 4  # after the rows themselves and their marks


def test_events_read_one_written_table_of_signals(spark):
    from newsloom.plans import catalog

    files = catalog.win11_exclusive_events(spark, "/root/testdata/sf0.001").inputFiles()
    assert len({f.rsplit("/", 1)[0] for f in files}) == 1


def test_event_study_states(spark):
    price = spark.createDataFrame([(i, 100.0 + i * (1 if i != 31 else 0), 100.0) for i in range(41) if i != 25], "idx bigint, close double, benchmark double")
    sig = [("T", i, 0.9, 5, 4, exact) for i, exact in ((1, True), (3, True), (6, False), (12, True), (20, True), (35, True))]
    s = spark.createDataFrame([*sig, ("T", 8, 0.9, 5, 2, True)], "ticker string, idx bigint, signal double, articles bigint, sources bigint, exact_timing boolean")
    tau = spark.createDataFrame([("T", 0.5, 0.5)], "ticker string, tau_positive double, tau_negative double")
    out = spark.createDataFrame([("T", 12)], "ticker string, idx bigint")
    got = {r["idx"]: r["status"] for r in reaction.event_study(s, tau, price, out).collect()}
    assert got == {1: "resolved", 3: "suppressed_overlap", 6: "resolved", 12: "excluded_invalid", 20: "missing_price_data", 35: "pending"}
    r = reaction.regime_results(s, tau, price, out).first()
    mean = [(100 + k + 5) / (100 + k - 1) - 1 for k in (1, 6)]
    assert (r["events"], r["resolved"], r["day0_events"]) == (6, 2, 1) and r["mean"] == pytest.approx(sum(mean) / 2)
    assert r["first_half"] == pytest.approx(mean[0]) and r["second_half"] == pytest.approx(mean[1]) and r["day0_mean"] == pytest.approx(101 / 100 - 1)


def test_payload_windows_stop_at_the_first_failure(spark):
    body = lambda n: json.dumps({"articles": [{"url": f"u{k}", "title": "t", "seendate": "20240101T000000Z", "domain": "d"} for k in range(n)]})
    df = spark.createDataFrame([(0, body(2)), (1, body(1)), (2, "<busy>"), (3, body(5))], "window int, body string")
    rows, outcome = feeds.windowed_articles(df)
    assert rows.count() == 3 and outcome.first()["status"] == "degraded" and outcome.first()["failed_window"] == 2
    assert feeds.windowed_articles(df.where("window > 1"))[1].first()["status"] == "unavailable"
    assert feeds.windowed_articles(df.where("window < 1"))[1].first()["status"] == "healthy"
    assert feeds.windowed_articles(df.limit(0))[1].first()["status"] == "degraded"


def test_sqlite_and_cache_files(spark, tmp_path):
    for n in (1, 2):
        db = sqlite3.connect(tmp_path / f"s{n}.db")
        db.execute("create table coverage (ticker text, active int, extra text)")
        db.executemany("insert into coverage values (?, ?, 'x')", [(f"T{n}{k}", k % 2) for k in range(3)])
        db.commit()
        db.close()
    got = feeds.sqlite_table(spark, str(tmp_path / "*.db"), "coverage", "ticker string, active bigint, started string")
    assert sorted((r[0], r[1], r[2]) for r in got.collect()) == [(f"T{n}{k}", k % 2, None) for n in (1, 2) for k in range(3)]
    cache = str(tmp_path / "cache")
    for k in (1, 2):
        feeds.replaced(spark.range(k), cache)
        assert spark.read.json(cache).count() == k


def test_member_table_finds_columns_by_header(spark):
    page = "<table id='constituents'><tr><th>Company</th><th>Ticker</th></tr><tr><td>A &amp; B[1]</td><td><b>BRK.B</b></td></tr><tr><td>no symbol</td></tr></table>"
    df = spark.createDataFrame([(page,), ("<table id=constituents><tr><th>x</th></tr></table>",), (None,)], "html string")
    assert [tuple(r) for r in feeds.member_table(df, "Ticker", "Company", "S&P 500").collect()] == [("BRK.B", "BRK-B", "A & B", "S&P 500")]
    assert feeds.member_table(df, "Ticker", "Company", "FTSE 100", ".L").first()["feed_symbol"] == "BRK.B.L"


def test_readers(spark, tmp_path):
    (tmp_path / "demo.json").write_text(json.dumps([{"published_hours_ago": 2.5, "title": "{company} wins", "source": "S", "url": "https://e.org/{symbol}"}]))
    d = readers.demo_articles(spark, str(tmp_path / "demo.json"), "2024-01-31 12:00:00", "Acme", "ACME").first()
    assert d["title"] == "Acme wins" and d["is_demo"] and d["published_at"].strftime("%H:%M") == "09:30"
    days = [dt.date(2023, 1, 1) + dt.timedelta(k) for k in range(200)]
    (tmp_path / "p.csv").write_text("date,close,volume\n" + "\n".join(f"{x},{'' if k == 5 else 10 + k},{'' if k == 6 else 3}" for k, x in enumerate(days)))
    p = readers.price_history(spark, str(tmp_path / "p.csv"))
    assert p.count() == 199 and p.where("volume is null").count() == 0
    first, second = spark.range(2), spark.range(5)
    assert readers.with_fallback(first, second).count() == 2 and readers.with_fallback(first.limit(0), second).count() == 5
    folder = readers.publish(second, str(tmp_path / "pub"), "20240101")
    assert spark.read.parquet(f"{tmp_path}/pub/{folder}").count() == 5
    readers.report(first, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_spaced_sample_keeps_its_distance(spark):
    df = spark.range(0, 400).selectExpr("'k' as k", "id as idx")
    got = sorted(r["idx"] for r in views.spaced_sample(df, ["k"], "idx", 5, 1).collect())
    assert len(got) > 30 and min(b - a for a, b in zip(got, got[1:])) >= 5
    assert got == sorted(r["idx"] for r in views.spaced_sample(df.repartition(7), ["k"], "idx", 5, 1).collect())
    assert got != sorted(r["idx"] for r in views.spaced_sample(df, ["k"], "idx", 5, 2).collect())


def test_readiness_counts_exclusive_sessions_inside_the_calendar(spark):
    s = spark.createDataFrame([("T", i, x, n) for i, x, n in ((0, 0.5, 3), (3, 0.5, 4), (5, 0.5, 3), (9, 0.5, 2), (12, -0.3, 3), (17, -0.3, 3))], "ticker string, idx bigint, signal double, sources bigint")
    got = {(r["tau"], r["regime"]): (r["tail_sessions"], r["with_3_sources"], r["after_exclusivity"], r["resolved_5"], r["resolved_10"]) for r in views.readiness(s, (0.2, 0.4), 20).collect()}
    assert got == {(0.2, "positive"): (4, 3, 2, 2, 2), (0.4, "positive"): (4, 3, 2, 2, 2), (0.2, "negative"): (2, 2, 2, 1, 0)}


def test_evidence_checks(spark):
    jobs = spark.createDataFrame([(1, 0, None), (2, 0, 5), (3, 95, 5), (4, 95, None), (5, 95, None)], "article_id bigint, published_s bigint, checked_s bigint")
    stored = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a")], "article_id bigint, fingerprint string")
    current = spark.createDataFrame([(1, "b"), (2, "b"), (3, "a"), (5, "a")], "article_id bigint, fingerprint string")
    got = {r["article_id"]: (r["evidence"], r["checked_s"]) for r in views.evidence_checked(jobs, stored, current, F.lit(100), 10).collect()}
    assert got == {1: ("changed", 100), 2: (None, 5), 3: ("current", 100), 4: (None, None), 5: (None, None)}
