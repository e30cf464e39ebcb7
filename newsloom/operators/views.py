"""Projections that a reader of the store sees: rows, cards, lists, checks, readiness.

All are selects over one input, keyed joins or grouped aggregates; nothing is resorted
beyond the order that the view itself states. Missing values stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import maths, text
from newsloom.operators import claims, windows


def news_rows(articles: DataFrame, analyses: DataFrame) -> DataFrame:
    """A nested row per article and whether a compatible analysis of it exists."""
    have = analyses.select("article_id").distinct().withColumn("_has", F.lit(True))
    j = articles.join(have, "article_id", "left")
    shares = F.struct("positive", "negative", "neutral").alias("shares")
    return j.select("article_id", F.struct("source", "published_at", maths.argmax_label(F.col("positive"), F.col("negative"), F.col("neutral")).alias("label"), shares).alias("row"), F.coalesce("_has", F.lit(False)).alias("has_compatible_analysis"))


def cards(articles: DataFrame) -> DataFrame:
    """Development cards: impact label and 0-100 score, and the corroboration struct
    with its labels. Columns as for ``claims.corroboration`` and magnitude."""
    c = claims.corroboration(articles)
    counts = F.struct("total", "corroborated", "contradicted", "unresolved", "supporting", "external", "is_official", claims.corroboration_label(F.col("corroborated"), F.col("external"), F.col("is_official")).alias("label"), claims.contradiction_label(F.col("contradicted"), F.col("total")).alias("conflict"))
    metric = F.when(F.col("external") == 0, "None found").when(F.col("external") == 1, "1 external source").otherwise(F.format_string("%d external sources", "external"))
    return c.select("article_id", maths.impact_label(F.col("magnitude")).alias("impact_label"), F.bround(F.col("magnitude") * 100).cast("int").alias("impact_score"), metric.alias("metric"), counts.alias("corroboration"))


def risk_rows(ranked: DataFrame, keys: list[str], order: list[Column], limit: int = 180) -> DataFrame:
    """Ranked risks numbered from 1, with a band and a summary of ``limit`` characters."""
    short = F.when(F.length("summary") > limit, F.concat(F.rtrim(F.left("summary", F.lit(limit))), F.lit("…"))).otherwise(F.col("summary"))
    return ranked.select("*", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("rank"), maths.risk_band(F.col("concern_index")).alias("band"), short.alias("shown"))


def search_labels(members: DataFrame, coverage: DataFrame, pending: DataFrame) -> DataFrame:
    """Members (symbol) with what a search shows: analysed with their number, requested,
    or not covered."""
    j = members.join(coverage.select("symbol", "n"), "symbol", "left").join(pending.select("symbol").distinct().withColumn("_p", F.lit(True)), "symbol", "left")
    return j.withColumn("label", F.when(F.col("n") > 0, text.plural(F.col("n"), "article")).when(F.col("_p"), "requested").otherwise("not covered")).drop("_p", "n")


def in_order(rows: DataFrame, states: list[str] | None, order: list[str]) -> DataFrame:
    """Rows of the given states (all for none), numbered in order within their ticker."""
    kept = rows.where(F.col("state").isin(*states)) if states else rows
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy(*order)))


def evidence_checked(jobs: DataFrame, stored: DataFrame, current: DataFrame, now: Column, open_s: int) -> DataFrame:
    """Analysed jobs (article_id, published_s, checked_s) whose evidence is to be looked
    at (never checked, or young enough that it may still grow) with the outcome current,
    changed or null where either fingerprint is missing, and the time of the check."""
    due = F.col("checked_s").isNull() | (F.col("published_s") >= now - open_s)
    j = jobs.join(stored.select("article_id", F.col("fingerprint").alias("_was")), "article_id", "left").join(current.select("article_id", F.col("fingerprint").alias("_is")), "article_id", "left")
    known = due & F.col("_was").isNotNull() & F.col("_is").isNotNull()
    return j.select("article_id", F.when(known, F.when(F.col("_was") == F.col("_is"), "current").otherwise("changed")).alias("evidence"), F.when(known, now).otherwise(F.col("checked_s")).alias("checked_s"))


def observed_only(daily: DataFrame, start: Column, end: Column, arrival: str) -> DataFrame:
    """Observed days in a window, the last arrival of a date; no day is made up."""
    return windows.keep_last(daily, ["ticker", "date"], arrival).where(F.col("date").between(start, end))


def readiness(signals: DataFrame, taus: tuple[float, ...], sessions: int, gap: int = 5, horizons: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Per (ticker, tau, regime): sessions in the tail, those with three sources, those
    left by exclusivity, and of these the ones whose horizons lie inside the calendar of
    ``sessions`` sessions."""
    # a handful of thresholds: each session is repeated once per threshold
    s = signals.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in taus])))
    s = s.withColumn("regime", F.when(F.col("signal") >= F.col("tau"), "positive").when(F.col("signal") <= -F.col("tau"), "negative")).where("regime is not null")
    keys = ["ticker", "tau", "regime"]
    kept = windows.exclusive(s.where("sources >= 3"), keys, "idx", gap).where("kept").groupBy(*keys).agg(F.count("*").alias("after_exclusivity"), *(F.count(F.when(F.col("idx") + h < sessions, 1)).alias(f"resolved_{h}") for h in horizons))
    tails = s.groupBy(*keys).agg(F.count("*").alias("tail_sessions"), F.count(F.when(F.col("sources") >= 3, 1)).alias("with_3_sources"))
    return tails.join(kept, keys, "left").na.fill(0)


def lineage(events: DataFrame, break_idx: int) -> DataFrame:
    """Per ticker: resolved events (idx, value, exact_timing, articles), the share of
    lagged ones, means before and from a break, whether the chronological halves
    straddle it (null below two events), and the median of articles."""
    w = Window.partitionBy("ticker")
    e = events.withColumn("_r", F.row_number().over(w.orderBy("idx"))).withColumn("_n", F.count("*").over(w))
    half = F.floor(F.col("_n") / 2)
    late = F.col("idx") >= break_idx
    at = lambda r: F.max(F.when(F.col("_r") == r, F.col("idx")))
    straddle = F.when(F.count("*") >= 2, (at(half) < break_idx) & (at(half + 1) >= break_idx))
    return e.groupBy("ticker").agg(F.count("*").alias("resolved"), F.avg((~F.col("exact_timing")).cast("double")).alias("lagged_share"), F.avg(F.when(~late, F.col("value"))).alias("mean_before"), F.avg(F.when(late, F.col("value"))).alias("mean_from"), straddle.alias("straddles"), F.median("articles").alias("median_articles"))


def spaced_sample(rows: DataFrame, keys: list[str], idx: str, gap: int, seed: int) -> DataFrame:
    """A repeatable random sample of each key in which no two rows lie closer than
    ``gap``: one row for each slice of gap width, the least by a seeded hash, unless a
    neighbouring slice's row is nearer than the gap and has the lesser hash."""
    h = F.xxhash64(*keys, idx, F.lit(seed))
    slot = F.floor(F.col(idx) / gap)
    first = rows.withColumn("_slot", slot).groupBy(*keys, "_slot").agg(F.min_by(idx, h).alias(idx), F.min(h).alias("_h"))
    w = Window.partitionBy(*keys).orderBy("_slot")
    near = lambda f: (F.abs(f(idx).over(w) - F.col(idx)) < gap) & (f("_h").over(w) < F.col("_h"))
    beaten = F.coalesce(near(F.lag), F.lit(False)) | F.coalesce(near(F.lead), F.lit(False))
    return first.withColumn("_b", beaten).where("not _b").select(*keys, idx)


def gold_records(analyses: DataFrame) -> DataFrame:
    """Analyses as labelled records: identity, event and label as structs."""
    return analyses.select("article_id", F.struct("ticker", "title", F.col("source").alias("publisher")).alias("subject"), F.struct("event_type", "direction", "magnitude", "time_horizon").alias("event"), F.struct("material", "reason", "group_id").alias("label"))


def from_gold(records: DataFrame) -> DataFrame:
    """The inverse of ``gold_records``."""
    return records.select("article_id", "subject.ticker", "subject.title", F.col("subject.publisher").alias("source"), "event.*", "label.*")


def gold_faults(records: DataFrame) -> DataFrame:
    """Records that may not be scored: without a label, or with an id that repeats."""
    n = records.groupBy("article_id").agg(F.count("*").alias("n"), F.max(F.col("label.material").isNull().cast("int")).alias("open"))
    return n.where("n > 1 or open = 1").select("article_id", F.when(F.col("n") > 1, "duplicate_id").otherwise("unlabelled").alias("fault"))
