"""Keyed merges, state transitions and ledger joins as pure DataFrame functions.

A merge is a union and one grouped aggregate, so hot keys are combined before the
shuffle; the caller writes the result over the old version. Atomic claims need an
external store: what is here computes the transition, not the locking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attempts allowed and first delay (minutes) by failure kind.
ATTEMPTS = {"transient": 4, "invalid": 2}
FIRST_DELAY = 15


def merge_articles(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert by fingerprint. Newest row wins except: published_at and relevance keep
    their maximum, snippet the newest non-null, is_demo the minimum, and ticker and
    normalized_title stay as first stored. Rows carry a rising ``seq``."""
    rows = stored.unionByName(batch)
    newest = lambda c: F.max_by(c, "seq").alias(c)
    first = lambda c: F.min_by(c, "seq").alias(c)
    return rows.groupBy("fingerprint").agg(
        first("ticker"), first("normalized_title"), newest("title"), newest("source"),
        F.max("published_at").alias("published_at"), F.max("relevance").alias("relevance"),
        F.max_by("snippet", F.when(F.col("snippet").isNotNull(), F.col("seq"))).alias("snippet"),
        F.min("is_demo").alias("is_demo"), F.max("seq").alias("seq"),
    )


def replace_rows(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch's rows, and the stored ones of other keys."""
    return stored.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch)


def append_missing(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Append-only insert: rows of keys that are not stored yet."""
    return stored.unionByName(batch.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


def merge_watermarks(stored: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per (ticker, provider): the watermark never moves back and a null keeps it, the
    last success stays until the next, failures count up and a success resets them."""
    s = stored.select("ticker", "provider", *[F.col(c).alias("_" + c) for c in ("through", "success_at", "failures")])
    both = s.join(attempts, ["ticker", "provider"], "full")
    failed = F.col("status").isin("failed", "partial")
    return both.select(
        "ticker", "provider",
        F.greatest("_through", "through").alias("through"),
        F.coalesce(F.when(~failed, F.col("attempt_at")), F.col("_success_at")).alias("success_at"),
        F.when(F.col("status").isNull(), F.col("_failures")).when(F.col("status") == "failed", F.coalesce("_failures", F.lit(0)) + 1).otherwise(0).cast("int").alias("failures"),
        F.coalesce("status", F.lit("idle")).alias("status"),
    )


def due(jobs: DataFrame, now: Column) -> DataFrame:
    """Pending jobs, retries whose time has come, and leases that ran out."""
    return jobs.where(
        (F.col("state") == "pending")
        | ((F.col("state") == "retry") & (F.col("next_attempt_at") <= now))
        | ((F.col("state") == "running") & (F.col("lease_expires_at") <= now))
    )


def claim(jobs: DataFrame, now: Column, owner: str, lease_minutes: int = 10) -> DataFrame:
    """Due jobs leased to the owner; all others as they are."""
    ready = (F.col("state") == "pending") | ((F.col("state") == "retry") & (F.col("next_attempt_at") <= now)) | ((F.col("state") == "running") & (F.col("lease_expires_at") <= now))
    ready = F.coalesce(ready, F.lit(False))
    return (
        jobs.withColumn("_r", ready)
        .withColumn("attempts", F.col("attempts") + F.when(F.col("_r"), 1).otherwise(0))
        .withColumn("lease_owner", F.when(F.col("_r"), F.lit(owner)).otherwise(F.col("lease_owner")))
        .withColumn("lease_expires_at", F.when(F.col("_r"), now + F.expr(f"interval {lease_minutes} minutes")).otherwise(F.col("lease_expires_at")))
        .withColumn("state", F.when(F.col("_r"), F.lit("running")).otherwise(F.col("state")))
        .drop("_r")
    )


def retry_delay_minutes(failures: Column) -> Column:
    """15 minutes, then four times as long after each further failure."""
    return F.lit(FIRST_DELAY) * F.pow(F.lit(4.0), failures - 1)


def after_failure(jobs: DataFrame, now: Column) -> DataFrame:
    """failure_kind set: one failure more, then a retry or, out of attempts, failed."""
    allowed = F.when(F.col("failure_kind") == "invalid", ATTEMPTS["invalid"]).otherwise(ATTEMPTS["transient"])
    n = F.col("failure_count") + 1
    over = n >= allowed
    hit = F.col("failure_kind").isNotNull()
    return (
        jobs.withColumn("_n", n)
        .withColumn("state", F.when(~hit, F.col("state")).when(over, F.lit("failed")).otherwise(F.lit("retry")))
        .withColumn("next_attempt_at", F.when(hit & ~over, F.timestamp_seconds(F.unix_timestamp(now) + (retry_delay_minutes(F.col("_n")) * 60).cast("bigint"))))
        .withColumn("failure_count", F.when(hit, F.col("_n")).otherwise(F.col("failure_count")))
        .drop("_n")
    )


def finish(jobs: DataFrame, outcomes: DataFrame, owner: str) -> DataFrame:
    """Spend is always added; the state changes only for the lease's owner."""
    o = outcomes.select("job_id", F.col("outcome").alias("_o"), F.col("spent").alias("_s"))
    own = (F.col("lease_owner") == owner) & F.col("_o").isNotNull()
    return (
        jobs.join(o, "job_id", "left")
        .withColumn("tokens", F.col("tokens") + F.coalesce("_s", F.lit(0)))
        .withColumn("state", F.when(F.coalesce(own, F.lit(False)), F.col("_o")).otherwise(F.col("state")))
        .drop("_o", "_s")
    )


def reconcile(articles: DataFrame, analysed: DataFrame, boundary: Column, skip: Column) -> DataFrame:
    """The one state of every article: analyzed, skipped:demo, baseline (older than the
    ledger), skipped:<reason>, or pending."""
    known = analysed.select("article_id").distinct().withColumn("_a", F.lit(True))
    return articles.join(known, "article_id", "left").select(
        "article_id",
        F.when(F.col("_a"), "analyzed").when(F.col("is_demo"), "skipped:demo").when(F.col("published_at") < boundary, "baseline").when(skip.isNotNull(), F.concat(F.lit("skipped:"), skip)).otherwise("pending").alias("state"),
    )


def unstored(batch: DataFrame, stored: DataFrame, window_seconds: int = 6 * 3600) -> DataFrame:
    """New rows that duplicate no stored one by provider id, canonical URL, or title
    and source within six hours: three equi joins, not one theta join."""
    s, b = stored, batch
    same_id = b.where("provider_id is not null").join(s.where("provider_id is not null").select("provider_id").distinct(), "provider_id", "left_semi").select("article_id")
    same_url = b.join(s.select("canonical_url").distinct(), "canonical_url", "left_semi").select("article_id")
    near = s.select("title_key", "source_key", F.col("published_s").alias("_s"))
    width = window_seconds
    near = near.withColumn("_b", F.explode(F.array(*[F.floor(F.col("_s") / width) + k for k in (-1, 0, 1)])))
    cand = b.withColumn("_b", F.floor(F.col("published_s") / width))
    same_title = cand.join(near.distinct(), ["title_key", "source_key", "_b"]).where(F.abs(F.col("published_s") - F.col("_s")) <= window_seconds).select("article_id")
    return b.join(same_id.unionByName(same_url).unionByName(same_title).distinct(), "article_id", "left_anti")


def job_summary(jobs: DataFrame, now: Column) -> DataFrame:
    is_due = F.coalesce((F.col("state") == "pending") | ((F.col("state") == "retry") & (F.col("next_attempt_at") <= now)), F.lit(False))
    return jobs.groupBy("state").agg(F.count("*").alias("n"), F.sum(is_due.cast("int")).alias("due"), F.sum("tokens").alias("tokens"))


def budgeted(outcomes: DataFrame, keys: list[str], order: str, budget: int, breaker: int = 2) -> DataFrame:
    """Runs outcomes in order until the budget is spent or ``breaker`` paid failures
    come one after another; cached outcomes cost nothing and reset nothing.

    ``outcome`` is cached, ok or failed; the result adds ``ran``. A fold over the
    sorted outcomes of a key, bounded by the attempts of one cycle.
    """
    start = F.struct(F.lit(0).alias("spent"), F.lit(0).alias("bad"), F.array().cast("array<struct<o:bigint,ran:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        cached = x["outcome"] == "cached"
        ran = cached | ((acc["spent"] < budget) & (acc["bad"] < breaker))
        paid = ran & ~cached
        return F.struct(
            (acc["spent"] + F.when(paid, 1).otherwise(0)).alias("spent"),
            F.when(paid & (x["outcome"] == "failed"), acc["bad"] + 1).when(paid, F.lit(0)).otherwise(acc["bad"]).alias("bad"),
            F.concat(acc["out"], F.array(F.struct(x["o"].alias("o"), ran.alias("ran")))).alias("out"),
        )

    lists = outcomes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).cast("bigint").alias("o"), "outcome"))).alias("_x"))
    ran = lists.select(*keys, F.explode(F.aggregate("_x", start, step, lambda a: a["out"])).alias("_e")).select(*keys, F.col("_e.o").alias(order), F.col("_e.ran").alias("ran"))
    return outcomes.join(ran, [*keys, order])
