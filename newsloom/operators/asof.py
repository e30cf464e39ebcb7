"""As-of joins on a session calendar.

A calendar is a dimension (one row per exchange session), turned into half-open
intervals and joined on a coarse time bucket plus the range, so the join is an equi
join at any calendar length; it is broadcast only while its row count is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = 30 * 86_400
_SMALL = 100_000


def intervals(sessions: DataFrame, open_s: Column, close_s: Column, key: list[str]) -> DataFrame:
    """[lo, hi) of the instants whose next session close is this one's: lo is the
    previous close, for the first session its own opening instant."""
    w = Window.partitionBy(*key).orderBy("_hi") if key else Window.orderBy("_hi")  # one row per session: a dimension
    return sessions.withColumn("_hi", close_s).withColumn("_lo", F.coalesce(F.lag("_hi").over(w), open_s))


def assign(rows: DataFrame, at_s: Column, spans: DataFrame, key: list[str], take: list[str]) -> DataFrame:
    """Rows with the columns ``take`` of the interval that holds ``at_s`` (long
    seconds); strict at the close, null outside every interval."""
    marked = spans.select(*key, *take, "_lo", "_hi").withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / _BUCKET), F.floor((F.col("_hi") - 1) / _BUCKET))))
    if spans.count() <= _SMALL:
        marked = F.broadcast(marked)
    left = rows.withColumn("_at", at_s).withColumn("_b", F.floor(F.col("_at") / _BUCKET))
    right = marked.select(*[F.col(c).alias(f"_k_{c}") for c in key], *take, "_lo", "_hi", F.col("_b").alias("_rb"))
    on = (F.col("_b") == F.col("_rb")) & (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi"))
    for c in key:
        on = on & (F.col(c) == F.col(f"_k_{c}"))
    return left.join(right, on, "left").drop("_at", "_b", "_rb", "_lo", "_hi", *[f"_k_{c}" for c in key])


def session_of(rows: DataFrame, sessions: DataFrame, at_s: Column, date_only: Column | None = None) -> DataFrame:
    """First session whose close is later than the instant; a date-only row counts
    from the midnight that ends its day. Sessions: (date, idx, close_at)."""
    close = F.unix_timestamp("close_at")
    spans = intervals(sessions, F.unix_timestamp(F.col("date").cast("timestamp")), close, []).select("idx", F.col("date").alias("session"), "_lo", "_hi")
    instant = at_s if date_only is None else F.when(date_only, (F.floor(at_s / 86_400) + 1) * 86_400).otherwise(at_s)
    return assign(rows, instant, spans, [], ["idx", "session"])


def next_session(days: DataFrame, sessions: DataFrame) -> DataFrame:
    """For each dated row the first session dated strictly later."""
    day = F.unix_timestamp(F.col("date").cast("timestamp"))
    # instants are day starts: the day itself must fall before the session's own date
    spans = intervals(sessions.select("date", "idx"), F.lit(-(10**10)).cast("bigint"), day, []).select(F.col("date").alias("session"), "idx", "_lo", "_hi")
    return assign(days, day, spans, [], ["session"]).where("session is not null")


def nearest(marks: DataFrame, mark_date: str, prices: DataFrame, price_date: str, value: str, key: list[str], within_days: int) -> DataFrame:
    """The value dated nearest to each mark, the earlier on ties, within a bound that
    keeps the join from pairing everything."""
    width = within_days + 1
    left = marks.withColumn("_d", F.unix_date(mark_date)).withColumn("_b", F.explode(F.array(*[F.floor(F.col("_d") / width) + k for k in (-1, 0, 1)])))
    right = prices.select(*[F.col(c).alias(f"_k_{c}") for c in key], F.col(price_date).alias("_pd"), F.col(value).alias("_v")).withColumn("_pn", F.unix_date("_pd")).withColumn("_pb", F.floor(F.col("_pn") / width))
    on = (F.col("_b") == F.col("_pb")) & (F.abs(F.col("_d") - F.col("_pn")) <= within_days)
    for c in key:
        on = on & (F.col(c) == F.col(f"_k_{c}"))
    order = F.struct(F.abs(F.col("_d") - F.col("_pn")), F.col("_pn"))
    return left.join(right, on).groupBy(*marks.columns).agg(F.min_by("_v", order).alias(value), F.min_by("_pd", order).alias("nearest_date"))
