"""Dates as providers write them, seeds, payloads and display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How providers write an instant, all in UTC.
STAMPS = ("yyyyMMdd'T'HHmmss'Z'", "yyyyMMddHHmmss", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parsed_stamp(value: Column) -> Column:
    """The instant in the first format that fits; null for none."""
    # each format has its own length or letters, so a value fits one at most
    fits = (r"^\d{8}T\d{6}Z$", r"^\d{14}$", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")
    return F.coalesce(*(F.try_to_timestamp(F.when(value.rlike(p), value), F.lit(s)) for p, s in zip(fits, STAMPS)))


def utc_date(at: Column) -> Column:
    """The UTC date of an instant (sessions run in UTC)."""
    return F.to_date(at)


def seed(*scope: str | Column, version: str = "v1") -> Column:
    """First eight bytes of the SHA-256 of the scope as an unsigned number."""
    label = F.concat_ws("|", F.lit(version), F.lit("bootstrap"), *(F.lit(x) if isinstance(x, str) else x for x in scope))
    return F.conv(F.substring(F.sha2(label, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def order_key(at: Column, day: Column, article_id: Column) -> Column:
    """Sorts instants, then rows that have only a date last in their day, then ids."""
    return F.struct(F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.concat(day.cast("string"), F.lit("T99"))).alias("moment"), article_id.alias("id"))


def percent(share: Column, digits: int = 1) -> Column:
    """A signed percentage; a dash for null."""
    return F.when(share.isNull(), "–").otherwise(F.format_string(f"%+.{digits}f%%", share * 100))


def short_date(day: Column) -> Column:
    return F.date_format(day, "d MMM yyyy")


def axis_ticks(low: Column, high: Column, count: int = 5) -> Column:
    """Evenly spaced marks over the padded range; a flat range is widened."""
    pad = F.when(high > low, (high - low) * 0.1).otherwise(F.greatest(F.abs(high) * 0.05, F.lit(1.0)))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: low - pad + (high - low + 2 * pad) * k / (count - 1))


def encoded(payload: Column) -> Column:
    """Canonical JSON: fields in the order of the struct, nulls kept."""
    return F.to_json(payload, {"ignoreNullFields": "false"})


def decoded(value: Column, schema: str, checks: dict[str, Column]) -> Column:
    """The payload, or null where it does not parse or a check on ``p`` fails."""
    p = F.from_json(value, schema, {"mode": "PERMISSIVE"})
    ok = p.isNotNull()
    for check in checks.values():
        ok = ok & F.coalesce(check, F.lit(False))
    return F.when(ok, p)


def same_json(a: Column, b: Column) -> Column:
    """Equal as JSON objects, whatever the order of their keys."""
    entries = lambda c: F.array_sort(F.map_entries(F.from_json(c, "map<string,string>")))
    return F.coalesce(entries(a) == entries(b), F.lit(False))


def known(value: Column, names: tuple[str, ...]) -> Column:
    """The value, or null if it is none of the names."""
    return F.when(value.isin(*names), value)
