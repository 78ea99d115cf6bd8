"""Column functions on numbers, times, arrays and maps.  Unknown is never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmill.functions.text import found

#: What a unit after a number multiplies by.
UNITS = {"K": 1e3, "M": 1e6, "B": 1e9, "万": 1e4, "亿": 1e8}


def _unit(c: Column) -> Column:
    return F.coalesce(*[F.when(F.upper(c) == u, F.lit(x)) for u, x in UNITS.items()], F.lit(1.0))


def compact_metric(raw: Column) -> Column:
    """Struct (value, approximate) of the first number with a unit in a text: 15.6K is 15600, about."""
    pattern = r"(?i)([0-9.]+)\s*(亿|万|[KMB])?"
    text = F.replace(raw, F.lit(","), F.lit(""))
    unit = F.regexp_extract(text, pattern, 2)
    number = F.regexp_extract(text, pattern, 1).try_cast("double")
    return F.struct(F.round(number * _unit(unit)).cast("bigint").alias("value"), F.when(number.isNotNull(), unit != "").alias("approximate"))


def follower_count(raw: Column) -> Column:
    """The whole text must be a number with or without unit; else NULL.  Not rounded."""
    pattern = r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*(亿|万|[KMB])?\s*$"
    text = F.replace(raw, F.lit(","), F.lit(""))
    return found(text, pattern).try_cast("double") * _unit(F.regexp_extract(text, pattern, 2))


def resolved_metric(exact: Column, label: Column) -> Column:
    """Struct (value, text, status): the exact number first; a compact label stays text; zero isn't missing."""
    compact = found(label, r"(?i)([0-9][0-9,.]*\s*(?:亿|万|[KMB]))(?:[^A-Za-z]|$)")
    plain = F.when(F.regexp_count(label, F.lit(r"[0-9][0-9,]*")) == 1, F.replace(found(label, r"([0-9][0-9,]*)"), F.lit(","), F.lit("")).try_cast("bigint"))
    ok = exact.isNotNull() & (exact >= 0)
    signed = label.rlike(r"-\s*[0-9]|[0-9]\.[0-9]")
    status = (
        F.when(ok, "exact").when(exact.isNotNull(), "invalid").when(label.isNull() | (F.trim(label) == ""), "missing")
        .when(compact.isNotNull(), "approximate").when(plain.isNotNull() & ~signed, "exact_label").otherwise("invalid")
    )
    return F.struct(F.when(ok, exact.cast("bigint")).when(status == "exact_label", plain).alias("value"), F.when(status == "approximate", compact).alias("text"), status.alias("status"))


def safe_ratio(a: Column, b: Column) -> Column:
    """A / b; NULL if either is unknown or b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def interaction_rate(likes: Column, comments: Column, plays: Column) -> Column:
    """(likes + comments) / plays; unknown parts stay unknown."""
    return safe_ratio(likes + comments, F.when(plays > 0, plays))


def duration_ms(supplied: Column, start: Column, end: Column) -> Column:
    """The supplied milliseconds if not negative, else end - start if not negative, else NULL."""
    took = F.unix_millis(end) - F.unix_millis(start)
    return F.coalesce(F.when(supplied >= 0, supplied.cast("bigint")), F.when(took >= 0, took))


def zoned_time(raw: Column) -> Column:
    """An ISO time that names its zone, as a timestamp; NULL without zone or for dates that don't exist."""
    return F.when(raw.rlike(r"(?:[Zz]|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(raw))


def epoch_agrees(raw: Column, epoch: Column) -> Column:
    """The time and the epoch seconds differ by a millisecond at most."""
    return F.abs(F.unix_micros(zoned_time(raw)) / F.lit(1e6) - epoch) <= 0.001


def months_before(end: Column, months: int) -> Column:
    """The start of an inclusive window of calendar months, the day cut to the month's length."""
    return end - F.make_interval(months=F.lit(months))


def retry_after_ms(raw: Column, now: Column) -> Column:
    """Milliseconds that a Retry-After value in seconds or as an ISO time asks for; not below zero."""
    seconds = raw.try_cast("double")
    until = F.unix_millis(zoned_time(raw)) - F.unix_millis(now)
    return F.coalesce(F.when(seconds >= 0, (seconds * 1000).cast("bigint")), F.greatest(until, F.lit(0)))


def per_week(count: Column, days: Column) -> Column:
    """Count in a span of days, by week."""
    return safe_ratio(count * 7, days)


def exact_keys(m: Column, keys: list[str]) -> Column:
    """Struct of keys that a map lacks and keys that it has too many."""
    want = F.array(*[F.lit(k) for k in sorted(keys)])
    return F.struct(F.array_sort(F.array_except(want, F.map_keys(m))).alias("missing"), F.array_sort(F.array_except(F.map_keys(m), want)).alias("unknown"))


def first_present(*columns: Column) -> Column:
    """The first value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def three_valued(ok: Column) -> Column:
    """Pass, fail or unknown of a nullable truth."""
    return F.when(ok.isNull(), "unknown").when(ok, "pass").otherwise("fail")


def within(value: Column, low: Column, high: Column) -> Column:
    """Nullable truth of low <= value <= high."""
    return value.between(low, high)


def country_gate(country: Column, targets: list[str]) -> Column:
    """Nullable truth: no targets pass all; unknown stays unknown; non_US fails only a US brief."""
    if not targets:
        return F.lit(True)
    known = F.when(country.isNotNull() & (country != "unknown"), country)
    return F.when(known == "non_US", F.lit(False) if targets == ["US"] else F.lit(None).cast("boolean")).otherwise(known.isin(*targets))
