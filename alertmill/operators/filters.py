"""Filters of lists, pages that know whether they are cut, host names and local bounds."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.functions.textsafety import nfkc

PAGE_MOST = 200


def contains_text(c: Column, text: str) -> Column:
    """Whether a column holds a text as it stands, case aside; %, _ and backslash are no wild cards."""
    return F.contains(F.lower(c), F.lit(text.lower()))


def intel_filter(now, source: str | None = None, kind: str | None = None, malware: str | None = None, seen_from=None, seen_before=None, confidence: int | None = None, text: str | None = None, with_expired: bool = False) -> Column:
    """Indicators not expired, and by what is given; text is looked for in value, malware, threat and any tag."""
    kind, malware, text = ((x or "").strip() for x in (kind, malware, text))
    out = F.lit(True) if with_expired else F.col("expires") > now
    for column, value in (("source", source), ("type", kind.lower() or None), ("malware", malware or None)):
        out = out if value is None else out & (F.col(column) == value)
    out = out if seen_from is None else out & (F.col("first_seen") >= seen_from)
    out = out if seen_before is None else out & (F.col("first_seen") < seen_before)
    out = out if confidence is None else out & (F.col("confidence") >= confidence)
    if text:
        out = out & (contains_text(F.col("value"), text) | contains_text(F.col("malware"), text) | contains_text(F.col("threat"), text) | F.exists("tags", lambda t: contains_text(t, text)))
    return out


def review_filter(text: str | None, columns: Sequence[str], number: str, statuses: Sequence[str] | None = None) -> Column:
    """Tickets by status, and by a number (#65 or 65) or a text in any of the columns."""
    out = F.lit(True) if statuses is None else F.col("status").isin(*statuses)
    text = (text or "").strip()
    text = text[1:].strip() if text.startswith("#") else text
    if re.fullmatch("[0-9]{1,18}", text):
        return out & (F.col(number) == int(text))
    if text:
        any_ = F.lit(False)
        for c in columns:
            any_ = any_ | F.coalesce(contains_text(F.col(c), text), F.lit(False))
        out = out & any_
    return out


def audit_filter(begin, end, groups: Sequence[str] = (), roles: Sequence[str] = (), subject: int | None = None) -> Column:
    """Events of a span, by group (what stands before the dot of their type), role of the actor and subject."""
    out = (F.col("created") >= begin) & (F.col("created") < end)
    out = out & F.substring_index("event_type", ".", 1).isin(*groups) if groups else out
    out = out & F.col("actor_role").isin(*roles) if roles else out
    return out if subject is None else out & (F.col("subject_id") == subject)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """A page of at most PAGE_MOST rows, counted from 1."""
    size = max(1, min(size, PAGE_MOST))
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def cut_page(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first rows, with `truncated`: whether there are more. One row more is read, nothing is counted."""
    over = df.orderBy(*order).limit(limit + 1)
    n = over.agg((F.count("*") > limit).alias("truncated"))  # one row
    return over.orderBy(*order).limit(limit).crossJoin(F.broadcast(n))


def host_name(name: Column) -> Column:
    """As hosts are compared: no characters that can't be seen, compatible forms folded, no last dot, small letters."""
    return F.lower(F.regexp_replace(F.trim(nfkc(F.regexp_replace(name, r"[\p{Cc}\p{Cf}]", ""))), r"\.$", ""))


def is_critical_host(name: Column, listed: Sequence[str]) -> Column:
    """Whether a host or its first label is a listed one."""
    host, names = host_name(name), [n.lower().rstrip(".") for n in listed if n]
    return F.coalesce((host != "") & (host.isin(*names) | F.substring_index(host, ".", 1).isin(*names)), F.lit(False))


def day_bounds(day: str, hours: int) -> tuple[Column, Column]:
    """A local day as instants, begin and end."""
    begin = F.lit(day).cast("timestamp_ntz").cast("timestamp") - F.expr(f"interval {hours} hours")
    return begin, begin + F.expr("interval 1 day")


def next_morning(micros: Column, hours_east: int, at: int = 8) -> Column:
    """The next time, in microseconds, that it is `at` o'clock in a zone of a fixed distance."""
    hour, day = 3_600_000_000, 86_400_000_000
    local = micros + hours_east * hour
    midnight = local - F.pmod(local, F.lit(day))
    return midnight + at * hour + F.when(F.pmod(local, F.lit(day)) < at * hour, 0).otherwise(day) - hours_east * hour


def distinct_in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key once, with the place where it came first."""
    return df.groupBy(key).agg(F.min(order).alias(order))
