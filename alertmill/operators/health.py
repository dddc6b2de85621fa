"""Health checks: each is one row (name, ok, value, threshold) from one aggregate over its table; report() puts them together.

`now` is a parameter in microseconds. A check that is switched off is ok and has no value. Shares and ages are rounded to one
decimal for display; what is judged is the exact value.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill import params as P

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


def _row(rows: DataFrame, name: str, ok: Column, value: Column, most: float | None) -> DataFrame:
    return rows.select(F.lit(name).alias("name"), ok.alias("ok"), value.cast("double").alias("value"), F.lit(most).cast("double").alias("threshold"))


def switched_off(rows: DataFrame, name: str, most: float | None) -> DataFrame:
    """The row of a check that does not apply; nothing of the table is read."""
    return _row(rows.sparkSession.range(1), name, F.lit(True), F.lit(None), most)


def age(rows: DataFrame, name: str, instant: Column, now: int, unit: int, most: float, ok_if_none: bool, none: float | None = None, digits: int = 1) -> DataFrame:
    """How long ago an instant of the table was (an aggregate like max of a column), in units; without one ok_if_none decides."""
    ago = (F.lit(now) - F.col("at")) / unit
    return _row(rows.agg(instant.alias("at")), name, F.coalesce(ago <= most, F.lit(ok_if_none)), F.coalesce(F.round(ago, digits), F.lit(none).cast("double")), most)


def share(rows: DataFrame, name: str, hit: Column, most: float) -> DataFrame:
    """The percentage of rows that are hits; 0 for no rows."""
    percent = F.coalesce(F.try_divide(100.0 * F.col("hits"), F.col("n")), F.lit(0.0))
    return _row(rows.agg(F.count_if(hit).alias("hits"), F.count("*").alias("n")), name, percent <= most, F.round(percent, 1), most)


def at_most(rows: DataFrame, name: str, count: Column, most: float) -> DataFrame:
    return _row(rows.agg(count.alias("n")), name, F.col("n") <= most, F.col("n"), most)


# --- the checks -----------------------------------------------------------------------------------------


def pull_heartbeat(heartbeats: DataFrame, now: int, most: float = P.HEARTBEAT_AGE_MIN) -> DataFrame:
    """Minutes since the last pull; no pull ever is an alarm."""
    return age(heartbeats, "heartbeat", F.max("last_seen_at"), now, MINUTE, most, ok_if_none=False)


def webhook_heartbeat(heartbeats: DataFrame, now: int, most: float = P.WEBHOOK_AGE_H) -> DataFrame:
    """Hours since the last real alert; a system without any yet is ok."""
    return age(heartbeats, "heartbeat", F.max("last_alert_at"), now, HOUR, most, ok_if_none=True, digits=2)


def intake_backlog(intake: DataFrame, now: int) -> DataFrame:
    waiting = F.when(F.col("processed_at").isNull() & F.col("error").isNull(), F.col("received_at"))
    return age(intake, "intake_backlog", F.min(waiting), now, MINUTE, P.INTAKE_AGE_S / 60, ok_if_none=True, none=0.0)


def job_backlog(jobs: DataFrame, now: int) -> DataFrame:
    due = F.when((F.col("status") == "pending") & (F.col("scheduled_at") <= now), F.col("scheduled_at"))
    return age(jobs, "job_backlog", F.min(due), now, MINUTE, P.JOB_AGE_S / 60, ok_if_none=True, none=0.0)


def null_results(runs: DataFrame, now: int) -> DataFrame:
    """Runs of the last hour without a result; lookups have a check of their own."""
    recent = runs.filter((F.col("created_at") > now - HOUR) & (F.col("created_at") <= now) & (F.col("pipeline") != "rag_lookup"))
    return share(recent, "llm_null_ratio", F.col("result").isNull(), 100 * P.NULL_RATIO_LIMIT)


def triage_unavailable(alerts: DataFrame, now: int) -> DataFrame:
    recent = alerts.filter((F.col("received_at") > now - DAY) & (F.col("received_at") <= now))
    return share(recent, "triage_unavailable", F.col("triage_status") == "unavailable", 100 * P.UNAVAILABLE_LIMIT)


def month_of(now: int) -> tuple[int, int]:
    """The first instants of a month and of the next (UTC)."""
    first = (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=now)).replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    after = (first + timedelta(days=31)).replace(day=1)
    return tuple(int(x.timestamp()) * 1_000_000 for x in (first, after))


def _spent(runs: DataFrame, now: int) -> DataFrame:
    first, after = month_of(now)
    return runs.filter((F.col("created_at") >= first) & (F.col("created_at") < after)).agg(F.coalesce(F.sum(F.col("cost_usd")), F.lit(0)).cast("double").alias("spent"))


def monthly_cost(runs: DataFrame, now: int, cap: float | None) -> DataFrame:
    """The month's spending as a percentage of its cap. A cap that can't be read (None) fails; of a cap of 0 nothing is spent."""
    if cap is None:
        return _row(runs.sparkSession.range(1), "monthly_cost", F.lit(False), F.lit(None), 100 * P.COST_LIMIT)
    percent = 100.0 * F.col("spent") / cap if cap else F.lit(0.0)
    return _row(_spent(runs, now), "monthly_cost", percent <= 100 * P.COST_LIMIT, F.round(percent, 1), 100 * P.COST_LIMIT)


def inventory(assets: DataFrame, enriched: bool = True) -> DataFrame:
    if not enriched:
        return switched_off(assets, "inventory_empty", 1)
    return _row(assets.agg(F.count("*").alias("n")), "inventory_empty", F.col("n") > 0, F.col("n"), 1)


def yesterday(now: int, zone: str = P.DISPLAY_TZ) -> tuple[int, int, int]:
    """The first instants of yesterday and today in a zone, and the hour there."""
    local = (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=now)).astimezone(ZoneInfo(zone))
    today = local.replace(hour=0, minute=0, second=0, microsecond=0)
    return int((today - timedelta(days=1)).timestamp()) * 1_000_000, int(today.timestamp()) * 1_000_000, local.hour


def digest_unreviewed(alerts: DataFrame, reviews: DataFrame, now: int) -> DataFrame:
    """Alerts that were closed by rule yesterday and have no review; asked from 17:00 local time on. A review's alert is looked up
    among the alerts of one day, so the shuffle holds that day alone."""
    begin, end, hour = yesterday(now)
    if hour < P.DIGEST_HOUR:
        return switched_off(alerts, "digest_unreviewed", 0)
    closed = alerts.filter((F.col("status") == "auto_closed") & ~F.col("is_synthetic") & (F.col("closed_at") >= begin) & (F.col("closed_at") < end))
    return at_most(closed.join(reviews, "alert_id", "left_anti"), "digest_unreviewed", F.count("*"), 0)


def knowledge_queue(drafts: DataFrame, most: int) -> DataFrame:
    return at_most(drafts, "knowledge_queue", F.count_if(F.col("status") == "pending"), most)


def knowledge_integrity(events: DataFrame, entries: DataFrame, now: int) -> DataFrame:
    """Entries still in use that failed their integrity check in the last day, each once."""
    failed = events.filter((F.col("event_type") == "rag.integrity_failed") & (F.col("created_at") > now - DAY) & (F.col("created_at") <= now)).select("subject_id").distinct()
    return at_most(failed.join(entries.filter("status = 'active'").select(F.col("entry_id").cast("string").alias("subject_id")), "subject_id", "left_semi"), "knowledge_integrity", F.count("*"), 0)


def retrieval_budget(runs: DataFrame, now: int, cap: float, enabled: bool = True) -> DataFrame:
    """The month's spending on lookups and drafts; reaching the cap is an alarm."""
    if not enabled:
        return switched_off(runs, "rag_budget", cap)
    return _row(_spent(runs.filter(F.col("pipeline").isin("rag_lookup", "knowledge_draft")), now), "rag_budget", F.col("spent") < cap, F.round("spent", 4), cap)


def lookup_failures(results: DataFrame, now: int, enabled: bool = True) -> DataFrame:
    """Lookups that failed in the last hour; the fifth is an alarm."""
    if not enabled:
        return switched_off(results, "rag_lookup_failures", P.LOOKUP_FAILURES)
    failed = results.filter((F.col("status") == "failed") & (F.col("created_at") > now - HOUR) & (F.col("created_at") <= now)).agg(F.count("*").alias("n"))
    return _row(failed, "rag_lookup_failures", F.col("n") < P.LOOKUP_FAILURES, F.col("n"), P.LOOKUP_FAILURES)


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
