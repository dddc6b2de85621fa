"""The status of alerts as a fold of their events, and what must hold of stored rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Which event leads from which status to which.
TRANSITIONS = {
    ("new", "enrich"): "enriching",
    ("enriching", "queue"): "queued",
    ("enriching", "auto_close"): "auto_closed",
    ("queued", "acknowledge"): "acknowledged",
    ("acknowledged", "close"): "closed",
    ("queued", "close"): "closed",
    ("acknowledged", "escalate"): "escalated",
    ("queued", "escalate"): "escalated",
    ("escalated", "conclude"): "closed",
    ("closed", "reopen"): "queued",
    ("auto_closed", "reopen"): "queued",
}
FIRST = "new"


def status_fold(events: DataFrame, subject: str = "subject_id", order: Sequence[str] = ("created_at", "audit_id"), event: str = "event_type") -> DataFrame:
    """Each event with status (after it) and legal: an illegal one changes nothing. Events are streamed in order, a
    subject's state is its status alone."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    names = [subject, *order, event]
    ordered = events.select(*names).repartition(subject).sortWithinPartitions(subject, *order)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, status = None, FIRST
        for frame in frames:
            out, legal = [], []
            for s, e in zip(frame[subject], frame[event], strict=True):
                if s != held:
                    held, status = s, FIRST
                after = TRANSITIONS.get((status, e))
                legal.append(after is not None)
                status = after or status
                out.append(status)
            yield frame.assign(status=out, legal=legal)

    return ordered.mapInPandas(fold, ", ".join([*(f"{n} {kinds[n]}" for n in names), "status string", "legal boolean"]))


def violations(alerts: DataFrame) -> DataFrame:
    """alert_id and constraint of each rule that a stored alert breaks. Columns: status, closed_at, sealed_at,
    duplicate_of, first_seen, last_seen, occurrence_count, risk_score, bucket_hash."""
    c = F.col
    rules = {
        "terminal_has_closed_at": c("status").isin("closed", "auto_closed", "duplicate") & c("closed_at").isNull(),
        "human_closed_is_sealed": (c("status") == "closed") & c("sealed_at").isNull(),
        "escalated_is_not_sealed": (c("status") == "escalated") & c("sealed_at").isNotNull(),
        "duplicate_is_closed_and_sealed": c("duplicate_of").isNotNull() & (c("closed_at").isNull() | c("sealed_at").isNull()),
        "no_self_pointer": c("duplicate_of") == c("alert_id"),
        "seen_in_order": c("last_seen") < c("first_seen"),
        "occurs": c("occurrence_count") < 1,
        "risk_in_range": (c("risk_score") < 0) | (c("risk_score") > 100),
        "hash_is_sha256": ~c("bucket_hash").rlike("^[0-9a-f]{64}$"),
    }
    broken = F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items())), lambda n: n.isNotNull())
    return alerts.select("alert_id", F.explode(broken).alias("constraint"))


# --- review notices ---------------------------------------------------------------------------------

#: The states a ticket does not come back from by itself, and what a notice without them leaves as it is.
TERMINAL = ("undone", "false_positive", "expired")
KEPT_WHEN_NULL = ("decided_by", "decided_at", "result")
NOTICE = ("sent_at", "status", *KEPT_WHEN_NULL)
APPLIED = "outcome string, reason string, last_sent long, stored_status string, stored_decided_by string, stored_decided_at long, stored_result string"


def apply_notice(stored: tuple | None, notice: tuple) -> tuple[tuple, str, str | None]:
    """The ticket after a notice (both as NOTICE), the outcome and why a notice was ignored: stale (sent before the last one),
    terminal (would open an ended ticket), decided (would open one that a later decision kept)."""
    if stored is None:
        return notice, "created", None
    sent, status, *kept = notice
    last, was, _, decided_at, _ = stored
    if sent < last:
        return stored, "ignored", "stale"
    if status == "open" and was in TERMINAL:
        return stored, "ignored", "terminal"
    if status == "open" and was == "kept" and decided_at is not None and decided_at > sent:
        return stored, "ignored", "decided"
    return (sent, status, *(b if b is not None else a for a, b in zip(stored[2:], kept, strict=True))), "updated", None


def plain(values: Iterable) -> tuple:
    """Cells of a pandas row: missing ones as None, numbers as Python's."""
    return tuple(None if x is None or x is pd.NA or x is pd.NaT or x != x else x.item() if hasattr(x, "item") else x for x in values)


def whole(frame: pd.DataFrame) -> pd.DataFrame:
    """Notices as objects whose instants are whole numbers or missing: pandas holds a column with gaps as floats, which a state's
    long field drops."""
    return frame.astype({"sent_at": "Int64", "decided_at": "Int64"}).astype(object)


def notices(rows: DataFrame, key: str = "id", order: Sequence[str] = ("arrival",), stored: DataFrame | None = None) -> DataFrame:
    """Each notice (key, order and NOTICE columns) with its outcome and the ticket after it (APPLIED), applied in order of
    arrival. Notices are streamed in sorted order; a ticket's state is one row.

    stored: tickets (key and NOTICE columns, one row a key) that the notices come to. With it, a row without an outcome and order
    follows for each ticket, old or new: what it is after all notices."""
    names = [key, *order, *NOTICE]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    both = rows.select(*names, F.lit(True).alias("_new"))
    if stored is not None:
        both = both.unionByName(stored.select(key, *NOTICE, F.lit(False).alias("_new")), allowMissingColumns=True)
    ordered = both.repartition(key).sortWithinPartitions(key, "_new", *order)
    told, at = stored is not None, 1 + len(order)
    columns = [key, *order, *(c.split()[0] for c in APPLIED.split(", "))]
    kind = ", ".join([*(f"{n} {kinds[n]}" for n in (key, *order)), APPLIED])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, held, ticket, types = False, None, None, None
        end = lambda: (held, *(None,) * len(order), None, None, *ticket)
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=columns)
        for batch in batches:
            types = types or [*batch.schema.types[:at], pa.string(), pa.string(), *batch.schema.types[at:-1]]
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or row[0] != held:
                    if begun and told:
                        out.append(end())
                    begun, held, ticket = True, row[0], None
                if row[-1]:
                    ticket, outcome, reason = apply_notice(ticket, row[at:-1])
                    out.append((*row[:at], outcome, reason, *ticket))
                else:
                    ticket = row[at:-1]
            if out:
                yield made(out)
        if begun and told:
            yield made([end()])

    return ordered.mapInArrow(fold, kind)
