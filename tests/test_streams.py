"""Streams on small inputs: timers of open clusters, late rows written once, notices and their guards."""

import random
import time

import pandas as pd
import pytest

from alertmill.operators import lifecycle
from alertmill.streaming import clusters, late, notices

MINUTE = 60_000_000


class Value:
    def __init__(self):
        self.now = None

    def exists(self):
        return self.now is not None

    def get(self):
        return self.now

    def update(self, x):
        self.now = x

    def clear(self):
        self.now = None


class Handle:
    """State, timers and a clock, as a stream has them."""

    def __init__(self):
        self.timers, self.ttl = set(), None

    def getValueState(self, name, schema, ttl_duration_ms=None):
        self.ttl = ttl_duration_ms
        return Value()

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)

    def getCurrentProcessingTimeInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


def drive(processor, batches, until):
    """batches: {ms: rows of (t, alert_id, auto_closed)}; timers fire in between, as the clock passes them."""
    h, out = Handle(), []
    processor.init(h)
    for ms in [*sorted(batches), until]:
        for due in sorted(x for x in h.timers if x <= ms):
            h.timers.discard(due)
            h.ms = due
            for frame in processor.handleExpiredTimer(("k",), h, h):
                out += [(due, *r[1:]) for r in frame.itertuples(index=False, name=None)]
        if ms in batches:
            h.ms = ms
            rows = pd.DataFrame(batches[ms], columns=["t", "alert_id", "auto_closed"])
            for frame in processor.handleInputRows(("k",), iter([rows]), h):
                out += [(ms, *r[1:]) for r in frame.itertuples(index=False, name=None)]
    return out, h


def test_arrival_timers_close_idle_old_and_auto_closed_clusters():
    make = lambda: clusters.ClusterProcessor(["key"], 15 * MINUTE, 240 * MINUTE, 1000, 30 * MINUTE, "arrival")
    m = 60_000
    out, h = drive(make(), {0: [(5, 1, False)], 14 * m: [(7, 2, False)]}, 60 * m)
    assert out == [(29 * m + 1, 1, 0, 14 * MINUTE, 2, "idle_gap")] and not h.timers and h.ttl == 2 * 255 * m
    busy = {k * 10 * m: [(0, k, True)] for k in range(6)}  # never idle: closed at 30 minutes, as a rule closed its first alert
    out, h = drive(make(), busy, 30 * m + 1)
    assert [(o[1], o[4], o[5]) for o in out][:1] == [(0, 4, "max_age")] and len(h.timers) == 1
    out, _ = drive(make(), {k * 10 * m: [(0, k, None)] for k in range(26)}, 400 * m)
    assert [(o[1], o[4], o[5]) for o in out] == [(0, 25, "max_age"), (25, 1, "idle_gap")]
    out, _ = drive(make(), {0: [(0, 1, False)], 15 * m: [(0, 2, False)]}, 15 * m)  # a gap of exactly 15 minutes joins
    assert out == []


def test_event_timers_wait_for_the_idle_gap():
    p = clusters.ClusterProcessor(["key"], 15 * MINUTE, 20 * MINUTE, 3, 30 * MINUTE, "event")
    out, h = drive(p, {100: [(0, 1, False), (14 * MINUTE, 2, False)]}, 10**9)
    assert [(o[0], o[1], o[4], o[5]) for o in out] == [(29 * 60_000 + 1, 1, 2, "idle_gap")] and not h.timers
    p = clusters.ClusterProcessor(["key"], 15 * MINUTE, 20 * MINUTE, 3, 30 * MINUTE, "event")
    out, h = drive(p, {100: [(k * MINUTE, k, False) for k in range(4)]}, 200)
    assert [(o[1], o[4], o[5]) for o in out] == [(0, 3, "max_size")] and h.timers == {18 * 60_000 + 1}


def test_late_rows_are_written_once(spark, tmp_path):
    rng = random.Random(3)
    batches = [[(rng.randrange(1000), 100 * b + i) for i in range(30)] for b in range(4)] + [[], [(2000, 900)], [(1899, 901), (1900, 902)]]
    split = late.LateSplit(f"file://{tmp_path}/s", "t", 100)
    newest, want = None, []
    for b, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "t long, id long").coalesce(2)
        for _ in range(2 if b % 2 else 1):  # some batches run again
            split(df, b)
        want += [(b, t, i, newest is not None and t < newest - 100) for t, i in rows]
        newest = max([t for t, _ in rows] + [newest or 0])
    split(spark.createDataFrame(batches[-1], "t long, id long"), len(batches) - 1)
    got = [(r["batch"], r["t"], r["id"], which) for which in (False, True) for r in split.table(spark, "t long, id long", which).collect()]
    assert sorted(got) == sorted(want) and {w for *_, w in want} == {False, True}


@pytest.mark.parametrize(
    "stored, notice, want",
    [
        (None, (5, "open", None, None, None), ("created", None)),
        ((5, "open", None, None, None), (4, "kept", "u", 1, "r"), ("ignored", "stale")),
        ((5, "open", None, None, None), (5, "kept", "u", 1, "r"), ("updated", None)),
        ((5, "undone", None, None, None), (6, "open", None, None, None), ("ignored", "terminal")),
        ((5, "undone", None, None, None), (6, "info", None, None, None), ("updated", None)),
        ((5, "kept", "u", 9, None), (8, "open", None, None, None), ("ignored", "decided")),
        ((5, "kept", "u", 9, None), (9, "open", None, None, None), ("updated", None)),
        ((5, "kept", "u", None, None), (6, "open", None, None, None), ("updated", None)),
    ],
)
def test_guards_of_notices(stored, notice, want):
    after, outcome, reason = lifecycle.apply_notice(stored, notice)
    assert (outcome, reason) == want
    assert after == (stored if outcome == "ignored" else (*notice[:2], *(b if b is not None else a for a, b in zip((stored or (None,) * 5)[2:], notice[2:], strict=True))))


def test_notices_bear_nulls_and_empty_tables(spark):
    kind = "id string, arrival long, sent_at long, status string, decided_by string, decided_at long, result string"
    rows = [("a", 1, 10, "open", None, None, None), ("a", 2, 11, "kept", "u1", 20, "done"), ("a", 3, 12, "open", None, None, None), ("a", 4, 30, "info", None, None, None), (None, 5, 1, "open", None, None, None), (None, 6, 2, "expired", None, None, None)]
    got = {r["arrival"]: r for r in lifecycle.notices(spark.createDataFrame(rows, kind)).collect()}
    assert [got[k]["outcome"] for k in range(1, 7)] == ["created", "updated", "ignored", "updated", "created", "updated"]
    assert got[3]["reason"] == "decided" and (got[4]["stored_status"], got[4]["stored_decided_by"], got[4]["stored_decided_at"]) == ("info", "u1", 20)
    assert lifecycle.notices(spark.createDataFrame([], kind)).count() == 0


def test_a_ticket_keeps_its_instants_as_whole_numbers():
    p = notices.NoticeProcessor("id", "arrival")
    p.init(Handle())
    frame = pd.DataFrame({"id": [1, 1], "arrival": [2, 1], "sent_at": [6, 5], "status": ["kept", "kept"], "decided_by": [None, "u"], "decided_at": [None, 9], "result": [None, None]})
    list(p.handleInputRows((1,), iter([frame]), None))
    assert p.ticket.get() == (6, "kept", "u", 9, None) and isinstance(p.ticket.get()[3], int)
    later = pd.DataFrame({"id": [1], "arrival": [3], "sent_at": [7], "status": ["open"], "decided_by": [None], "decided_at": [None], "result": [None]})
    (out,) = p.handleInputRows((1,), iter([later]), None)
    assert out["reason"].tolist() == ["decided"] and out["stored_decided_at"].tolist() == [9]


def test_batches_of_many_tickets_go_on_from_what_was_left(spark, tmp_path):
    """As one pass over all notices, with batches that run again, tickets that skip a batch, and a null key; thousands of tickets
    without a call of Python and of state for each."""
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    rows = [(pick(None, *range(9000)) if a % 50 else None, a, rng.randrange(300), pick("open", "kept", "undone", "info"), pick(None, "u", "v"), pick(None, 2**60 + 1, rng.randrange(300)), pick(None, "r")) for a in range(20_000)]
    kind = "id long, arrival long, sent_at long, status string, decided_by string, decided_at long, result string"
    whole = spark.createDataFrame(rows, kind).coalesce(2)
    batches = notices.AppliedBatches(f"file://{tmp_path}/t", "id long, arrival long")
    began = time.time()
    for b, (low, high) in enumerate(((0, 8000), (8000, 8000), (8000, 15_000), (15_000, 20_000))):
        for _ in range(2 if b == 2 else 1):
            batches(whole.filter(f"arrival >= {low} and arrival < {high}"), b)
    spent = time.time() - began
    got = sorted(batches.applied(spark).collect(), key=lambda r: r["arrival"])
    assert got == sorted(lifecycle.notices(whole).collect(), key=lambda r: r["arrival"])
    last = {r["id"]: tuple(r)[4:] for r in got}
    assert {r["id"]: tuple(r)[1:] for r in batches.tickets(spark, 3).collect()} == last
    assert spent < 40  # a call for each of the 15,000 or so was over a minute


def test_a_call_for_a_key_reads_its_state_once():
    p = clusters.ClusterProcessor(["key"], 15 * MINUTE, 240 * MINUTE, 1000, 30 * MINUTE, "order")
    p.init(Handle())
    p.open.exists = None  # not to be asked
    frames = [pd.DataFrame({"t": t, "alert_id": i}) for t, i in (([20 * MINUTE, 0], [3, 1]), ([MINUTE], [2]))]
    out = [tuple(r) for f in p.handleInputRows(("k",), iter(frames), None) for r in f.itertuples(index=False, name=None)]
    assert out == [("k", 1, 0, MINUTE, 2, "idle_gap")] and p.open.get() == (3, 20 * MINUTE, 20 * MINUTE, 1, False)
