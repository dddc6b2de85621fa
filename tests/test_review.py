"""Health checks at their edges, routes of unknown clusters, and prompts against a plain reading of them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from alertmill.functions import prompts
from alertmill.operators import health, routes

MINUTE, HOUR = health.MINUTE, health.HOUR
NOW = 1_700_000_000_000_000


def only(df):
    (row,) = df.collect()
    return row["ok"], row["value"]


@pytest.mark.parametrize(("seen", "pull", "webhook"), [([], (False, None), (True, None)), ([30 * MINUTE, 90 * MINUTE], (True, 30.0), (True, 0.5)), ([30 * MINUTE + 1], (False, 30.0), (True, 0.5)), ([24 * HOUR + 1], (False, 1440.0), (False, 24.0))])
def test_heartbeats(spark, seen, pull, webhook):
    rows = spark.createDataFrame([(NOW - s, NOW - s) for s in seen], "last_seen_at long, last_alert_at long")
    assert only(health.pull_heartbeat(rows, NOW)) == pull and only(health.webhook_heartbeat(rows, NOW)) == webhook


def test_backlogs_shares_and_counts(spark):
    intake = spark.createDataFrame([(NOW - 9 * MINUTE, NOW, None), (NOW - 8 * MINUTE, None, "bad"), (NOW - 5 * MINUTE, None, None)], "received_at long, processed_at long, error string")
    assert only(health.intake_backlog(intake, NOW)) == (True, 5.0) and only(health.intake_backlog(intake, NOW + 1)) == (False, 5.0) and only(health.intake_backlog(intake.limit(0), NOW)) == (True, 0.0)
    jobs = spark.createDataFrame([("pending", NOW - 11 * MINUTE), ("pending", NOW + MINUTE), ("done", NOW - HOUR)], "status string, scheduled_at long")
    assert only(health.job_backlog(jobs, NOW)) == (False, 11.0)
    runs = spark.createDataFrame([(NOW, "tier1", None, 1.0), (NOW - HOUR + 1, "tier1", "x", 2.0), (NOW - HOUR, "tier1", None, 3.0), (NOW, "rag_lookup", None, 4.0)], "created_at long, pipeline string, result string, cost_usd double")
    assert only(health.null_results(runs, NOW)) == (False, 50.0) and only(health.null_results(runs.limit(0), NOW)) == (True, 0.0)
    assert only(health.monthly_cost(runs, NOW, 12.5)) == (True, 80.0) and only(health.monthly_cost(runs, NOW, 12.0))[0] is False
    assert only(health.monthly_cost(runs, NOW, None)) == (False, None) and only(health.monthly_cost(runs, NOW, 0)) == (True, 0.0)
    assert only(health.retrieval_budget(runs, NOW, 4.0)) == (False, 4.0) and only(health.retrieval_budget(runs, NOW, 4.1)) == (True, 4.0) and only(health.retrieval_budget(runs, NOW, 0.0, enabled=False)) == (True, None)
    failed = spark.createDataFrame([("failed", NOW - k) for k in range(5)] + [("failed", NOW - HOUR), ("ok", NOW)], "status string, created_at long")
    assert only(health.lookup_failures(failed, NOW)) == (False, 5.0) and only(health.lookup_failures(failed.filter(F.col("created_at") < NOW), NOW)) == (True, 4.0)
    assert only(health.inventory(runs.limit(0))) == (False, 0.0) and only(health.inventory(runs.limit(0), enriched=False)) == (True, None)
    drafts = spark.createDataFrame([("pending",), ("pending",), ("kept",), (None,)], "status string")
    assert only(health.knowledge_queue(drafts, 2)) == (True, 2.0) and only(health.knowledge_queue(drafts, 1)) == (False, 2.0)
    events = spark.createDataFrame([("rag.integrity_failed", "1", NOW), ("rag.integrity_failed", "1", NOW - 5), ("rag.integrity_failed", "2", NOW), ("rag.integrity_failed", "3", NOW - 24 * HOUR), ("x", "3", NOW)], "event_type string, subject_id string, created_at long")
    entries = spark.createDataFrame([(1, "active"), (2, "retired"), (3, "active")], "entry_id long, status string")
    assert only(health.knowledge_integrity(events, entries, NOW)) == (False, 1.0)


def test_a_digest_is_asked_for_in_the_evening_and_about_yesterday(spark):
    evening = NOW - NOW % (24 * HOUR) + 10 * HOUR  # 17:00 at +7
    begin, end, hour = health.yesterday(evening)
    assert hour == 17 and end - begin == 24 * HOUR and evening - end == 17 * HOUR
    rows = [(1, "auto_closed", False, begin), (2, "auto_closed", False, end - 1), (3, "auto_closed", False, end), (4, "auto_closed", True, begin), (5, "closed", False, begin), (6, "auto_closed", False, None)]
    alerts = spark.createDataFrame(rows, "alert_id long, status string, is_synthetic boolean, closed_at long")
    reviews = spark.createDataFrame([(1,)], "alert_id long")
    assert only(health.digest_unreviewed(alerts, reviews, evening)) == (False, 1.0)
    assert only(health.digest_unreviewed(alerts, reviews, evening - 1)) == (True, None)


def test_routes_are_those_of_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["unknown", "unknown", "malware", "recon", None]), rng.choice(["a", "b", "c", None]), rng.choice(["critical", "low", None])) for _ in range(200)]
    ways = {"keep": {}, "move": {"a": "fresh", "b": "recon"}, "drop": {"a": None, "b": None, "c": None}}
    got = {r["route"]: r for r in routes.summary(spark.createDataFrame(rows, "category string, family string, severity string"), ways, ["malware", "recon"]).collect()}
    for name, way in ways.items():
        view = []
        for category, family, severity in rows:
            to = way.get(family, category) if category == "unknown" else category
            if to is not None:
                view.append((to, severity))
        unknown = sum(c == "unknown" for c, _ in view)
        severe = [c for c, s in view if s == "critical"]
        r = got[name]
        assert (r["clusters"], r["unknown"], r["expressible"], r["severe"], r["severe_expressible"]) == (len(view), unknown, len(view) - unknown, len(severe), sum(c != "unknown" for c in severe))
        assert r["cells"] == len(set(view)) and r["large_cells"] == sum(view.count(x) >= 10 for x in set(view)) and r["proportional_unknown"] == round(300 * unknown / len(view))
        assert r["new_categories"] == ("fresh" if name == "move" else "")
    assert routes.summary(spark.createDataFrame([], "category string, family string, severity string"), ways, []).count() == 0


def read_plainly(text, nonce, phrases, words):
    """Tags one after another, then lines one after another."""
    opens, closes = f'<untrusted_data nonce="{nonce}"', f'</untrusted_data nonce="{nonce}">'
    out, kept, pending, at = [], "", None, 0
    line = lambda i: text.count("\n", 0, i) + 1
    spans = []
    for m in re.finditer("(?:" + re.escape(opens) + "[^>]*>)|" + re.escape(closes), text):
        if m[0] == closes:
            if pending is None:
                out.append(("unbalanced_block", line(m.start()), None, None))
            else:
                spans.append((pending, m.end()))
            pending = None
        else:
            if pending is not None:
                out.append(("unbalanced_block", line(pending), None, None))
            pending = m.start()
    if pending is not None:
        out.append(("unbalanced_block", line(pending), None, None))
    for a, b in spans:
        kept += text[at:a] + "\n" * text.count("\n", a, b)
        at = b
    kept += text[at:]
    for phrase in phrases:
        kept = kept.replace(phrase, "")
    for i, row in enumerate(kept.split("\n"), 1):
        tokens = [t.strip("·-:,.()[]#→∈∧≠") for t in row.split()]
        bad = [t for t in tokens if t and t not in words and not re.fullmatch(r"-?\d+|T\d{4}(\.\d{3})?|[a-z]{2,6}-\d{1,2}|\d{1,3}\.\d{1,3}|=|\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ|\d+\.\d+", t)]
        if bad:
            out.append(("free_text", i, bad[0][:40], len(bad)))
    return sorted(out, key=lambda v: (v[0] != "unbalanced_block", v[1]))


def test_prompts_are_read_as_they_are_plainly(spark):
    rng = random.Random(8)
    nonce = r"a\E.b$"
    parts = ["\n", "\n", " ", "high", "stray", "x" * 50, "(12)", "T1110.001,", "sbf-1", "2024-01-02T03:04:05Z", "=", "Heading two", "·", "1.2", "\u3000", f'<untrusted_data nonce="{nonce}" source="a\nb">', f'<untrusted_data nonce="{nonce}">', f'</untrusted_data nonce="{nonce}">', '<untrusted_data nonce="z">', "$1", "é"]
    texts = ["", *("".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 30))) for _ in range(300)), f'<untrusted_data nonce="{nonce}">' + "free words\n" * 20_000 + f'</untrusted_data nonce="{nonce}">\nend']
    rows = spark.createDataFrame([(i, x, nonce) for i, x in enumerate(texts)] + [(-1, None, nonce), (-2, "a 1\nb", None)], "id long, text string, nonce string")
    got = {r["id"]: r["v"] for r in rows.select("id", prompts.lint(F.col("text"), F.col("nonce"), ["Heading two", "-"], ["high"]).alias("v")).collect()}
    assert got[-1] is None and [tuple(v) for v in got[-2]] == [("free_text", 1, "a", 1), ("free_text", 2, "b", 1)]
    for i, text in enumerate(texts):
        assert [tuple(v) for v in got[i]] == read_plainly(text, nonce, ["Heading two"], ["high"]), text[:300]
