"""Queries of what people review: health checks, routes of unknown clusters, linted prompts, drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertmill.functions import drafts, prompts
from alertmill.functions import scalar as S
from alertmill.operators import health, routes
from alertmill.plans import model as M
from alertmill.plans.model import ALERTS, DAY, HOUR, NOW, RUNS, with_
from alertmill.plans.registry import query

# --- health -----------------------------------------------------------------------------------------

#: 18:00 in the zone of display, ten days before all alerts end; half past midnight within the years of the runs.
ALERTS_AT, RUNS_AT = NOW - 10 * DAY + 11 * HOUR, 834_798_600_000_000
MONTH, NEXT_MONTH = health.month_of(RUNS_AT)
YESTERDAY, TODAY, _ = health.yesterday(ALERTS_AT)
CAP, LOOKUP_CAP, QUEUE = 40.0, 3.0, 200

HEALTH = with_(ALERTS, RUNS, """r AS (SELECT created, cost_usd, CASE WHEN stopped_by IS NULL THEN verdict END AS result, CASE model_id WHEN 'model-0' THEN 'rag_lookup' WHEN 'model-1' THEN 'knowledge_draft' ELSE pipeline END AS pipeline FROM runs)""")
_AGE = "SELECT '{name}' AS name, coalesce(ago <= {most}, {empty}) AS ok, coalesce(round(ago, 1), {none}) AS value, CAST({most} AS DOUBLE) AS threshold FROM (SELECT ({now} - {instant}) / 60000000 AS ago FROM {rows})"
_SHARE = "SELECT '{name}', coalesce(p, 0) <= {most}, coalesce(round(p, 1), 0), CAST({most} AS DOUBLE) FROM (SELECT 100.0::DOUBLE * count(*) FILTER (WHERE {hit}) / nullif(count(*), 0) AS p FROM {rows})"
_COUNT = "SELECT '{name}', n <= {most}, CAST(n AS DOUBLE), CAST({most} AS DOUBLE) FROM (SELECT count(*) AS n FROM {rows})"
_SPENT = "(SELECT CAST(coalesce(sum(cost_usd), 0) AS DOUBLE) AS s FROM r WHERE created >= {month} AND created < {after}{more})"
_month = {"month": MONTH, "after": NEXT_MONTH}


@query(HEALTH + "\nUNION ALL\n".join([
    _AGE.format(name="heartbeat", most=30, empty="false", none="NULL", now=ALERTS_AT, instant="max(t)", rows=f"alerts WHERE t <= {ALERTS_AT}"),
    _AGE.format(name="intake_backlog", most=5.0, empty="true", none=0, now=ALERTS_AT, instant="min(t)", rows=f"alerts WHERE t <= {ALERTS_AT} AND acked IS NULL AND triage_status <> 'failed'"),
    _AGE.format(name="job_backlog", most=10.0, empty="true", none=0, now=RUNS_AT, instant="min(epoch_us(o_orderdate))", rows=f"orders WHERE o_orderstatus = 'P' AND epoch_us(o_orderdate) <= {RUNS_AT}"),
    _SHARE.format(name="llm_null_ratio", most=30.0, hit="result IS NULL", rows=f"r WHERE created > {RUNS_AT - HOUR} AND created <= {RUNS_AT} AND pipeline <> 'rag_lookup'"),
    _SHARE.format(name="triage_unavailable", most=10.0, hit="triage_status = 'failed'", rows=f"alerts WHERE t > {ALERTS_AT - DAY} AND t <= {ALERTS_AT}"),
    f"SELECT 'monthly_cost', 100 * s / {CAP} <= 80, round(100 * s / {CAP}, 1), 80.0::DOUBLE FROM " + _SPENT.format(**_month, more=""),
    "SELECT 'inventory_empty', count(*) > 0, CAST(count(*) AS DOUBLE), 1.0::DOUBLE FROM nation",
    _COUNT.format(name="digest_unreviewed", most=0, rows=f"alerts WHERE status = 'auto_closed' AND NOT is_synthetic AND t >= {YESTERDAY} AND t < {TODAY} AND k % 2 <> 0"),
    _COUNT.format(name="knowledge_queue", most=QUEUE, rows="part WHERE p_size % 10 = 0"),
    _COUNT.format(name="knowledge_integrity", most=0, rows=f"(SELECT DISTINCT alert_id % 50 AS e FROM alerts WHERE k % 10 = 3 AND t > {ALERTS_AT - DAY} AND t <= {ALERTS_AT}) WHERE e IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 > 0)"),
    f"SELECT 'rag_budget', s < {LOOKUP_CAP}, round(s, 4), {LOOKUP_CAP}::DOUBLE FROM " + _SPENT.format(**_month, more=" AND pipeline IN ('rag_lookup', 'knowledge_draft')"),
    f"SELECT 'rag_lookup_failures', count(*) < 5, CAST(count(*) AS DOUBLE), 5.0::DOUBLE FROM r WHERE pipeline = 'rag_lookup' AND result IS NULL AND created > {RUNS_AT - HOUR} AND created <= {RUNS_AT}",
]))
def health_report(t):
    """Twelve health checks at one instant, each from one aggregate."""
    c = F.col
    a = M.alerts(t)
    runs = M.runs(t).select(c("created").alias("created_at"), "cost_usd", F.when(c("stopped_by").isNull(), c("verdict")).alias("result"), F.when(c("model_id") == "model-0", "rag_lookup").when(c("model_id") == "model-1", "knowledge_draft").otherwise(c("pipeline")).alias("pipeline"))
    jobs = t.orders.select(S.chosen(c("o_orderstatus"), {"P": "pending"}, "done").alias("status"), M.micros(c("o_orderdate")).alias("scheduled_at"))
    intake = a.filter(c("t") <= ALERTS_AT).select(c("t").alias("received_at"), c("acked").alias("processed_at"), F.when(c("triage_status") == "failed", "failed").alias("error"), c("t").alias("last_seen_at"))
    stored = a.select("alert_id", c("t").alias("received_at"), c("t").alias("closed_at"), "status", "is_synthetic", F.when(c("triage_status") == "failed", "unavailable").otherwise(c("triage_status")).alias("triage_status"))
    events = a.select(F.when(c("k") % 10 == 3, "rag.integrity_failed").otherwise("other").alias("event_type"), (c("alert_id") % 50).cast("string").alias("subject_id"), c("t").alias("created_at"))
    lookups = runs.filter("pipeline = 'rag_lookup'").select("created_at", F.when(c("result").isNull(), "failed").otherwise("done").alias("status"))
    return health.report(
        health.pull_heartbeat(intake, ALERTS_AT),
        health.intake_backlog(intake, ALERTS_AT),
        health.job_backlog(jobs, RUNS_AT),
        health.null_results(runs, RUNS_AT),
        health.triage_unavailable(stored, ALERTS_AT),
        health.monthly_cost(runs, RUNS_AT, CAP),
        health.inventory(t.nation),
        health.digest_unreviewed(stored, a.filter("k % 2 = 0").select("alert_id"), ALERTS_AT),
        health.knowledge_queue(t.part.select(F.when(c("p_size") % 10 == 0, "pending").otherwise("kept").alias("status")), QUEUE),
        health.knowledge_integrity(events, t.nation.select(c("n_nationkey").alias("entry_id"), F.when(c("n_nationkey") % 3 > 0, "active").otherwise("retired").alias("status")), ALERTS_AT),
        health.retrieval_budget(runs, RUNS_AT, LOOKUP_CAP),
        health.lookup_failures(lookups, RUNS_AT),
    )


# --- routes -----------------------------------------------------------------------------------------

CATEGORIES = {0: "unknown", 1: "unknown", 2: "unknown", 3: "unknown", 4: "malware", 5: "recon", 6: "execution", 7: "brute_force"}
TABLED = ("malware", "recon", "execution", "brute_force")
ROUTES = {"as it is": {}, "new category": {"click": "interface", "view": "interface"}, "known category": {"click": "recon"}, "left out": {"click": None, "view": None}}
_TABLED = ", ".join(f"'{x}'" for x in TABLED)
CLUSTERS = "clusters AS (SELECT rule_id AS family, severity, CASE WHEN k % 9 < 4 THEN 'unknown' WHEN k % 9 = 4 THEN 'malware' WHEN k % 9 = 5 THEN 'recon' WHEN k % 9 = 6 THEN 'execution' WHEN k % 9 = 7 THEN 'brute_force' END AS category FROM alerts)"


def _routed(route: str, mapping: dict) -> str:
    arms = "".join(f" WHEN category = 'unknown' AND family = '{f}' THEN {'NULL' if to is None else repr(to)}" for f, to in mapping.items())
    return f"SELECT '{route}' AS route, CASE{arms} WHEN true THEN category END AS category, severity FROM clusters"


GRID = with_(ALERTS, CLUSTERS, "routed AS (" + " UNION ALL ".join(_routed(*r) for r in ROUTES.items()) + ")", "grid AS (SELECT route, category, severity, count(*) AS clusters FROM routed WHERE category IS NOT NULL GROUP BY ALL)")


def clusters_of(t):
    a = M.alerts(t)
    return a.select(F.col("rule_id").alias("family"), "severity", S.chosen(F.col("k") % 9, CATEGORIES).alias("category"))


@query(GRID + "SELECT * FROM grid")
def route_grid(t):
    """Clusters by route, category and severity."""
    return routes.grid(clusters_of(t), ROUTES)


@query(GRID + f"""SELECT route, CAST(sum(clusters) AS BIGINT) AS clusters, CAST(coalesce(sum(clusters) FILTER (WHERE category = 'unknown'), 0) AS BIGINT) AS unknown, CAST(coalesce(sum(clusters) FILTER (WHERE category <> 'unknown'), 0) AS BIGINT) AS expressible,
  CAST(coalesce(sum(clusters) FILTER (WHERE severity IN ('critical', 'high')), 0) AS BIGINT) AS severe, CAST(coalesce(sum(clusters) FILTER (WHERE severity IN ('critical', 'high') AND category <> 'unknown'), 0) AS BIGINT) AS severe_expressible,
  count(*) AS cells, count(*) FILTER (WHERE clusters >= {routes.LARGE_CELL}) AS large_cells, coalesce(string_agg(DISTINCT category, ',' ORDER BY category) FILTER (WHERE category NOT IN ({_TABLED}, 'unknown')), '') AS new_categories,
  round(100.0::DOUBLE * coalesce(sum(clusters) FILTER (WHERE category = 'unknown'), 0) / sum(clusters), 1) AS unknown_share, CAST(round_even({routes.PROPORTIONAL}::DOUBLE * coalesce(sum(clusters) FILTER (WHERE category = 'unknown'), 0) / sum(clusters), 0) AS BIGINT) AS proportional_unknown FROM grid GROUP BY route""")
def route_summary(t):
    """What each route of unknown clusters would change."""
    return routes.summary(clusters_of(t), ROUTES, TABLED)


# --- prompts ----------------------------------------------------------------------------------------

_NONCE = "substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16)"
_LINE = "CAST(5 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS INTEGER)"


@query(f"""SELECT doc_id, kind, {_LINE} AS line, token, CAST(count AS INTEGER) AS count FROM documents JOIN (VALUES (1, 'free_text', 'hello', 2), (2, 'unbalanced_block', NULL, NULL), (2, 'free_text', '<untrusted_data', 2), (3, 'free_text', '</untrusted_data', 2)) v(case_, kind, token, count) ON doc_id % 4 = case_""")
def prompts_linted(t):
    """Prompts that hold each whole document as a block: what else stands in them, by line."""
    c = F.col
    nonce = F.substring(F.sha2(c("doc_id").cast("string"), 256), 1, 16)
    tail = F.element_at(F.array(F.lit("high 2024-01-01T00:00:00Z, (T1110.001) = sbf-1"), F.lit("hello there: high [12]"), F.concat(F.lit('<untrusted_data nonce="'), nonce, F.lit('">')), F.lit('</untrusted_data nonce="00">')), (c("doc_id") % 4 + 1).cast("int"))
    text = F.concat(F.lit('Alert data\n<untrusted_data nonce="'), nonce, F.lit('" source="log">\n'), F.coalesce("text", F.lit("")), F.lit('\n</untrusted_data nonce="'), nonce, F.lit('">\n'), tail)
    return t.documents.select("doc_id", F.inline(prompts.lint(text, nonce, ("Alert data",), ("high",)))).select("doc_id", "kind", "line", "token", "count")


# --- drafts -----------------------------------------------------------------------------------------

DRAFT_FAULTS = ["", "v1_schema:title", "v1_tags:unknown_tag", "v2_closed:conclusion", "v3_hostname:summary", "v4_structure:summary", "v5_count:check_next_time", ""]
_DRAFT_CASE = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(DRAFT_FAULTS)) + " END"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 8 = 6 THEN concat_ws(',', long, fault) ELSE concat_ws(',', fault, long) END AS faults
  FROM (SELECT doc_id, nullif({_DRAFT_CASE}, '') AS fault, CASE WHEN n_chars % 150 > 100 THEN 'v5_length:confidence_note' END AS long FROM documents)""")
def drafts_checked(t):
    """Drafts about all documents, with a fault in most of them."""
    c, case = F.col, F.col("doc_id") % 8
    lit = lambda *x: F.array(*map(F.lit, x))
    draft = F.struct(
        F.when(case != 1, "A title").alias("title"), F.when(case == 3, "threat").otherwise("benign").alias("conclusion"), c("lang").alias("category"), lit("T1110").alias("mitre_ids"), F.lit(None).cast("string").alias("soar_scenario"), lit("5760").alias("rule_ids"), c("source").alias("log_source"),
        F.when(case == 2, lit("backup", "zzz")).otherwise(lit("backup")).alias("tags"), F.when(case == 4, "It ran on WEB-01 alone").when(case == 5, "It ran\n level : high").otherwise("It ran").alias("summary"),
        lit("Same hour").alias("distinguishing_signals"), F.when(case == 6, F.array_repeat(F.lit("Ask"), 7)).otherwise(lit("Ask")).alias("check_next_time"), F.repeat(F.lit("x "), (c("n_chars") % 150).cast("int")).alias("confidence_note"),
    )
    source = F.struct(F.lit("benign").alias("conclusion"), c("lang").alias("category"), lit("T1110").alias("mitre_ids"), F.lit(None).cast("string").alias("soar_scenario"), lit("5760").alias("rule_ids"), c("source").alias("log_source"), lit("web-01").alias("hostnames"), lit("an.ho").alias("usernames"))
    checked = drafts.with_faults(t.documents.select("doc_id", "lang", "source", "n_chars"), F.to_json(draft, {"ignoreNullFields": "false"}), source, ("backup",))
    return checked.select("doc_id", F.array_join("faults", ",").alias("faults"))
