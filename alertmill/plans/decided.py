"""Queries of suggestions and decisions, filters of lists, audit reports and paired measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertmill import params as P
from alertmill.functions import scalar as S
from alertmill.operators import decisions as D
from alertmill.operators import filters, keyed, prefix
from alertmill.plans import model as M
from alertmill.plans.model import ALERTS, CASES, DIMENSIONS, PREDICTIONS, RUNS, Tables, with_
from alertmill.plans.registry import query

EVENTS = ("tier1.decided", "alert.acknowledged", "autoclose.reviewed", "case.opened", "label.created", "tier1.escalated", "tier1.reopened")


def audit(t: Tables) -> DataFrame:
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + n).alias("audit_id"), S.chosen((F.col("l_orderkey") + n) % 7, dict(enumerate(EVENTS))).alias("event_type"), part.alias("subject_id"), (F.col("l_suppkey") % 10).alias("actor_id"),
        S.chosen(F.col("l_suppkey") % 3, {0: "analyst", 1: "admin"}, "system").alias("actor_role"), S.chosen(part % 3, {0: "escalated", 1: "false_positive"}, "true_positive").alias("decision"), (part % 4 == 0).alias("undo"), M.micros(F.col("l_shipdate")).alias("created"),
    )


AUDIT = f"""audit AS (SELECT l_orderkey * 10 + l_linenumber AS audit_id, CASE (l_orderkey + l_linenumber) % 7 {' '.join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(EVENTS))} END AS event_type, l_partkey AS subject_id, l_suppkey % 10 AS actor_id,
  CASE l_suppkey % 3 WHEN 0 THEN 'analyst' WHEN 1 THEN 'admin' ELSE 'system' END AS actor_role, CASE l_partkey % 3 WHEN 0 THEN 'escalated' WHEN 1 THEN 'false_positive' ELSE 'true_positive' END AS decision, l_partkey % 4 = 0 AS undo, epoch_us(l_shipdate) AS created FROM lineitem)"""


def jobs(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(k.alias("job_id"), F.when(k % 2 == 0, "pull").otherwise("triage").alias("job_type"), S.chosen(F.col("o_orderstatus"), {"F": "succeeded", "O": "failed"}, "processing").alias("status"), M.micros(F.col("o_orderdate")).alias("scheduled"), (k % 4).alias("attempts"), F.when(k % 5 == 0, "timeout").alias("last_error"))


JOBS = """jobs AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'pull' ELSE 'triage' END AS job_type, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'processing' END AS status,
  epoch_us(o_orderdate) AS scheduled, o_orderkey % 4 AS attempts, CASE WHEN o_orderkey % 5 = 0 THEN 'timeout' END AS last_error FROM orders)"""

# --- suggestions ---------------------------------------------------------------------------------


def suggestions(t: Tables) -> DataFrame:
    k = F.col("l_partkey")
    flagged = F.filter(F.array(F.when(k % 2 == 0, "step2"), F.when(k % 3 == 0, "step3"), F.when(k % 5 == 0, "step6")), lambda x: x.isNotNull())
    missing = F.when(k % 7 == 0, F.array(F.lit("severity"), F.lit("other"), F.lit("playbook_rule")))
    return t.lineitem.select(
        k.alias("k"), flagged.alias("flagged"), missing.alias("missing"), F.when(k % 10 == 0, "invalid").alias("verifier"), S.chosen(k % 4, {0: "true_positive", 1: "false_positive", 2: "needs_review"}).alias("stored"),
        S.chosen(k % 3, {0: "true_positive", 1: "escalate"}, "false_positive").alias("proposed"), F.when(k % 11 != 0, k % 101).alias("percent"), S.chosen(k % 3, {0: "incident", 1: "benign"}).alias("side"),
    )


FLAGS = "array_to_string(list_filter([CASE WHEN k % 2 = 0 THEN 'facts_mismatch' END, CASE WHEN k % 3 = 0 THEN 'no_verified_quote' END, CASE WHEN k % 7 = 0 THEN 'fp_policy:severity' END, CASE WHEN k % 7 = 0 AND NOT {ruled} THEN 'fp_policy:playbook_rule' END, CASE WHEN k % 10 = 0 THEN 'verifier_invalid' WHEN k % 5 = 0 AND NOT {ruled} THEN 'verifier_disagrees' END], lambda x: x IS NOT NULL), ',')"
RULED = "(CASE WHEN k % 11 <> 0 AND (k % 3 = 0 OR (k % 3 = 1 AND k % 101 >= 80)) THEN true ELSE false END)"
SUGGESTED = "(SELECT l_partkey AS k FROM lineitem)"


@query(f"SELECT held, count(*) AS n FROM (SELECT {FLAGS.format(ruled='false')} AS held FROM {SUGGESTED}) GROUP BY held")
def held_reasons(t):
    held = D.held_reasons(F.col("flagged"), F.col("missing"), F.col("verifier"))
    return suggestions(t).groupBy(F.array_join(held, ",").alias("held")).agg(F.count("*").alias("n"))


@query(f"SELECT held, count(*) AS n FROM (SELECT {FLAGS.format(ruled=RULED)} AS held FROM {SUGGESTED}) GROUP BY held")
def served_reasons(t):
    x = suggestions(t).withColumn("rule", D.knowledge_verdict(F.col("percent"), F.col("side"), 80))
    held = D.served_reasons(D.held_reasons(F.col("flagged"), F.col("missing"), F.col("verifier")), F.col("rule").isNotNull())
    return x.groupBy(F.array_join(held, ",").alias("held")).agg(F.count("*").alias("n"))


@query(f"SELECT served, count(*) AS n FROM (SELECT CASE k % 4 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'false_positive' WHEN 2 THEN CASE k % 3 WHEN 0 THEN 'true_positive' WHEN 2 THEN 'false_positive' END END AS served FROM {SUGGESTED}) GROUP BY served")
def served_action(t):
    return suggestions(t).groupBy(D.served_action(F.col("stored"), F.col("proposed")).alias("served")).agg(F.count("*").alias("n"))


@query(f"SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN k % 11 = 0 THEN NULL WHEN k % 3 = 0 THEN CASE WHEN k % 101 >= 80 THEN 'true_positive' ELSE 'false_positive' END WHEN k % 3 = 1 AND k % 101 >= 80 THEN 'false_positive' END AS verdict FROM {SUGGESTED}) GROUP BY verdict")
def knowledge_rule(t):
    return suggestions(t).groupBy(D.knowledge_verdict(F.col("percent"), F.col("side"), 80).alias("verdict")).agg(F.count("*").alias("n"))


@query(with_(ALERTS) + """SELECT gaps, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN severity = 'critical' THEN 'severity' END, CASE WHEN k % 9 IN (0, 4) THEN 'ioc_reputation' END, CASE WHEN k % 4 IN (0, 3) THEN 'asset_criticality' END,
  CASE WHEN k % 6 = 0 THEN 'identity_privileged' END, CASE WHEN k % 5 = 0 THEN 'playbook_rule' END], lambda x: x IS NOT NULL), ',') AS gaps FROM alerts WHERE status = 'closed' OR status = 'queued') GROUP BY gaps""")
def policy_gaps(t):
    k = F.col("k")
    gaps = D.policy_gaps(F.lit("false_positive"), F.col("severity"), S.chosen(k % 9, {0: "Malicious", 4: "suspicious"}, "clean"), S.chosen(k % 4, {0: "HIGH", 1: "medium", 2: "low"}, "unknown"), k % 6 == 0, k % 5 != 0)
    return M.alerts(t).filter("status in ('closed', 'queued')").groupBy(F.array_join(gaps, ",").alias("gaps")).agg(F.count("*").alias("n"))


@query(with_(ALERTS) + """SELECT wrong, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN k % 5 = 0 THEN 'severity' END, CASE WHEN k % 7 = 0 THEN 'occurrence_count' END], lambda x: x IS NOT NULL), ',') AS wrong FROM alerts) GROUP BY wrong""")
def basis_mismatches(t):
    a, k = M.alerts(t), F.col("k")
    facts = {"severity": F.col("severity"), "ioc_reputation": F.lit("clean"), "asset_criticality": F.lit(None), "identity_privileged": F.lit(True), "occurrence_count": F.col("occurrence_count")}
    said = facts | {"severity": F.when(k % 5 == 0, "odd").otherwise(F.upper("severity")), "asset_criticality": F.lit("None"), "identity_privileged": F.lit("TRUE"), "occurrence_count": F.col("occurrence_count") + F.when(k % 7 == 0, 1).otherwise(0)}
    return a.groupBy(F.array_join(D.basis_mismatches(said, facts), ",").alias("wrong")).agg(F.count("*").alias("n"))


@query(with_(ALERTS) + "SELECT status, count(*) AS n FROM (SELECT CASE WHEN k % 3 = 0 AND acked < 1705000000000000 - 120000000 THEN 'pending' WHEN k % 3 = 0 THEN 'processing' ELSE 'done' END AS status FROM alerts) GROUP BY status")
def stale_locks(t):
    a = M.alerts(t).withColumn("s", F.when(F.col("k") % 3 == 0, "processing").otherwise("done"))
    return a.groupBy(D.effective_status(F.col("s"), F.lit("pending"), F.col("acked"), 1705000000000000).alias("status")).agg(F.count("*").alias("n"))


@query(with_(ALERTS) + "SELECT count(*) FILTER (WHERE occurrence_count - k % 250 > 20) AS stale, count(*) AS n FROM alerts")
def stale_decisions(t):
    return M.alerts(t).agg(F.count_if(D.is_stale(F.col("occurrence_count"), F.col("k") % 250)).alias("stale"), F.count("*").alias("n"))


@query(with_(ALERTS) + "SELECT a.alert_id, count(b.alert_id) AS known FROM alerts a LEFT JOIN alerts b ON a.agent_name = b.agent_name AND a.rule_id = b.rule_id AND b.t < a.t AND b.decided < a.t GROUP BY a.alert_id")
def as_of_known(t):
    """Decisions on the same rule and host that were there when an alert came in."""
    a = M.alerts(t).select("alert_id", "agent_name", "rule_id", "t", "decided")
    made = a.filter("decided is not null").select("agent_name", "rule_id", F.col("decided").alias("t"))  # never before its alert
    known = prefix.running(made, a.select("agent_name", "rule_id", "t", "alert_id"), ["agent_name", "rule_id"], 7 * M.DAY, {"known": F.lit(1).cast("long")}, {})
    return known.select("alert_id", "known")


@query(with_(ALERTS) + "SELECT severity, CASE severity WHEN 'critical' THEN 'escalate' WHEN 'high' THEN 'needs_review' ELSE 'false_positive' END AS verdict, count(*) AS n FROM alerts GROUP BY ALL")
def severity_baseline(t):
    return M.alerts(t).groupBy("severity", S.chosen(F.col("severity"), D.BY_SEVERITY).alias("verdict")).agg(F.count("*").alias("n"))


# --- filters and pages ---------------------------------------------------------------------------


def indicators(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(k.alias("id"), F.col("p_name").alias("value"), F.col("p_brand").alias("malware"), F.concat(F.lit("t_"), (k % 7).cast("string")).alias("threat"), F.array(F.concat(F.lit("a%"), (k % 5).cast("string")), F.lit("x")).alias("tags"), S.chosen(k % 3, {0: "feed0", 1: "feed1"}, "feed2").alias("source"), F.when(k % 2 == 0, "domain").otherwise("ip").alias("type"), (k % 101).cast("int").alias("confidence"), (F.lit(M.NOW) - k * M.HOUR).alias("first_seen"), (F.lit(M.NOW) + (k % 9 - 2) * M.DAY).alias("expires"))


INTEL = """intel AS (SELECT p_partkey AS id, p_name AS value, p_brand AS malware, 't_' || (p_partkey % 7) AS threat, ['a%' || (p_partkey % 5), 'x'] AS tags, 'feed' || (p_partkey % 3) AS source, CASE WHEN p_partkey % 2 = 0 THEN 'domain' ELSE 'ip' END AS type,
  CAST(p_partkey % 101 AS INTEGER) AS confidence, 1706659200000000 - p_partkey * 3600000000 AS first_seen, 1706659200000000 + (p_partkey % 9 - 2) * 86400000000 AS expires FROM part)"""


@query(with_(INTEL) + "SELECT id FROM intel WHERE expires > 1706659200000000 AND source = 'feed1' AND type = 'domain' AND first_seen >= 1706659200000000 - 1500 * 3600000000 AND first_seen < 1706659200000000 - 10 * 3600000000 AND confidence >= 30")
def intel_filtered(t):
    return indicators(t).filter(filters.intel_filter(M.NOW, source="feed1", kind=" Domain ", seen_from=M.NOW - 1500 * M.HOUR, seen_before=M.NOW - 10 * M.HOUR, confidence=30)).select("id")


@query(with_(INTEL) + r"SELECT id FROM intel WHERE value ILIKE '%A\%3%' ESCAPE '\' OR malware ILIKE '%A\%3%' ESCAPE '\' OR threat ILIKE '%A\%3%' ESCAPE '\' OR list_bool_or(list_transform(tags, lambda g: g ILIKE '%A\%3%' ESCAPE '\'))")
def intel_text(t):
    return indicators(t).filter(filters.intel_filter(M.NOW, text="A%3", with_expired=True)).select("id")


@query("SELECT 'number' AS how, o_orderkey AS ticket FROM orders WHERE o_orderkey = 65 UNION ALL SELECT 'text', o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority ILIKE '%urgent%'")
def tickets(t):
    o = t.orders.withColumns({"ticket": F.col("o_orderkey"), "status": F.col("o_orderstatus")})
    by_number = o.filter(filters.review_filter(" # 65", ["o_orderpriority"], "ticket")).select(F.lit("number").alias("how"), "ticket")
    return by_number.unionByName(o.filter(filters.review_filter("Urgent", ["o_orderpriority"], "ticket", ["F", "P"])).select(F.lit("text").alias("how"), "ticket"))


@query(with_(AUDIT, ALERTS) + "SELECT event_type, actor_role, count(*) AS n FROM audit WHERE created >= 788918400000000 AND created < 852076800000000 AND event_type LIKE 'tier1.%' AND actor_role IN ('analyst', 'admin') AND subject_id NOT IN (SELECT alert_id FROM alerts WHERE NOT visible AND status = 'queued') GROUP BY ALL")
def audit_filtered(t):
    hidden = M.alerts(t).filter("not visible and status = 'queued'").select(F.col("alert_id").alias("subject_id"))
    kept = audit(t).filter(filters.audit_filter(788918400000000, 852076800000000, ["tier1"], ["analyst", "admin"])).join(hidden, "subject_id", "left_anti")
    return kept.groupBy("event_type", "actor_role").agg(F.count("*").alias("n"))


@query(with_(ALERTS) + "SELECT alert_id FROM alerts WHERE status = 'queued' ORDER BY occurrence_count DESC, alert_id LIMIT 200 OFFSET 400")
def offset_page(t):
    return filters.page(M.alerts(t).filter("status = 'queued'"), [F.desc("occurrence_count"), F.col("alert_id")], 3, 500).select("alert_id")


@query(with_(CASES) + "SELECT case_id, (SELECT count(*) > 200 FROM cases WHERE priority = 1) AS truncated FROM cases WHERE priority = 1 ORDER BY created DESC, case_id LIMIT 200")
def truncated_page(t):
    return filters.cut_page(M.cases(t).filter("priority = 1"), [F.desc("created"), F.col("case_id")], 200).select("case_id", "truncated")


@query("SELECT count(*) FILTER (WHERE c_custkey % 4 < 2) AS critical, count(*) AS n FROM customer")
def critical_hosts(t):
    host = S.chosen(F.col("c_custkey") % 4, {0: "​ＤＣ-01.home.arpa.", 1: "dc-01", 2: "dc-012"}, "x.dc-01")
    return t.customer.agg(F.count_if(filters.is_critical_host(host, ["DC-01"])).alias("critical"), F.count("*").alias("n"))


@query(with_(ALERTS) + "SELECT alert_id, epoch_us(CASE WHEN (make_timestamp(t) + INTERVAL 7 HOUR)::TIME < TIME '08:00' THEN date_trunc('day', make_timestamp(t) + INTERVAL 7 HOUR) ELSE date_trunc('day', make_timestamp(t) + INTERVAL 7 HOUR) + INTERVAL 1 DAY END + INTERVAL 1 HOUR) AS next FROM alerts")
def next_mornings(t):
    return M.alerts(t).select("alert_id", filters.next_morning(F.col("t"), 7).alias("next"))


@query(with_(ALERTS) + "SELECT count(*) AS n FROM alerts WHERE make_timestamp(t) >= TIMESTAMP '2024-01-09 17:00:00' AND make_timestamp(t) < TIMESTAMP '2024-01-10 17:00:00'")
def local_day_bounds(t):
    begin, end = filters.day_bounds("2024-01-10", 7)
    return M.alerts(t).filter((F.col("t") >= F.unix_micros(begin)) & (F.col("t") < F.unix_micros(end))).agg(F.count("*").alias("n"))


@query("SELECT p_brand AS entry, min(p_partkey) AS place FROM part GROUP BY p_brand")
def blocklist_order(t):
    return filters.distinct_in_order(t.part.select(F.col("p_brand").alias("entry"), F.col("p_partkey").alias("place")), "entry", "place")


# --- reports -------------------------------------------------------------------------------------


@query(with_(ALERTS) + "SELECT count(*) AS alerts, count(*) FILTER (WHERE k % 3 > 0) AS heads, count(*) FILTER (WHERE k % 3 = 0) AS duplicates, max(occurrence_count) FILTER (WHERE k % 3 > 0) AS most FROM alerts")
def report_heads(t):
    head = F.col("k") % 3 > 0
    return M.alerts(t).agg(F.count("*").alias("alerts"), F.count_if(head).alias("heads"), F.count_if(~head).alias("duplicates"), F.max(F.when(head, F.col("occurrence_count"))).alias("most"))


@query(with_(JOBS) + "SELECT status, count(*) AS n FROM jobs WHERE job_type = 'pull' GROUP BY status")
def report_pull_jobs(t):
    return jobs(t).filter("job_type = 'pull'").groupBy("status").agg(F.count("*").alias("n"))


@query(with_(JOBS) + "SELECT job_type, last_error IS NULL AS is_well FROM (SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY scheduled DESC, job_id DESC) AS r FROM jobs) WHERE r = 1")
def report_cursor(t):
    return jobs(t).groupBy("job_type").agg(F.max_by(F.col("last_error").isNull(), F.struct("scheduled", "job_id")).alias("is_well"))


@query(with_(JOBS) + "SELECT count(*) FILTER (WHERE status = 'failed' AND attempts >= 3) AS exhausted, count(*) FILTER (WHERE status = 'failed') AS failed FROM jobs")
def report_exhausted(t):
    failed = F.col("status") == "failed"
    return jobs(t).agg(F.count_if(failed & (F.col("attempts") >= 3)).alias("exhausted"), F.count_if(failed).alias("failed"))


@query(with_(RUNS) + "SELECT step, count(*) AS n FROM (SELECT CASE WHEN forced THEN 'invalid' WHEN verdict IS NULL THEN 'skipped' ELSE 'agrees' END AS step FROM runs WHERE role = 'verifier') GROUP BY step")
def report_verifier_step(t):
    step = F.when(F.col("forced"), "invalid").when(F.col("verdict").isNull(), "skipped").otherwise("agrees")
    return M.runs(t).filter("role = 'verifier'").groupBy(step.alias("step")).agg(F.count("*").alias("n"))


@query(with_(RUNS) + "SELECT strftime(make_timestamp(created), '%Y-%m-%d') AS day, pipeline, count(*) AS n, CAST(sum(cost_usd) AS DOUBLE) AS cost, sum(sum(cost_usd)) OVER (PARTITION BY pipeline ORDER BY strftime(make_timestamp(created), '%Y-%m-%d'))::DOUBLE AS so_far FROM runs GROUP BY 1, 2")
def report_daily_cost(t):
    day = M.runs(t).groupBy(F.date_format(F.timestamp_micros("created"), "yyyy-MM-dd").alias("day"), "pipeline").agg(F.count("*").alias("n"), F.sum("cost_usd").alias("c"))
    so_far = F.sum("c").over(Window.partitionBy("pipeline").orderBy("day"))
    return day.select("day", "pipeline", "n", F.col("c").cast("double").alias("cost"), so_far.cast("double").alias("so_far"))


@query(with_(ALERTS) + "SELECT status, severity, count(*) AS n, count(*) FILTER (WHERE acked IS NOT NULL) AS acked FROM alerts WHERE NOT is_synthetic GROUP BY CUBE (status, severity)")
def report_queue_cube(t):
    return M.alerts(t).filter("not is_synthetic").cube("status", "severity").agg(F.count("*").alias("n"), F.count("acked").alias("acked"))


@query(with_(AUDIT) + "SELECT " + ", ".join(f"count(*) FILTER (WHERE event_type = '{e}') AS {e.replace('.', '_')}" for e in EVENTS[:4]) + " FROM audit")
def report_human_events(t):
    return audit(t).filter(F.col("event_type").isin(*EVENTS[:4])).agg(*(F.count_if(F.col("event_type") == e).alias(e.replace(".", "_")) for e in EVENTS[:4]))


@query(with_(AUDIT, ALERTS) + "SELECT count(*) AS n FROM audit JOIN alerts ON alert_id = subject_id AND NOT is_synthetic WHERE event_type = 'autoclose.reviewed'")
def report_reviews(t):
    real = M.alerts(t).filter("not is_synthetic").select(F.col("alert_id").alias("subject_id"))
    return audit(t).filter("event_type = 'autoclose.reviewed'").join(real, "subject_id").agg(F.count("*").alias("n"))


@query(with_(AUDIT) + "SELECT count(*) AS label_created, count(*) FILTER (WHERE undo) AS undone FROM audit WHERE event_type = 'label.created'")
def report_label_events(t):
    return audit(t).filter("event_type = 'label.created'").agg(F.count("*").alias("label_created"), F.count_if("undo").alias("undone"))


@query(with_(AUDIT, ALERTS) + "SELECT source, count(*) AS n FROM audit JOIN alerts ON alert_id = subject_id AND NOT is_synthetic WHERE event_type = 'label.created' GROUP BY source")
def report_labels_by_source(t):
    a = M.alerts(t).filter("not is_synthetic").select(F.col("alert_id").alias("subject_id"), "source")
    return audit(t).filter("event_type = 'label.created'").join(a, "subject_id").groupBy("source").agg(F.count("*").alias("n"))


def pilot(t: Tables) -> DataFrame:
    """Decisions on real alerts that were not opened again, with the arm and the verdict that the model had given."""
    a = M.alerts(t).filter("not is_synthetic").select(F.col("alert_id").alias("subject_id"), "source", F.when(F.col("visible"), "visible").otherwise("blind").alias("arm"), "acked", F.when(F.col("k") % 6 == 0, "no_result").when(F.col("k") % 6 == 1, "needs_review").when(F.col("k") % 2 == 0, "escalate").otherwise("false_positive").alias("verdict"))
    e = audit(t)
    again = e.filter("event_type = 'tier1.reopened'").select("subject_id")
    return e.filter("event_type = 'tier1.decided'").join(a, "subject_id").join(again, "subject_id", "left_anti")


PILOT = """pilot AS (SELECT e.*, a.source, CASE WHEN visible THEN 'visible' ELSE 'blind' END AS arm, acked, CASE WHEN k % 6 = 0 THEN 'no_result' WHEN k % 6 = 1 THEN 'needs_review' WHEN k % 2 = 0 THEN 'escalate' ELSE 'false_positive' END AS verdict
  FROM audit e JOIN alerts a ON alert_id = subject_id AND NOT is_synthetic WHERE event_type = 'tier1.decided' AND subject_id NOT IN (SELECT subject_id FROM audit WHERE event_type = 'tier1.reopened'))"""


@query(with_(AUDIT, ALERTS, PILOT) + "SELECT coalesce(source, 'all') AS source, count(*) AS decisions, count(*) FILTER (WHERE verdict = 'needs_review') AS needs_review, count(*) FILTER (WHERE verdict = 'no_result') AS no_result, count(*) FILTER (WHERE verdict IN ('escalate', 'false_positive')) AS denominator, count(*) FILTER (WHERE (verdict = 'escalate' AND decision = 'escalated') OR (verdict = 'false_positive' AND decision = 'false_positive')) AS agreed FROM pilot WHERE arm = 'blind' GROUP BY ROLLUP (source) HAVING count(*) > 0")
def pilot_agreement(t):
    v, d = F.col("verdict"), F.col("decision")
    agreed = ((v == "escalate") & (d == "escalated")) | ((v == "false_positive") & (d == "false_positive"))
    aggregates = [F.count("*").alias("decisions"), F.count_if(v == "needs_review").alias("needs_review"), F.count_if(v == "no_result").alias("no_result"), F.count_if(v.isin("escalate", "false_positive")).alias("denominator"), F.count_if(agreed).alias("agreed")]
    return keyed.rollup_all(pilot(t).filter("arm = 'blind'"), [], "source", aggregates, "all").filter("decisions > 0")


@query(with_(AUDIT, ALERTS, PILOT) + "SELECT actor_id, arm, coalesce(source, 'all') AS source, count(*) AS decisions, count(*) FILTER (WHERE decision = 'escalated') AS escalated FROM pilot GROUP BY actor_id, arm, ROLLUP (source)")
def pilot_persons(t):
    return keyed.rollup_all(pilot(t), ["actor_id", "arm"], "source", [F.count("*").alias("decisions"), F.count_if(F.col("decision") == "escalated").alias("escalated")], "all")


@query(with_(AUDIT, ALERTS) + "SELECT arm, coalesce(source, 'all') AS source, count(*) AS swept FROM (SELECT CASE WHEN visible THEN 'visible' ELSE 'blind' END AS arm, source FROM audit e JOIN alerts ON alert_id = subject_id AND NOT is_synthetic WHERE event_type = 'case.opened' AND subject_id NOT IN (SELECT subject_id FROM audit WHERE event_type = 'tier1.escalated')) GROUP BY arm, ROLLUP (source)")
def pilot_swept(t):
    e = audit(t)
    a = M.alerts(t).filter("not is_synthetic").select(F.col("alert_id").alias("subject_id"), "source", F.when(F.col("visible"), "visible").otherwise("blind").alias("arm"))
    swept = e.filter("event_type = 'case.opened'").join(e.filter("event_type = 'tier1.escalated'").select("subject_id"), "subject_id", "left_anti").join(a, "subject_id")
    return keyed.rollup_all(swept, ["arm"], "source", [F.count("*").alias("swept")], "all")


@query(with_(AUDIT, ALERTS) + "SELECT arm, coalesce(source, 'all') AS source, count(*) AS reopened FROM (SELECT CASE WHEN visible THEN 'visible' ELSE 'blind' END AS arm, source FROM (SELECT DISTINCT subject_id FROM audit WHERE event_type = 'tier1.reopened') JOIN alerts ON alert_id = subject_id AND NOT is_synthetic) GROUP BY arm, ROLLUP (source)")
def pilot_reopened(t):
    a = M.alerts(t).filter("not is_synthetic").select(F.col("alert_id").alias("subject_id"), "source", F.when(F.col("visible"), "visible").otherwise("blind").alias("arm"))
    again = a.join(audit(t).filter("event_type = 'tier1.reopened'").select("subject_id"), "subject_id", "left_semi")
    return keyed.rollup_all(again, ["arm"], "source", [F.count("*").alias("reopened")], "all")


@query(with_(ALERTS) + "SELECT k % 500 AS head, count(*) AS n, min(t) AS first_seen, max(t) AS last_seen FROM alerts WHERE k % 3 = 0 GROUP BY 1")
def duplicate_spans(t):
    return M.alerts(t).filter("k % 3 = 0").groupBy((F.col("k") % 500).alias("head")).agg(F.count("*").alias("n"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))


@query(with_(ALERTS) + "SELECT agent_name, rule_id FROM (SELECT agent_name, rule_id, row_number() OVER (PARTITION BY agent_name ORDER BY count(*) DESC, min(alert_id)) AS r FROM alerts GROUP BY agent_name, rule_id) WHERE r = 1")
def most_common_rule(t):
    return D.most_common(M.alerts(t), ["agent_name"], "rule_id", "alert_id")


@query(with_(CASES, ALERTS) + "SELECT truth, count(*) AS n FROM (SELECT k % 400 AS case_id, CASE WHEN bool_or(k % 11 = 0) THEN 'TP' WHEN bool_or(k % 11 = 1) THEN NULL ELSE 'FP' END AS truth FROM alerts GROUP BY 1) GROUP BY truth")
def case_truths(t):
    a = M.alerts(t).select((F.col("k") % 400).alias("case_id"), F.when(F.col("k") % 11 == 0, "TP").when(F.col("k") % 11 > 1, "FP").alias("label"))
    return D.case_truth(a, "case_id", "label").groupBy("truth").agg(F.count("*").alias("n"))


@query(with_(PREDICTIONS) + "SELECT lang, count(*) AS n, count(*) FILTER (WHERE verdict = truth) AS on_right, count(*) FILTER (WHERE second = truth) AS off_right FROM predictions WHERE verdict IS NOT NULL GROUP BY lang")
def paired_runs(t):
    p = M.predictions(t)
    both = D.paired(p.select("doc_id", F.col("verdict").alias("v")), p.select("doc_id", F.col("second").alias("v")), "doc_id", "v").join(p.select("doc_id", "lang", "truth"), "doc_id")
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("on") == F.col("truth")).alias("on_right"), F.count_if(F.col("off") == F.col("truth")).alias("off_right"))


@query(with_(ALERTS) + "SELECT rule_id, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in P.SEVERITIES) + ", count(*) * 1.0 / (SELECT count(*) FROM alerts) AS share FROM alerts GROUP BY rule_id")
def coverage_grid(t):
    a = M.alerts(t)
    total = a.agg(F.count("*").alias("total"))  # one row
    grid = a.groupBy("rule_id").pivot("severity", list(P.SEVERITIES)).agg(F.count(F.lit(1))).na.fill(0)
    n = a.groupBy("rule_id").agg(F.count("*").alias("n"))
    return grid.join(n, "rule_id").crossJoin(F.broadcast(total)).select("rule_id", *P.SEVERITIES, (F.col("n").cast("double") / F.col("total")).alias("share"))


@query(with_(PREDICTIONS) + "SELECT source, count(*) AS n, count(*) FILTER (WHERE second = truth) AS same FROM predictions GROUP BY source")
def labeller_vs_truth(t):
    return M.predictions(t).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("second") == F.col("truth")).alias("same"))


@query("SELECT technique, count(*) AS n, via, name FROM (SELECT technique, CASE WHEN e.name IS NOT NULL THEN 'exact' WHEN p.name IS NOT NULL THEN 'parent' END AS via, coalesce(e.name, p.name) AS name FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'T' || (p_partkey % 30) WHEN 1 THEN 'T' || (p_partkey % 30) || '.001' ELSE 'X' END AS technique FROM part) x LEFT JOIN (SELECT 'T' || n_nationkey AS id, n_name AS name FROM nation) e ON e.id = technique LEFT JOIN (SELECT 'T' || n_nationkey AS id, n_name AS name FROM nation) p ON p.id = split_part(technique, '.', 1)) GROUP BY ALL")
def technique_lookup(t):
    k = F.col("p_partkey")
    base = F.concat(F.lit("T"), (k % 30).cast("string"))
    x = t.part.select(F.when(k % 4 == 0, base).when(k % 4 == 1, F.concat(base, F.lit(".001"))).otherwise("X").alias("technique"))
    r = t.nation.select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("id"), "n_name")
    return D.parents_lookup(x, r, "technique", "id", "n_name").groupBy("technique", "via", "name").agg(F.count("*").alias("n"))


@query(with_(RUNS) + "SELECT count(*) AS n FROM runs a JOIN (SELECT DISTINCT role, pipeline FROM runs WHERE forced) b ON a.role IS NOT DISTINCT FROM b.role AND a.pipeline = b.pipeline")
def null_role_join(t):
    r = M.runs(t)
    b = r.filter("forced").select(F.col("role").alias("b_role"), F.col("pipeline").alias("b_pipeline")).distinct()
    return r.join(b, F.col("role").eqNullSafe(F.col("b_role")) & (F.col("pipeline") == F.col("b_pipeline"))).agg(F.count("*").alias("n"))


@query(with_(AUDIT) + "SELECT actor_role, c_name IS NOT NULL AS known, count(*) AS n FROM audit LEFT JOIN customer ON actor_role IN ('analyst', 'admin') AND c_custkey = actor_id GROUP BY ALL")
def guarded_actor_join(t):
    people = t.customer.select(F.col("c_custkey").alias("person"), "c_name")
    key = F.when(F.col("actor_role").isin("analyst", "admin"), F.col("actor_id"))
    return audit(t).withColumn("person", key).join(people, "person", "left").groupBy("actor_role", F.col("c_name").isNotNull().alias("known")).agg(F.count("*").alias("n"))


@query(with_(PREDICTIONS) + "SELECT doc_id, score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.65 THEN 'medium' WHEN score >= 0.5 THEN 'low' END IS NOT NULL AS has_level, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS r FROM predictions WHERE score >= 0.5) WHERE r <= 3")
def kept_matches(t):
    near = M.predictions(t).filter("score >= 0.5")
    kept = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id"))).filter(F.col("place") <= P.KEPT_MATCHES)
    return kept.select("doc_id", "score", S.match_level(F.col("score")).isNotNull().alias("has_level"), F.col("place").cast("long").alias("place"))


@query(with_(ALERTS) + """, each AS (SELECT agent_name, 'srcip' AS kind, 0 AS o, srcip AS value, count(*) AS n FROM alerts WHERE srcip <> '' GROUP BY ALL UNION ALL SELECT agent_name, 'user', 1, alert_user, count(*) FROM alerts WHERE alert_user IS NOT NULL GROUP BY ALL
    UNION ALL SELECT agent_name, 'dstip', 2, dstip, count(*) FROM alerts GROUP BY ALL)
  SELECT agent_name, kind, value, n, place FROM (SELECT *, row_number() OVER (PARTITION BY agent_name ORDER BY o, n DESC, value) AS place FROM each) WHERE place <= 50""")
def ranked_entities(t):
    """The entities of each host's case, by kind and count, to the feature's cap for a case."""
    a = M.alerts(t)
    kinds = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(kind).alias("kind"), F.col(c).alias("value")) for o, (kind, c) in enumerate((("srcip", "srcip"), ("user", "alert_user"), ("dstip", "dstip")))))
    each = a.select("agent_name", F.explode(kinds).alias("e")).select("agent_name", "e.*").filter("value is not null and value <> ''").groupBy("agent_name", "o", "kind", "value").agg(F.count("*").alias("n"))
    first = keyed.top_groups(each.withColumn("place", F.row_number().over(Window.partitionBy("agent_name").orderBy("o", F.desc("n"), "value"))), ["value"], P.ENTITY_CAP, [F.col("place")], ["agent_name"])
    return first.select("agent_name", "kind", "value", "n", F.col("place").cast("long").alias("place"))


@query(with_(ALERTS) + "SELECT alert_id, array_to_string(list_sort(list_distinct(list_filter([CASE k % 4 WHEN 0 THEN 'linux' WHEN 1 THEN 'web' END, CASE k % 3 WHEN 0 THEN 'auth' WHEN 1 THEN 'web' END], lambda x: x IS NOT NULL))), ',') AS tags FROM alerts")
def tags_of_groups(t):
    table = F.create_map(*(F.lit(x) for kv in {"sudo": "linux", "nginx": "web", "sshd": "auth", "apache": "web"}.items() for x in kv))
    groups = F.array(S.chosen(F.col("k") % 4, {0: " SUDO ", 1: "nginx"}, "none"), S.chosen(F.col("k") % 3, {0: "sshd", 1: "Apache"}))
    tags = F.filter(F.transform(groups, lambda g: F.try_element_at(table, F.lower(F.trim(g)))), lambda x: x.isNotNull())
    return M.alerts(t).select("alert_id", F.array_join(F.array_sort(F.array_distinct(tags)), ",").alias("tags"))


@query(with_(RUNS) + "SELECT subject_id, run_id FROM (SELECT subject_id, run_id, row_number() OVER (PARTITION BY subject_id ORDER BY created DESC, run_id DESC) AS r FROM runs WHERE verdict = 'escalate' AND created < 820454400000000) WHERE r = 1")
def newest_lookup(t):
    before = D.as_of(M.runs(t).filter("verdict = 'escalate'"), "created", 820454400000000)
    return before.groupBy("subject_id").agg(F.max_by("run_id", F.struct("created", "run_id")).alias("run_id"))


HISTORY_ROWS = 200


@query(with_(RUNS) + f"""SELECT pool, run_id, least(n, {HISTORY_ROWS}) - back + 1 AS place, n > {HISTORY_ROWS} AS truncated FROM (SELECT subject_id % 20 AS pool, run_id, row_number() OVER (PARTITION BY subject_id % 20 ORDER BY created DESC, run_id DESC) AS back,
  count(*) OVER (PARTITION BY subject_id % 20) AS n FROM runs) WHERE back <= {HISTORY_ROWS}""")
def ticket_history(t):
    """The newest 200 rows of each pool of subjects, the oldest of them first, and whether there are more. Spark cuts each task's
    rows to the limit before the shuffle; the counts are a second, small aggregate."""
    runs = M.runs(t).select((F.col("subject_id") % 20).alias("pool"), "run_id", "created")
    newest = runs.withColumn("back", F.row_number().over(Window.partitionBy("pool").orderBy(F.desc("created"), F.desc("run_id")))).filter(F.col("back") <= HISTORY_ROWS)
    n = runs.groupBy("pool").agg(F.count("*").alias("n"))
    return newest.join(n, "pool").select("pool", "run_id", (F.least(F.col("n"), F.lit(HISTORY_ROWS)) - F.col("back") + 1).alias("place"), (F.col("n") > HISTORY_ROWS).alias("truncated"))


@query(with_(PREDICTIONS) + "SELECT l.lang, count(*) AS n, count(*) FILTER (WHERE p.doc_id IS NULL) AS no_label FROM (SELECT doc_id, lang FROM documents) l LEFT JOIN predictions p ON p.doc_id = l.doc_id GROUP BY l.lang")
def labels_as_predictions(t):
    p = M.predictions(t).select("doc_id", F.lit(True).alias("has"))
    return t.documents.select("doc_id", "lang").join(p, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("has").isNull()).alias("no_label"))


@query(with_(PREDICTIONS) + "SELECT source, count(*) AS n FROM predictions WHERE source NOT IN ('src0', 'src2') GROUP BY source")
def scenario_exclusion(t):
    out = t.spark.createDataFrame([("src2",), ("src0",), ("src2",)], "source string")
    return M.predictions(t).join(out, "source", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


@query(with_(DIMENSIONS) + "SELECT problem, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN criticality = 'unknown' THEN 'criticality_unknown' END, CASE WHEN NOT active THEN 'inactive' END, CASE WHEN length(owner) > 8 THEN 'owner_long' END], lambda x: x IS NOT NULL)) AS problem FROM assets) GROUP BY problem")
def inventory_problems(t):
    rules = {"criticality_unknown": F.col("criticality") == "unknown", "inactive": ~F.col("active"), "owner_long": F.length("owner") > 8}
    found = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())), lambda x: x.isNotNull())
    return M.assets(t).select(F.explode(found).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query(with_(ALERTS) + "SELECT day, rule_id, alert_id, n FROM (SELECT strftime(make_timestamp(t), '%Y-%m-%d') AS day, rule_id, alert_id, row_number() OVER (PARTITION BY strftime(make_timestamp(t), '%Y-%m-%d'), rule_id ORDER BY t, alert_id) AS r, count(*) OVER (PARTITION BY strftime(make_timestamp(t), '%Y-%m-%d'), rule_id) AS n FROM alerts) WHERE r = 1")
def day_samples(t):
    a = M.alerts(t).withColumn("day", F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd"))
    return a.groupBy("day", "rule_id").agg(F.min(F.struct("t", "alert_id"))["alert_id"].alias("alert_id"), F.count("*").alias("n"))
