"""Queries of measures and gates: arms of a lab, leaks, regression, gold candidates, threat figures, further health checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from alertmill import params as P
from alertmill.functions import scalar as S
from alertmill.operators import evaluate, keyed
from alertmill.plans import model as M
from alertmill.plans.analysis import FOLD, clusters, recursive
from alertmill.plans.decided import AUDIT, INTEL, JOBS, audit, indicators, jobs
from alertmill.plans.model import ALERTS, LAB, PREDICTIONS, RUNS, with_
from alertmill.plans.registry import query

# --- reports -------------------------------------------------------------------------------------


@query(with_(RUNS) + "SELECT role, replace(model_id, 'model-', 'p') AS prompt_version, count(*) AS n FROM runs GROUP BY ALL")
def report_prompt_versions(t):
    return M.runs(t).groupBy("role", F.replace("model_id", F.lit("model-"), F.lit("p")).alias("prompt_version")).agg(F.count("*").alias("n"))


@query(with_(ALERTS) + "SELECT count(*) FILTER (WHERE status = 'auto_closed' AND severity <> 'critical') AS auto_closed, count(*) FILTER (WHERE status = 'auto_closed' AND severity = 'critical') AS blocked FROM alerts")
def report_autoclose_events(t):
    """Auto-close events and those that were blocked, as alerts are critical."""
    a = M.alerts(t).filter("status = 'auto_closed'")
    return a.agg(F.count_if(F.col("severity") != "critical").alias("auto_closed"), F.count_if(F.col("severity") == "critical").alias("blocked"))


# --- evaluation ----------------------------------------------------------------------------------

ARMS = PREDICTIONS + """, arms AS (SELECT *, truth = 'escalate' AS truth_tp, CASE verdict WHEN 'escalate' THEN true WHEN 'benign' THEN false END AS model_tp, score < 0.3 AS held, score > 0.2 AS seen, CASE WHEN score > 0.5 THEN score END AS best_pct FROM predictions)"""


@query(with_(ARMS) + """SELECT lang, count(*) AS n, count(model_tp) AS answered, count(*) FILTER (WHERE model_tp = truth_tp) AS correct,
  count(*) FILTER (WHERE model_tp AND truth_tp) AS hits, count(*) FILTER (WHERE model_tp IS NOT NULL AND truth_tp) AS truth_tp, count(*) FILTER (WHERE model_tp) AS said_tp,
  CAST(count(*) FILTER (WHERE model_tp = truth_tp) AS DOUBLE) / nullif(count(model_tp), 0) AS accuracy, CAST(count(*) FILTER (WHERE model_tp AND truth_tp) AS DOUBLE) / nullif(count(*) FILTER (WHERE model_tp IS NOT NULL AND truth_tp), 0) AS tp_recall,
  CAST(count(*) FILTER (WHERE model_tp AND truth_tp) AS DOUBLE) / nullif(count(*) FILTER (WHERE model_tp), 0) AS tp_precision,
  count(*) FILTER (WHERE held AND model_tp <> truth_tp) AS held_wrong, count(*) FILTER (WHERE held AND model_tp = truth_tp) AS held_right,
  count(*) FILTER (WHERE seen) AS seen, count(*) FILTER (WHERE seen AND best_pct IS NOT NULL) AS with_match, avg(best_pct) FILTER (WHERE seen) AS mean_best_pct FROM arms GROUP BY lang""")
def lab_summary(t):
    p = M.predictions(t)
    said = S.chosen(F.col("verdict"), {"escalate": True, "benign": False})
    rows = p.select("lang", (F.col("truth") == "escalate").alias("truth_tp"), said.alias("model_tp"), (F.col("score") < 0.3).alias("held"), (F.col("score") > 0.2).alias("seen"), F.when(F.col("score") > 0.5, F.col("score")).alias("best_pct"))
    return evaluate.arm_summary(rows, ["lang"])


LEAKS = f"""matched AS (SELECT DISTINCT doc_id AS subject, unnest([doc_id % 53, doc_id % 37]) AS entry FROM documents WHERE doc_id IS NOT NULL),
facts AS (SELECT item_id AS entry, CASE WHEN item_id % 6 <> 0 THEN {M.NOW} - item_id * {M.DAY} END AS approved, item_id % 9 AS run FROM benchmark)"""


@query(with_(LEAKS) + f"""SELECT subject, bool_or(coalesce(run = subject % 9, false)) AS same_run, bool_or(coalesce(approved > {M.NOW} - 20 * {M.DAY}, false)) AS after_cutoff, count(*) FILTER (WHERE approved IS NULL) AS unplaceable
  FROM matched LEFT JOIN facts USING (entry) GROUP BY subject""")
def leak_flags(t):
    ids = t.documents.select(F.col("doc_id").alias("subject")).filter("subject is not null").distinct()
    matched = ids.select("subject", F.explode(F.array_distinct(F.array(F.col("subject") % 53, F.col("subject") % 37))).alias("entry"))
    i = F.col("item_id")
    entries = t.benchmark.select(i.alias("entry"), F.when(i % 6 != 0, F.lit(M.NOW) - i * M.DAY).alias("approved"))
    entry_runs = t.benchmark.select(i.alias("entry"), (i % 9).alias("run"))
    return evaluate.leaks(matched, ids.select("subject", (F.col("subject") % 9).alias("run")), entries, entry_runs, M.NOW - 20 * M.DAY)


F1 = "(CASE WHEN count(*) FILTER (WHERE truth = '{c}') > 0 THEN 2.0 * count(*) FILTER (WHERE truth = '{c}' AND {v} = '{c}') / (count(*) FILTER (WHERE truth = '{c}') + count(*) FILTER (WHERE {v} = '{c}')) END)"
MACRO = {v: f"(SELECT ({F1.format(c='escalate', v=v)} + {F1.format(c='benign', v=v)}) / 2 FROM predictions)" for v in ("verdict", "second")}


@query(with_(PREDICTIONS) + f"""SELECT rule, baseline, candidate, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT 'macro_f1' AS rule, {MACRO['verdict']} AS baseline, {MACRO['second']} AS candidate, {MACRO['verdict']} - {MACRO['second']} <= 0.03 AS ok
  UNION ALL SELECT 'recall_escalate', a, b, b >= a FROM (SELECT CAST(count(*) FILTER (WHERE verdict = 'escalate') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE second = 'escalate') AS DOUBLE) AS b FROM predictions WHERE truth = 'escalate')
  UNION ALL SELECT 'asr', a, b, b <= a FROM (SELECT CAST(count(*) FILTER (WHERE verdict = 'benign') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE second = 'benign') AS DOUBLE) AS b FROM predictions WHERE truth = 'escalate' AND lang = 'en'))""")
def regression_gate(t):
    """The second system against the first; attacks are the English rows of truth `escalate`."""
    p = M.predictions(t)
    return evaluate.regression_gate(p, "verdict", "second", F.col("lang") == "en")


@query(with_(PREDICTIONS) + """SELECT labeller, doc_id, place FROM (SELECT labeller, doc_id, CAST(row_number() OVER (PARTITION BY labeller ORDER BY sha256('20260904:' || labeller || ':' || doc_id), doc_id) AS INTEGER) AS place
  FROM predictions, (SELECT unnest(['first', 'second']) AS labeller)) WHERE place <= 50""")
def labeller_pages(t):
    """The first page of each labeller's own order, the hash of a seed, the labeller and the id."""
    each = M.predictions(t).select("doc_id", F.explode(F.array(F.lit("first"), F.lit("second"))).alias("labeller"))
    key = F.sha2(F.concat_ws(":", F.lit(str(P.BOOTSTRAP_SEED)), "labeller", F.col("doc_id").cast("string")), 256)
    order = Window.partitionBy("labeller").orderBy(key, "doc_id")
    return each.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= P.QUEUE_PAGE)


@query(with_(ALERTS) + "SELECT severity, CASE severity WHEN 'critical' THEN 'escalate' WHEN 'high' THEN 'needs_review' ELSE 'false_positive' END AS verdict, count(*) AS n FROM alerts GROUP BY ALL")
def baseline_verdicts(t):
    return M.alerts(t).groupBy("severity", evaluate.baseline_verdict(F.col("severity")).alias("verdict")).agg(F.count("*").alias("n"))


@query(with_(ALERTS) + """SELECT agent_name, printf('%d.%03d (%d / %d)', m // 1000, m % 1000, closed, n) AS rate, CASE WHEN worst IS NULL THEN 'n/a' ELSE worst || ' ms' END AS worst FROM (
  SELECT *, (2000 * closed + n) // (2 * n) AS m FROM (SELECT agent_name, count(*) FILTER (WHERE status = 'closed') AS closed, count(*) AS n, max(CASE WHEN k % 4 = 0 THEN k END) AS worst FROM alerts GROUP BY agent_name))""")
def report_cells(t):
    g = M.alerts(t).groupBy("agent_name").agg(F.count_if(F.col("status") == "closed").alias("closed"), F.count("*").alias("n"), F.max(F.when(F.col("k") % 4 == 0, F.col("k"))).alias("worst"))
    return g.select("agent_name", S.rate_cell(F.col("closed"), F.col("n")).alias("rate"), S.ms_cell(F.col("worst")).alias("worst"))


# --- gold candidates -----------------------------------------------------------------------------


@query(recursive(with_(ALERTS, FOLD)) + "SELECT c.first_id AS cluster_id, a.severity, a.source, c.n, coalesce(c.closed_by, '') AS closed_by, CASE WHEN a.rule_id = 'click' AND a.srcip = '' THEN 'loopback' ELSE '' END AS excluded_reason FROM closed c JOIN alerts a ON a.alert_id = c.first_id")
def gold_candidates(t):
    """A row for each cluster with its head's fields; heads from the host itself are marked, never dropped."""
    heads = M.alerts(t).select(F.col("alert_id").alias("first_id"), "severity", "source", "srcip", F.col("rule_id").alias("head_rule"))
    met = clusters(t).join(heads, "first_id")
    own = (F.col("head_rule") == "click") & (F.col("srcip") == "")
    return met.select(F.col("first_id").alias("cluster_id"), "severity", "source", "n", F.coalesce("closed_by", F.lit("")).alias("closed_by"), F.when(own, "loopback").otherwise("").alias("excluded_reason"))


EXPECTED = {0: ("view", "click"), 1: ("error",), 2: ("signup", "purchase")}


@query(with_(ALERTS, LAB) + f"""SELECT run_id, count(*) AS heads, count(*) FILTER (WHERE {' OR '.join(f"(run_id % 4 = {k} AND rule_id IN ({', '.join(map(repr, v))}))".replace(',)', ')') for k, v in EXPECTED.items())} OR run_id % 4 = 3) AS in_scope,
  min(t) AS first_seen, max(t) AS last_seen FROM alerts JOIN lab_windows ON t >= starts AND t < ends GROUP BY run_id""")
def window_truth(t):
    """Heads in each window, and those whose rule the window expects; a benign window (run 3 of 4) expects all."""
    met = keyed.range_membership(M.alerts(t).select("alert_id", "t", "rule_id"), M.lab_windows(t), "t", "starts", "ends")
    kind = F.col("run_id") % 4
    scope = kind == 3
    for k, rules in EXPECTED.items():
        scope = scope | ((kind == k) & F.col("rule_id").isin(*rules))
    return met.groupBy("run_id").agg(F.count("*").alias("heads"), F.count_if(scope).alias("in_scope"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))


@query(with_(AUDIT, ALERTS) + """SELECT state, label, count(*) AS n FROM (SELECT CASE WHEN decision = 'escalated' THEN 'queued' ELSE 'auto_closed' END AS state, CASE WHEN decision = 'escalated' THEN 'true_positive' WHEN decision IS NOT NULL THEN 'false_positive' END AS label
  FROM (SELECT alert_id FROM alerts WHERE status = 'auto_closed') LEFT JOIN (SELECT subject_id, arg_max(decision, (created, audit_id)) AS decision FROM audit WHERE event_type = 'autoclose.reviewed' GROUP BY subject_id) ON subject_id = alert_id) GROUP BY ALL""")
def digest_review(t):
    """Auto-closed alerts after their last review: a wrong one opens again, and either answer leaves a label."""
    last = keyed.latest_by(audit(t).filter("event_type = 'autoclose.reviewed'"), ["subject_id"], ["created", "audit_id"]).select(F.col("subject_id").alias("alert_id"), "decision")
    met = M.alerts(t).filter("status = 'auto_closed'").join(last, "alert_id", "left")
    wrong = F.col("decision") == "escalated"
    return met.groupBy(F.when(wrong, "queued").otherwise("auto_closed").alias("state"), F.when(wrong, "true_positive").when(F.col("decision").isNotNull(), "false_positive").alias("label")).agg(F.count("*").alias("n"))


# --- order and sets ------------------------------------------------------------------------------


@query(with_(ALERTS) + "SELECT agent_name, rule_id, CAST(row_number() OVER (PARTITION BY agent_name ORDER BY min((t, alert_id))) AS INTEGER) AS place FROM alerts GROUP BY agent_name, rule_id")
def ordered_distinct(t):
    """The rules of each host in the order in which they were first met."""
    met = M.alerts(t).groupBy("agent_name", "rule_id").agg(F.min(F.struct("t", "alert_id")).alias("first"))
    return met.select("agent_name", "rule_id", F.row_number().over(Window.partitionBy("agent_name").orderBy("first")).alias("place"))


@query(with_(ALERTS) + """SELECT alert_id, array_to_string(list_sort(list_distinct(list_concat(old, fresh))), ',') AS merged, array_to_string(list_sort(list_distinct(list_filter(fresh, lambda x: NOT list_contains(old, x)))), ',') AS added
  FROM (SELECT alert_id, ['s' || (k % 3), 's' || (k % 5)] AS old, ['s' || (k % 5), 's' || (k % 7)] AS fresh FROM alerts)""")
def merged_sources(t):
    s = lambda n: F.concat(F.lit("s"), (F.col("k") % n).cast("string"))
    old, fresh = F.array(s(3), s(5)), F.array(s(5), s(7))
    return M.alerts(t).select("alert_id", F.array_join(F.sort_array(F.array_union(old, fresh)), ",").alias("merged"), F.array_join(F.sort_array(F.array_except(fresh, old)), ",").alias("added"))


@query(with_(ALERTS) + """SELECT r.case_id, severity, 'category: ' || severity || chr(10) || 'rules: ' || rules || CASE WHEN users <> '' THEN chr(10) || 'users: ' || users ELSE '' END AS text FROM (
    SELECT k % 500 AS case_id, array_to_string(list_sort(list(DISTINCT rule_id)), ' ') AS rules, coalesce(array_to_string(list_sort(list(DISTINCT alert_user) FILTER (WHERE alert_user IS NOT NULL)), ' '), '') AS users FROM alerts GROUP BY 1) r
  JOIN (SELECT k % 500 AS case_id, severity, row_number() OVER (PARTITION BY k % 500 ORDER BY count(*) DESC, min(alert_id)) AS i FROM alerts GROUP BY 1, severity) s ON s.case_id = r.case_id AND i = 1""")
def case_fingerprints(t):
    """Each case's main severity (the first met on ties), rules and users as one text."""
    a = M.alerts(t).withColumn("case_id", F.col("k") % 500)
    by = a.groupBy("case_id", "severity").agg(F.count("*").alias("n"), F.min("alert_id").alias("met")).groupBy("case_id").agg(F.max_by("severity", F.struct("n", -F.col("met"))).alias("severity"))
    sets = a.groupBy("case_id").agg(*(F.array_join(F.sort_array(F.collect_set(c)), " ").alias(n) for c, n in (("rule_id", "rules"), ("alert_user", "users"))))
    line = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"{name}: "), F.col(c)))
    return sets.join(by, "case_id").select("case_id", "severity", F.concat_ws("\n", line("category", "severity"), line("rules", "rules"), line("users", "users")).alias("text"))


# --- threat figures ------------------------------------------------------------------------------

LIVE = f"expires > {M.NOW}"
TODAY = (M.NOW + 7 * M.HOUR) // M.DAY


@query(with_(INTEL) + f"""SELECT CAST(d AS BIGINT) AS day, coalesce(count(id) FILTER (WHERE source = 'feed0'), 0) AS feed0, coalesce(count(id) FILTER (WHERE source = 'feed1'), 0) AS feed1, count(id) AS total
  FROM range({TODAY - 29}, {TODAY + 1}) r(d) LEFT JOIN (SELECT * FROM intel WHERE {LIVE}) ON (first_seen + {7 * M.HOUR}) // {M.DAY} = d GROUP BY d""")
def threat_days(t):
    """Live indicators by local day of their first sight over thirty days, with days of none."""
    days = t.spark.range(TODAY - 29, TODAY + 1).toDF("day")
    found = indicators(t).filter(LIVE).withColumn("day", F.floor((F.col("first_seen") + 7 * M.HOUR) / M.DAY)).filter(F.col("day").between(TODAY - 29, TODAY))
    by = found.groupBy("day").agg(*(F.count_if(F.col("source") == s).alias(s) for s in ("feed0", "feed1")), F.count("*").alias("total"))
    return days.join(by, "day", "left").na.fill(0)


@query(with_(INTEL) + f"SELECT count(*) FILTER (WHERE confidence >= 75) AS high_confidence, count(*) FILTER (WHERE id % 3 > 0) AS matched, count(*) FILTER (WHERE (first_seen + {7 * M.HOUR}) // {M.DAY} = {TODAY}) AS seen_today FROM intel WHERE {LIVE}")
def threat_counts(t):
    today = F.floor((F.col("first_seen") + 7 * M.HOUR) / M.DAY) == TODAY
    return indicators(t).filter(LIVE).agg(F.count_if(F.col("confidence") >= P.HIGH_CONFIDENCE).alias("high_confidence"), F.count_if(F.col("id") % 3 > 0).alias("matched"), F.count_if(today).alias("seen_today"))


@query(with_(INTEL) + f"SELECT 'newest' AS list, malware, max(first_seen) AS value FROM intel WHERE {LIVE} AND malware <> '' GROUP BY malware ORDER BY value DESC, malware LIMIT 3")
def threat_newest(t):
    by = indicators(t).filter(LIVE).filter("malware <> ''").groupBy("malware").agg(F.max("first_seen").alias("value"))
    return by.orderBy(F.desc("value"), "malware").limit(P.NEWEST_MALWARE).select(F.lit("newest").alias("list"), "malware", "value")


@query(with_(INTEL) + f"SELECT malware, count(*) AS n FROM intel WHERE {LIVE} AND malware <> '' GROUP BY malware ORDER BY n DESC, malware LIMIT 10")
def threat_top_malware(t):
    return indicators(t).filter(LIVE).filter("malware <> ''").groupBy("malware").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "malware").limit(P.TOP_MALWARE)


# --- health --------------------------------------------------------------------------------------


@query(with_(JOBS, RUNS) + f"""SELECT name, value, value <= most AS ok FROM (
  SELECT 'job_backlog_s' AS name, CAST(({M.NOW} - min(scheduled)) / 1e6 AS DOUBLE) AS value, 600.0 AS most FROM jobs WHERE status = 'processing'
  UNION ALL SELECT 'llm_null_ratio', CAST(count(*) FILTER (WHERE verdict IS NULL) AS DOUBLE) / count(*), 0.3 FROM runs UNION ALL SELECT 'triage_unavailable', CAST(count(*) FILTER (WHERE stopped_by = 'budget') AS DOUBLE) / count(*), 0.1 FROM runs
  UNION ALL SELECT 'failed_jobs', CAST(count(*) AS DOUBLE), 0.0 FROM jobs WHERE status = 'failed' UNION ALL SELECT 'inventory_empty', CAST(count(*) = 0 AS INTEGER)::DOUBLE, 0.0 FROM nation)""")
def health_backlogs(t):
    j = jobs(t).agg(((F.lit(M.NOW) - F.min(F.when(F.col("status") == "processing", F.col("scheduled")))) / 1e6).alias("job_backlog_s"), F.count_if(F.col("status") == "failed").alias("failed_jobs"))
    r = M.runs(t).agg(F.try_divide(F.count_if(F.col("verdict").isNull()), F.count("*")).alias("llm_null_ratio"), F.try_divide(F.count_if(F.col("stopped_by") == "budget"), F.count("*")).alias("triage_unavailable"))
    i = t.nation.agg((F.count("*") == 0).cast("int").alias("inventory_empty"))
    limits = {"job_backlog_s": float(P.JOB_AGE_S), "llm_null_ratio": P.NULL_RATIO_LIMIT, "triage_unavailable": P.UNAVAILABLE_LIMIT, "failed_jobs": 0.0, "inventory_empty": 0.0}
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value"), F.lit(m).alias("most")) for n, m in limits.items())))
    return j.crossJoin(r).crossJoin(i).select(rows.alias("r")).select("r.name", "r.value", (F.col("r.value") <= F.col("r.most")).alias("ok"))  # one row each
