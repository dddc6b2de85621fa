"""Relational queries: scores, queue, rules, latest rows, as-of joins, rollups, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertmill import params as P
from alertmill.functions import scalar as S
from alertmill.operators import enrich, keyed
from alertmill.plans import model as M
from alertmill.plans.model import ALERTS, CASES, DIMENSIONS, LAB, RUNS, Tables, with_
from alertmill.plans.registry import query

# --- classification, scores, queue -------------------------------------------------------------


@query(with_(ALERTS) + "SELECT severity, count(*) AS n, count(DISTINCT agent_name) AS agents FROM alerts WHERE NOT is_synthetic GROUP BY severity")
def severity_counts(t):
    return M.alerts(t).filter("not is_synthetic").groupBy("severity").agg(F.count("*").alias("n"), F.count_distinct("agent_name").alias("agents"))


SCORED = f"""
asset_of AS (SELECT hostname, min(criticality) AS criticality, min(owner) AS owner FROM assets WHERE active GROUP BY hostname),
identity_of AS (SELECT username, bool_or(is_privileged) AS is_privileged FROM identities WHERE active GROUP BY username),
ioc_of AS (SELECT value, max(CASE reputation WHEN 'clean' THEN 1 WHEN 'suspicious' THEN 2 ELSE 3 END) AS r FROM iocs WHERE expires > {M.NOW} GROUP BY value),
scored AS (
  SELECT *, least(100, base + least(25, a + i + c + o)) AS score FROM (
    SELECT x.*, s.criticality, s.hostname IS NOT NULL AS asset_present, d.is_privileged,
      'skipped' AS reputation,
      CASE severity WHEN 'critical' THEN 70 WHEN 'high' THEN 50 WHEN 'medium' THEN 28 ELSE 10 END AS base,
      CASE s.criticality WHEN 'high' THEN 30 WHEN 'medium' THEN 10 ELSE 0 END AS a,
      CASE WHEN d.is_privileged THEN 15 ELSE 0 END AS i, 0 AS c,
      CASE WHEN occurrence_count >= 100 THEN 10 WHEN occurrence_count >= 10 THEN 5 ELSE 0 END AS o
    FROM alerts x LEFT JOIN asset_of s ON x.agent_name = s.hostname LEFT JOIN identity_of d ON x.alert_user = d.username
  )
)"""


def scored(t: Tables) -> DataFrame:
    a = enrich.with_asset(M.alerts(t), M.assets(t), ["agent_name"])
    a = enrich.with_identity(a, M.identities(t))
    a = a.withColumn("criticality", F.col("asset.criticality")).withColumn("reputation", F.lit("skipped"))
    return a.withColumn("risk", S.risk_components(F.col("severity"), F.col("criticality"), F.col("is_privileged"), F.col("reputation"), F.col("occurrence_count"))).withColumn("score", F.col("risk.score"))


BAND = "CASE WHEN score <= 24 THEN 'low' WHEN score <= 49 THEN 'medium' WHEN score <= 74 THEN 'high' ELSE 'critical' END"


@query(with_(ALERTS, DIMENSIONS, SCORED) + f"SELECT {BAND} AS band, count(*) AS n, min(score) AS least, max(score) AS most FROM scored GROUP BY 1")
def risk_score_bands(t):
    return scored(t).groupBy(S.risk_band(F.col("score")).alias("band")).agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


@query(with_(ALERTS, DIMENSIONS, SCORED) + "SELECT alert_id, base, a AS asset, i AS identity, o AS occurrence, score FROM scored")
def risk_components(t):
    return scored(t).select("alert_id", *(F.col(f"risk.{c}").alias(c) for c in ("base", "asset", "identity", "occurrence", "score")))


@query(with_(ALERTS) + "SELECT alert_id, sha256(concat_ws('|', rule_id, srcip, dstip, agent_name, CAST(floor(t / 1000000 / 300.0) AS BIGINT))) AS bucket_hash FROM alerts")
def event_bucket_hash(t):
    a = M.alerts(t)
    return a.select("alert_id", S.event_bucket_hash(F.col("rule_id"), F.col("srcip"), F.col("dstip"), F.col("agent_name"), F.col("t") / 1_000_000).alias("bucket_hash"))


@query(with_(ALERTS) + "SELECT visible, severity, count(*) AS n FROM alerts GROUP BY visible, severity")
def blind_arm_split(t):
    return M.alerts(t).groupBy("visible", "severity").agg(F.count("*").alias("n"))


RETRIAGE = "(triaged_count > 0 AND (occurrence_count >= 10 * triaged_count OR occurrence_count - triaged_count >= 200))"
QUEUE_WHERE = "status IN ('queued', 'escalated') AND NOT is_synthetic"


def queue(t: Tables) -> DataFrame:
    """Open alerts that are not synthetic, with what the queue is sorted by."""
    return scored(t).filter(F.col("status").isin("queued", "escalated") & ~F.col("is_synthetic")).withColumn("retriage", S.needs_retriage(F.col("triaged_count"), F.col("occurrence_count")))


@query(with_(ALERTS, DIMENSIONS, SCORED) + f"""SELECT alert_id, severity, score, retriage, CAST(row_number() OVER (ORDER BY retriage DESC, score DESC NULLS LAST, t, alert_id) AS INTEGER) AS place
  FROM (SELECT *, {RETRIAGE} AS retriage FROM scored WHERE {QUEUE_WHERE}) ORDER BY place LIMIT 50""")
def queue_page(t):
    page = queue(t).select("alert_id", "severity", "score", "retriage", "t").orderBy(F.desc("retriage"), F.desc_nulls_last("score"), "t", "alert_id").limit(P.QUEUE_PAGE)
    place = Window.orderBy(F.desc("retriage"), F.desc_nulls_last("score"), "t", "alert_id")  # over one page
    return page.withColumn("place", F.row_number().over(place)).drop("t")


@query(with_(ALERTS, DIMENSIONS, SCORED) + f"SELECT {BAND} AS band, severity, count(*) AS n FROM scored WHERE {QUEUE_WHERE} GROUP BY 1, 2")
def queue_facets(t):
    return queue(t).groupBy(S.risk_band(F.col("score")).alias("band"), "severity").agg(F.count("*").alias("n"))


@query(with_(ALERTS) + f"SELECT triaged_count, count(*) AS n, count(*) FILTER (WHERE {RETRIAGE}) AS due FROM alerts GROUP BY triaged_count")
def needs_retriage(t):
    return M.alerts(t).groupBy("triaged_count").agg(F.count("*").alias("n"), F.count_if(S.needs_retriage(F.col("triaged_count"), F.col("occurrence_count"))).alias("due"))


@query(with_(ALERTS) + """, days AS (SELECT unnest(range(0, 31)) AS d), sources AS (SELECT unnest(['lab', 'replay', 'wazuh']) AS source),
  n AS (SELECT CAST(floor((t - 1704067200000000 + 25200000000) / 86400000000.0) AS BIGINT) AS d, source, count(*) AS n FROM alerts GROUP BY 1, 2)
  SELECT strftime(DATE '2024-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') AS day, source, coalesce(n, 0) AS n FROM days CROSS JOIN sources LEFT JOIN n USING (d, source)""")
def local_day_series(t):
    local = F.floor((F.col("t") - 1704067200000000 + 7 * M.HOUR) / M.DAY)
    counts = M.alerts(t).groupBy(local.alias("d"), "source").agg(F.count("*").alias("n"))
    grid = t.spark.range(31).select(F.col("id").alias("d"), F.explode(F.array(*map(F.lit, ("lab", "replay", "wazuh")))).alias("source"))
    return grid.join(counts, ["d", "source"], "left").select(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("d").cast("int")), "yyyy-MM-dd").alias("day"), "source", F.coalesce("n", F.lit(0)).alias("n"))


@query(with_(ALERTS) + "SELECT agent_name, count(*) AS n FROM alerts WHERE NOT is_synthetic GROUP BY agent_name ORDER BY n DESC, agent_name LIMIT 10")
def top_agents(t):
    return M.alerts(t).filter("not is_synthetic").groupBy("agent_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "agent_name").limit(10)


@query(with_(ALERTS) + "SELECT coalesce(status, 'all') AS status, coalesce(triage_status, 'all') AS triage_status, count(*) AS n FROM alerts GROUP BY GROUPING SETS ((status), (triage_status), ())")
def funnel_status(t):
    return M.alerts(t).groupingSets([["status"], ["triage_status"], []], "status", "triage_status").agg(F.count("*").alias("n")).select(F.coalesce("status", F.lit("all")).alias("status"), F.coalesce("triage_status", F.lit("all")).alias("triage_status"), "n")


@query(with_(ALERTS) + "SELECT rule_id, n, total, round(100.0 * n / total, 2) AS percent FROM (SELECT rule_id, count(*) AS n FROM alerts GROUP BY rule_id), (SELECT count(*) AS total FROM alerts) WHERE round(100.0 * n / total, 2) > 15")
def rule_width_share(t):
    return enrich.rule_width(M.alerts(t), "rule_id", 15)


RULES = [
    ("r-click-low", '[{"field": "rule_id", "op": "eq", "value": "click"}, {"field": "rule_level", "op": "lte", "value": 7}]'),
    ("r-net", '[{"field": "srcip", "op": "cidr", "value": "10.0.0.0/28"}]'),
    ("r-bad", '[{"field": "rule_id", "op": "regex", "value": ".*"}]'),
    ("r-host", '[{"field": "agent_name", "op": "prefix", "value": "host-1"}, {"field": "rule_id", "op": "in", "value": ["view", "error"]}]'),
]
BLOCK = "CASE WHEN severity = 'critical' THEN 'critical' WHEN agent_name IN ('host-7') THEN 'never_autoclose_agent' WHEN criticality = 'high' THEN 'asset_high' WHEN NOT asset_present THEN 'asset_not_in_inventory' WHEN is_privileged THEN 'identity_privileged' END"
ROUTED = f"""routed AS (SELECT *, CASE WHEN block IS NULL THEN CASE WHEN rule_id = 'click' AND rule_level <= 7 THEN 'r-click-low'
  WHEN srcip <> '' AND CAST(split_part(srcip, '.', 4) AS INTEGER) < 16 THEN 'r-net' WHEN agent_name LIKE 'host-1%' AND rule_id IN ('view', 'error') THEN 'r-host' END END AS matched_rule
  FROM (SELECT *, {BLOCK} AS block FROM scored))"""


def routed(t: Tables) -> DataFrame:
    block = S.first_block(F.col("severity"), F.col("agent_name"), F.col("asset_present"), F.col("criticality"), F.col("is_privileged"), F.col("reputation"), ["host-7"])
    return enrich.route(scored(t), RULES, block)


@query(with_(ALERTS, DIMENSIONS, SCORED, ROUTED) + "SELECT matched_rule, severity, count(*) AS n, CAST(sum(occurrence_count) AS BIGINT) AS occurrences FROM routed WHERE matched_rule IS NOT NULL GROUP BY 1, 2")
def autoclose_simulate(t):
    return routed(t).filter("matched_rule is not null").groupBy("matched_rule", "severity").agg(F.count("*").alias("n"), F.sum("occurrence_count").alias("occurrences"))


@query(with_(ALERTS, DIMENSIONS, SCORED, ROUTED) + "SELECT b.block, count(r.alert_id) AS n FROM (SELECT unnest(['critical', 'never_autoclose_agent', 'asset_high', 'asset_not_in_inventory', 'identity_privileged', 'ioc_bad']) AS block) b LEFT JOIN routed r USING (block) GROUP BY 1")
def hard_block_tally(t):
    names = ("critical", "never_autoclose_agent", "asset_high", "asset_not_in_inventory", "identity_privileged", "ioc_bad")
    counts = routed(t).filter("block is not null").groupBy("block").agg(F.count("*").alias("n"))
    grid = t.spark.createDataFrame([(b,) for b in names], "block string")
    return grid.join(counts, "block", "left").select("block", F.coalesce("n", F.lit(0)).alias("n"))


@query(with_(ALERTS, DIMENSIONS) + f""", asked AS (SELECT alert_id, srcip AS value FROM alerts WHERE srcip NOT LIKE '10.%' AND srcip <> '' UNION SELECT alert_id, dstip FROM alerts WHERE false),
  worst AS (SELECT value, max(CASE reputation WHEN 'clean' THEN 1 WHEN 'suspicious' THEN 2 ELSE 3 END) AS r FROM iocs WHERE expires > {M.NOW} GROUP BY value)
  SELECT value, CASE r WHEN 1 THEN 'clean' WHEN 2 THEN 'suspicious' ELSE 'malicious' END AS reputation FROM worst""")
def ioc_worst(t):
    rank = F.array_position(F.array(*map(F.lit, P.REPUTATIONS)), F.col("reputation"))
    return M.iocs(t).filter(F.col("expires") > M.NOW).groupBy("value").agg(F.max_by("reputation", rank).alias("reputation"))


@query(with_(ALERTS, DIMENSIONS) + f""", public AS (SELECT alert_id, '8.8.' || (k % 7) || '.' || (k % 60) AS a, CASE WHEN k % 4 = 0 THEN '' ELSE '9.9.9.' || (k % 9) END AS b FROM alerts),
  feed AS (SELECT '8.8.' || (s_suppkey % 7) || '.' || (s_suppkey % 60) AS value, CASE s_suppkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS r FROM supplier WHERE s_suppkey % 5 > 0
           UNION ALL SELECT '9.9.9.' || (s_suppkey % 5), CASE s_suppkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END FROM supplier WHERE s_suppkey % 5 > 3),
  met AS (SELECT p.alert_id, max(r) AS r FROM public p LEFT JOIN feed f ON f.value IN (p.a, p.b) GROUP BY 1)
  SELECT coalesce(CASE r WHEN 1 THEN 'clean' WHEN 2 THEN 'suspicious' WHEN 3 THEN 'malicious' END, 'not_found') AS reputation, count(*) AS n FROM met GROUP BY 1""")
def ioc_worst_wins(t):
    k, s = F.col("k"), F.col("s_suppkey")
    a = M.alerts(t).select("alert_id", F.concat(F.lit("8.8."), (k % 7).cast("string"), F.lit("."), (k % 60).cast("string")).alias("a"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("9.9.9."), (k % 9).cast("string"))).alias("b"))
    bad = S.chosen(s % 3, {0: "malicious", 1: "suspicious"}, "clean")
    feed = t.supplier.select(F.concat(F.lit("8.8."), (s % 7).cast("string"), F.lit("."), (s % 60).cast("string")).alias("value"), bad.alias("reputation"), (s % 5).alias("expires"))
    feed = feed.unionByName(t.supplier.select(F.concat(F.lit("9.9.9."), (s % 5).cast("string")).alias("value"), bad.alias("reputation"), (s % 5 - 3).alias("expires")))
    return enrich.with_reputation(a, feed, "alert_id", ["a", "b"], 0).groupBy("reputation").agg(F.count("*").alias("n"))


@query(with_(ALERTS, DIMENSIONS) + """, h AS (SELECT hostname, min(criticality) AS criticality FROM assets WHERE active GROUP BY hostname)
  SELECT coalesce(a.criticality, b.criticality, 'absent') AS criticality, count(*) AS n FROM (SELECT *, 'host-' || (k % 80) AS origin_host FROM alerts) x
  LEFT JOIN h a ON a.hostname = x.agent_name LEFT JOIN h b ON b.hostname = x.origin_host GROUP BY 1""")
def asset_fallback_lookup(t):
    a = M.alerts(t).withColumn("origin_host", F.concat(F.lit("host-"), (F.col("k") % 80).cast("string")))
    return enrich.with_asset(a, M.assets(t), ["agent_name", "origin_host"]).groupBy(F.coalesce("asset.criticality", F.lit("absent")).alias("criticality")).agg(F.count("*").alias("n"))


# --- latest rows, as-of, ranges, percentiles --------------------------------------------------


@query(with_(RUNS) + "SELECT subject_id, run_id, verdict, latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY created DESC, run_id DESC) AS r FROM runs WHERE role = 'proposer') WHERE r = 1")
def latest_per_subject(t):
    return keyed.latest_by(M.runs(t).filter("role = 'proposer'").select("subject_id", "run_id", "verdict", "latency_ms", "created"), ["subject_id"], ["created", "run_id"]).drop("created")


@query(with_(ALERTS) + """SELECT d.alert_id, coalesce(max(a.acked), -1) AS acked, coalesce(d.decided - max(a.acked), -1) AS waited FROM alerts d LEFT JOIN alerts a ON a.agent_name = d.agent_name AND a.acked <= d.decided WHERE d.decided IS NOT NULL GROUP BY d.alert_id, d.decided""")
def asof_ack_to_decide(t):
    a = M.alerts(t)
    got = keyed.as_of(a.filter("decided is not null").select("alert_id", "agent_name", "decided"), a.filter("acked is not null").select("agent_name", "acked"), ["agent_name"], "decided", "acked", ["acked"])
    return got.select("alert_id", F.coalesce("acked", F.lit(-1)).alias("acked"), F.coalesce(F.col("decided") - F.col("acked"), F.lit(-1)).alias("waited"))


@query(with_(RUNS, CASES) + """SELECT c.case_id, arg_max(r.verdict, (r.created, r.run_id)) AS verdict, coalesce(arg_max(r.run_id, (r.created, r.run_id)), -1) AS run_id
  FROM cases c LEFT JOIN runs r ON r.subject_id = c.case_id AND r.created <= c.created + 60 * 86400000000 GROUP BY c.case_id""")
def asof_newest_run(t):
    c = M.cases(t).select("case_id", F.col("case_id").alias("subject_id"), (F.col("created") + 60 * M.DAY).alias("decided"))
    r = M.runs(t).select("subject_id", "created", "run_id", "verdict")
    return keyed.as_of(c, r, ["subject_id"], "decided", "created", ["run_id", "verdict"]).select("case_id", "verdict", F.coalesce("run_id", F.lit(-1)).alias("run_id"))


@query(with_(ALERTS) + "SELECT visible, coalesce(source, 'all') AS source, count(*) AS n, count(DISTINCT agent_name) AS agents, median(decided - t) / 1e6 AS median_s FROM alerts WHERE NOT is_synthetic GROUP BY visible, ROLLUP(source)")
def rollup_arm_source(t):
    a = M.alerts(t).filter("not is_synthetic")
    return keyed.rollup_all(a, ["visible"], "source", [F.count("*").alias("n"), F.count_distinct("agent_name").alias("agents"), F.expr("percentile_cont(0.5) within group (order by decided - t) / 1e6").alias("median_s")])


@query(with_(ALERTS) + "SELECT coalesce(source, 'all') AS source, severity, count(*) AS n FROM alerts GROUP BY ROLLUP(source), severity")
def rollup_cross(t):
    return keyed.rollup_all(M.alerts(t), ["severity"], "source", [F.count("*").alias("n")]).select("source", "severity", "n")


@query(with_(RUNS) + "SELECT role, count(*) AS n, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, max(latency_ms) AS most FROM runs GROUP BY role")
def latency_percentiles(t):
    return M.runs(t).groupBy("role").agg(F.count("*").alias("n"), F.expr("cast(percentile_disc(0.5) within group (order by latency_ms) as int)").alias("p50"), F.expr("cast(percentile_disc(0.95) within group (order by latency_ms) as int)").alias("p95"), F.max("latency_ms").alias("most"))


@query(with_(RUNS) + "SELECT count(*) AS subjects, quantile_disc(total, 0.5) AS p50, quantile_disc(total, 0.95) AS p95 FROM (SELECT subject_id, CAST(sum(latency_ms) AS BIGINT) AS total FROM runs GROUP BY subject_id)")
def latency_sum_then_percentile(t):
    s = M.runs(t).groupBy("subject_id").agg(F.sum("latency_ms").alias("total"))
    return s.agg(F.count("*").alias("subjects"), F.expr("cast(percentile_disc(0.5) within group (order by total) as bigint)").alias("p50"), F.expr("cast(percentile_disc(0.95) within group (order by total) as bigint)").alias("p95"))


@query(with_(ALERTS) + "SELECT agent_name, max(gap) AS longest, count(gap) AS gaps FROM (SELECT agent_name, t - lag(t) OVER (PARTITION BY agent_name ORDER BY t, alert_id) AS gap FROM alerts) GROUP BY agent_name")
def max_gap_lag(t):
    w = Window.partitionBy("agent_name").orderBy("t", "alert_id")
    return M.alerts(t).withColumn("gap", F.col("t") - F.lag("t").over(w)).groupBy("agent_name").agg(F.max("gap").alias("longest"), F.count("gap").alias("gaps"))


@query(with_(ALERTS) + "SELECT a.agent_name, count(*) AS n FROM alerts a WHERE status = 'auto_closed' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.alert_id) GROUP BY 1")
def unreviewed_anti(t):
    return M.alerts(t).filter("status = 'auto_closed'").join(t.labels.select(F.col("doc_id").alias("alert_id")), "alert_id", "left_anti").groupBy("agent_name").agg(F.count("*").alias("n"))


@query(with_(ALERTS) + "SELECT a.severity, count(*) AS n FROM alerts a WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.alert_id AND l.quality = 1) GROUP BY 1")
def exists_semi(t):
    return M.alerts(t).join(t.labels.filter("quality = 1").select(F.col("doc_id").alias("alert_id")), "alert_id", "left_semi").groupBy("severity").agg(F.count("*").alias("n"))


@query(with_(ALERTS, LAB) + "SELECT run_id, count(*) AS n, count(DISTINCT agent_name) AS agents FROM alerts JOIN lab_windows ON t >= starts AND t < ends GROUP BY run_id")
def lab_window_membership(t):
    return keyed.range_membership(M.alerts(t), M.lab_windows(t), "t", "starts", "ends").groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("agent_name").alias("agents"))


@query(with_(ALERTS) + """SELECT s.alert_id, count(*) AS n FROM alerts s JOIN alerts o ON o.rule_id = s.rule_id AND o.agent_name = s.agent_name AND o.t >= s.t - 4 * 3600000000 GROUP BY s.alert_id""")
def burst_count(t):
    w = Window.partitionBy("rule_id", "agent_name").orderBy("t").rangeBetween(-4 * M.HOUR, Window.unboundedFollowing)
    return M.alerts(t).select("alert_id", F.count("*").over(w).alias("n"))


@query(with_(ALERTS) + """, u AS (SELECT agent_name, t, alert_id, 'head' AS kind FROM alerts UNION ALL SELECT agent_name, acked, alert_id, 'ack' FROM alerts WHERE acked IS NOT NULL),
  p AS (SELECT *, row_number() OVER (PARTITION BY agent_name ORDER BY t, alert_id, kind) AS pos, count(*) OVER (PARTITION BY agent_name) AS n FROM u)
  SELECT agent_name, pos, kind, alert_id, n FROM p WHERE n <= 300 OR pos <= 150 OR pos > n - 150""")
def timeline_union_head_tail(t):
    a = M.alerts(t)
    u = a.select("agent_name", "t", "alert_id", F.lit("head").alias("kind")).unionByName(a.filter("acked is not null").select("agent_name", F.col("acked").alias("t"), "alert_id", F.lit("ack").alias("kind")))
    return keyed.head_and_tail(u, ["agent_name"], ["t", "alert_id", "kind"], P.TIMELINE_ROWS, P.TIMELINE_HALF).select("agent_name", F.col("at").cast("long").alias("pos"), "kind", "alert_id", "n")


@query(with_(ALERTS) + "SELECT alert_id, t FROM alerts WHERE (t, alert_id) < (1705000000000000, 100000) ORDER BY t DESC, alert_id DESC LIMIT 25")
def keyset_page(t):
    after = (F.col("t") < 1705000000000000) | ((F.col("t") == 1705000000000000) & (F.col("alert_id") < 100000))
    return M.alerts(t).filter(after).select("alert_id", "t").orderBy(F.desc("t"), F.desc("alert_id")).limit(25)


@query(with_(RUNS) + "SELECT step, count(*) AS n, count(DISTINCT subject_id) AS subjects FROM (SELECT subject_id, unnest(CAST(flagged_by AS VARCHAR[])) AS step FROM (SELECT subject_id, json_extract_string(flagged_by, '$[*]') AS flagged_by FROM runs WHERE forced)) GROUP BY step")
def json_flags_explode(t):
    return M.runs(t).filter("forced").select("subject_id", F.explode(F.from_json("flagged_by", "array<string>")).alias("step")).groupBy("step").agg(F.count("*").alias("n"), F.count_distinct("subject_id").alias("subjects"))


@query(with_(RUNS) + """SELECT pipeline, role, sum(n)::BIGINT AS runs, string_agg(coalesce(verdict, '?') || '=' || n, ',' ORDER BY coalesce(verdict, '?')) AS verdicts FROM (SELECT pipeline, role, verdict, count(*) AS n FROM runs GROUP BY ALL) GROUP BY pipeline, role""")
def usage_map_agg(t):
    n = M.runs(t).groupBy("pipeline", "role", F.coalesce("verdict", F.lit("?")).alias("verdict")).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("verdict", "n")))
    return n.groupBy("pipeline", "role").agg(F.sum("n").alias("runs"), F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["verdict"], p["n"].cast("string"))), ",").alias("verdicts"))


@query(with_(ALERTS) + "SELECT agent_name, array_to_string(list_slice(list_sort(list_distinct(list(srcip))), 1, 5), ',') AS sources FROM alerts WHERE srcip <> '' GROUP BY agent_name")
def array_distinct_cap(t):
    return M.alerts(t).filter("srcip <> ''").groupBy("agent_name").agg(F.array_join(F.slice(F.array_sort(F.collect_set("srcip")), 1, 5), ",").alias("sources"))


@query(with_(RUNS) + "SELECT strftime(make_timestamp(created), '%Y-%m') AS month, count(*) AS n, CAST(sum(cost_usd) AS DOUBLE) AS spent, count(DISTINCT subject_id) AS subjects FROM runs GROUP BY 1")
def month_spend(t):
    return M.runs(t).groupBy(F.date_format(F.timestamp_micros("created"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("cost_usd").cast("double").alias("spent"), F.count_distinct("subject_id").alias("subjects"))


@query(with_(ALERTS) + "SELECT alert_id, value, (SELECT count(*) FROM alerts WHERE severity = 'high') AS total FROM alerts WHERE severity = 'high' ORDER BY value DESC, alert_id LIMIT 20")
def total_over_page(t):
    a = M.alerts(t).filter("severity = 'high'").select("alert_id", "value")
    total = a.agg(F.count("*").alias("total"))  # one row
    return a.orderBy(F.desc("value"), "alert_id").limit(20).crossJoin(F.broadcast(total))


@query(with_(ALERTS) + "(SELECT agent_name, 'both' AS side FROM alerts WHERE severity = 'critical' INTERSECT SELECT agent_name, 'both' FROM alerts WHERE status = 'closed') UNION ALL (SELECT agent_name, 'never_closed' AS side FROM alerts WHERE severity = 'critical' EXCEPT SELECT agent_name, 'never_closed' FROM alerts WHERE status = 'closed')")
def set_intersect_except(t):
    a = M.alerts(t)
    x, y = a.filter("severity = 'critical'").select("agent_name"), a.filter("status = 'closed'").select("agent_name")
    return x.intersect(y).withColumn("side", F.lit("both")).unionByName(x.subtract(y).withColumn("side", F.lit("never_closed")))
