"""More reports: intake, entity history, techniques, cases, labels, spans, evidence, threat lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertmill.functions import networks as N
from alertmill.operators import keyed
from alertmill.plans import model as M
from alertmill.plans.model import ALERTS, CASES, DAY, DIMENSIONS, LAB, NOW, PREDICTIONS, RUNS, with_
from alertmill.plans.registry import query


@query(with_(ALERTS) + """SELECT source, count(*) AS n, quantile_disc(lag, 0.5) AS p50, quantile_disc(lag, 0.95) AS p95, max(lag) AS most, count(*) FILTER (WHERE lag > 60000000) AS over_a_minute
  FROM (SELECT source, acked - t AS lag FROM alerts WHERE acked IS NOT NULL AND NOT is_synthetic) GROUP BY source""")  # fmt: skip
def intake_latency(t):
    a = M.alerts(t).filter("acked is not null and not is_synthetic").select("source", (F.col("acked") - F.col("t")).alias("lag"))
    p = {q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY lag)") for q in (0.5, 0.95)}
    return a.groupBy("source").agg(F.count("*").alias("n"), p[0.5].cast("long").alias("p50"), p[0.95].cast("long").alias("p95"), F.max("lag").alias("most"), F.count_if(F.col("lag") > 60_000_000).alias("over_a_minute"))


@query(with_(ALERTS) + "SELECT source, status, count(*) AS n, count(*) FILTER (WHERE is_synthetic) AS synthetic, max(occurrence_count) AS most FROM alerts GROUP BY source, status")
def intake_outcomes(t):
    return M.alerts(t).groupBy("source", "status").agg(F.count("*").alias("n"), F.count_if("is_synthetic").alias("synthetic"), F.max("occurrence_count").alias("most"))


WRONG, FLAGGED = "status = 'auto_closed' AND k % 2 = 0", "status = 'closed' AND k % 30 = 2"


@query(with_(ALERTS) + f"""SELECT agent_name, count(*) AS wrong FROM alerts WHERE {WRONG} AND t >= {NOW - 7 * DAY}
  AND agent_name NOT IN (SELECT agent_name FROM alerts WHERE {FLAGGED} AND t >= {NOW - 7 * DAY}) GROUP BY agent_name HAVING count(*) >= 2""")  # fmt: skip
def suspected_wrong(t):
    recent = M.alerts(t).filter(F.col("t") >= NOW - 7 * DAY)
    wrong = recent.filter(WRONG).groupBy("agent_name").agg(F.count("*").alias("wrong")).filter("wrong >= 2")
    return wrong.join(recent.filter(FLAGGED).select("agent_name"), "agent_name", "left_anti")


SEEN = """seen AS (SELECT alert_id, t, rule_id, status, srcip AS entity FROM alerts WHERE srcip <> '' UNION ALL SELECT alert_id, t, rule_id, status, dstip FROM alerts)"""


@query(with_(ALERTS, SEEN) + f"""SELECT entity, rule_id, count(*) AS n FROM seen JOIN (SELECT entity, min(t) AS first FROM seen WHERE status = 'escalated' AND t >= {NOW - 12 * DAY} GROUP BY entity) USING (entity)
  WHERE t >= first - {7 * DAY} AND t < first GROUP BY entity, rule_id""")  # fmt: skip
def entity_history(t):
    """What each address did in the seven days before its first recent escalation."""
    a = M.alerts(t).select("t", "rule_id", "status", "srcip", "dstip")
    seen = a.select("t", "rule_id", "status", F.explode(F.array("srcip", "dstip")).alias("entity")).filter("entity <> ''")
    first = seen.filter((F.col("status") == "escalated") & (F.col("t") >= NOW - 12 * DAY)).groupBy("entity").agg(F.min("t").alias("first"))
    return seen.join(first, "entity").filter((F.col("t") >= F.col("first") - 7 * DAY) & (F.col("t") < F.col("first"))).groupBy("entity", "rule_id").agg(F.count("*").alias("n"))


@query(with_(ALERTS) + """SELECT rule_id, technique, weight, CAST(place AS INTEGER) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY weight DESC, technique) AS place FROM (
      SELECT rule_id, technique, CAST(sum(occurrence_count) AS BIGINT) AS weight FROM (
        SELECT rule_id, occurrence_count, unnest(list_distinct(['T10' || (k % 5), 'T10' || (k % 3), 'T11' || (k % 7)])) AS technique FROM alerts) GROUP BY rule_id, technique)) WHERE place <= 5""")  # fmt: skip
def technique_rank(t):
    k = F.col("k")
    ids = F.array_distinct(F.array(*(F.concat(F.lit(p), (k % m).cast("string")) for p, m in (("T10", 5), ("T10", 3), ("T11", 7)))))
    weighed = M.alerts(t).select("rule_id", "occurrence_count", F.explode(ids).alias("technique")).groupBy("rule_id", "technique").agg(F.sum("occurrence_count").alias("weight"))
    return weighed.withColumn("place", F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("weight"), "technique"))).filter("place <= 5")


@query(with_(CASES, RUNS) + """SELECT case_id, status, coalesce(n, 0) AS n, coalesce(spent, 0) AS spent_ms, last FROM cases
  LEFT JOIN (SELECT subject_id, count(*) AS n, CAST(sum(latency_ms) AS BIGINT) AS spent, max(created) AS last FROM runs WHERE role IS NOT NULL GROUP BY subject_id) ON subject_id = case_id""")  # fmt: skip
def case_counters(t):
    by_case = M.runs(t).filter("role is not null").groupBy(F.col("subject_id").alias("case_id")).agg(F.count("*").alias("n"), F.sum("latency_ms").alias("spent_ms"), F.max("created").alias("last"))
    return M.cases(t).select("case_id", "status").join(by_case, "case_id", "left").select("case_id", "status", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("spent_ms", F.lit(0)).alias("spent_ms"), "last")


@query(with_(RUNS) + "SELECT subject_id, run_id, created FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY created, run_id) AS place FROM runs) WHERE place <= 50")
def cut_timeline(t):
    return keyed.top_groups(M.runs(t).select("subject_id", "run_id", "created"), [], 50, [F.col("created"), F.col("run_id")], ["subject_id"])


@query(with_(PREDICTIONS) + """SELECT basis, label, count(*) AS n FROM (
    SELECT CASE WHEN score > 0.9 THEN 'truth' WHEN verdict = second THEN 'agreement' WHEN score < 0.2 THEN 'adjudicated' ELSE 'missing' END AS basis,
      CASE WHEN score > 0.9 THEN truth WHEN verdict = second THEN verdict WHEN score < 0.2 THEN truth END AS label FROM predictions) GROUP BY basis, label""")  # fmt: skip
def gold_precedence(t):
    """A frozen label is the known truth, else what both labellers say, else the adjudicated one."""
    score, agree = F.col("score"), F.col("verdict") == F.col("second")
    basis = F.when(score > 0.9, "truth").when(agree, "agreement").when(score < 0.2, "adjudicated").otherwise("missing")
    label = F.when(score > 0.9, F.col("truth")).when(agree, F.col("verdict")).when(score < 0.2, F.col("truth"))
    return M.predictions(t).groupBy(basis.alias("basis"), label.alias("label")).agg(F.count("*").alias("n"))


@query(with_(PREDICTIONS) + """SELECT doc_id, labeller, label, reason FROM (
    SELECT doc_id, unnest([{'labeller': 'first', 'label': verdict}, {'labeller': 'second', 'label': second}], recursive := true), truth, verdict, second, score FROM predictions),
    LATERAL (SELECT CASE WHEN score > 0.9 THEN 'window' ELSE 'peer' END AS reason)
  WHERE CASE WHEN score > 0.9 THEN label <> truth ELSE verdict <> second END""")  # fmt: skip
def adjudication_rows(t):
    """A row for each label that disagrees with the known truth or, without one, with the other labeller."""
    p = M.predictions(t)
    each = p.select("doc_id", "truth", "verdict", "second", "score", F.explode(F.array(*(F.struct(F.lit(n).alias("labeller"), F.col(c).alias("label")) for n, c in (("first", "verdict"), ("second", "second"))))).alias("l")).select("*", "l.*")
    known = F.col("score") > 0.9
    wanted = (known & (F.col("label") != F.col("truth"))) | (~known & (F.col("verdict") != F.col("second")))
    return each.filter(wanted).select("doc_id", "labeller", "label", F.when(known, "window").otherwise("peer").alias("reason"))


@query(with_(ALERTS) + """SELECT agent_name, count(*) AS overlaps, max(until - t) AS most FROM (
    SELECT agent_name, t, lag(acked) OVER (PARTITION BY agent_name ORDER BY t, alert_id) AS until FROM alerts WHERE acked IS NOT NULL) WHERE until > t GROUP BY agent_name""")  # fmt: skip
def span_overlaps(t):
    order = Window.partitionBy("agent_name").orderBy("t", "alert_id")
    spans = M.alerts(t).filter("acked is not null").withColumn("until", F.lag("acked").over(order))
    return spans.filter("until > t").groupBy("agent_name").agg(F.count("*").alias("overlaps"), F.max(F.col("until") - F.col("t")).alias("most"))


@query(with_(ALERTS, LAB) + """SELECT source, CASE WHEN run_id IS NOT NULL AND k % 2 = 0 THEN 'lab' ELSE source END AS retagged, count(*) AS n
  FROM (SELECT a.source, a.k, w.run_id FROM alerts a LEFT JOIN lab_windows w ON a.t BETWEEN w.starts AND w.ends) GROUP BY 1, 2""")  # fmt: skip
def retag_source(t):
    """Alerts inside a lab window, both ends counted, take its source."""
    a = M.alerts(t).select("alert_id", "t", "k", "source")
    closed = M.lab_windows(t).select("starts", (F.col("ends") + 1).alias("ends"))
    inside = keyed.range_membership(a.filter("k % 2 = 0").select("alert_id", "t"), closed, "t", "starts", "ends").select("alert_id", F.lit(True).alias("inside"))
    met = a.join(inside, "alert_id", "left")
    return met.groupBy("source", F.when(F.col("inside"), "lab").otherwise(F.col("source")).alias("retagged")).agg(F.count("*").alias("n"))


@query(with_(DIMENSIONS) + f"""SELECT source, value, n, CAST(place AS INTEGER) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, value) AS place FROM (SELECT source, value, count(*) AS n FROM iocs WHERE expires > {NOW} GROUP BY source, value)) WHERE place <= 3""")  # fmt: skip
def threat_top_values(t):
    live = M.iocs(t).filter(F.col("expires") > NOW).groupBy("source", "value").agg(F.count("*").alias("n"))
    return live.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "value"))).filter("place <= 3")


@query(with_(DIMENSIONS) + f"SELECT value, min(expires) AS expires, count(DISTINCT source) AS feeds FROM iocs WHERE expires > {NOW} AND reputation <> 'clean' AND value NOT LIKE '10.%' GROUP BY value")
def blocklist(t):
    listed = M.iocs(t).filter((F.col("expires") > NOW) & (F.col("reputation") != "clean")).withColumn("value", N.blocklist_entry(F.lit("ip:port"), F.col("value"))).filter("value is not null")
    return listed.groupBy("value").agg(F.min("expires").alias("expires"), F.count_distinct("source").alias("feeds"))


@query("""SELECT reason, count(*) AS n FROM (
    SELECT CASE WHEN text IS NULL THEN 'not_in_case' WHEN length(trim(quote, ' ')) < 8 THEN 'too_short'
      WHEN contains(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), regexp_replace(quote, '[ \\t\\r\\n]+', ' ', 'g')) THEN 'ok' ELSE 'not_found' END AS reason
    FROM (SELECT text, CASE WHEN doc_id % 3 = 0 THEN 'zz' ELSE '' END || substr(text, 11, 30) AS quote FROM documents)) GROUP BY reason""")  # fmt: skip
def evidence_check(t) -> DataFrame:
    """Whether a quote is in its text, white space aside, and why not."""
    plain = lambda c: F.regexp_replace(c, "[ \t\r\n]+", " ")
    quote = F.concat(F.when(F.col("doc_id") % 3 == 0, "zz").otherwise(""), F.substring("text", 11, 30))
    reason = F.when(F.col("text").isNull(), "not_in_case").when(F.length(F.trim(quote)) < 8, "too_short").when(F.contains(plain(F.col("text")), plain(quote)), "ok").otherwise("not_found")
    return t.documents.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
