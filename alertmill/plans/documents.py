"""Queries of typed reads, context blocks, frozen outputs, and of paired runs."""

from __future__ import annotations


from pyspark.sql import functions as F

from alertmill.functions import scalar as S
from alertmill.functions import typed
from alertmill.operators import context, evaluate
from alertmill.plans import model as M
from alertmill.plans.model import ALERTS, PREDICTIONS, with_
from alertmill.plans.registry import query
from alertmill.sources import freeze, scratch

#: Payloads by form, with the fault, criticality and reputation that each is read as.
PAYLOADS = [
    ('{"enrichment": {"schema_version": "1.2", "asset": {"criticality": "high", "in_inventory": true}, "ti": [{"verdict": "clean"}]}}', None, "high", "clean"),
    ('{"enrichment": {"schema_version": "2.0", "asset": {"criticality": "high"}}}', "enrichment.schema_version: missing or not 1.x", "unknown", "skipped"),
    ('{"enrichment": {"schema_version": "1.0", "asset": {"criticality": "huge", "owner": 3}}}', "enrichment.asset.criticality: outside its vocabulary", "unknown", "skipped"),
    ('{"rule": {"id": "1"}}', "enrichment: missing", "unknown", "skipped"),
    ('{"enrichment": {"schema_version": "1.9", "ti": [{"verdict": "suspicious"}], "ioc": {"verdict": "malicious"}}}', None, "unknown", "malicious"),
    ('{"enrichment": {"schema_version": "1.9", "ti": ["x"]}}', "enrichment.ti[]: wrong type", "unknown", "skipped"),
    ('{"enrichment": {"schema_version": "1.9", "asset": null}}', None, "unknown", "skipped"),
    ('{"enrichment": {"schema_version": "1.9", "asset": {"in_inventory": "yes"}}}', "enrichment.asset.in_inventory: wrong type", "unknown", "skipped"),
]


def _case(values: list) -> str:
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return "CASE k % 8 " + " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values)) + " END"


@query(with_(ALERTS) + f"SELECT fault, criticality, reputation, severity, count(*) AS n FROM (SELECT severity, {_case([p[1] for p in PAYLOADS])} AS fault, {_case([p[2] for p in PAYLOADS])} AS criticality, {_case([p[3] for p in PAYLOADS])} AS reputation FROM alerts) GROUP BY ALL")
def enrichment_read(t):
    """The context that each alert's payload gives, or the first fault of its enrichment block."""
    payload = S.chosen(F.col("k") % 8, {i: p[0] for i, p in enumerate(PAYLOADS)})
    c = M.alerts(t).select("severity", typed.enrichment(payload, F.col("alert_user").isNotNull()).alias("c"))
    fault = F.concat(F.col("c.fault.field"), F.lit(": "), F.col("c.fault.fault"))
    return c.groupBy(fault.alias("fault"), "c.criticality", "c.reputation", "severity").agg(F.count("*").alias("n"))


@query(with_(PREDICTIONS) + """SELECT fault, action, reasons, count(*) AS n FROM (SELECT CASE WHEN verdict IS NULL THEN 'suggested_action: missing' WHEN verdict = 'needs_review' THEN 'suggested_action: invalid' WHEN doc_id % 5 = 0 THEN 'reasons[].source: invalid' END AS fault,
  CASE WHEN verdict IN ('escalate', 'benign') AND doc_id % 5 <> 0 THEN CASE verdict WHEN 'escalate' THEN 'true_positive' ELSE 'false_positive' END END AS action, CASE WHEN verdict IN ('escalate', 'benign') AND doc_id % 5 <> 0 THEN 1 END AS reasons FROM predictions) GROUP BY ALL""")
def answers_guarded(t):
    """Answers of a model as JSON, read under closed sets; what has a fault gives no answer."""
    p = M.predictions(t)
    action = F.when(F.col("verdict") == "escalate", "true_positive").when(F.col("verdict") == "benign", "false_positive").otherwise(F.col("verdict"))
    text = lambda name: F.lit("x").alias(name)
    basis = F.struct(F.lit("low").alias("severity"), F.lit("clean").alias("ioc_reputation"), F.lit("high").alias("asset_criticality"), F.lit("true").alias("identity_privileged"), F.col("doc_id").cast("int").alias("occurrence_count"), F.lit("r").alias("playbook_rule_applied"))
    reason = F.struct(text("claim"), text("quote"), F.when(F.col("doc_id") % 5 == 0, "web").otherwise("context").alias("source"))
    body = F.struct(action.alias("suggested_action"), F.lit("low").alias("confidence"), basis.alias("structured_basis"), F.array(reason).alias("reasons"), text("playbook_used"), *map(text, typed.ANALYST_TEXTS), F.array(F.lit("look")).alias(typed.ANALYST_LIST), text("unknown"))
    read = p.select(typed.guarded_answer(F.to_json(body)).alias("g"))
    return read.groupBy(F.col("g.fault").alias("fault"), F.col("g.answer.suggested_action").alias("action"), F.size("g.answer.reasons").alias("reasons")).agg(F.count("*").alias("n")).withColumn("reasons", F.when(F.col("reasons") >= 0, F.col("reasons")))


CONTEXT_BYTES = 400


@query(with_(ALERTS) + f"""SELECT agent_name, block, CAST(shown AS INTEGER) AS shown, omitted FROM (
  WITH l AS (SELECT agent_name, row_number() OVER w AS i, strlen(line) AS bytes, line FROM (SELECT agent_name, t, alert_id, 'alert: id=' || alert_id || ' rule=' || rule_id || coalesce(' user="é ' || alert_user || '"', '') AS line FROM alerts) WINDOW w AS (PARTITION BY agent_name ORDER BY t, alert_id)),
  s AS (SELECT *, sum(bytes + 1) OVER (PARTITION BY agent_name ORDER BY i) - 1 AS size, sum(bytes + 1) OVER (PARTITION BY agent_name) - 1 AS total, count(*) OVER (PARTITION BY agent_name) AS n FROM l),
  k AS (SELECT *, size + CASE WHEN total > {CONTEXT_BYTES} THEN length('(' || n || ' more lines)') + 1 ELSE 0 END <= {CONTEXT_BYTES} AS fits FROM s)
  SELECT agent_name, concat_ws(chr(10), nullif(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE fits), ''), ''), CASE WHEN count(*) > count(*) FILTER (WHERE fits) THEN '(' || (count(*) - count(*) FILTER (WHERE fits)) || ' more lines)' END) AS block,
    count(*) FILTER (WHERE fits) AS shown, CAST(count(*) - count(*) FILTER (WHERE fits) AS INTEGER) AS omitted FROM k GROUP BY agent_name)""")
def context_blocks(t):
    """The alerts of each host as lines of a block of at most 400 bytes."""
    fields = {"id": F.col("alert_id"), "rule": F.col("rule_id"), "user": F.concat(F.lit("é\t"), F.col("alert_user"))}
    lines = M.alerts(t).withColumn("line", context.line("alert", fields))
    return context.blocks(lines, "agent_name", [F.col("t"), F.col("alert_id")], "line", CONTEXT_BYTES)


@query(with_(ALERTS) + """SELECT 'gold.csv' AS name, count(*) AS rows, sha256('alert_id,rule_id,severity,note' || chr(10) || string_agg(line || chr(10), '' ORDER BY alert_id)) AS sha256 FROM (
  SELECT alert_id, alert_id || ',' || rule_id || ',' || severity || ',' || CASE WHEN alert_user IS NULL THEN '' ELSE chr(34) || alert_user || ', ' || chr(34) || chr(34) || 'x' || chr(34) || chr(34) || chr(34) END AS line FROM alerts WHERE k % 3 = 1 AND status = 'escalated')""")
def frozen_outputs(t):
    """Chosen alerts as one canonical file: its rows and hash."""
    gold = M.alerts(t).filter("k % 3 = 1 and status = 'escalated'").select("alert_id", "rule_id", "severity", F.concat("alert_user", F.lit(', "x"')).alias("note"))
    path = scratch.path(t.spark, "gold")
    entry = freeze.freeze(gold, path, "gold.csv", ["alert_id"])
    freeze.manifest(path, [entry])
    return t.spark.read.schema("name string, rows long, sha256 string").option("multiLine", True).json(f"{path}/manifest.json")


@query(with_(PREDICTIONS) + """SELECT change, columns, count(*) AS n FROM (SELECT CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN a.doc_id IS NULL OR b.doc_id IS NULL THEN '' ELSE 'label' END AS columns FROM (SELECT doc_id, verdict FROM predictions WHERE doc_id % 7 > 0) a FULL JOIN (SELECT doc_id, second AS verdict FROM predictions WHERE doc_id % 7 < 6) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.verdict IS DISTINCT FROM b.verdict) GROUP BY ALL""")
def gold_changes(t):
    """What differs between two versions of labels."""
    p = M.predictions(t)
    old, new = (p.filter(which).select("doc_id", "lang", F.col(c).alias("label")) for which, c in (("doc_id % 7 > 0", "verdict"), ("doc_id % 7 < 6", "second")))
    return freeze.version_diff(old, new, ["doc_id"]).groupBy("change", F.array_join("columns", ",").alias("columns")).agg(F.count("*").alias("n"))


_A, _B = evaluate.Z_ERROR, evaluate.Z_POWER


@query(with_(PREDICTIONS) + f"""SELECT lang, n, discordant, round(pow({_A} * sqrt(discordant) + {_B} * sqrt(discordant - 0.0025), 2) / 0.0025, 6) AS pairs_for_5_percent,
  round(least(discordant, ({_A} * sqrt(n * discordant) + sqrt({_A * _A} * n * discordant - (n + {_B * _B}) * discordant * ({_A * _A} - {_B * _B}))) / (n + {_B * _B})), 9) AS least_difference
  FROM (SELECT lang, count(*) AS n, count(*) FILTER (WHERE verdict IS DISTINCT FROM second) * 1.0 / count(*) AS discordant FROM predictions GROUP BY lang)""")
def power_by_language(t):
    """How many pairs a paired test of two runs needs, and what difference the pairs at hand let it see."""
    g = M.predictions(t).groupBy("lang").agg(F.count("*").alias("n"), (F.count_if(~F.col("verdict").eqNullSafe(F.col("second"))) / F.count("*")).alias("discordant"))
    return g.select("lang", "n", "discordant", F.round(evaluate.pairs_needed(F.lit(0.05), F.col("discordant")), 6).alias("pairs_for_5_percent"), F.round(evaluate.least_difference(F.col("n"), F.col("discordant")), 9).alias("least_difference"))


@query()
def paired_delta_interval(t):
    """The interval of the difference in macro-F1 of two runs; held against resampled rows in tests."""
    return evaluate.paired_delta(M.predictions(t).select("truth", F.col("verdict").alias("first"), "second"))
