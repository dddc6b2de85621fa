"""The tables that the queries read: alerts, runs, dimensions and logs as views of the star schema at hand.

Each view is here twice, as a DataFrame and as a DuckDB CTE, with the same columns. Times are microseconds since 1970 in
`t` columns, so that no session time zone matters; `as_of` instants are parameters, never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.functions import scalar as S

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000
#: 2024-01-31T00:00:00Z, after all alerts.
NOW = 1_706_659_200_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


class Tables:
    """Lazily read tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def alerts(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    a = t.events.select(F.col("event_id").alias("alert_id"), micros(F.col("ts")).alias("t"), F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("agent_name"), F.col("event_type").alias("rule_id"), k.alias("k"), F.col("value"))
    a = a.withColumns({
        "rule_level": F.col("k") % 16,
        "srcip": F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("10.0.0."), (F.col("k") % 50).cast("string"))),
        "dstip": F.concat(F.lit("192.0.2."), (F.col("k") % 7).cast("string")),
        "alert_user": F.when(F.col("k") % 3 != 0, F.concat(F.lit("user"), (F.col("k") % 20).cast("string"))),
        "source": S.chosen(F.col("k") % 3, {0: "wazuh", 1: "lab", 2: "replay"}),
        "is_synthetic": F.col("k") % 97 == 0,
        "key_hash": F.sha2(F.col("alert_id").cast("string"), 256),
        "status": S.chosen(F.col("k") % 5, {0: "queued", 1: "auto_closed", 2: "closed", 3: "escalated", 4: "queued"}),
        "triage_status": S.chosen(F.col("k") % 4, {0: "pending", 1: "done", 2: "failed", 3: "done"}),
        "triaged_count": F.col("k") % 4,
        "occurrence_count": 1 + (F.col("k") * 7) % 250,
        "acked": F.when(F.col("k") % 4 != 0, F.col("t") + (F.col("k") % 60).cast("long") * MINUTE),
        "decided": F.when(F.col("k") % 5 == 2, F.col("t") + (60 + F.col("k") % 90).cast("long") * MINUTE),
    })
    return a.withColumns({"severity": S.severity(F.col("rule_level")), "visible": S.suggestion_visible(F.col("key_hash"))})


ALERTS = """
alerts AS (
  SELECT *, CASE WHEN rule_level >= 12 THEN 'critical' WHEN rule_level >= 8 THEN 'high' WHEN rule_level >= 5 THEN 'medium' ELSE 'low' END AS severity,
    CAST('0x' || substr(key_hash, 1, 8) AS BIGINT) % 2 = 0 AS visible
  FROM (
    SELECT event_id AS alert_id, epoch_us(ts) AS t, 'host-' || user_id AS agent_name, event_type AS rule_id, k, value, k % 16 AS rule_level,
      CASE WHEN k % 5 = 0 THEN '' ELSE '10.0.0.' || (k % 50) END AS srcip, '192.0.2.' || (k % 7) AS dstip,
      CASE WHEN k % 3 <> 0 THEN 'user' || (k % 20) END AS alert_user,
      CASE k % 3 WHEN 0 THEN 'wazuh' WHEN 1 THEN 'lab' ELSE 'replay' END AS source, k % 97 = 0 AS is_synthetic,
      sha256(CAST(event_id AS VARCHAR)) AS key_hash,
      CASE k % 5 WHEN 1 THEN 'auto_closed' WHEN 2 THEN 'closed' WHEN 3 THEN 'escalated' ELSE 'queued' END AS status,
      CASE k % 4 WHEN 0 THEN 'pending' WHEN 2 THEN 'failed' ELSE 'done' END AS triage_status,
      k % 4 AS triaged_count, 1 + (k * 7) % 250 AS occurrence_count,
      CASE WHEN k % 4 <> 0 THEN epoch_us(ts) + (k % 60)::BIGINT * 60000000 END AS acked,
      CASE WHEN k % 5 = 2 THEN epoch_us(ts) + (60 + k % 90)::BIGINT * 60000000 END AS decided
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
  )
)"""


def assets(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    return t.nation.select(F.concat(F.lit("host-"), (n * 3).cast("string")).alias("hostname"), S.chosen(n % 4, {0: "high", 1: "medium", 2: "low", 3: "unknown"}).alias("criticality"), F.col("n_name").alias("owner"), (n % 11 != 10).alias("active"))


def identities(t: Tables) -> DataFrame:
    return t.customer.filter("c_custkey < 15").select(F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("username"), (F.col("c_nationkey") % 4 == 0).alias("is_privileged"), F.lit(True).alias("active"))


def iocs(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(
        F.when(k % 2 == 0, F.concat(F.lit("192.0.2."), (k % 7).cast("string"))).otherwise(F.concat(F.lit("10.0.0."), (k % 60).cast("string"))).alias("value"),
        F.concat(F.lit("feed"), (k % 3).cast("string")).alias("source"),
        S.chosen(k % 9, {0: "malicious", 4: "suspicious"}, "clean").alias("reputation"),
        (F.lit(NOW) + (k % 5 - 2).cast("long") * DAY).alias("expires"),
    )


DIMENSIONS = """
assets AS (SELECT 'host-' || (n_nationkey * 3) AS hostname, CASE n_nationkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'unknown' END AS criticality, n_name AS owner, n_nationkey % 11 <> 10 AS active FROM nation),
identities AS (SELECT 'user' || c_custkey AS username, c_nationkey % 4 = 0 AS is_privileged, true AS active FROM customer WHERE c_custkey < 15),
iocs AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN '192.0.2.' || (s_suppkey % 7) ELSE '10.0.0.' || (s_suppkey % 60) END AS value, 'feed' || (s_suppkey % 3) AS source,
  CASE s_suppkey % 9 WHEN 0 THEN 'malicious' WHEN 4 THEN 'suspicious' ELSE 'clean' END AS reputation, 1706659200000000 + (s_suppkey % 5 - 2) * 86400000000 AS expires FROM supplier)"""


def runs(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    return t.lineitem.select(
        (F.col("l_orderkey") * 10_000_000 + n * 1_000_000 + F.col("l_partkey")).alias("run_id"),
        F.col("l_orderkey").alias("subject_id"),
        S.chosen(n % 3, {0: "proposer", 1: "verifier"}).alias("role"),
        S.chosen(n % 2, {0: "tier1", 1: "tier2"}).alias("pipeline"),
        micros(F.col("l_shipdate")).alias("created"),
        (F.col("l_quantity") * 100).cast("int").alias("latency_ms"),
        F.col("l_tax").cast("decimal(10,5)").alias("cost_usd"),
        F.col("l_extendedprice").cast("int").alias("input_tokens"),
        S.chosen(F.col("l_returnflag"), {"A": "escalate", "N": "needs_review", "R": "false_positive"}).alias("verdict"),
        F.when(F.col("l_linestatus") == "F", "budget").alias("stopped_by"),
        F.concat(F.lit("model-"), (F.col("l_suppkey") % 3).cast("string")).alias("model_id"),
        F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n % 4)), lambda i: F.concat(F.lit('"s'), i.cast("string"), F.lit('"'))), ","), F.lit("]")).alias("flagged_by"),
        (F.col("l_partkey") % 5 == 0).alias("forced"),
    )


RUNS = """
runs AS (
  SELECT l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS run_id, l_orderkey AS subject_id, CASE l_linenumber % 3 WHEN 0 THEN 'proposer' WHEN 1 THEN 'verifier' END AS role,
    CASE l_linenumber % 2 WHEN 0 THEN 'tier1' ELSE 'tier2' END AS pipeline, epoch_us(l_shipdate) AS created, CAST(l_quantity * 100 AS INTEGER) AS latency_ms,
    CAST(l_tax AS DECIMAL(10,5)) AS cost_usd, CAST(trunc(l_extendedprice) AS INTEGER) AS input_tokens,
    CASE l_returnflag WHEN 'A' THEN 'escalate' WHEN 'N' THEN 'needs_review' WHEN 'R' THEN 'false_positive' END AS verdict,
    CASE WHEN l_linestatus = 'F' THEN 'budget' END AS stopped_by, 'model-' || (l_suppkey % 3) AS model_id,
    '[' || array_to_string(list_transform(range(1, greatest(1, l_linenumber % 4) + 1), lambda x: '"s' || x || '"'), ',') || ']' AS flagged_by, l_partkey % 5 = 0 AS forced
  FROM lineitem
)"""


def cases(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("opened_by"), S.chosen(F.col("o_orderstatus"), {"O": "investigating", "P": "investigating"}, "concluded").alias("status"), micros(F.col("o_orderdate")).alias("created"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_totalprice").alias("amount"))


CASES = """
cases AS (SELECT o_orderkey AS case_id, o_custkey AS opened_by, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'investigating' ELSE 'concluded' END AS status, epoch_us(o_orderdate) AS created,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_totalprice AS amount FROM orders)"""


def lab_windows(t: Tables) -> DataFrame:
    """Disjoint spans of six hours, one every second day."""
    return t.nation.filter("n_nationkey < 14").select(F.col("n_nationkey").alias("run_id"), (F.lit(NOW - 30 * DAY) + F.col("n_nationkey").cast("long") * 2 * DAY).alias("starts"), (F.lit(NOW - 30 * DAY) + F.col("n_nationkey").cast("long") * 2 * DAY + 6 * HOUR).alias("ends"))


LAB = """lab_windows AS (SELECT n_nationkey AS run_id, 1706659200000000 - 30 * 86400000000 + n_nationkey * 2 * 86400000000 AS starts,
  1706659200000000 - 30 * 86400000000 + n_nationkey * 2 * 86400000000 + 6 * 3600000000 AS ends FROM nation WHERE n_nationkey < 14)"""


def predictions(t: Tables) -> DataFrame:
    """Truth and verdict by document: labels, and a verdict that depends on the source and length."""
    d = t.labels.join(t.documents.groupBy("doc_id").agg(F.min("source").alias("source"), F.min("lang").alias("lang"), F.min("n_chars").alias("n_chars")), "doc_id")
    n = F.col("n_chars") % 10
    return d.select("doc_id", F.when(F.col("toxic") == 1, "escalate").otherwise("benign").alias("truth"), F.when(n == 0, F.lit(None)).when(n < 3, "escalate").when(n < 5, "needs_review").when((n < 7) & (F.col("toxic") == 1), "escalate").otherwise("benign").alias("verdict"), "lang", "source", F.when(n % 2 == 0, "escalate").otherwise("benign").alias("second"), (F.col("n_chars") % 101 / 100.0).alias("score"))


PREDICTIONS = """predictions AS (
  SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'escalate' ELSE 'benign' END AS truth,
    CASE WHEN n_chars % 10 = 0 THEN NULL WHEN n_chars % 10 < 3 THEN 'escalate' WHEN n_chars % 10 < 5 THEN 'needs_review' WHEN n_chars % 10 < 7 AND toxic = 1 THEN 'escalate' ELSE 'benign' END AS verdict,
    lang, source, CASE WHEN n_chars % 2 = 0 THEN 'escalate' ELSE 'benign' END AS second, n_chars % 101 / 100.0 AS score
  FROM labels l JOIN (SELECT doc_id, min(source) AS source, min(lang) AS lang, min(n_chars) AS n_chars FROM documents GROUP BY doc_id) d ON l.doc_id = d.doc_id
)"""


def with_(*views: str) -> str:
    return "WITH " + ",\n".join(v.strip() for v in views) + "\n"
