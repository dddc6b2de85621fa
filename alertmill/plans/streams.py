"""Queries that run a stream over the tables to its end and hold what it has written against SQL."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.functions import scalar as S
from alertmill.operators import lifecycle
from alertmill.plans import model as M
from alertmill.plans.analysis import AGE, FOLD, GAP, SIZE, recursive
from alertmill.plans.model import ALERTS, Tables, with_
from alertmill.plans.registry import query
from alertmill.sources import pull, scratch
from alertmill.streaming import clusters, late
from alertmill.streaming import notices as N


@contextmanager
def state_store(spark: SparkSession):
    """RocksDB as the state store: keyed state with timers needs it, and keys that are kept need not fit in memory."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, clusters.STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run(stream: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows of a stream run to its end, and its checkpoint."""
    spark = stream.sparkSession
    out, mark = scratch.path(spark, name), scratch.path(spark, f"{name}-log")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), mark


# --- pull -------------------------------------------------------------------------------------------


def search_rows(t: Tables) -> DataFrame:
    """Alerts as a search index holds them; every 41st is a heartbeat."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    rule = F.struct(F.when(k % 41 == 0, "100999").otherwise(F.col("event_type")).alias("id"))
    body = F.struct(F.col("event_id").cast("string").alias("id"), rule.alias("rule"), F.struct(F.concat(F.lit("m"), (k % 3).cast("string")).alias("name")).alias("manager"))
    return t.events.select((F.floor(M.micros(F.col("ts")) / 1000)).alias("sort_ms"), F.col("event_id").alias("id"), F.to_json(body).alias("value"))


@query("""SELECT epoch_us(ts) // 1000 // 3600000 AS hour, 'm' || k % 3 AS manager_id, k % 41 = 0 AS heartbeat, count(*) AS n, CAST(min(epoch_us(ts) // 1000) AS BIGINT) AS first_ms, CAST(sum(event_id) AS BIGINT) AS ids
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY ALL""")
def pulled_alerts(t):
    """All alerts, recorded as pages of a search index and pulled as a stream that stops and goes on with its overlap."""
    pages, out, mark = (scratch.path(t.spark, f"pull-{x}") for x in ("pages", "rows", "log"))
    pull.record_pages(search_rows(t), pages)
    options = {"pages": pages, "page_size": 400, "overlap_s": 3600}
    for _ in range(2):  # the second start reads the overlap again and adds nothing
        with state_store(t.spark):
            pull.ingest(t.spark, out, mark, **options).awaitTermination()
    rows = t.spark.read.schema(pull.SCHEMA).parquet(out)
    return rows.groupBy(F.floor(F.col("sort_ms") / 3_600_000).alias("hour"), "manager_id", "heartbeat").agg(F.count("*").alias("n"), F.min("sort_ms").alias("first_ms"), F.sum(F.col("source_alert_id").cast("long")).alias("ids"))


# --- clusters with timers ---------------------------------------------------------------------------

TOLERANCE = M.HOUR


@query(recursive(with_(ALERTS, FOLD)) + f"""SELECT rule_id, agent_name, first_id, first_seen, last_seen, n,
  coalesce(closed_by, CASE WHEN (last_seen + {GAP}) // 1000 + 1 <= (SELECT max(t) // 1000 FROM alerts) - {TOLERANCE // 1000} THEN 'idle_gap' END) AS closed_by FROM closed""")
def stream_idle_clusters(t):
    """The cluster fold as a stream in event time: clusters end by a timer once the watermark has passed their idle gap, without
    a later alert; those still open at the end have no closed_by."""
    with state_store(t.spark):
        events = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events*").parquet(t.sf_dir)
        rows = events.select(F.col("event_type").alias("rule_id"), F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("agent_name"), M.micros(F.col("ts")).alias("t"), F.col("event_id").alias("alert_id"), F.col("ts").cast("timestamp").alias("at"))
        stream = clusters.closed_clusters(rows, ("rule_id", "agent_name"), GAP, AGE, SIZE, clock="event", event_time="at", tolerance=f"{TOLERANCE // 1_000_000} seconds")
        closed, mark = run(stream, "idle")
        return closed.unionByName(scratch.written(clusters.open_clusters(t.spark, mark, ("rule_id", "agent_name")), "open"))


# --- late rows --------------------------------------------------------------------------------------

SLOTS, LATE_AFTER = 4, 10 * M.DAY


@query(with_(ALERTS) + f"""SELECT slot, late, count(*) AS n, CAST(sum(alert_id) AS BIGINT) AS ids FROM (
  SELECT a.slot, alert_id, coalesce(t < before - {LATE_AFTER}, false) AS late FROM (SELECT *, (k * 7 + t // 86400000000 // 8) % {SLOTS} AS slot FROM alerts) a
  JOIN (SELECT s.slot, max(t) AS before FROM (SELECT unnest(range({SLOTS})) AS slot) s LEFT JOIN (SELECT t, (k * 7 + t // 86400000000 // 8) % {SLOTS} AS own FROM alerts) o ON o.own < s.slot GROUP BY s.slot) b ON a.slot = b.slot) GROUP BY ALL""")
def late_rows(t):
    """Alerts that arrive in four batches, parted into those on time and those late for what had come before."""
    slot = (F.col("k") * 7 + F.floor(F.floor(F.col("t") / M.DAY) / 8)) % SLOTS
    rows = M.alerts(t).select("alert_id", "t", slot.cast("long").alias("slot"))
    path = scratch.path(t.spark, "late")
    split = late.LateSplit(path, "t", LATE_AFTER)
    source, mark = scratch.path(t.spark, "late-in"), scratch.path(t.spark, "late-log")
    for k in range(SLOTS):
        rows.filter(F.col("slot") == k).write.mode("append").parquet(source)
        t.spark.readStream.schema(rows.schema).parquet(source).writeStream.foreachBatch(split).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    kind = "alert_id long, t long, slot long"
    both = split.table(t.spark, kind, False).withColumn("late", F.lit(False)).unionByName(split.table(t.spark, kind, True).withColumn("late", F.lit(True)))
    return both.groupBy("slot", "late").agg(F.count("*").alias("n"), F.sum("alert_id").alias("ids"))


# --- review notices ---------------------------------------------------------------------------------


def notice_rows(t: Tables) -> DataFrame:
    n = F.col("l_linenumber").cast("long")
    status = S.chosen((F.col("l_partkey") + n) % 9, {0: "kept", 3: "kept", 5: "undone", 7: "false_positive", 8: "info"}, "open")
    return t.lineitem.select(
        F.col("l_orderkey").alias("id"), (n * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("arrival"), (M.micros(F.col("l_shipdate")) + n * M.DAY * 12).alias("sent_at"), status.alias("status"),
        F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("u"), (F.col("l_suppkey") % 7).cast("string"))).alias("decided_by"),
        F.when(F.col("l_suppkey") % 2 == 0, M.micros(F.col("l_shipdate")) + (F.col("l_suppkey") % 90).cast("long") * M.DAY).alias("decided_at"),
        F.when(F.col("l_suppkey") % 5 == 0, F.col("l_returnflag")).alias("result"),
    )


_TERMINAL = ", ".join(f"'{s}'" for s in lifecycle.TERMINAL)
NOTICES = f"""raw AS (SELECT l_orderkey AS id, l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey AS arrival, epoch_us(l_shipdate) + l_linenumber::BIGINT * 12 * 86400000000 AS sent_at,
  CASE (l_partkey + l_linenumber) % 9 WHEN 0 THEN 'kept' WHEN 3 THEN 'kept' WHEN 5 THEN 'undone' WHEN 7 THEN 'false_positive' WHEN 8 THEN 'info' ELSE 'open' END AS status,
  CASE WHEN l_suppkey % 3 = 0 THEN 'u' || l_suppkey % 7 END AS decided_by, CASE WHEN l_suppkey % 2 = 0 THEN epoch_us(l_shipdate) + (l_suppkey % 90)::BIGINT * 86400000000 END AS decided_at,
  CASE WHEN l_suppkey % 5 = 0 THEN l_returnflag END AS result FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrival) AS i FROM raw),
f AS (
  SELECT id, i, arrival, 'created' AS outcome, CAST(NULL AS VARCHAR) AS reason, sent_at AS last_sent, status AS stored_status, decided_by AS stored_decided_by, decided_at AS stored_decided_at, result AS stored_result FROM n WHERE i = 1
  UNION ALL
  SELECT id, i, arrival, CASE WHEN why IS NULL THEN 'updated' ELSE 'ignored' END, why, CASE WHEN why IS NULL THEN sent_at ELSE last_sent END, CASE WHEN why IS NULL THEN status ELSE stored_status END,
    CASE WHEN why IS NULL THEN coalesce(decided_by, stored_decided_by) ELSE stored_decided_by END, CASE WHEN why IS NULL THEN coalesce(decided_at, stored_decided_at) ELSE stored_decided_at END, CASE WHEN why IS NULL THEN coalesce(result, stored_result) ELSE stored_result END
  FROM (SELECT n.*, f.* EXCLUDE (id, i, arrival), CASE WHEN n.sent_at < f.last_sent THEN 'stale' WHEN n.status = 'open' AND f.stored_status IN ({_TERMINAL}) THEN 'terminal'
      WHEN n.status = 'open' AND f.stored_status = 'kept' AND f.stored_decided_at > n.sent_at THEN 'decided' END AS why FROM f JOIN n ON n.id = f.id AND n.i = f.i + 1)
)"""
APPLIED = ", ".join(["id", "arrival", *(c.split()[0] for c in lifecycle.APPLIED.split(", "))])


@query(recursive(with_(NOTICES)) + f"SELECT {APPLIED} FROM f")
def notices_applied(t):
    """Review notices applied in order of arrival, in one pass."""
    return lifecycle.notices(notice_rows(t))


@query(recursive(with_(NOTICES)) + "SELECT outcome, reason, stored_status, count(*) AS n, count(stored_decided_by) AS decided, count(stored_decided_at) AS dated, CAST(sum(last_sent // 1000000) AS BIGINT) AS sent FROM f GROUP BY ALL")
def notices_streamed(t):
    """The same as a stream of three batches; each goes on from the tickets that the one before has left."""
    rows = scratch.written(notice_rows(t), "notices")
    source, out, mark = (scratch.path(t.spark, f"notices-{x}") for x in ("in", "out", "log"))
    batches = N.AppliedBatches(out, "id long, arrival long")
    for low, high in ((0, 3), (3, 5), (5, 1000)):
        rows.filter((F.col("arrival") >= low * 10**12) & (F.col("arrival") < high * 10**12)).write.mode("append").parquet(source)
        t.spark.readStream.schema(rows.schema).parquet(source).writeStream.foreachBatch(batches).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return batches.applied(t.spark).groupBy("outcome", "reason", "stored_status").agg(F.count("*").alias("n"), F.count("stored_decided_by").alias("decided"), F.count("stored_decided_at").alias("dated"), F.sum(F.floor(F.col("last_sent") / 1_000_000)).alias("sent"))
