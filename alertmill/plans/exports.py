"""Queries of intake files and exports: archives, search hits, feeds, CSV, dumps, ids, trailing windows, cleaned texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertmill.functions import scalar as S
from alertmill.functions import textsafety as T
from alertmill.plans import model as M
from alertmill.plans.extra import K, REJECTED, raw_alerts
from alertmill.plans.model import ALERTS, DIMENSIONS, NOW, with_
from alertmill.plans.registry import query
from alertmill.sources import alerts as A
from alertmill.sources import freeze, intel, scratch


@query(f"SELECT coalesce({REJECTED}, 'accepted') AS outcome, CASE WHEN {REJECTED} IS NULL THEN event_type END AS rule_id, count(*) AS n FROM {K} GROUP BY ALL")
def archive_read(t):
    """Raw alerts written as an archive of one a line, with blank lines, and read back."""
    path = scratch.path(t.spark, "archive")
    raw_alerts(t).select(F.when(F.col("event_id") % 2 == 0, F.concat("value", F.lit("\n"))).otherwise(F.col("value")).alias("value")).write.text(path)
    read = A.read_archive(t.spark, path)
    return read.groupBy(F.coalesce("rejected", F.lit("accepted")).alias("outcome"), F.when(F.col("rejected").isNull(), F.col("rule_id")).alias("rule_id")).agg(F.count("*").alias("n"))


@query(f"SELECT event_id AS alert_id, event_type AS rule_id FROM {K} WHERE {REJECTED} IS NULL AND event_id % 4 < 3")
def new_hits(t):
    """Alerts of result pages that are not stored yet: pages of a hundred hits, some of them twice."""
    raw = raw_alerts(t).filter("value like '{%'").select("event_id", F.explode(F.when(F.col("event_id") % 5 == 0, F.array("value", "value")).otherwise(F.array("value"))).alias("value"))
    pages = raw.groupBy(F.floor(F.col("event_id") / 100).alias("page")).agg(F.concat(F.lit('{"hits":{"hits":['), F.array_join(F.collect_list("value"), ","), F.lit("]}}")).alias("value"))
    rows = A.accepted(A.parse(A.search_hits(pages))).select(F.col("alert_id").cast("long").alias("alert_id"), "rule_id", F.lit("m").alias("manager_id"))
    stored = t.events.filter("event_id % 4 = 3").select(F.col("event_id").alias("alert_id"), F.lit("m").alias("manager_id"))
    return A.new_only(rows, stored).select("alert_id", "rule_id")


FEED = """WITH old AS (SELECT 'urlhaus' AS source, 'domain' AS type, 'd' || p_partkey % 500 || '.com' AS value, min(p_partkey * 1000) AS first_seen, min(p_size % 10) AS confidence FROM part WHERE p_partkey % 3 > 0 GROUP BY 3),
  new AS (SELECT 'urlhaus' AS source, 'domain' AS type, 'd' || p_partkey % 700 || '.com' AS value, min(p_partkey * 900) AS first_seen, max(p_size % 10) AS confidence FROM part WHERE p_partkey % 3 < 2 GROUP BY 3)
  SELECT coalesce(o.value, n.value) AS value, CASE WHEN n.value IS NULL THEN o.first_seen WHEN o.value IS NULL THEN n.first_seen ELSE least(o.first_seen, n.first_seen) END AS first_seen, CAST(coalesce(n.confidence, o.confidence) AS VARCHAR) AS confidence,
    CASE WHEN n.value IS NULL THEN 'kept' WHEN o.value IS NULL THEN 'new' ELSE 'updated' END AS change FROM old o FULL JOIN new n ON o.value = n.value"""


@query(FEED)
def feed_upsert(t):
    """A stored feed after a load that is written as CSV and read back."""
    k = F.col("p_partkey")

    def side(which, modulus, factor, confidence):
        value = F.concat(F.lit("d"), (k % modulus).cast("string"), F.lit(".com")).alias("value")
        return t.part.filter(which).groupBy(F.lit("urlhaus").alias("source"), F.lit("domain").alias("type"), value).agg(F.min(k * factor).alias("first_seen"), confidence(F.col("p_size") % 10).cast("string").alias("confidence"))

    path = scratch.path(t.spark, "feed")
    load = side("p_partkey % 3 < 2", 700, 900, F.max)
    load.select(*(F.col(c).cast("string").alias(c) if c in load.columns else F.lit(None).cast("string").alias(c) for c in intel.COLUMNS)).write.csv(path, header=True)
    read = intel.read_feed(t.spark, path).filter("malformed is null").select("source", "type", "value", F.col("first_seen").cast("long").alias("first_seen"), "confidence")
    return intel.upsert(side("p_partkey % 3 > 0", 500, 1000, F.min), read).select("value", "first_seen", "confidence", "change")


@query(with_(DIMENSIONS) + f"""SELECT 'iocs.csv' AS name, count(*) AS rows, sha256(chr(65279) || 'k,value,note,tags,expires,expired' || chr(13) || chr(10) || string_agg(line || chr(13) || chr(10), '' ORDER BY k)) AS sha256 FROM (
  SELECT s_suppkey AS k, s_suppkey || ',10.0.0.' || s_suppkey % 60 || ',' || CASE s_suppkey % 4 WHEN 0 THEN '''=1+1' WHEN 1 THEN ''' @x' WHEN 2 THEN '' ELSE chr(34) || 'a, ' || chr(34) || chr(34) || 'b' || chr(34) || chr(34) || chr(34) END || ',' || chr(34) || 't' || s_suppkey % 3 || ',u' || chr(34) || ','
    || strftime(make_timestamp({NOW} + (s_suppkey % 5 - 2) * 86400000000), '%Y-%m-%dT%H:%M:%S+00:00') || ',' || CASE WHEN s_suppkey % 5 - 2 <= 0 THEN 'true' ELSE 'false' END AS line FROM supplier)""")
def iocs_exported(t):
    """Indicators as they are served, exported for spreadsheets: the hash of the file."""
    k = F.col("s_suppkey")
    note = F.element_at(F.array(F.lit("=1+1"), F.lit(" @x"), F.lit(None).cast("string"), F.lit('a, "b"')), (k % 4 + 1).cast("int"))
    feed = t.supplier.select(k.alias("k"), F.concat(F.lit("10.0.0."), (k % 60).cast("string")).alias("value"), note.alias("note"), F.array(F.concat(F.lit("t"), (k % 3).cast("string")), F.lit("u")).alias("tags"), (F.lit(NOW) + (k % 5 - 2).cast("long") * M.DAY).alias("expires"))
    path = scratch.path(t.spark, "export")
    freeze.manifest(path, [freeze.export(intel.served(feed, NOW), path, "iocs.csv", ["k"])])
    return t.spark.read.schema("name string, rows long, sha256 string").option("multiLine", True).json(f"{path}/manifest.json")


@query(f"""SELECT event_id, CASE WHEN k % 5 = 0 THEN NULL ELSE '{{"a":[{{"x":' || k || ',"y":null}},"é"],"b":' || event_id || ',"z":{{"n":1,"o":true}}}}' END AS dump, k % 3 = 0 AS is_id FROM {K}""")
def sorted_dumps(t):
    """Documents with their keys in order, and which texts are alert ids."""
    e = t.events.withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    k, i = F.col("k").cast("string"), F.col("event_id").cast("string")
    text = F.concat(F.lit('{"z": {"o": true, "n": 1}, "b": '), i, F.lit(', "a": [{"y": null, "x": '), k, F.lit('}, "é"]'), F.when(F.col("k") % 5 == 0, "").otherwise("}"))
    ids = F.when(F.col("k") % 3 == 0, F.concat(i, F.lit("."), k)).when(F.col("k") % 3 == 1, F.concat(i, F.lit("."), k, F.lit("\n"))).otherwise(F.concat(F.lit("gl-"), i))
    return e.select("event_id", S.sorted_json(text).alias("dump"), S.is_alert_id(ids).alias("is_id"))


TRAILING = {"1h": M.HOUR, "24h": M.DAY, "7d": 7 * M.DAY, "30d": 30 * M.DAY}


@query(with_(ALERTS, "last AS (SELECT max(t) AS now FROM alerts)") + "\nUNION ALL\n".join(f"SELECT source, '{name}' AS span, count(*) FILTER (WHERE t > now - {width}) AS n, count(*) FILTER (WHERE t > now - {2 * width} AND t <= now - {width}) AS before FROM alerts, last GROUP BY source" for name, width in TRAILING.items()))
def trailing_windows(t):
    """Counts of the last hour, day, week and month before the newest alert, and of as much before that."""
    a = M.alerts(t)
    now = a.agg(F.max("t").alias("now"))  # one row
    age = F.col("now") - F.col("t")
    counts = F.array(*(F.struct(F.lit(name).alias("span"), F.count_if(age < width).alias("n"), F.count_if((age >= width) & (age < 2 * width)).alias("before")) for name, width in TRAILING.items()))
    return a.crossJoin(F.broadcast(now)).groupBy("source").agg(counts.alias("c")).select("source", F.inline("c"))


@query("""SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), '''', '&#x27;')) AS escaped, true AS storable, sha256(text) AS visible FROM documents""")
def texts_cleaned(t):
    """Whole documents escaped for a page, checked for storage, and without invisible characters that are put into them."""
    shown = T.without_invisible(F.concat(F.lit("​"), "text", F.lit("⁠﻿")))
    return t.documents.select("doc_id", F.sha2(T.html_escaped(F.col("text")), 256).alias("escaped"), S.stable_text(F.col("text")).alias("storable"), F.sha2(shown, 256).alias("visible"))
