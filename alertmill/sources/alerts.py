"""Raw alert JSON to flat typed rows, with a named reason for what is rejected; archives, feeds and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill import params as P
from alertmill.functions import scalar as S
from alertmill.functions.networks import is_private6
from alertmill.functions.textsafety import utf8_truncated

#: All leaves are text: what can't be read as its type becomes its default, and never fails a row.
ALERT = """id string, timestamp string, full_log string, previous_output string,
  rule struct<id:string,level:string,description:string,groups:array<string>,mitre:struct<id:array<string>>>,
  agent struct<id:string,name:string,ip:string>, manager struct<name:string>, predecoder struct<hostname:string>, decoder struct<name:string,parent:string>,
  data struct<srcip:string,dstip:string,srcport:string,dstport:string,srcuser:string,dstuser:string,win:struct<system:struct<message:string,systemTime:string>,
    eventdata:struct<ipAddress:string,sourceIp:string,destinationIp:string,ipPort:string,sourcePort:string,destinationPort:string,targetUserName:string,subjectUserName:string,user:string>>>,
  timing struct<event_time:string>, enrichment struct<asset:struct<user:string>>"""
#: The order in which mandatory fields are checked.
REQUIRED = (("id", "missing_id"), ("rule.id", "missing_rule_id"), ("rule.description", "missing_description"), ("timestamp", "missing_timestamp"))
#: Addresses that stand for none.
EMPTY_ADDRESSES = ("-", "::1", "127.0.0.1", "0.0.0.0", "::")


def _text(path: str) -> Column:
    return F.nullif(F.trim(F.col(f"a.{path}")), F.lit(""))


def _address(path: str) -> Column:
    c = _text(path)
    return F.when(~c.isin(*EMPTY_ADDRESSES), c)


def _account(path: str) -> Column:
    """Without its domain; machine accounts (ending in $) are none."""
    c = S.without_domain(_text(path))
    return F.when(~c.endswith("$"), F.nullif(c, F.lit("")))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns that are worked out once a row: a generator of one row, which no filter or projection above it
    is moved through and copied into."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def parse(raw: DataFrame, column: str = "value") -> DataFrame:
    """A row for each raw text: its alert's fields, or `rejected` with the reason (not_json first, then REQUIRED)."""
    body = F.coalesce(F.get_json_object(column, "$._source"), F.col(column))
    is_json = F.get_json_object(column, "$").isNotNull() & F.col(column).rlike(r"^\s*\{")
    out = _once(_once(raw, _body=body, _json=is_json), a=F.from_json("_body", ALERT))
    reason = F.when(~F.coalesce("_json", F.lit(False)), "not_json")
    for path, name in REQUIRED:
        reason = reason.when(_text(path).isNull(), name)
    reason = reason.when(S.iso_instant(F.col("a.timestamp")).isNull(), "bad_timestamp")
    win = "data.win.eventdata"
    srcip = F.coalesce(_text("data.srcip"), _address(f"{win}.ipAddress"), _address(f"{win}.sourceIp"), F.lit(""))
    dstip = F.coalesce(_text("data.dstip"), _address(f"{win}.destinationIp"), F.lit(""))
    port = lambda *paths: S.safe_int(F.coalesce(*map(_text, paths)))
    level = S.safe_int(F.col("a.rule.level"))
    dst_port = port("data.dstport", f"{win}.destinationPort")
    log = F.coalesce(F.col("a.full_log"), F.col("a.data.win.system.message"), F.col("_body"))
    found = S.categories(F.col("a.rule.mitre.id"), F.col("a.rule.groups"), F.col("a.decoder.name"), dst_port)
    out = _once(out, rejected=reason, _level=level, _log=log, _found=found, _time=S.iso_instant(F.col("a.timestamp")), _src=srcip, _dst=dstip)
    out = out.select(
        *raw.columns,
        "rejected",
        _text("id").alias("alert_id"),
        _text("rule.id").alias("rule_id"),
        F.col("_level").alias("rule_level"),
        S.severity(F.col("_level")).alias("severity"),
        F.col("a.rule.description").alias("description"),
        F.coalesce(_text("agent.name"), _text("manager.name"), F.lit("unknown")).alias("agent_name"),
        _text("agent.id").alias("agent_id"),
        _text("predecoder.hostname").alias("origin_host"),
        F.col("_time").alias("alert_time"),
        F.coalesce(S.iso_instant(F.col("a.timing.event_time")), S.iso_instant(F.col("a.data.win.system.systemTime"))).alias("event_time"),
        F.col("_src").alias("srcip"),
        F.col("_dst").alias("dstip"),
        port("data.srcport", f"{win}.ipPort", f"{win}.sourcePort").alias("src_port"),
        dst_port.alias("dst_port"),
        F.coalesce(_account("data.dstuser"), _account("data.srcuser"), _account(f"{win}.targetUserName"), _account(f"{win}.user"), _account(f"{win}.subjectUserName"), _account("enrichment.asset.user")).alias("alert_user"),
        F.col("a.decoder.name").alias("decoder"),
        F.coalesce("a.rule.mitre.id", F.array().cast("array<string>")).alias("mitre_ids"),
        F.coalesce("a.rule.groups", F.array().cast("array<string>")).alias("rule_groups"),
        utf8_truncated(F.col("_log"), P.RAW_LOG_BYTES).alias("raw_log"),
        (F.octet_length("_log") > P.RAW_LOG_BYTES).alias("raw_log_truncated"),
        (F.col("a.rule.id") == P.HEARTBEAT_RULE).alias("is_heartbeat"),
        F.col("_found.category").alias("category"),
        F.col("_found.categories").alias("categories"),
        F.col("_found.resolved_by").alias("resolved_by"),
        F.coalesce(S.is_private_ipv4(F.col("_src")), is_private6(F.col("_src"))).alias("srcip_is_private"),
        F.coalesce(S.is_private_ipv4(F.col("_dst")), is_private6(F.col("_dst"))).alias("dstip_is_private"),
    )
    return out


def search_hits(pages: DataFrame, column: str = "value") -> DataFrame:
    """Each hit of search result pages as its raw text."""
    return pages.select(F.explode(F.from_json(F.get_json_object(column, "$.hits.hits"), "array<string>")).alias("value"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """An archive of one alert a line."""
    return parse(spark.read.text(path).filter(F.trim("value") != ""))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("rejected is null and not coalesce(is_heartbeat, false)").drop("rejected", "is_heartbeat")


def new_only(rows: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("manager_id", "alert_id")) -> DataFrame:
    """Rows whose key is not stored yet, one of each."""
    return rows.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")
