"""Threat-intelligence feeds and inventories: validation, folding and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.functions import scalar as S
from alertmill.operators.keyed import merge_snapshot

COLUMNS = ("source", "first_seen", "type", "value", "threat", "malware", "confidence", "tags", "reference")
# Limits of a feed row.
SOURCES = ("threatfox", "urlhaus", "malwarebazaar")
BYTES = {"value": 2048, "type": 64, "malware": 256, "threat": 256, "reference": 2048}
TAGS_MAX, TAG_BYTES = 32, 64
CONTROL = r"[\x00-\x1f\x7f]"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    fields = ", ".join(f"{c} string" for c in COLUMNS)
    return spark.read.schema(f"{fields}, malformed string").csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="malformed")


def rejection(as_of: Column, malformed: Column | None = None) -> Column:
    """The first reason, in a fixed order, why a feed row is skipped, or null."""
    c = {k: F.trim(F.coalesce(F.col(k), F.lit(""))) for k in COLUMNS}
    tags = F.filter(F.transform(F.split(c["tags"], "[,;]"), F.trim), lambda t: t != "")
    seen = first_seen()
    checks = [
        (malformed.isNotNull() if malformed is not None else F.lit(False), "row_malformed"),
        (~F.is_valid_utf8(F.concat(*(F.coalesce(F.col(k), F.lit("")) for k in COLUMNS))), "invalid_utf8"),
        (~F.lower(c["source"]).isin(*SOURCES), "source_invalid"),
        (c["first_seen"] == "", "first_seen_missing"),
        (seen.isNull() | (seen > as_of + F.expr("interval 1 day")), "first_seen_invalid"),
        (F.octet_length(c["type"]) > BYTES["type"], "type_too_long"),
        (~c["type"].rlike("^[a-z0-9_:.-]+$"), "type_invalid"),
        (c["value"] == "", "value_empty"),
        (c["value"].rlike(CONTROL), "value_control_char"),
        (F.octet_length(c["value"]) > BYTES["value"], "value_too_long"),
        (F.octet_length(c["threat"]) > BYTES["threat"], "threat_too_long"),
        (F.octet_length(c["malware"]) > BYTES["malware"], "malware_too_long"),
        ((c["confidence"] != "") & ~c["confidence"].rlike("^[+-]?[0-9]{1,9}$"), "confidence_not_integer"),
        ((c["confidence"] != "") & ~F.coalesce(c["confidence"].try_cast("int").between(0, 100), F.lit(False)), "confidence_out_of_range"),
        (F.size(tags) > TAGS_MAX, "tags_too_many"),
        (F.exists(tags, lambda t: F.octet_length(t) > TAG_BYTES), "tag_too_long"),
        (F.octet_length(c["reference"]) > BYTES["reference"], "reference_too_long"),
        (F.concat_ws(" ", c["threat"], c["malware"], c["tags"], c["reference"]).rlike(CONTROL), "text_control_char"),
    ]
    out = F.when(checks[0][0], checks[0][1])
    for test, name in checks[1:]:
        out = out.when(test, name)
    return out


def first_seen() -> Column:
    text = F.regexp_replace(F.trim("first_seen"), " UTC$", "")
    plain = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"), F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z")))
    return S.iso_instant(F.coalesce(plain, text))


def folded(rows: DataFrame, order: str) -> DataFrame:
    """One row a key (source, type, normalised value): the first by `order`, with the least first_seen of all."""
    keyed = rows.withColumn("value", S.ioc_value(F.col("value"), F.col("type"))).withColumn("seen", first_seen())
    rest = [c for c in COLUMNS if c not in ("source", "type", "value", "first_seen")]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("r")
    return keyed.groupBy("source", "type", "value").agg(first, F.min("seen").alias("first_seen")).select("source", "type", "value", "first_seen", *(F.col(f"r.{c}").alias(c) for c in rest))


def upsert(stored: DataFrame, load: DataFrame) -> DataFrame:
    """The stored feed after a load: the least first_seen stays, other fields are the new ones; adds change."""
    return merge_snapshot(stored, load, ("source", "type", "value"), {"first_seen": F.least("old.first_seen", "new.first_seen")})


def reload(stored: DataFrame, load: DataFrame, key: str) -> DataFrame:
    """An inventory after a full load: keys that are missing from it stay, inactive."""
    out = merge_snapshot(stored, load, (key,), {"active": F.lit(True)})
    return out.withColumn("active", F.when(F.col("change") == "kept", F.lit(False)).otherwise(F.lit(True)))


def served(feed: DataFrame, as_of: int, times: tuple[str, ...] = ("first_seen", "expires")) -> DataFrame:
    """Indicators as they are shown: times (microseconds) as UTC ISO text, and whether each has expired by as_of."""
    iso = lambda c: F.date_format(F.to_utc_timestamp(F.timestamp_micros(c), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias(c)
    return feed.select(*(iso(c) if c in times else F.col(c) for c in feed.columns), (F.col("expires") <= as_of).alias("expired"))
