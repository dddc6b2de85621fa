"""Dimension lookups, scores, rules and routes."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill import params as P
from alertmill.functions import scalar as S
from alertmill.functions.networks import in_network, is_private6


def with_asset(alerts: DataFrame, assets: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds asset, the whole row of the first of the named columns that is an active host, and asset_present."""
    active = assets.filter("active").groupBy("hostname").agg(F.min(F.struct("criticality", "owner")).alias("asset"))
    out = alerts
    for k, name in enumerate(names):
        out = out.join(active.select(F.col("hostname").alias(f"_h{k}"), F.col("asset").alias(f"_a{k}")), F.col(name) == F.col(f"_h{k}"), "left")
    found = F.coalesce(*(F.col(f"_a{k}") for k in range(len(names))))
    out = out.withColumn("asset", found).withColumn("asset_present", F.col("asset").isNotNull())
    return out.drop(*(f"_{p}{k}" for k in range(len(names)) for p in "ha"))


def with_identity(alerts: DataFrame, identities: DataFrame, user: str = "alert_user") -> DataFrame:
    """Adds identity_status (skipped, not_found, found) and is_privileged, null if unknown."""
    active = identities.filter("active").groupBy(F.col("username").alias("_u")).agg(F.max("is_privileged").alias("is_privileged"))
    out = alerts.join(active, F.col(user) == F.col("_u"), "left")
    return out.withColumn("identity_status", F.when(F.col(user).isNull(), "skipped").when(F.col("_u").isNull(), "not_found").otherwise("found")).drop("_u")


def with_reputation(alerts: DataFrame, iocs: DataFrame, id_: str, addresses: Sequence[str], as_of: int) -> DataFrame:
    """Adds reputation: the worst of the unexpired entries of the row's public addresses; skipped without such."""
    public = [F.when((F.col(a) != "") & ~F.coalesce(S.is_private_ipv4(F.col(a)), is_private6(F.col(a)), F.lit(False)), F.col(a)) for a in addresses]
    asked = alerts.select(id_, F.explode(F.array_distinct(F.filter(F.array(*public), lambda a: a.isNotNull()))).alias("value"))
    rank = F.array_position(F.array(*map(F.lit, P.REPUTATIONS)), F.col("reputation"))
    worst = iocs.filter(F.col("expires") > as_of).groupBy("value").agg(F.max_by("reputation", rank).alias("reputation"))
    rank = F.array_position(F.array(*map(F.lit, P.REPUTATIONS)), F.col("reputation"))
    found = asked.join(worst, "value", "left").groupBy(id_).agg(F.max_by("reputation", F.when(F.col("reputation").isNotNull(), rank)).alias("_r"))
    return alerts.join(found.withColumn("_asked", F.lit(True)), id_, "left").withColumn("reputation", F.when(F.col("_asked").isNull(), "skipped").otherwise(F.coalesce("_r", F.lit("not_found")))).drop("_r", "_asked")


def compiled_rule(match: str) -> Column | None:
    """A rule's JSON list of {field, op, value} as a condition, or None if any part of it is malformed. An empty list
    matches all; a null field never matches."""
    try:
        conditions = json.loads(match)
    except ValueError:
        return None
    if not isinstance(conditions, list):
        return None
    out = F.lit(True)
    for c in conditions:
        if not isinstance(c, Mapping) or c.get("op") not in P.RULE_FIELDS.get(c.get("field"), ()) or "value" not in c:
            return None
        field, op, value = F.col(c["field"]), c["op"], c["value"]
        if op == "in":
            if not isinstance(value, list) or not value:
                return None
            test = field.isin(value)
        elif op == "cidr":
            if not isinstance(value, str):
                return None
            test = in_network(field, value)
        elif op == "prefix":
            if not isinstance(value, str):
                return None
            test = field.startswith(value)
        elif op == "lte":
            if not isinstance(value, int):
                return None
            test = field <= value
        else:
            if isinstance(value, list | dict):
                return None
            test = field == value
        out = out & F.coalesce(test, F.lit(False))
    return out


def route(alerts: DataFrame, rules: Sequence[tuple[str, str]], block: Column) -> DataFrame:
    """Adds block, rule_id_matched (the first of the rules, (id, match JSON), in order) and route."""
    hit = F.lit(None).cast("string")
    for rule_id, match in reversed(rules):
        test = compiled_rule(match)
        if test is not None:
            hit = F.when(test, F.lit(rule_id)).otherwise(hit)
    out = alerts.withColumn("block", block)
    out = out.withColumn("matched_rule", F.when(F.col("block").isNull(), hit))
    return out.withColumn("route", F.when(F.col("matched_rule").isNotNull(), "auto_closed").otherwise("queued"))


def decide(facts: DataFrame, rules: Sequence[tuple[str, Mapping[str, object], str]]) -> DataFrame:
    """Adds decided_by and action of the first rule in order that holds. A rule is (id, conditions, action); a condition
    is fact: value, fact: [values], fact_lt: n or fact_gte: n. A null fact makes a condition false."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for rule_id, conditions, action in reversed(rules):
        test = F.lit(True)
        for name, value in conditions.items():
            if name.endswith("_lt"):
                one = F.col(name[:-3]) < value
            elif name.endswith("_gte"):
                one = F.col(name[:-4]) >= value
            else:
                one = F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value
            test = test & F.coalesce(one, F.lit(False))
        out = F.when(test, F.struct(F.lit(rule_id).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return facts.withColumn("_d", out).withColumns({"decided_by": F.col("_d.rule"), "action": F.col("_d.action")}).drop("_d")


def conflicts(spark, rules: Sequence[tuple[str, Mapping[str, object], str]], grid: Mapping[str, Sequence]) -> DataFrame:
    """Pairs of rules with different actions that both hold somewhere on the grid of literal facts."""
    points = spark.range(1)
    for name, values in grid.items():
        points = points.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    points = points.withColumn("point", F.struct(*grid))
    held = None
    for k, rule in enumerate(rules):
        own = decide(points, [rule]).filter("action is not null").select("point", F.lit(k).alias("at"), "decided_by", "action")
        held = own if held is None else held.unionByName(own)
    a, b = held.alias("a"), held.alias("b")
    both = a.join(b, (F.col("a.point") == F.col("b.point")) & (F.col("a.at") < F.col("b.at")) & (F.col("a.action") != F.col("b.action")))
    return both.groupBy(F.col("a.decided_by").alias("first_rule"), F.col("b.decided_by").alias("second_rule")).agg(F.count("*").alias("points"))


def rule_width(alerts: DataFrame, rule: str, share: float = P.RULE_WIDTH_SHARE) -> DataFrame:
    """Rules that close more than a share (in percent) of all alerts: n, total and percent."""
    each = alerts.groupBy(rule).agg(F.count("*").alias("n"))
    total = alerts.agg(F.count("*").alias("total"))  # one row
    out = each.filter(F.col(rule).isNotNull()).crossJoin(F.broadcast(total)).withColumn("percent", F.round(100.0 * F.col("n") / F.col("total"), 2))
    return out.filter(F.col("percent") > share)


def representatives(heads: DataFrame, case: str, trigger: str, limit: int = P.REPRESENTATIVES) -> DataFrame:
    """The trigger alert of each case, then the most severe, to a limit."""
    order = Window.partitionBy(case).orderBy(F.when(F.col("alert_id") == F.col(trigger), 0).otherwise(1), S.severity_rank(F.col("severity")), F.desc("rule_level"), F.desc("occurrence_count"), "alert_id")
    return heads.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
