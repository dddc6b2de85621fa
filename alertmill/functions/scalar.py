"""Column expressions over alerts; all run inside code generation unless noted."""

from __future__ import annotations

import ipaddress
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertmill import params as P


def chosen(key: Column, table: Mapping, default=None) -> Column:
    """A value from a small literal table."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def severity(level: Column) -> Column:
    out = None
    for least, name in P.SEVERITY_LEVELS:
        out = F.when(level >= least, name) if out is None else out.when(level >= least, name)
    return out.otherwise("low")


def severity_rank(name: Column) -> Column:
    """0 for the most severe."""
    return F.array_position(F.array(*map(F.lit, P.SEVERITIES)), name) - 1


def risk_components(sev: Column, criticality: Column, privileged: Column, reputation: Column, occurrences: Column) -> Column:
    """A struct of the parts and the capped total. Unknown values weigh nothing; a null flag is not privileged."""
    base = chosen(sev, P.RISK_BASE, 0)
    asset = chosen(criticality, P.RISK_ASSET, 0)
    identity = F.when(privileged.eqNullSafe(True), P.RISK_IDENTITY).otherwise(0)
    ioc = chosen(reputation, P.RISK_IOC, 0)
    (most, high), (some, low) = P.RISK_OCCURRENCES
    times = F.when(occurrences >= most, high).when(occurrences >= some, low).otherwise(0)
    total = F.least(F.lit(P.RISK_CAP), base + F.least(F.lit(P.RISK_CONTEXT_CAP), asset + identity + ioc + times))
    return F.struct(base.alias("base"), asset.alias("asset"), identity.alias("identity"), ioc.alias("ioc"), times.alias("occurrence"), total.alias("score"))


def risk_band(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for most, name in P.RISK_BANDS[:-1]:
        out = out.when(score <= most, name)
    return out.otherwise(P.RISK_BANDS[-1][1])


def needs_retriage(triaged: Column, occurrences: Column) -> Column:
    return (triaged > 0) & ((occurrences >= P.RETRIAGE_FACTOR * triaged) | (occurrences - triaged >= P.RETRIAGE_DELTA))


def event_bucket_hash(rule_id: Column, srcip: Column, dstip: Column, agent: Column, epoch_s: Column) -> Column:
    """The hash of an event's keys and its five minutes; nulls are empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (rule_id, srcip, dstip, agent)]
    return F.sha2(F.concat_ws("|", *parts, F.floor(epoch_s / 300).cast("string")), 256)


def suggestion_visible(key_hash: Column, fraction: float = P.BLIND_FRACTION) -> Column:
    """The visible arm, from the first 32 bits of a hex hash: even numbers at one half, else a share of hundred."""
    n = F.conv(F.substring(key_hash, 1, 8), 16, 10).cast("long")
    return n % 2 == 0 if fraction == 0.5 else n % 100 >= int(fraction * 100)


def safe_int(text: Column, default: int = 0) -> Column:
    return F.coalesce(F.trim(text).try_cast("int"), F.lit(default))


def without_domain(account: Column) -> Column:
    return F.substring_index(account, "\\", -1)


def iso_instant(text: Column) -> Column:
    """A timestamp from ISO text that has an offset (Z, +07:00 or +0700); null for anything else."""
    t = F.regexp_replace(F.trim(text), "([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    ok = t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?(Z|[+-][0-9]{2}:[0-9]{2})$")
    return F.when(ok, t.try_cast("timestamp"))


def stable_text(text: Column) -> Column:
    """Whether text can be stored: valid UTF-8 without NUL."""
    return F.is_valid_utf8(text) & ~F.contains(text, F.lit("\x00"))


#: The two forms of an alert's id.
ALERT_ID = r"^([0-9]+\.[0-9]+|gl-[0-9A-HJKMNP-TV-Z]{26}-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})\z"


def is_alert_id(text: Column) -> Column:
    """Whether a text is an alert's id as a whole; false for null."""
    return F.coalesce(text.rlike(ALERT_ID), F.lit(False))


def sorted_json(text: Column) -> Column:
    """A JSON document with the keys of all its objects in order, without blanks; null for what can't be read."""
    return F.to_json(F.try_parse_json(text))


def without_hour_bucket(fingerprint: Column) -> Column:
    return F.regexp_replace(fingerprint, r"\|[0-9]{8}-[0-9]{2}\z", "")


def ioc_value(value: Column, kind: Column) -> Column:
    """Domains and hashes in lower case, all trimmed."""
    return F.when((kind == "domain") | kind.endswith("_hash"), F.lower(F.trim(value))).otherwise(F.trim(value))


def match_level(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for least, name in P.MATCH_LEVELS:
        out = out.when(score >= least, name)
    return out.otherwise(F.lit(None).cast("string"))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector or lengths that differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(F.size(a) == F.size(b), F.try_divide(dot, norm(a) * norm(b)))


_OCTET = "(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"


def ipv4_number(ip: Column) -> Column:
    """The number of a dotted IPv4 address, else null."""
    number = F.aggregate(F.split(ip, "[.]"), F.lit(0).cast("long"), lambda n, part: n * 256 + part.cast("int"))
    return F.when(ip.rlike(f"^{_OCTET}([.]{_OCTET}){{3}}$"), number)


PRIVATE_NETS = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")


def is_private_ipv4(ip: Column) -> Column:
    """Null if there is no readable IPv4 address (networks.is_private6 reads the others)."""
    nets = [ipaddress.ip_network(n) for n in PRIVATE_NETS]

    def inside(n: Column) -> Column:
        out = F.lit(False)
        for net in nets:
            out = out | n.between(int(net.network_address), int(net.broadcast_address))
        return out

    return F.transform(F.array(ipv4_number(ip)), inside)[0]  # the number is worked out once


def _any(keys: Column, names) -> Column:
    """Whether any key is one of names: a look-up in a set for each key."""
    return F.exists(keys, lambda k: k.isin(*names))


def _found(keys: Column, table: Mapping[str, str]) -> Column:
    """The categories that a table gives any of the keys, the most severe first."""
    of: dict[str, list[str]] = {}
    for key, category in table.items():
        of.setdefault(category, []).append(key)
    hits = [F.when(_any(keys, of[c]), F.lit(c)) for c in P.CATEGORY_PRIORITY if c in of]
    return F.filter(F.array(*hits), lambda c: c.isNotNull())


def categories(mitre: Column, groups: Column, decoder: Column, port: Column, more_techniques: Mapping[str, str] | None = None) -> Column:
    """A struct of category, categories and resolved_by: the first tier that finds any; within it all, most severe first.
    more_techniques is consulted last."""
    none = F.array().cast("array<string>")
    low = F.coalesce(F.lower(F.trim(decoder)), F.lit(""))
    keys = F.struct(
        F.filter(F.transform(F.coalesce(mitre, none), lambda t: F.upper(F.trim(t))), lambda t: t != "").alias("ids"),
        F.transform(F.coalesce(groups, none), lambda g: F.lower(F.trim(g))).alias("groups"),
        F.filter(F.array(*(F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in P.DECODERS)), lambda k: k.isNotNull()).alias("decoders"),
        F.contains(low, F.lit(P.WINDOWS_DECODER)).alias("windows"),
        F.coalesce(port.cast("string"), F.lit("")).alias("port"),
    )
    bound = F.transform(F.array(keys), lambda k: F.struct(k.alias("keys"), F.transform(F.filter(k["ids"], lambda t: F.contains(t, F.lit("."))), lambda t: F.substring_index(t, ".", 1)).alias("parents")))

    def first_tier(x: Column) -> Column:
        k, parents = x["keys"], x["parents"]
        yes, windows = F.lit(True), k["windows"]
        tiers = [
            (windows, k["ids"], P.WINDOWS_TECHNIQUES, "mitre"),
            (windows, parents, P.WINDOWS_TECHNIQUES, "mitre_parent"),
            (windows, k["groups"], P.WINDOWS_GROUPS, "rule_groups"),
            (yes, k["ids"], P.TECHNIQUES, "mitre"),
            (yes, parents, P.TECHNIQUES, "mitre_parent"),
            (yes, k["groups"], P.GROUPS, "rule_groups"),
            (yes, k["decoders"], P.DECODERS, "decoder"),
            (~windows, F.array(k["port"]), {str(p): c for p, c in P.PORTS.items()}, "dst_port"),
        ]
        if more_techniques:
            tiers += [(yes, k["ids"], more_techniques, "mitre"), (yes, parents, more_techniques, "mitre_parent")]
        out = None
        for open_, own, table, by in tiers:
            hit = open_ & _any(own, table)
            answer = F.struct(_found(own, table).alias("categories"), F.lit(by).alias("resolved_by"))
            out = F.when(hit, answer) if out is None else out.when(hit, answer)
        return out.otherwise(F.struct(none.alias("categories"), F.lit("none").alias("resolved_by")))

    answer = F.transform(F.transform(bound, first_tier), lambda a: F.struct(F.coalesce(F.get(a["categories"], F.lit(0)), F.lit("unknown")).alias("category"), a["categories"].alias("categories"), a["resolved_by"].alias("resolved_by")))
    return answer[0]


def first_block(sev: Column, agent: Column, present: Column, criticality: Column, privileged: Column, reputation: Column, never: Sequence[str] = ()) -> Column:
    """The first reason why an alert may not be closed by a rule, or null."""
    return (
        F.when(sev == "critical", "critical")
        .when(agent.isin(*never) if never else F.lit(False), "never_autoclose_agent")
        .when(criticality == "high", "asset_high")
        .when(~present, "asset_not_in_inventory")
        .when(privileged.eqNullSafe(True), "identity_privileged")
        .when(reputation.isin("malicious", "suspicious"), "ioc_bad")
    )


def spreadsheet_safe(c: Column) -> Column:
    """Text that a spreadsheet won't take for a formula."""
    return F.when(c.rlike("^[\\t\\r]") | c.rlike("(?U)^\\s*[=+@-]"), F.concat(F.lit("'"), c)).otherwise(c)


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """The bounds of a share by Wilson's score, null without trials."""
    p = F.try_divide(hits, n)
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.struct((mid - half).alias("low"), (mid + half).alias("high")))


def rate_cell(num: Column, den: Column) -> Column:
    """A rate as text with its counts, thousandths rounded half up; n/a with nothing to divide."""
    thousandths = F.call_function("div", 2000 * num + den, 2 * den)
    return F.when(den == 0, "n/a").otherwise(F.format_string("%d.%03d (%d / %d)", F.call_function("div", thousandths, F.lit(1000)), thousandths % 1000, num, den))


def ms_cell(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.concat(value.cast("long").cast("string"), F.lit(" ms")))
