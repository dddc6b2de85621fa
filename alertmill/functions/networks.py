"""IP addresses and networks of both families as column expressions.

An address is a key: its family and its bits in hexadecimal digits (4 and 8, or 6 and 32 of them), so that keys of a family
sort as addresses do and a network is a range of keys. Text is read as strictly as addresses are written: no leading zeros, no
zone, one `::` at most.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = rf"{OCTET}(\.{OCTET}){{3}}"
DIGITS = {"4": 8, "6": 32}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once: expressions that name it many times would hold it as many times."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _hex_of_dotted(text: Column) -> Column:
    return F.lower(F.array_join(F.transform(F.split(text, r"\."), lambda p: F.lpad(F.hex(p.cast("int")), 2, "0")), ""))


def key4(text: Column) -> Column:
    """The key of a dotted IPv4 address, else null."""
    return F.when(text.rlike(rf"^{DOTTED}\z"), F.concat(F.lit("4"), _hex_of_dotted(text)))


def key6(text: Column) -> Column:
    """The key of an IPv6 address, else null. The last 32 bits may be dotted."""
    empty = F.array().cast("array<string>")
    groups = lambda side: F.when(side == "", empty).otherwise(F.split(side, ":", -1))

    def undotted(t: Column) -> Column:
        tail = F.regexp_extract(t, rf":({DOTTED})\z", 1)
        turned = let(_hex_of_dotted(tail), lambda bits: F.concat(F.substr(t, F.lit(1), F.length(t) - F.length(tail)), F.substring(bits, 1, 4), F.lit(":"), F.substring(bits, 5, 4)))
        return F.lower(F.when(tail != "", turned).otherwise(t))

    def of_sides(s: Column) -> Column:
        both = F.struct(groups(F.get(s, F.lit(0))).alias("l"), F.coalesce(groups(F.get(s, F.lit(1))), empty).alias("r"), (F.size(s) == 2).alias("short"))
        return F.when(F.size(s) <= 2, let(both, of_groups))

    def of_groups(g: Column) -> Column:
        n = F.size(g["l"]) + F.size(g["r"])
        good = F.when(g["short"], n <= 7).otherwise(n == 8) & F.forall(F.concat(g["l"], g["r"]), lambda x: x.rlike(r"^[0-9a-f]{1,4}\z"))
        whole = F.concat(g["l"], F.array_repeat(F.lit("0"), F.when(g["short"], F.greatest(8 - n, F.lit(0))).otherwise(0)), g["r"])
        return F.when(good, F.concat(F.lit("6"), F.array_join(F.transform(whole, lambda x: F.lpad(x, 4, "0")), "")))

    fits = text.rlike(r"^[0-9A-Fa-f:.]{2,45}\z") & F.contains(text, F.lit(":"))
    return F.when(fits, let(text, lambda t: let(F.split(undotted(t), "::", -1), of_sides)))


def address_key(text: Column) -> Column:
    """The key of an address of either family, null for other text."""
    return F.coalesce(key4(text), key6(text))


def unmapped(key: Column) -> Column:
    """An IPv6 key that wraps an IPv4 address as the key of that address."""
    return let(key, lambda k: F.when(k.startswith("6" + "0" * 20 + "ffff"), F.concat(F.lit("4"), F.substring(k, 26, 8))).otherwise(k))


def address_text(key: Column) -> Column:
    """An address as it is written: dotted, or in groups with the longest run of zero groups (the first of equal ones) as `::`."""

    def shortened(groups: Column) -> Column:
        out = groups
        for n in range(2, 9):  # a longer run, where there is one, is asked for later and wins
            zeros = f"(^|:)0(:0){{{n - 1}}}($|:)"
            out = F.when(groups.rlike(zeros), F.concat(F.regexp_replace(F.regexp_extract(groups, f"^(.*?){zeros}", 1), ":$", ""), F.lit("::"), F.regexp_extract(groups, f"^(.*?){zeros}(.*)$", 5))).otherwise(out)
        return out

    def written(k: Column) -> Column:
        dotted = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substr(k, 2 + 2 * i, F.lit(2)), 16, 10)), ".")
        groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substr(k, 2 + 4 * i, F.lit(4)), "^0{1,3}", "")), ":")
        return F.when(k.startswith("4"), dotted).otherwise(let(groups, shortened))

    return let(key, written)


def bounds(net: str) -> tuple[str, str] | None:
    """The first and last key of a network as a literal (host bits allowed), or None."""
    try:
        n = ipaddress.ip_network(net, strict=False)
    except ValueError:
        return None
    return tuple(f"{n.version}{int(a):0{DIGITS[str(n.version)]}x}" for a in (n[0], n[-1]))


def within(key: Column, nets: Sequence[str]) -> Column:
    """Whether a key lies in any of these networks of its family; false for null and for networks that can't be read."""
    ends = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in filter(None, map(bounds, nets))]
    if not ends:
        return F.lit(False)
    return F.coalesce(let(key, lambda k: F.exists(F.array(*ends), lambda e: k.between(e["a"], e["b"]))), F.lit(False))


def in_network(text: Column, net: str) -> Column:
    """Whether an address lies in a network; false where either can't be read or their families differ."""
    return within(address_key(text), [net])


def masked(key: Column, length: Column) -> Column:
    """The first `length` bits of a key, as a text that is equal for the addresses of one network."""
    whole, rest = F.floor(length / 4).cast("int"), (length % 4).cast("int")
    nibble = F.conv(F.substr(key, whole + 2, F.lit(1)), 16, 10).cast("int")
    cut = nibble - nibble % F.element_at(F.array(*(F.lit(16 >> r) for r in range(4))), rest + 1)
    return F.concat(F.substr(key, F.lit(1), whole + 1), F.when(rest > 0, F.lower(F.hex(cut))).otherwise(""))


def network(text: Column) -> Column:
    """length and prefix (as masked()) of a network written address/length, or of an address alone; null for other text."""
    given = F.when(F.contains(text, F.lit("/")), F.substring_index(text, "/", -1))
    slashes = F.length(text) - F.length(F.replace(text, F.lit("/")))

    def of_key(k: Column) -> Column:
        most = F.when(k.startswith("4"), 32).otherwise(128)
        good = given.isNull() | (given.rlike(r"^[0-9]{1,3}\z") & (given.try_cast("int") <= most) & (slashes == 1))
        return F.when(k.isNotNull() & good, let(F.coalesce(given.try_cast("int"), most), lambda n: F.struct(n.alias("length"), masked(k, n).alias("prefix"))))

    return let(address_key(F.substring_index(text, "/", 1)), of_key)


def longest_prefix(rows: DataFrame, nets: DataFrame, address: str, net: str, values: Sequence[str]) -> DataFrame:
    """rows with net and values of the narrowest network that holds their address (of equal networks that of the least values),
    null without one.

    An address is cut to each length that the networks have (a few of 162) and joined by the cut key: an equi-join, however
    many networks there are."""
    known = nets.select(network(F.col(net)).alias("_n"), F.struct(F.col(net).alias("_net"), *values).alias("_v")).filter("_n is not null").groupBy("_n.prefix", "_n.length").agg(F.min("_v").alias("_v"))
    lengths = sorted((r[0], r[1]) for r in known.select(F.left("prefix", F.lit(1)), "length").distinct().collect())  # 162 at most
    own = rows.withColumns({"_row": F.monotonically_increasing_id(), "_key": address_key(F.col(address))})
    by_family = [F.array(*(F.lit(n) for f, n in lengths if f == family)).cast("array<int>") for family in "46"]
    asked = own.select("_row", "_key", F.explode(F.when(F.col("_key").startswith("4"), by_family[0]).when(F.col("_key").startswith("6"), by_family[1])).alias("length"))
    met = asked.withColumn("prefix", masked(F.col("_key"), F.col("length"))).join(known, ["prefix", "length"]).groupBy("_row").agg(F.max_by("_v", "length").alias("_v"))
    return own.join(met, "_row", "left").select(*rows.columns, F.col("_v._net").alias(net), *(F.col(f"_v.{v}").alias(v) for v in values))


# What is not public IPv6 space, and the blocks inside it that are.
PRIVATE_V6 = ("::/3", "2001::/23", "2001:db8::/32", "2002::/16", "4000::/2", "8000::/2", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10")
PUBLIC_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")


def is_private6(text: Column) -> Column:
    """Whether an IPv6 address is private, local or reserved; null for other text. One that wraps an IPv4 address is reserved."""
    return let(F.when(F.contains(text, F.lit(":")), key6(text)), lambda k: F.when(k.isNotNull(), within(k, PRIVATE_V6) & ~within(k, PUBLIC_V6)))


# --- blocklists and lookups --------------------------------------------------------------------------

# Networks and endings of names that a blocklist never carries, and the one IPv6 block that it may.
NEVER_V4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4")
ONLY_V6, NEVER_V6 = "2000::/3", ("2001:2::/48",)
NEVER_ENDINGS = ("local", "localhost", "localdomain", "lan", "home", "internal", "intranet", "corp", "arpa", "test", "invalid", "example", "onion")

LABEL = "[a-z0-9_]([a-z0-9_-]{0,61}[a-z0-9_])?"
PORT = "(6553[0-5]|655[0-2][0-9]|65[0-4][0-9]{2}|6[0-4][0-9]{3}|0{0,4}[1-9]|0{0,3}[1-9][0-9]|0{0,2}[1-9][0-9]{2}|0?[1-9][0-9]{3}|[1-5][0-9]{4})"


def blocked_name(value: Column) -> Column:
    """A domain as a line of a blocklist, or null: labels of letters, digits, - and _, a last one that is a real top-level label
    (no digits, or punycode) and none of NEVER_ENDINGS."""
    name = F.lower(value)
    last = F.substring_index(name, ".", -1)
    good = value.rlike(r"^[A-Za-z0-9_.-]{1,253}\z") & name.rlike(rf"^{LABEL}(\.{LABEL})+\z") & last.rlike(r"^([a-z]{2,63}|xn--[a-z0-9-]+)\z") & ~last.isin(*NEVER_ENDINGS)
    return F.when(good, name)


def address_of_port(value: Column) -> Column:
    """The key of an address with a port: 1.2.3.4:443, an IPv4 address alone, or [2001:db8::1]:443; IPv6 only in brackets."""
    v4 = F.regexp_extract(value, rf"^({DOTTED})(:{PORT})?\z", 1)
    v6 = F.regexp_extract(value, rf"^\[([0-9A-Fa-f:.]+)\]:{PORT}\z", 1)
    return F.when(v4 != "", key4(v4)).when(v6 != "", key6(v6))


def blocked_address(key: Column) -> Column:
    """An address as a line of a blocklist, or null where none may carry it. One that wraps an IPv4 address counts as that."""

    def line(k: Column) -> Column:
        good = F.when(k.startswith("4"), ~within(k, NEVER_V4)).otherwise(within(k, [ONLY_V6]) & ~within(k, NEVER_V6))
        return F.when(good, address_text(k))

    return let(unmapped(key), line)


def blocklist_entry(kind: Column, value: Column) -> Column:
    """The line that an indicator gives a blocklist, or null: only domains and addresses with ports give any."""
    return F.when(kind == "domain", blocked_name(value)).when(kind == "ip:port", blocked_address(address_of_port(value)))


def lookup(iocs: DataFrame, asked: DataFrame, value: str, as_of: int) -> DataFrame:
    """asked with every indicator (value, type, source, expires) that its value names: equal after trimming, domains and hashes in
    lower case; an IPv4 address also names the ip:port entries of it. Adds expired. An equi-join by the folded value and one by
    the address before the port."""
    folded = (F.col("type") == "domain") | F.col("type").endswith("_hash")
    ask = asked.withColumns({"_raw": F.trim(value), "_low": F.lower(F.trim(value)), "_id": F.monotonically_increasing_id()})
    found = iocs.select(F.col("value").alias("_value"), "type", "source", "expires", folded.alias("_folded"))
    same = ask.join(found.withColumn("_low", F.lower("_value")), "_low").filter(F.when(F.col("_folded"), F.col("_value") == F.col("_low")).otherwise(F.col("_value") == F.col("_raw")))
    ports = found.filter("type = 'ip:port' and _value like '%:%'").withColumn("_raw", F.substring_index("_value", ":", 1))
    by_port = ask.filter(key4(F.col("_raw")).isNotNull()).join(ports, "_raw")
    columns = [*asked.columns, F.col("_value").alias("found"), "type", "source", "expires", (F.col("expires") <= as_of).alias("expired")]
    return same.select(*columns).unionByName(by_port.select(*columns))
