"""Addresses, networks and blocklist lines, against the standard library's reading of them."""

import ipaddress
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alertmill.functions import networks as N

ODD = ["", "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", "1.2.3.4 ", ":", "::", ":::", "1::2::3", "::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "12345::", "g::", "::ffff:1.2.3.4", "::1.2.3.4",
       "1::1.2.3.256", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.4:5", "fe80::1%eth0", "2001:DB8::A", "1.2.3.4:80", "0:0:0:0:0:0:0:0", "1:0:0:2:0:0:0:3", "1:0:0:2:0:0:3:4", "0:1:0:1:0:1:0:1", None, "a\n", "1.2.3.4\n"]


def read(text):
    try:
        return ipaddress.ip_address(text) if text and "%" not in text else None
    except ValueError:
        return None


def random_texts(rng, n):
    out = []
    for _ in range(n):
        v6 = ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([(1 << 128) - 1, 0xFFFF << 64, (0xFFFF << 112) | 0xFFFF, 0xFFFF0000FFFF << 40]))
        out += [str(ipaddress.IPv4Address(rng.getrandbits(32))), str(v6), v6.exploded.upper()]
    return out


def test_keys_and_texts_are_those_of_the_standard_library(spark):
    texts = ODD + random_texts(random.Random(1), 150)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.address_key(F.col("t")).alias("k")).withColumn("text", N.address_text(F.col("k"))).withColumn("plain", N.unmapped(F.col("k"))).collect()
    for r in rows:
        a = read(r["t"])
        assert r["k"] == (None if a is None else f"{a.version}{int(a):0{N.DIGITS[str(a.version)]}x}"), r["t"]
        if a is not None:
            want = str(a) if a.version == 4 or a.ipv4_mapped is None else None
            assert r["text"] == (want or re.sub("^::ffff:.*", lambda m: f"::ffff:{int(a) >> 16 & 0xFFFF:x}:{int(a) & 0xFFFF:x}", str(a)))
            mapped = a.version == 6 and a.ipv4_mapped
            assert r["plain"] == (f"4{int(mapped):08x}" if mapped else r["k"])


def test_containment_and_longest_prefix_are_brute_force(spark):
    rng = random.Random(2)
    nets = ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/23", "10.1.2.3", "0.0.0.0/0", "2001:db8::/32", "2001:db8:1::/47", "2001:db8:1::5/128", "::/0", "10.1.2.99/30", "x", "10.0.0.0/33", "1.2.3.4/-1", "1.2.3.4/8/9", None, "fe80::/129"]
    texts = [t for t in ODD if t is None or "\n" not in t] + [f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(6)}" for _ in range(60)] + [f"2001:db8:{rng.randrange(3)}::{rng.randrange(7)}" for _ in range(60)]

    def network(n):
        try:
            return ipaddress.ip_network(n, strict=False) if n else None
        except ValueError:
            return None

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    known = spark.createDataFrame([(n, f"owner {i}") for i, n in enumerate(nets)], "net string, owner string")
    got = {r["i"]: (r["net"], r["owner"]) for r in N.longest_prefix(rows, known, "t", "net", ["owner"]).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        a = read(t)
        hold = [(n.prefixlen, k) for k, n in enumerate(map(network, nets)) if n is not None and a is not None and a.version == n.version and a in n]
        assert got[i] == ((None, None) if not hold else (nets[max(hold)[1]], f"owner {max(hold)[1]}")), t
    one = rows.select("i", *(N.in_network(F.col("t"), n or "").alias(f"n{k}") for k, n in enumerate(nets))).collect()
    for r in one:
        a = read(texts[r["i"]])
        for k, n in enumerate(map(network, nets)):
            assert r[f"n{k}"] == (n is not None and a is not None and a.version == n.version and a in n)


def plain_entry(kind, value):
    """A line of a blocklist by the standard library."""
    if value is None:
        return None
    if kind == "domain":
        labels = value.lower().split(".")
        ok = len(value) <= 253 and len(labels) > 1 and all(re.fullmatch("[a-z0-9_]([a-z0-9_-]*[a-z0-9_])?", x) and len(x) < 64 for x in labels)
        return value.lower() if ok and value.isascii() and re.fullmatch("[a-z]{2,63}|xn--[a-z0-9-]+", labels[-1]) and labels[-1] not in N.NEVER_ENDINGS else None
    if kind != "ip:port":
        return None
    m = re.fullmatch(r"\[([0-9A-Fa-f:.]+)\]:([0-9]{1,5})|([0-9.]+)(?::([0-9]{1,5}))?", value)
    port = m and (m[2] or m[4] or "1")
    a = read(m[1] or m[3]) if m and 1 <= int(port) <= 65535 else None
    if a is None or (m[1] and a.version == 4):
        return None
    a = a.ipv4_mapped or a if a.version == 6 else a
    inside = lambda nets: any(a in ipaddress.ip_network(n) for n in nets)
    good = not inside(N.NEVER_V4) if a.version == 4 else inside([N.ONLY_V6]) and not inside(N.NEVER_V6)
    return str(a) if good else None


CASES = ["evil.com", "EVIL.Com", "a.test", "x.local", "nodots", "-a.com", "a-.com", "a..com", "a.com.", ".com", "a_b.c-d.org", "127.0.0.0x1", "1.2.3.4", "xn--a.xn--b9", "é.com", "a" * 63 + ".com", "a" * 64 + ".com", ("a" * 60 + ".") * 4 + "com", ("a" * 60 + ".") * 5 + "com", "a.com\n", None,
         "8.8.8.8:53", "8.8.8.8", "8.8.8.8:0", "8.8.8.8:65535", "8.8.8.8:65536", "8.8.8.8:00053", "8.8.8.8:000053", "10.0.0.1:80", "100.64.0.1:1", "100.128.0.1:1", "192.0.2.1:443", "224.0.0.1:1", "[2606:4700::1]:443", "2606:4700::1", "[2001:2::1]:1", "[2001:DB8:0:0::1]:1", "[::ffff:8.8.8.8]:53", "[::ffff:10.0.0.1]:53",
         "[fe80::1]:1", "[8.8.8.8]:53", "[2606::1]:99999", "[2606::1]", "host:80", "8.8.8.8:80\n"]


def test_blocklist_lines(spark):
    rows = spark.createDataFrame([(k, v) for k in ("domain", "ip:port", "url", None) for v in CASES], "kind string, value string")
    for r in rows.withColumn("line", N.blocklist_entry(F.col("kind"), F.col("value"))).collect():
        assert r["line"] == plain_entry(r["kind"], r["value"]), (r["kind"], r["value"])


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 70000), st.sampled_from(["", "0", "00"]))
def test_ports(port, zeros):
    text = f"{zeros}{port}"
    assert bool(re.fullmatch(N.PORT, text)) == (len(text) <= 5 and 1 <= port <= 65535)


def test_lookup(spark):
    iocs = spark.createDataFrame([("evil.com", "domain", "f1", 5), ("EVIL.com", "url", "f1", 5), ("8.8.8.8:53", "ip:port", "f2", 9), ("8.8.8.8", "ip", "f2", 9), ("8.8.8.80:1", "ip:port", "f2", 9), ("abc", "md5_hash", "f3", 9), (None, "url", "f4", 1)], "value string, type string, source string, expires long")
    asked = spark.createDataFrame([(" Evil.com ",), ("EVIL.com",), ("8.8.8.8",), ("ABC",), (None,), ("8.8.8",)], "q string")
    got = sorted((r["q"], r["found"], r["expired"]) for r in N.lookup(iocs, asked, "q", 5).collect())
    assert got == [(" Evil.com ", "evil.com", True), ("8.8.8.8", "8.8.8.8", False), ("8.8.8.8", "8.8.8.8:53", False), ("ABC", "abc", False), ("EVIL.com", "EVIL.com", True), ("EVIL.com", "evil.com", True)]


def test_private_ipv6_is_the_standard_librarys(spark):
    rng = random.Random(7)
    texts = [str(ipaddress.IPv6Address((rng.choice([0x2001, 0x2002, 0x2600, 0xFC00, 0xFE80, 0xFF02, 0x64, 0x100, 0x3FFF, 0x2001, 0x4000, 0]) << 112) | rng.choice([rng.getrandbits(112), rng.getrandbits(16) << 96, 1, 0xDB8 << 96, 0x1 << 96 | 1, 0x20 << 96]))) for _ in range(300)]
    for r in spark.createDataFrame([(t,) for t in [*texts, "1.2.3.4", "", None, "x:y"]], "t string").withColumn("p", N.is_private6(F.col("t"))).collect():
        a = read(r["t"])
        assert r["p"] == (bool(a.is_private or a.is_loopback or a.is_link_local or a.is_reserved) if a is not None and a.version == 6 else None), r["t"]
