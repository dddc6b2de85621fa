"""Queries over addresses of both families: owners by network, rules with networks, blocklist lines, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.functions import networks as N
from alertmill.functions import scalar as S
from alertmill.operators import enrich
from alertmill.plans import model as M
from alertmill.plans.model import ALERTS, NOW, Tables, with_
from alertmill.plans.registry import query


def _text(*parts) -> F.Column:
    return F.concat(*(p.cast("string") if isinstance(p, F.Column) else F.lit(p) for p in parts))


def addressed(t: Tables) -> DataFrame:
    """Alerts with an IPv4 address, an IPv6 address or none."""
    k = F.col("k")
    v4, v6 = _text("10.", k % 4, ".", k % 8, ".", k % 50), _text("2001:DB8:", k % 4, "::", F.hex(k % 20))
    return M.alerts(t).withColumn("srcip", F.when(k % 3 == 0, v4).when(k % 3 == 1, v6).otherwise(""))


ADDRESSED = "a AS (SELECT alert_id, k % 3 AS f, k % 4 AS b, k % 8 AS c FROM alerts)"


@query(with_(ALERTS, ADDRESSED, """nets AS (SELECT n_name AS owner, n_nationkey % 3 AS kind, n_nationkey % 4 AS b, n_nationkey % 8 AS c, CASE n_nationkey % 3 WHEN 0 THEN '10.' || n_nationkey % 4 || '.0.0/16'
    WHEN 1 THEN '10.' || n_nationkey % 4 || '.' || n_nationkey % 8 || '.0/24' ELSE '2001:db8:' || n_nationkey % 4 || '::/48' END AS net FROM nation)""", """met AS (
  SELECT alert_id, net, owner, row_number() OVER (PARTITION BY alert_id ORDER BY kind DESC, net, owner) AS r FROM a JOIN nets n ON a.b = n.b AND ((f = 0 AND kind = 0) OR (f = 0 AND kind = 1 AND a.c = n.c) OR (f = 1 AND kind = 2)))""")
    + "SELECT net, owner, count(*) AS n FROM a LEFT JOIN (SELECT * FROM met WHERE r = 1) USING (alert_id) GROUP BY ALL")
def network_owners(t):
    """Alerts by the narrowest network that holds their address."""
    n = F.col("n_nationkey")
    net = F.when(n % 3 == 0, _text("10.", n % 4, ".0.0/16")).when(n % 3 == 1, _text("10.", n % 4, ".", n % 8, ".0/24")).otherwise(_text("2001:db8:", n % 4, "::/48"))
    nets = t.nation.select(F.col("n_name").alias("owner"), net.alias("net"))
    return N.longest_prefix(addressed(t).select("alert_id", "srcip"), nets, "srcip", "net", ["owner"]).groupBy("net", "owner").agg(F.count("*").alias("n"))


@query(with_(ALERTS, ADDRESSED) + "SELECT CASE WHEN f = 1 AND b = 1 THEN 'r-six' WHEN f = 0 AND b IN (2, 3) THEN 'r-four' END AS matched_rule, count(*) AS n FROM a GROUP BY 1")
def autoclose_networks(t):
    """Rules with networks of both families, over all alerts."""
    rules = [("r-six", '[{"field": "srcip", "op": "cidr", "value": "2001:db8:1::7/48"}]'), ("r-four", '[{"field": "srcip", "op": "cidr", "value": "10.2.0.0/15"}]'), ("r-bad", '[{"field": "srcip", "op": "cidr", "value": "10.0.0.0/99"}]')]
    return enrich.route(addressed(t), rules, F.lit(None).cast("string")).groupBy("matched_rule").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey AS k, CASE s_suppkey % 8 WHEN 0 THEN 'bad' || s_suppkey || '.example.com' WHEN 1 THEN '192.0.2.' || s_suppkey % 250 WHEN 3 THEN '2606:4700::' || lower(to_hex(s_suppkey % 4096 + 16))
  WHEN 5 THEN '198.51.100.' || s_suppkey % 250 END AS entry FROM supplier""")
def blocklist_entries(t):
    """The blocklist line of each indicator, or none: names, private and mapped addresses, ports, other kinds."""
    k = F.col("s_suppkey")
    kind = S.chosen(k % 8, {0: "domain", 6: "domain", 7: "url"}, "ip:port")
    forms = {0: _text("Bad", k, ".Example.com"), 1: _text("192.0.2.", k % 250, ":", 1 + k % 60000), 2: _text("10.1.", k % 200, ".1:80"), 3: _text("[2606:4700:0::", F.hex(k % 4096 + 16), "]:443"), 4: F.lit("2606:4700::5:443"), 5: _text("[::ffff:198.51.100.", k % 250, "]:53"), 6: _text("host", k, ".local"), 7: F.lit("http://a.com/")}
    value = F.element_at(F.array(*(forms[i] for i in range(8))), (k % 8 + 1).cast("int"))
    return t.supplier.select(k.alias("k"), N.blocklist_entry(kind, value).alias("entry"))


@query(f"""WITH iocs AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'domain' WHEN 1 THEN 'ip:port' WHEN 2 THEN 'md5_hash' ELSE 'url' END AS type, CASE s_suppkey % 4 WHEN 0 THEN 'd' || s_suppkey % 40 || '.evil.com'
    WHEN 1 THEN '8.8.' || s_suppkey % 5 || '.' || s_suppkey % 9 || ':' || (s_suppkey % 3 + 1) WHEN 2 THEN 'ab' || s_suppkey % 30 ELSE 'HTTP://X/' || s_suppkey % 30 END AS value, {NOW} + (s_suppkey % 5 - 2) * 86400000000 AS expires FROM supplier),
  q AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'D' || c_custkey % 40 || '.EVIL.com' WHEN 1 THEN '8.8.' || c_custkey % 5 || '.' || c_custkey % 9 WHEN 2 THEN 'AB' || c_custkey % 30 ELSE (CASE WHEN c_custkey % 8 = 3 THEN 'HTTP' ELSE 'http' END) || '://X/' || c_custkey % 30 END AS q FROM customer)
  SELECT q, value AS found, type, expires <= {NOW} AS expired, count(*) AS n FROM q JOIN iocs ON (type IN ('domain', 'md5_hash') AND value = lower(q)) OR (type IN ('ip:port', 'url') AND value = q) OR (type = 'ip:port' AND split_part(value, ':', 1) = q) GROUP BY ALL""")
def ioc_lookup(t):
    """Indicators that values name: folded by type, and by address where an indicator has a port."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    forms = [_text("d", k % 40, ".evil.com"), _text("8.8.", k % 5, ".", k % 9, ":", k % 3 + 1), _text("ab", k % 30), _text("HTTP://X/", k % 30)]
    iocs = t.supplier.select(F.element_at(F.array(*forms), (k % 4 + 1).cast("int")).alias("value"), S.chosen(k % 4, {0: "domain", 1: "ip:port", 2: "md5_hash"}, "url").alias("type"), F.lit("feed").alias("source"), (F.lit(NOW) + (k % 5 - 2).cast("long") * M.DAY).alias("expires"))
    asks = [_text(" D", c % 40, ".EVIL.com"), _text("8.8.", c % 5, ".", c % 9), _text("AB", c % 30), _text(F.when(c % 8 == 3, "HTTP").otherwise("http"), "://X/", c % 30)]
    asked = t.customer.select(F.element_at(F.array(*asks), (c % 4 + 1).cast("int")).alias("q")).distinct()
    return N.lookup(iocs, asked, "q", NOW).groupBy(F.trim("q").alias("q"), "found", "type", "expired").agg(F.count("*").alias("n"))
