"""Typed reads of JSON: order of faults, closed sets, and what is kept."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from alertmill.functions import typed

GOOD = {"enrichment": {"schema_version": "1.4", "extra": 1, "asset": {"criticality": "high", "in_inventory": True, "owner": "ann", "role": None, "user_is_admin": False}, "ti": [{"verdict": "clean"}, {"verdict": "suspicious", "x": 1}], "ioc": {"verdict": "malicious"}}}
ANSWER = {
    "suggested_action": "true_positive", "confidence": "low", "playbook_used": None, "summary": "s", "reading_attack": "a", "reading_benign": "b", "would_change": "w", "next_checks": ["one", "two"], "extra": {"x": 1},
    "structured_basis": {"severity": "low", "ioc_reputation": "clean", "asset_criticality": "unknown", "identity_privileged": "true", "occurrence_count": 3, "playbook_rule_applied": None, "more": 1},
    "reasons": [{"claim": "c", "quote": "q", "source": "context", "z": 0}],
}


def changed(doc, path, value="GONE"):
    doc = copy.deepcopy(doc)
    *head, last = path
    node = doc
    for p in head:
        node = node[p]
    if value == "GONE":
        del node[last]
    else:
        node[last] = value
    return doc


E = ("enrichment",)
FAULTS = [
    (None, "enrichment", "missing"), ("[1]", "enrichment", "missing"), ("{not json", "enrichment", "missing"), ({"enrichment": None}, "enrichment", "missing"), ({"enrichment": "x"}, "enrichment", "wrong type"),
    (changed(GOOD, (*E, "schema_version")), "enrichment.schema_version", "missing or not 1.x"), (changed(GOOD, (*E, "schema_version"), "1.x"), "enrichment.schema_version", "missing or not 1.x"), (changed(GOOD, (*E, "schema_version"), 1.0), "enrichment.schema_version", "missing or not 1.x"),
    (changed(GOOD, (*E, "asset"), 3), "enrichment.asset", "wrong type"), (changed(GOOD, (*E, "asset", "criticality"), 3), "enrichment.asset.criticality", "wrong type"), (changed(GOOD, (*E, "asset", "criticality"), None), "enrichment.asset.criticality", "wrong type"),
    (changed(GOOD, (*E, "asset", "criticality"), "huge"), "enrichment.asset.criticality", "outside its vocabulary"), (changed(GOOD, (*E, "asset", "in_inventory"), "true"), "enrichment.asset.in_inventory", "wrong type"), (changed(GOOD, (*E, "asset", "owner"), ["x"]), "enrichment.asset.owner", "wrong type"),
    (changed(GOOD, (*E, "asset", "user_is_admin"), 1), "enrichment.asset.user_is_admin", "wrong type"), (changed(GOOD, (*E, "ti"), {}), "enrichment.ti", "wrong type"), (changed(GOOD, (*E, "ti"), ["x"]), "enrichment.ti[]", "wrong type"), (changed(GOOD, (*E, "ti", 1, "verdict"), "bad"), "enrichment.ti[].verdict", "outside its vocabulary"),
    (changed(GOOD, (*E, "ti", 0, "verdict")), "enrichment.ti[].verdict", "wrong type"), (changed(GOOD, (*E, "ioc"), []), "enrichment.ioc", "wrong type"), (changed(GOOD, (*E, "ioc"), {}), "enrichment.ioc.verdict", "wrong type"),
    # the first of two
    (changed(changed(GOOD, (*E, "ioc"), {}), (*E, "asset", "owner"), 1), "enrichment.asset.owner", "wrong type"),
]


def test_enrichment_names_its_first_fault(spark):
    rows = [(i, x if x is None or isinstance(x, str) else json.dumps(x)) for i, (x, _, _) in enumerate(FAULTS)]
    got = {r["i"]: r["c"] for r in spark.createDataFrame(rows, "i int, t string").select("i", typed.enrichment(F.col("t"), F.lit(True)).alias("c")).collect()}
    for i, (_, field, fault) in enumerate(FAULTS):
        assert tuple(got[i]["fault"]) == (field, fault), rows[i]
        assert tuple(got[i])[1:] == (False, "unknown", None, None, None, "skipped", "skipped", "skipped", "skipped")


def test_enrichment_values(spark):
    cases = [
        (GOOD, True, (True, "high", "ann", None, False, "malicious", "found", "found", "found")),
        (GOOD, False, (True, "high", "ann", None, None, "malicious", "found", "skipped", "found")),
        (changed(GOOD, (*E, "asset", "user_is_admin"), True), False, (True, "high", "ann", None, True, "malicious", "found", "found", "found")),
        ({"enrichment": {"schema_version": "1.0"}}, True, (False, "unknown", None, None, None, "skipped", "skipped", "skipped", "skipped")),
        ({"enrichment": {"schema_version": "1.0", "asset": {"in_inventory": False}, "ti": [], "ioc": None}}, None, (False, "unknown", None, None, None, "skipped", "not_found", "skipped", "skipped")),
        (changed(GOOD, (*E, "ioc")), True, (True, "high", "ann", None, False, "suspicious", "found", "found", "found")),
    ]
    rows = [(i, json.dumps(doc), named) for i, (doc, named, _) in enumerate(cases)]
    for r in spark.createDataFrame(rows, "i int, t string, named boolean").select("i", typed.enrichment(F.col("t"), F.col("named")).alias("c")).collect():
        assert r["c"]["fault"] is None and tuple(r["c"])[1:] == cases[r["i"]][2]


B, R = ("structured_basis",), ("reasons", 0)
ANSWERS = [
    (ANSWER, None), ("[]", "result: expected object"), (None, "result: expected object"), *((changed(ANSWER, (n,)), f"{n}: missing") for n in typed.FIELDS), (changed(ANSWER, ("suggested_action",), "close"), "suggested_action: invalid"), (changed(ANSWER, ("confidence",), 1), "confidence: invalid"),
    (changed(ANSWER, B, []), "structured_basis: expected object"), (changed(ANSWER, (*B, "occurrence_count")), "structured_basis.occurrence_count: missing"), (changed(ANSWER, (*B, "severity"), "none"), "structured_basis.severity: invalid"), (changed(ANSWER, (*B, "identity_privileged"), True), "structured_basis.identity_privileged: invalid"),
    (changed(ANSWER, (*B, "occurrence_count"), True), "structured_basis.occurrence_count: expected integer"), (changed(ANSWER, (*B, "occurrence_count"), 1.5), "structured_basis.occurrence_count: expected integer"), (changed(ANSWER, (*B, "playbook_rule_applied"), 1), "structured_basis.playbook_rule_applied: expected string or null"),
    (changed(ANSWER, ("reasons",), {}), "reasons: expected array"), (changed(ANSWER, R, "x"), "reasons[]: expected object"), (changed(ANSWER, (*R, "quote")), "reasons[].quote: missing"), (changed(ANSWER, (*R, "claim"), 1), "reasons[].claim: expected string"), (changed(ANSWER, (*R, "source"), "web"), "reasons[].source: invalid"),
    (changed(ANSWER, ("playbook_used",), 1), "playbook_used: expected string or null"), (changed(ANSWER, ("summary",), None), "summary: expected string"), (changed(ANSWER, ("next_checks",), "x"), "next_checks: expected array"), (changed(ANSWER, ("next_checks",), []), "next_checks: expected non-empty array"), (changed(ANSWER, ("next_checks", 1), 2), "next_checks[]: expected string"),
]


def test_answers_are_guarded(spark):
    rows = [(i, x if x is None or isinstance(x, str) else json.dumps(x)) for i, (x, _) in enumerate(ANSWERS)]
    got = {r["i"]: r["c"] for r in spark.createDataFrame(rows, "i int, t string").select("i", typed.guarded_answer(F.col("t")).alias("c")).collect()}
    for i, (_, fault) in enumerate(ANSWERS):
        assert got[i]["fault"] == fault and (got[i]["answer"] is None) == (fault is not None), rows[i]
    a = got[0]["answer"].asDict(True)
    assert "extra" not in a and a["structured_basis"]["occurrence_count"] == 3 and a["reasons"] == [{"claim": "c", "quote": "q", "source": "context"}] and a["next_checks"] == ["one", "two"]


@pytest.mark.parametrize("text", ["", "nul", '{"a": 1} x'])
def test_unreadable_texts_have_no_context(spark, text):
    c = spark.createDataFrame([(text,)], "t string").select(typed.enrichment(F.col("t"), F.lit(True)).alias("c")).first()["c"]
    assert tuple(c["fault"]) == ("enrichment", "missing")
