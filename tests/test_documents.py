"""Frozen files, context blocks and paired measures against plain Python."""

import csv
import datetime
import hashlib
import io
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertmill.operators import context, evaluate
from alertmill.sources import freeze


def test_two_freezes_have_the_same_bytes(spark, tmp_path):
    rng = random.Random(1)
    at = datetime.datetime(2024, 1, 2, 3, 4, 5, 600000)
    rows = [(rng.randrange(50), rng.choice([None, "a,b", 'say "x"', "line\nbreak", "é", ""]), rng.choice([True, False, None]), rng.choice([at, None])) for _ in range(200)]
    kind = "id long, text string, flag boolean, at timestamp"
    entries = []
    for k in range(2):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, kind).repartition(3 + k)
        entries.append(freeze.freeze(df, f"file://{tmp_path}/{k}", "x.csv", ["id"]))
    a, b = ((tmp_path / str(k) / "x.csv").read_bytes() for k in range(2))
    assert a == b and entries[0] == entries[1] and entries[0]["sha256"] == hashlib.sha256(a).hexdigest() and entries[0]["bytes"] == len(a) and entries[0]["rows"] == 200
    got = list(csv.reader(io.StringIO(a.decode(), newline="")))
    text = lambda v: "" if v is None else {True: "true", False: "false"}[v] if isinstance(v, bool) else "2024-01-02T03:04:05.600000+00:00" if v == at else str(v)
    assert got[0] == ["id", "text", "flag", "at"] and sorted(got[1:]) == sorted([text(x) for x in r] for r in rows) and [int(r[0]) for r in got[1:]] == sorted(r[0] for r in rows)
    said = json.loads(freeze.manifest(f"file://{tmp_path}/0", [entries[0]]))
    assert said == [entries[0]] and json.loads((tmp_path / "0" / "manifest.json").read_text()) == said
    empty = freeze.freeze(spark.createDataFrame([], kind), f"file://{tmp_path}/e", "x.csv", ["id"])
    assert empty["rows"] == 0 and (tmp_path / "e" / "x.csv").read_bytes() == b"id,text,flag,at\n"


def test_version_diff(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1), (4, None, 1)], "id long, x string, y int")
    new = spark.createDataFrame([(1, "a", None), (2, "B", 2), (4, None, 1), (5, "e", 1)], "id long, x string, y int")
    got = {r["id"]: (r["change"], r["columns"]) for r in freeze.version_diff(old, new, ["id"]).collect()}
    assert got == {2: ("changed", ["x", "y"]), 3: ("removed", []), 5: ("added", [])}
    wider = freeze.version_diff(old, new.withColumn("z", F.lit(1)), ["id"])
    assert {r["id"] for r in wider.collect() if r["change"] == "changed"} == {1, 2, 4}


def test_blocks_fit_their_bytes(spark):
    rng = random.Random(4)
    rows = [(s, k, rng.choice([None, "é" * rng.randrange(12), "x" * rng.randrange(30), "日本" * 3])) for s in range(30) for k in range(rng.randrange(1, 12))]
    rows += [(99, 0, "y" * 500), (98, 0, "z" * 60), (97, 0, None)]
    df = spark.createDataFrame(rows, "s long, k long, line string")
    got = {r["s"]: r for r in context.blocks(df, "s", [F.col("k")], "line", 60).collect()}
    for s in {r[0] for r in rows}:
        lines = [t for q, _, t in sorted(rows, key=lambda r: r[:2]) if q == s and t is not None]
        if not lines:
            assert s not in got
            continue
        whole, n = "\n".join(lines), len(lines)
        if len(whole.encode()) <= 60:
            want, shown = whole, n
        else:
            room = 60 - len(f"({n} more lines)") - 1
            shown = next(k for k in range(n, -1, -1) if len("\n".join(lines[:k]).encode()) <= room)
            want = "\n".join([*lines[:shown], f"({n - shown} more lines)"])
        assert (got[s]["block"], got[s]["shown"], got[s]["omitted"]) == (want, shown, n - shown) and len(got[s]["block"].encode()) <= 60
    assert context.blocks(df.limit(0), "s", [F.col("k")], "line").count() == 0


@pytest.mark.parametrize("value, want", [(None, None), ("", None), (" \t\n ", None), ("a b", 'k="a b"'), ('say "x" y', "k=\"say 'x' y\""), ('"x"', 'k="x"'), ("a\x00b  c", 'k="a b c"'), ("x" * 10, "k=" + "x" * 10), ("x" * 11, "k=" + "x" * 9 + "…")])
def test_pairs(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(context.pair("k", F.col("v"), 10)).first()[0] == want


def test_paired_delta_is_like_resampling_rows(spark):
    rng = np.random.default_rng(5)
    truth = np.where(rng.random(250) < 0.3, "escalate", "benign")
    flip = {"benign": "escalate", "escalate": "benign"}
    first = [t if rng.random() < 0.7 else flip[t] for t in truth]
    second = [t if rng.random() < 0.9 else flip[t] for t in truth]
    df = spark.createDataFrame(list(zip(map(str, truth), map(str, first), map(str, second), strict=True)), "truth string, first string, second string")
    got = evaluate.paired_delta(df).first()
    a, b, deltas = np.array(first), np.array(second), []
    for _ in range(1000):
        k = rng.integers(0, 250, 250)
        macro = lambda said, k=k: np.mean([2 * ((said[k] == c) & (truth[k] == c)).sum() / ((said[k] == c).sum() + (truth[k] == c).sum()) for c in ("escalate", "benign")])
        deltas.append(macro(b) - macro(a))
    assert np.allclose([got["low"], got["high"]], np.quantile(deltas, [0.025, 0.975]), atol=0.02) and got["undefined"] == 0
    same = evaluate.paired_delta(df.withColumn("second", F.col("first"))).first()
    assert (same["low"], same["high"]) == (0, 0)  # the draws are shared
    nothing = spark.createDataFrame([("other", "escalate", "benign")], "truth string, first string, second string")
    assert tuple(evaluate.paired_delta(nothing).first()) == (None, None, 1.0) and evaluate.paired_delta(df.limit(0)).count() == 0


def test_power(spark):
    needed = lambda d, psi: (evaluate.Z_ERROR * math.sqrt(psi) + evaluate.Z_POWER * math.sqrt(psi - d * d)) ** 2 / (d * d)
    cases = [(n, psi) for n in (5, 56, 400, 10**6) for psi in (0.05, 0.2, 0.6)]
    rows = spark.createDataFrame(cases, "n long, psi double").select("n", "psi", evaluate.least_difference(F.col("n"), F.col("psi")).alias("d"), evaluate.pairs_needed(F.lit(0.1), F.col("psi")).alias("need")).collect()
    for r in rows:
        assert r["need"] == pytest.approx(needed(0.1, r["psi"]))
        low, high = 0.001, r["psi"] - 1e-6
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if needed(mid, r["psi"]) > r["n"] else (low, mid)
        assert r["d"] == pytest.approx(high, abs=2e-3)
    odd = spark.createDataFrame([(0, 0.0), (None, None)], "n long, psi double").select(evaluate.least_difference(F.col("n"), F.col("psi")), evaluate.pairs_needed(F.lit(0.0), F.col("psi"))).collect()
    assert [tuple(r) for r in odd] == [(None, None)] * 2


def test_lines_of_a_block_are_worked_out_once(spark):
    """Each value is folded by one expression in the whole plan of the blocks, however often its line is looked at."""
    df = spark.range(5).select("id", F.col("id").cast("string").alias("v"))
    made = context.blocks(df.withColumn("line", context.line("a", {"k": F.col("v"), "l": F.col("v")})), "id", [F.col("v")], "line")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 2
