"""Operators on small tables: streams against the batch fold, samples, draws, guards, with null and boundary rows."""

import numpy as np
from pyspark.sql import functions as F

from alertmill.operators import decisions as D
from alertmill.operators import evaluate, filters, retrieve, sessions
from alertmill.plans import extra, model
from alertmill.sources import alerts as A
from alertmill.streaming import clusters

SF_DIR = "/root/testdata/sf0.001"


def test_stream_equals_the_batch_fold(spark):
    t = model.Tables(spark, SF_DIR)
    from alertmill.plans import registry

    rows = t.events.select(F.col("event_type").alias("rule_id"), F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("agent_name"), model.micros(F.col("ts")).alias("t"), F.col("event_id").alias("alert_id"))
    want = sessions.fold_clusters(rows, ("rule_id", "agent_name"), gap=extra.STREAM_GAP, age=extra.STREAM_AGE, size=extra.STREAM_SIZE)
    got = registry.QUERIES["stream_clusters"](spark, SF_DIR)
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(want.columns)
    as_set = lambda df: sorted(map(str, df.select(*names).collect()))
    assert as_set(got) == as_set(want) and got.filter("closed_by is null").count() > 0


def test_fold_at_the_bounds(spark):
    s = 1_000_000
    times = [0, 900, 1801, 1801 + 900]  # a gap of exactly 15 minutes joins, one second more splits
    rows = [("r", "", "d", "h", t * s, i) for i, t in enumerate(times)] + [("r", "", "d", "h2", k * 600 * s, 100 + k) for k in range(26)]
    df = spark.createDataFrame(rows, "rule_id string, srcip string, dstip string, agent_name string, t long, alert_id long")
    got = {(r["agent_name"], r["first_id"]): (r["n"], r["closed_by"]) for r in sessions.fold_clusters(df).collect()}
    assert got == {("h", 0): (2, "idle_gap"), ("h", 2): (2, None), ("h2", 100): (25, "max_age"), ("h2", 125): (1, None)}  # an age of exactly 4 h joins
    assert sessions.fold_clusters(df.limit(0)).count() == 0


def test_bootstrap_is_like_resampling_rows(spark):
    rng = np.random.default_rng(2)
    truth = np.where(rng.random(300) < 0.3, "escalate", "benign")
    verdict = np.where(rng.random(300) < 0.8, truth, np.where(truth == "benign", "escalate", "benign"))
    df = spark.createDataFrame([(str(a), str(b)) for a, b in zip(truth, verdict, strict=True)], "truth string, verdict string")
    got = evaluate.bootstrap(df).first()
    f1 = []
    for _ in range(1000):
        k = rng.integers(0, 300, 300)
        a, b = truth[k], verdict[k]
        f1.append(np.mean([2 * ((a == c) & (b == c)).sum() / ((a == c).sum() + (b == c).sum()) for c in ("escalate", "benign")]))
    assert np.allclose([got["low"], got["high"]], np.quantile(f1, [0.025, 0.975]), atol=0.02)
    assert evaluate.bootstrap(df.limit(0)).count() <= 1


def test_strata_and_their_places(spark):
    assert evaluate.largest_remainder({"a": 5, "b": 3, "c": 2}, 5) == {"a": 3, "b": 1, "c": 1}
    assert evaluate.largest_remainder({"a": 0}, 5) == {"a": 0}
    df = spark.createDataFrame([(i, "a" if i < 60 else "b" if i < 90 else None) for i in range(100)], "id long, s string")
    got = evaluate.stratified(df.filter("s is not null"), ["s"], "id", 30, 7)
    again = evaluate.stratified(df.filter("s is not null"), ["s"], "id", 30, 7)
    assert {r["s"]: r["n"] for r in got.groupBy("s").agg(F.count("*").alias("n")).collect()} == {"a": 20, "b": 10}
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in again.collect())


def test_changed_keys_overflow(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k long")
    assert sorted(r[0] for r in clusters.changed_keys(df, "k", 3).collect()) == ["1", "2", "3"]
    assert [r[0] for r in clusters.changed_keys(df, "k", 2).collect()] == ["many"]
    assert clusters.changed_keys(df.limit(0), "k", 2).count() == 0


def test_windows_rows_heartbeats_and_event_times(spark):
    win = '{"id":"1","timestamp":"2024-01-01T00:00:00Z","rule":{"id":"9","description":"d","level":"12"},"manager":{"name":"m"},"decoder":{"name":"windows_eventchannel"},"data":{"win":{"system":{"message":"msg","systemTime":"2024-01-01T01:00:00.5Z"},"eventdata":{"ipAddress":"-","sourceIp":"10.1.1.1","targetUserName":"HOST$","subjectUserName":"D\\\\bob","ipPort":"x","sourcePort":"48104"}}}}'
    beat = '{"_source":{"id":"2","timestamp":"2024-01-01T07:00:00+0700","rule":{"id":"100999","description":"beat","level":3},"timing":{"event_time":"2024-01-01T00:00:00"}}}'
    rows = [win, beat, '{"id":"3"}', '{"id":"4","rule":{"id":"1"}}', '{"id":"5","rule":{"id":"1","description":"d"},"timestamp":"later"}', '{"rule":{}}', "[]", "", None]
    got = A.parse(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    by = {r["value"]: r for r in got}
    w = by[win]
    assert (w["agent_name"], w["srcip"], w["src_port"], w["alert_user"], w["raw_log"], w["severity"], w["srcip_is_private"]) == ("m", "10.1.1.1", 0, "bob", "msg", "critical", True)
    assert w["event_time"].isoformat() == "2024-01-01T01:00:00.500000" and by[beat]["event_time"] is None and by[beat]["is_heartbeat"]
    assert [by[r]["rejected"] for r in rows] == [None, None, "missing_rule_id", "missing_description", "bad_timestamp", "missing_id", "not_json", "not_json", "not_json"]
    assert [r["alert_id"] for r in A.accepted(A.parse(spark.createDataFrame([(r,) for r in rows], "value string"))).collect()] == ["1"]
    assert A.parse(spark.createDataFrame([], "value string")).count() == 0


def test_guards_and_pages(spark):
    df = spark.createDataFrame([(None, None, None), (["step6", "x"], ["severity", "severity", "y"], "invalid")], "f array<string>, m array<string>, v string")
    assert [r[0] for r in df.select(D.held_reasons(F.col("f"), F.col("m"), F.col("v"))).collect()] == [[], ["fp_policy:severity", "verifier_invalid"]]
    one = spark.createDataFrame([(80, "incident"), (79, "incident"), (80, "benign"), (79, "benign"), (None, "incident"), (90, None)], "p int, s string")
    assert [r[0] for r in one.select(D.knowledge_verdict(F.col("p"), F.col("s"), 80)).collect()] == ["true_positive", "false_positive", "false_positive", None, None, None]
    assert [r[0] for r in one.select(D.knowledge_verdict(F.col("p"), F.col("s"), 0)).collect()] == [None] * 6
    n = spark.range(5)
    assert [tuple(r) for r in filters.cut_page(n, [F.col("id")], 3).orderBy("id").collect()] == [(0, True), (1, True), (2, True)]
    assert [r["truncated"] for r in filters.cut_page(n, [F.col("id")], 5).collect()] == [False] * 5 and filters.cut_page(n.limit(0), [F.col("id")], 5).count() == 0
    assert [r["id"] for r in filters.page(n, [F.col("id")], 2, 2).collect()] == [2, 3]
    text = spark.createDataFrame([("50%_a\\b",), ("50xa",), (None,)], "c string")
    assert [r[0] for r in text.select(filters.contains_text(F.col("c"), "%_A\\")).collect()] == [True, False, None]
    truths = D.case_truth(spark.createDataFrame([(1, "TP"), (1, None), (2, "FP"), (2, None), (3, "FP")], "c int, l string"), "c", "l")
    assert {r["c"]: r["truth"] for r in truths.collect()} == {1: "TP", 2: None, 3: "FP"}


def test_nearest_by_scan_and_by_join(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, "m" if i % 4 else "n", rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(60)] + [(70, "m", None), (71, "m", [0.0] * 5), (72, "m", [1.0]), (73, None, [1.0] * 5)]
    e = spark.createDataFrame(rows, "entry long, model string, embedding array<double>")
    q = e.filter("entry % 7 = 0 or entry > 69").withColumnRenamed("entry", "query")
    want = []
    for i, m, v in rows:
        if (i % 7 == 0 or i > 69) and v and any(v) and m:
            near = [(-np.dot(v, w) / (np.dot(v, v) * np.dot(w, w)) ** 0.5, j) for j, n, w in rows if j != i and n == m and w and len(w) == len(v) and any(w)]
            want += [(i, j, r + 1) for r, (_, j) in enumerate(sorted((round(s, 12), j) for s, j in near)[:3])]
    close = lambda df: sum((r["query"], r["entry"], r["rank"]) in set(want) for r in df.collect())
    got = retrieve.nearest_exact(q, e, 3)
    assert got.count() == len(want) and close(got) >= 0.9 * len(want)  # equal cosines may differ in their last bit
    monkeypatch.setattr(retrieve, "SENT_NUMBERS", 0)
    got = retrieve.nearest_exact(q, e, 3)
    assert got.count() == len(want) and close(got) >= 0.9 * len(want)
