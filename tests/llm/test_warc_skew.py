"""A payload that half of all pages share: counted without payloads, and its rows are split."""

from collections import Counter

from alertmill.llm import warc


def test_a_frequent_payload_is_split(spark):
    rows = [(i, "u", "same " * 2000 if i % 2 else f"page {i} " * 40) for i in range(3000)] + [(1, "again", "same " * 2000), (None, "v", "page 2 " * 40), (9000, "w", None), (9001, "w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        typed = warc.with_types(pages).select("page_id", "url", "n", "first_id", "payload")
        got = typed.rdd.mapPartitions(lambda it: [[tuple(r)[:4] for r in it]]).collect()
        plan = typed._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    payload = {}
    for i, _, h in rows:
        payload.setdefault(h or "", []).append(i)
    want = Counter((i, u, len(h or ""), min(x for x in payload[h or ""] if x is not None)) for i, u, h in rows)
    assert Counter(r for part in got for r in part) == want
    sizes = [len(p) for p in got if p]
    assert "skew=true" in plan and max(sizes) < 1000
