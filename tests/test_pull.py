"""The pull reader over recorded pages and over HTTP: page walks, restarts, overlaps, retries."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from alertmill.sources import pull

HOUR = 3_600_000


def alert(i, at, rule="5710", manager="m1"):
    return {"_id": f"x{i}", "_source": {"id": f"a{i}", "timestamp": "t", "rule": {"id": rule}, "manager": {"name": manager}, "text": 'é "quoted" } ] ,'}, "sort": [at, f"x{i}"]}


def record(folder, hits, name=""):
    hits = sorted(hits, key=lambda h: h["sort"])
    for k in range(0, len(hits), 7):
        part = hits[k : k + 7]
        (folder / f"{part[0]['sort'][0]}-{part[-1]['sort'][0]}-{name}{k}.json").write_text(json.dumps({"took": 3, "hits": {"total": {"hits": [1]}, "hits": part}}, ensure_ascii=False))


def rows(df):
    return sorted((r["sort_ms"], r["manager_id"], r["source_alert_id"], r["heartbeat"], json.dumps(json.loads(r["value"]), sort_keys=True)) for r in df.collect())


def want(hits):
    return sorted((h["sort"][0], h["_source"]["manager"]["name"], h["_source"]["id"], h["_source"]["rule"]["id"] == "100999", json.dumps(h, sort_keys=True)) for h in hits)


def test_hits_keep_their_text():
    page = '{"a": {"hits": 1}, "hits": {"total": 2, "hits": [ {"sort": [1], "n": 1.50} , {"sort":[2]}]}}'
    assert [raw for _, raw in pull.hits_of(page)] == ['{"sort": [1], "n": 1.50}', '{"sort":[2]}']
    assert pull.hits_of('{"hits":{"hits":[]}}') == []
    for bad in ('{"hits": {}}', "{}"):
        with pytest.raises(ValueError):
            pull.hits_of(bad)


@pytest.mark.parametrize("size", [1, 3, 7, 500])
def test_backfill_reads_the_span_once(spark, tmp_path, size):
    rng = random.Random(1)
    hits = [alert(i, rng.randrange(50) * 1000, rng.choice(["5710", "100999"])) for i in range(60)]
    record(tmp_path, hits)
    at = {"pages": f"file://{tmp_path}", "page_size": size, "partitions": 4}
    assert rows(pull.backfill(spark, **at)) == want(hits)
    assert rows(pull.backfill(spark, since=10_000, until=31_000, **at)) == want([h for h in hits if 10_000 <= h["sort"][0] < 31_000])
    assert pull.backfill(spark, since=60_000, **at).count() == 0


def test_a_pull_goes_on_from_its_checkpoint(spark, tmp_path):
    """Stopped and started again over pages that grow, with alerts that are indexed late: each alert once, as the batch reads it."""
    pages, out, mark = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "mark")
    pages.mkdir()
    options = {"pages": f"file://{pages}", "page_size": 5, "partitions": 3, "overlap_s": 60}
    pull.ingest(spark, out, mark, **options).awaitTermination()  # nothing there yet
    rng = random.Random(2)
    first = [alert(i, HOUR + rng.randrange(600_000), manager=rng.choice(["m1", "m2"])) for i in range(40)] + [alert(99, HOUR, "100999")]
    record(pages, first, "first")
    pull.ingest(spark, out, mark, **options).awaitTermination()
    newest = max(h["sort"][0] for h in first)
    late = [alert(200 + i, newest - rng.randrange(59_000)) for i in range(10)]
    more = [alert(300 + i, newest + 1 + rng.randrange(600_000)) for i in range(30)]
    same_id = [alert(300, newest + 500_000, manager="m9")]
    record(pages, [*late, *more, *same_id], "second")
    for _ in range(3):  # a start without news changes nothing
        pull.ingest(spark, out, mark, **options).awaitTermination()
    got = spark.read.parquet(out)
    assert rows(got) == want([*first, *late, *more, *same_id])
    assert rows(got) == rows(pull.backfill(spark, **options).dropDuplicates(["manager_id", "source_alert_id"]))
    assert got.filter("heartbeat").count() == 1


def test_a_replayed_batch_asks_for_the_same_span():
    reader = pull.StreamReader({"pages": "file:///x", "partitions": "3", "overlap_s": "60", "since": "2024-01-01"})
    begin = 1_704_067_200_000
    spans = reader.partitions({"last_sort": None}, {"last_sort": begin + 100_000})
    assert (spans[0].gte, spans[-1].lt) == (begin, begin + 100_001) and all(a.lt == b.gte for a, b in zip(spans, spans[1:], strict=False))
    again = reader.partitions({"last_sort": begin + 100_000}, {"last_sort": begin + 200_000})
    assert (again[0].gte, again[-1].lt) == (begin + 40_000, begin + 200_001)
    assert [(s.gte, s.lt) for s in reader.partitions({"last_sort": begin}, {"last_sort": None})] == [(0, 0)]


class Index(BaseHTTPRequestHandler):
    hits: list = []
    failures = 0
    asked: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if Index.failures:
            Index.failures -= 1
            self.send_error(503)
            return
        if self.headers.get("Authorization") != "ApiKey k":
            self.send_error(401)
            return
        Index.asked.append(body)
        span, after = body.get("query", {}).get("range", {}).get("timestamp", {}), body.get("search_after")
        found = [h for h in Index.hits if span.get("gte", 0) <= h["sort"][0] < span.get("lt", 1 << 62) and (not after or h["sort"] > after)]
        found.sort(key=lambda h: h["sort"], reverse=body["sort"][0]["timestamp"] == "desc")
        text = json.dumps({"hits": {"hits": found[: body["size"]]}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(text)

    def log_message(self, *args):
        pass


def test_over_http_with_failures(spark):
    server = HTTPServer(("127.0.0.1", 0), Index)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    options = {"url": f"http://127.0.0.1:{server.server_port}", "index": "alerts", "authorization": "ApiKey k", "page_size": 4, "partitions": 2}
    Index.hits, Index.failures = [alert(i, i * 10) for i in range(23)], 2
    assert rows(pull.backfill(spark, **options)) == want(Index.hits)
    assert any("search_after" in b for b in Index.asked)
    reader = pull.Reader(options | {"authorization": "wrong"})
    with pytest.raises(Exception, match="401"):
        reader.partitions()
    Index.failures = pull.TRIES
    with pytest.raises(Exception, match="503"):
        reader.partitions()
    server.shutdown()


def test_recorded_pages_are_read_back(spark, tmp_path):
    own = [(k * 7 % 100, f"i{k}", json.dumps({"id": f"a{k}", "rule": {"id": "1"}})) for k in range(100)]
    pull.record_pages(spark.createDataFrame(own, "sort_ms long, id string, value string"), f"file://{tmp_path}/p", 9)
    got = pull.backfill(spark, pages=f"file://{tmp_path}/p", page_size=11)
    assert sorted((r["sort_ms"], r["source_alert_id"]) for r in got.collect()) == sorted((s, json.loads(v)["id"]) for s, _, v in own)


def test_a_span_lists_once_and_reads_each_file_once(tmp_path):
    """Also where files overlap, as after a late recording."""
    rng = random.Random(3)
    hits = [alert(i, rng.randrange(5000)) for i in range(300)]
    record(tmp_path, hits[:200], "a")
    record(tmp_path, hits[200:], "b")
    pages, calls = pull.Recorded({"pages": f"file://{tmp_path}"}), []

    class Counted:
        def __init__(self, store):
            self.store = store

        def __getattr__(self, name):
            calls.append(name)
            return getattr(self.store, name)

    pages.store = Counted(pages.store)
    got = [h["sort"] for h, _ in pages.hits(1000, 4000, 5)]
    assert got == sorted(h["sort"] for h in hits if 1000 <= h["sort"][0] < 4000)
    files = [f.stem.split("-") for f in tmp_path.iterdir()]
    assert calls.count("get_file_info") == 1
    assert calls.count("open_input_stream") == sum(int(f[1]) >= 1000 and int(f[0]) < 4000 for f in files)
