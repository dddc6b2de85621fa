"""Pulls alerts from a search index page by page: a Python data source for backfills and for streams.

    spark.dataSource.register(SearchSource)
    spark.read.format("alert_search").options(url=..., index=..., since=..., until=...).load()     a backfill
    spark.readStream.format("alert_search").options(url=..., index=...).load()                      the live pull

An offset is the newest sort value that has been asked for. A batch reads from `overlap_s` before the last offset, so that
alerts indexed late come along, up to the newest value; it is cut by time into partitions, which executors page through on
their own (search_after), and its bounds are in the checkpoint, so that a replay asks for the same span. What the overlap reads
again is taken out downstream: ingest() keeps each (manager, alert) once.
"""

from __future__ import annotations

import heapq
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from alertmill import params as P

SCHEMA = "sort_ms long, manager_id string, source_alert_id string, heartbeat boolean, value string"
PAGE, OVERLAP_S, PARTITIONS, TRIES, TIMEOUT_S = 500, 60, 8, 4, 60
#: Sort values are milliseconds; an open end is this one.
ENDLESS = 1 << 62


def skip(text: str, at: int) -> int:
    while at < len(text) and text[at] in " \t\r\n":
        at += 1
    return at


def member(text: str, at: int, name: str) -> int | None:
    """Where the value of an object's member begins; at: where the object does."""
    decoder = json.JSONDecoder()
    at = skip(text, at + 1)
    while text[at] != "}":
        key, at = decoder.raw_decode(text, at)
        at = skip(text, skip(text, at) + 1)  # the colon
        if key == name:
            return at
        _, at = decoder.raw_decode(text, at)
        at = skip(text, at)
        if text[at] == ",":
            at = skip(text, at + 1)
    return None


def hits_of(page: str) -> list[tuple[dict, str]]:
    """The hits of a result page, each as read and as it was written."""
    outer = member(page, skip(page, 0), "hits")
    at = None if outer is None else member(page, outer, "hits")
    if at is None or page[at] != "[":
        raise ValueError("a result page without hits.hits")
    decoder, out = json.JSONDecoder(), []
    at = skip(page, at + 1)
    while page[at] != "]":
        hit, end = decoder.raw_decode(page, at)
        out.append((hit, page[at:end]))
        at = skip(page, end)
        if page[at] == ",":
            at = skip(page, at + 1)
    return out


def sort_of(hit: dict) -> int:
    return int(hit["sort"][0])


# --- where pages come from


class Http:
    """A search index over HTTP. Requests that fail by network or server are tried again; others fail at once."""

    def __init__(self, options: dict):
        self.url = f"{options['url'].rstrip('/')}/{options.get('index', 'alerts-*')}/_search"
        self.header = options.get("authorization")

    def post(self, body: dict) -> str:
        headers = {"Content-Type": "application/json"} | ({"Authorization": self.header} if self.header else {})
        for left in range(TRIES - 1, -1, -1):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), headers), timeout=TIMEOUT_S) as answer:
                    return answer.read().decode()
            except urllib.error.HTTPError as e:
                if e.code < 500 or not left:
                    raise
            except OSError:
                if not left:
                    raise
            time.sleep(0.2 * 2 ** (TRIES - left))
        raise AssertionError

    def page(self, gte: int, lt: int, after: list | None, size: int) -> str:
        span = {"gte": gte} | ({"lt": lt} if lt < ENDLESS else {})
        body = {"size": size, "sort": [{"timestamp": "asc"}, {"_id": "asc"}], "fields": ["timestamp"], "query": {"range": {"timestamp": span}}}
        return self.post(body | ({"search_after": after} if after else {}))

    def hits(self, gte: int, lt: int, size: int) -> Iterator[tuple[dict, str]]:
        """All hits with gte <= sort < lt, page after page until one is not full."""
        after = None
        while True:
            found = hits_of(self.page(gte, lt, after, size))
            yield from found
            if len(found) < size:
                return
            after = found[-1][0]["sort"]

    def newest(self) -> int | None:
        hits = hits_of(self.post({"size": 1, "sort": [{"timestamp": "desc"}], "fields": ["timestamp"]}))
        return sort_of(hits[0][0]) if hits else None


class Recorded:
    """Pages recorded as files of a folder (any file system that Arrow reads), named <first>-<last>[-...].json by their sort
    values, so that a span opens only the files that it meets."""

    def __init__(self, options: dict):
        from pyarrow import fs

        self.store, self.folder = fs.FileSystem.from_uri(options["pages"])

    def files(self) -> list[tuple[int, int, str]]:
        from pyarrow import fs

        names = [f.path for f in self.store.get_file_info(fs.FileSelector(self.folder)) if f.base_name.endswith(".json")]
        return sorted((*map(int, n.rsplit("/", 1)[-1].removesuffix(".json").split("-")[:2]), n) for n in names)

    def hits(self, gte: int, lt: int, size: int) -> Iterator[tuple[dict, str]]:
        """All hits of the span in order. The folder is listed once and each file of the span read once; what is held are the hits
        of files that overlap."""
        held: list[tuple[list, int, dict, str]] = []
        n = 0
        for first, last, name in self.files():
            if last < gte or first >= lt:
                continue
            while held and held[0][0][0] < first:
                yield heapq.heappop(held)[2:]
            with self.store.open_input_stream(name) as f:
                for hit, raw in hits_of(f.read().decode()):
                    if gte <= sort_of(hit) < lt:
                        heapq.heappush(held, (hit["sort"], n := n + 1, hit, raw))
        while held:
            yield heapq.heappop(held)[2:]

    def newest(self) -> int | None:
        return max((last for _, last, _ in self.files()), default=None)


# --- the data source


@dataclass
class Span(InputPartition):
    gte: int
    lt: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.size = int(options.get("page_size", PAGE))
        self.partitions_wanted = max(1, int(options.get("partitions", PARTITIONS)))

    def source(self) -> Http | Recorded:
        if ("url" in self.options) == ("pages" in self.options):
            raise ValueError("give either url or pages")
        return Http(self.options) if "url" in self.options else Recorded(self.options)

    def since(self) -> int:
        """The first sort value of a pull: the option `since`, a day or milliseconds."""
        given = self.options.get("since", "0")
        if given.lstrip("-").isdigit():
            return int(given)
        from datetime import UTC, datetime

        return int(datetime.fromisoformat(given).replace(tzinfo=UTC).timestamp() * 1000)

    def cut(self, gte: int, lt: int) -> list[Span]:
        """The span in parts of equal time."""
        n = max(1, min(self.partitions_wanted, lt - gte))
        edges = [gte + (lt - gte) * k // n for k in range(n)] + [lt]
        return [Span(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def partitions(self) -> list[Span]:
        newest = self.source().newest()
        end = min(int(self.options.get("until", ENDLESS)), ENDLESS if newest is None else newest + 1)
        return self.cut(self.since(), end) if newest is not None and end > self.since() else [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        if partition.gte >= partition.lt:
            return
        for hit, raw in self.source().hits(partition.gte, partition.lt, self.size):
            alert = hit.get("_source") or {}
            rule, manager = alert.get("rule") or {}, alert.get("manager") or {}
            yield sort_of(hit), manager.get("name"), alert.get("id"), rule.get("id") == P.HEARTBEAT_RULE, raw


class StreamReader(Reader, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.overlap = int(float(options.get("overlap_s", OVERLAP_S)) * 1000)

    def initialOffset(self) -> dict:
        return {"last_sort": None}

    def latestOffset(self) -> dict:
        return {"last_sort": self.source().newest()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        last, newest = start["last_sort"], end["last_sort"]
        if newest is None:
            return [Span(0, 0)]
        return self.cut(self.since() if last is None else max(self.since(), last - self.overlap), newest + 1)

    def commit(self, end: dict) -> None:
        pass


class SearchSource(DataSource):
    """Options: url (with index, authorization) or pages; since, until (backfills); page_size, partitions, overlap_s."""

    @classmethod
    def name(cls) -> str:
        return "alert_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


# --- pulls


def backfill(spark: SparkSession, **options: object) -> DataFrame:
    """A row for each hit between since and until; no cursor is read or moved."""
    spark.dataSource.register(SearchSource)
    return spark.read.format("alert_search").options(**options).load()


def pulled(spark: SparkSession, **options: object) -> DataFrame:
    """The live pull as a stream. Hits of the overlap come again."""
    spark.dataSource.register(SearchSource)
    return spark.readStream.format("alert_search").options(**options).load()


def once_each(rows: DataFrame, overlap_s: float = OVERLAP_S) -> DataFrame:
    """A stream of pulled rows with each (manager, alert) once. What the overlap can bring again is at most so old, and its keys
    are in the state for twice as long. Rows without an alert id are told apart by their text."""
    key = F.coalesce("source_alert_id", F.concat(F.lit("#"), F.sha2("value", 256)))
    timed = rows.withColumns({"_at": F.timestamp_millis("sort_ms"), "_manager": F.coalesce("manager_id", F.lit("")), "_alert": key})
    return timed.withWatermark("_at", f"{int(2 * overlap_s * 1000)} milliseconds").dropDuplicatesWithinWatermark(["_manager", "_alert"]).drop("_at", "_manager", "_alert")


def ingest(spark: SparkSession, path: str, checkpoint: str, every: str | None = None, **options: object) -> StreamingQuery:
    """Pulls into a Parquet table at path, each alert once, from where the checkpoint stands. every: the trigger's interval, as
    "60 seconds"; without one all that is there is pulled and the query ends. Heartbeats are rows of their own kind."""
    rows = once_each(pulled(spark, **options), float(options.get("overlap_s", OVERLAP_S)))
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def record_pages(alerts: DataFrame, path: str, size: int = PAGE) -> None:
    """Writes rows of (sort_ms, id, value: an alert as JSON) as pages that Recorded reads, each task its own part of the order."""
    from collections.abc import Iterable

    ordered = alerts.select("sort_ms", F.col("id").cast("string").alias("id"), "value").repartitionByRange("sort_ms", "id").sortWithinPartitions("sort_ms", "id")

    def write(rows: Iterable) -> None:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        held: list = []

        def put() -> None:
            body = ",".join(f'{{"_id": {json.dumps(r["id"])}, "_source": {r["value"]}, "sort": [{r["sort_ms"]}, {json.dumps(r["id"])}]}}' for r in held)
            with store.open_output_stream(f"{folder}/{held[0]['sort_ms']}-{held[-1]['sort_ms']}-{held[0]['id']}.json") as f:
                f.write(f'{{"hits": {{"hits": [{body}]}}}}'.encode())
            held.clear()

        for r in rows:
            held.append(r)
            if len(held) == size:
                put()
        if held:
            put()

    ordered.foreachPartition(write)
