"""Streaming: alerts without repeats, open clusters as keyed state, changed keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from alertmill import params as P
from alertmill.operators.sessions import KEYS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPEN = "first_id long, first_seen long, last_seen long, n long, auto_closed boolean"
OUTPUT = "first_id long, first_seen long, last_seen long, n long, closed_by string"


class ClusterProcessor(StatefulProcessor):
    """One open cluster for each key: its first id, first and last time, and size. An alert that breaks a rule closes it and
    opens the next. A batch's alerts are folded in order of time; what is late for its open cluster joins it.

    clock "order": alerts alone close clusters. "event": a timer closes a cluster once the watermark has passed its idle gap.
    "arrival": an alert counts at the time when it is processed, timers close clusters at their idle gap or age, whichever comes
    first, and state that no timer has met goes by its time to live. auto_age: the age of clusters whose first alert was closed
    by a rule (column auto_closed)."""

    def __init__(self, key_names: list[str], gap: int, age: int, size: int, auto_age: int, clock: str):
        self.key_names, self.gap, self.age, self.size, self.auto_age, self.clock = key_names, gap, age, size, auto_age, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = {"ttl_duration_ms": 2 * (self.age + self.gap) // 1000} if self.clock == "arrival" else {}
        self.open = handle.getValueState("open", OPEN, **ttl)

    def limit(self, auto: bool) -> int:
        return self.auto_age if auto else self.age

    def due(self, now: tuple) -> int:
        """The first millisecond at which a timer can close the cluster: no later alert can join it."""
        _, first, last, _, auto = now
        ends = last + self.gap if self.clock == "event" else min(last + self.gap, first + self.limit(auto))
        return ends // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.open.get()
        now = tuple(held) if held else None
        before = self.due(now) if now and self.clock != "order" else None
        closed, arrived = [], []
        at = timerValues.getCurrentProcessingTimeInMs() * 1000 if self.clock == "arrival" else None
        for frame in rows:  # lists, as most keys have few rows and pandas takes longer to sort them than Python
            n = len(frame)
            autos = frame["auto_closed"].eq(True).tolist() if "auto_closed" in frame else [False] * n
            arrived += zip([at] * n if at is not None else frame["t"].tolist(), frame["alert_id"].tolist(), autos, strict=True)
        for t, i, a in sorted(arrived):
            if now:
                _, first, last, n, auto = now
                why = "idle_gap" if t - last > self.gap else "max_age" if t - first > self.limit(auto) else "max_size" if n >= self.size else None
                if why:
                    closed.append((*key, *now[:4], why))
                    now = None
            now = (i, t, t, 1, a) if now is None else (now[0], min(now[1], t), max(now[2], t), now[3] + 1, now[4])
        self.open.update(now)
        if self.clock != "order" and before != self.due(now):
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(self.due(now))
        if closed:
            yield self.rows(closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.open.get()
        if not held:
            return
        now = tuple(held)
        if self.due(now) > expiredTimerInfo.getExpiryTimeInMs():  # the timer of an earlier alert
            return
        self.open.clear()
        idle = self.clock == "event" or now[2] + self.gap <= now[1] + self.limit(now[4])
        yield self.rows([(*key, *now[:4], "idle_gap" if idle else "max_age")])

    def rows(self, closed: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(closed, columns=[*self.key_names, *(c.split()[0] for c in OUTPUT.split(", "))])

    def close(self) -> None:
        pass


def closed_clusters(alerts: DataFrame, keys=KEYS, gap: int = P.IDLE_GAP_S * 1_000_000, age: int = P.MAX_AGE_S * 1_000_000, size: int = P.MAX_SIZE, auto_age: int = P.AUTO_CLOSED_AGE_S * 1_000_000, clock: str = "order", event_time: str | None = None, tolerance: str = "15 minutes") -> DataFrame:
    """A stream of the closed clusters. alerts: a stream of keys, t (microseconds), alert_id and maybe auto_closed; clock as in
    ClusterProcessor, with the timestamp column event_time and its tolerance for "event". The session's state store must be
    STATE_STORE."""
    if clock == "event":
        alerts = alerts.withWatermark(event_time, tolerance)
    kinds = {f.name: f.dataType.simpleString() for f in alerts.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), OUTPUT])
    processor = ClusterProcessor(list(keys), gap, age, size, auto_age, clock)
    return alerts.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", {"order": "None", "event": "EventTime", "arrival": "ProcessingTime"}[clock])


def open_clusters(spark: SparkSession, checkpoint: str, keys=KEYS) -> DataFrame:
    """The clusters that a stream of closed_clusters() has left open, from its state: what a replay run to its end adds."""
    state = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    values = [F.col(f"value.{c.split()[0]}") for c in OUTPUT.split(", ")[:-1]]
    return state.select(*(F.col(f"key.{k}") for k in keys), *values, F.lit(None).cast("string").alias("closed_by"))


def first_arrivals(alerts: DataFrame, keys: list[str], event_time: str, tolerance: str = "1 hour") -> DataFrame:
    """A stream without repeats of a key inside the watermark; a join with what is stored takes care of older ones."""
    return alerts.withWatermark(event_time, tolerance).dropDuplicatesWithinWatermark(keys)


def idle_windows(alerts: DataFrame, event_time: str, key: str, gap: str, tolerance: str) -> DataFrame:
    """A stream of sessions by idle gap alone, given out when the watermark has passed them."""
    marked = alerts.withWatermark(event_time, tolerance)
    return marked.groupBy(key, F.session_window(event_time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("first_seen"), F.col("w.end").alias("ends"), "n")


def changed_keys(batch: DataFrame, key: str, most: int) -> DataFrame:
    """The distinct keys of a micro-batch; more than `most` are one row `many`."""
    keys = batch.select(F.col(key).cast("string").alias("changed")).distinct()
    few = keys.limit(most + 1)
    n = few.agg(F.count("*").alias("n"))  # one row
    return few.crossJoin(F.broadcast(n)).select(F.when(F.col("n") > most, "many").otherwise(F.col("changed")).alias("changed")).distinct()
