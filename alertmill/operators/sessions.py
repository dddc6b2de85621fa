"""Cluster folds: alerts of one key in sessions cut by idle gap, age and size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertmill import params as P

KEYS = ("rule_id", "srcip", "dstip", "agent_name")


def idle_sessions(alerts: DataFrame, keys: Sequence[str] = KEYS, time: str = "t", id_: str = "alert_id", gap: int = P.IDLE_GAP_S * 1_000_000) -> DataFrame:
    """Adds session (from 0 in each key): a gap longer than `gap` starts a new one, an equal one doesn't."""
    order = Window.partitionBy(*keys).orderBy(time, id_)
    starts = F.when(F.col(time) - F.lag(time).over(order) > gap, 1).otherwise(0)
    return alerts.withColumn("_start", starts).withColumn("session", F.sum("_start").over(order).cast("long")).drop("_start")


def fold_clusters(alerts: DataFrame, keys: Sequence[str] = KEYS, time: str = "t", id_: str = "alert_id", gap: int = P.IDLE_GAP_S * 1_000_000, age: int = P.MAX_AGE_S * 1_000_000, size: int = P.MAX_SIZE) -> DataFrame:
    """keys, first_id, first_seen, last_seen, n and closed_by (idle_gap, max_age, max_size, or null for the last).

    The idle test always compares with the key's event before, whatever cluster that is in, so that idle sessions are
    independent of each other. Sessions inside both caps are final at once. The others go to a fold in order of time: one
    Python call per session, streamed in sorted order, with a state of a few numbers; a session is never held whole."""
    sessions = idle_sessions(alerts, keys, time, id_, gap)
    within = [*keys, "session"]
    spans = sessions.groupBy(*within).agg(F.min(F.struct(time, id_)).alias("a"), F.max(time).alias("last_seen"), F.count("*").alias("n"))
    last = F.lead("session").over(Window.partitionBy(*keys).orderBy("session")).isNull()
    spans = spans.withColumn("ends", F.when(~last, "idle_gap"))
    over = (F.col("last_seen") - F.col(f"a.{time}") > age) | (F.col("n") > size)
    whole = spans.filter(~over).select(*keys, F.col(f"a.{id_}").alias("first_id"), F.col(f"a.{time}").alias("first_seen"), "last_seen", "n", F.col("ends").alias("closed_by"))

    long = sessions.join(spans.filter(over).select(*within, "ends"), within).select(*within, F.col(time).alias("_t"), F.col(id_).alias("_id"), "ends")
    ordered = long.repartition(*within).sortWithinPartitions(*within, "_t", "_id")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None  # group, keys, first id, first, last, n, ends
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False, name=None):
                group, t, i, ends = r[: len(within)], r[-3], r[-2], r[-1]
                if state and state[0] != group:
                    rows.append((*state[0][:-1], *state[1:5], state[5]))
                    state = None
                if state:
                    why = "max_age" if t - state[2] > age else "max_size" if state[4] >= size else None
                    if why:
                        rows.append((*state[0][:-1], *state[1:5], why))
                        state = None
                state = (group, i, t, t, 1, ends) if state is None else (*state[:3], t, state[4] + 1, ends)
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if state:
            yield pd.DataFrame([(*state[0][:-1], *state[1:5], state[5])], columns=names)

    names = [*keys, "first_id", "first_seen", "last_seen", "n", "closed_by"]
    kinds = {f.name: f.dataType.simpleString() for f in whole.schema.fields}
    folded = ordered.mapInPandas(fold, ", ".join(f"{c} {kinds[c]}" for c in names))
    return whole.unionByName(folded)
