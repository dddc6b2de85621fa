"""Review notices as a stream: each is applied to its ticket, in keyed state or in a table of tickets after each batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from alertmill.operators import lifecycle
from alertmill.operators.lifecycle import APPLIED, NOTICE, apply_notice, plain, whole

TICKET = "sent_at long, status string, decided_by string, decided_at long, result string"


class NoticeProcessor(StatefulProcessor):
    """A ticket's last state; a batch's notices are applied in order of arrival."""

    def __init__(self, key: str, order: str):
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ticket = handle.getValueState("ticket", TICKET)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = tuple(self.ticket.get()) if self.ticket.exists() else None
        out = []
        for row in whole(pd.concat(list(rows)).sort_values(self.order)[[self.order, *NOTICE]]).itertuples(index=False, name=None):
            row = plain(row)
            stored, outcome, reason = apply_notice(stored, row[1:])
            out.append((key[0], row[0], outcome, reason, *stored))
        self.ticket.update(stored)
        yield pd.DataFrame(out, columns=[self.key, self.order, *(c.split()[0] for c in APPLIED.split(", "))], dtype=object)

    def close(self) -> None:
        pass


def applied(stream: DataFrame, key: str = "id", order: str = "arrival") -> DataFrame:
    """As lifecycle.notices(), for a stream whose batches come in order of arrival. Each ticket of a batch is a call of Python with
    reads and writes of its state, some milliseconds: for batches of few tickets. For others, AppliedBatches."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    rows = stream.select(key, order, *NOTICE)
    return rows.groupBy(key).transformWithStateInPandas(NoticeProcessor(key, order), f"{key} {kinds[key]}, {order} {kinds[order]}, {APPLIED}", "Append", "None")


def tickets(spark: SparkSession, checkpoint: str, key: str = "id") -> DataFrame:
    """The tickets as a stream of applied() has left them, from its state."""
    state = spark.read.format("statestore").option("stateVarName", "ticket").load(checkpoint)
    return state.select(F.col(f"key.{key}").alias(key), "value.*")


class AppliedBatches:
    """For foreachBatch: as applied(), for batches of many tickets. A batch's notices and the tickets as the batch before has left
    them are folded in one sorted pass, without a call a ticket. What the notices did and the tickets after them are parts of one
    write under the batch's id, so that a batch that runs again replaces what it had written. A batch writes all tickets again."""

    def __init__(self, path: str, kind: str, key: str = "id", order: str = "arrival"):
        """kind: the schema of key and order."""
        self.path, self.kind, self.key, self.order = path.rstrip("/"), kind, key, order

    def rows(self, spark: SparkSession, where: str) -> DataFrame:
        return spark.read.schema(f"{self.kind}, {APPLIED}, ticket boolean").parquet(where)

    def tickets(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The tickets after a batch."""
        left = self.rows(spark, f"{self.path}/batch={batch_id}").filter("ticket")
        return left.select(self.key, *(F.col(c.split()[0]).alias(n) for c, n in zip(APPLIED.split(", ")[2:], NOTICE, strict=True)))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = self.tickets(spark, batch_id - 1) if batch_id else spark.createDataFrame([], batch.select(self.key, *NOTICE).schema)
        out = lifecycle.notices(batch, self.key, [self.order], stored)
        out.withColumn("ticket", F.col("outcome").isNull()).write.mode("overwrite").partitionBy("ticket").parquet(f"{self.path}/batch={batch_id}")

    def applied(self, spark: SparkSession) -> DataFrame:
        """The notices of all batches, as applied() has them."""
        return self.rows(spark, self.path).filter("not ticket").drop("ticket", "batch")
