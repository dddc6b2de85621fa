"""Late rows beside a stream: one input, two tables, each written once whatever is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LateSplit:
    """For foreachBatch: writes a batch's rows once, parted by whether they are late: more than `tolerance` before the newest
    time of the batches before. Both tables are parts of one write under the batch's id, so that a batch that runs again
    replaces what it had written, and neither table can have it without the other. time: a column of numbers."""

    def __init__(self, path: str, time: str, tolerance: int):
        self.path, self.time, self.tolerance = path.rstrip("/"), time, tolerance

    def newest(self, spark: SparkSession, batch_id: int) -> int | None:
        """The newest time of all batches before: each has left its own and theirs as one row."""
        if batch_id == 0:
            return None
        return spark.read.schema("newest long").parquet(f"{self.path}/newest/batch={batch_id - 1}").first()[0]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = self.newest(spark, batch_id)
        limit = F.lit(None if before is None else before - self.tolerance).cast("long")
        rows = f"{self.path}/rows/batch={batch_id}"
        batch.withColumn("late", F.coalesce(F.col(self.time) < limit, F.lit(False))).write.mode("overwrite").partitionBy("late").parquet(rows)
        own = spark.read.schema(batch.schema).parquet(rows).agg(F.max(self.time).cast("long").alias("newest"))
        own.select(F.greatest("newest", F.lit(before).cast("long")).alias("newest")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/newest/batch={batch_id}")

    def table(self, spark: SparkSession, schema: str, late: bool) -> DataFrame:
        """The rows that were on time, or late, with their batch."""
        return spark.read.schema(f"{schema}, batch long, late boolean").parquet(f"{self.path}/rows").filter(F.col("late") == late).drop("late")
