"""Joins and folds by key that the built-in operators do not name: latest row, as-of, ranges, disjunctions, snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; order should end in a unique column. Partial maxima come before the shuffle."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("last"))
    return best.select("last.*")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], allow_equal: bool = True) -> DataFrame:
    """left with the values of the last right row at or before (or before) its time, null without one.

    Both sides are merged in one order by key and time and the last value is carried forward: one shuffle by key and
    no pairs. Where times tie in right, values in order decide. Null keys match nothing."""
    flag = 0 if allow_equal else 1
    rows = right.select(*keys, F.col(right_time).alias("_t"), F.lit(flag).alias("_side"), F.struct(*values).alias("_v"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    asks = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1 - flag).alias("_side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    before = Window.partitionBy(*keys).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.filter(known & F.col("_t").isNotNull()).unionByName(asks).withColumn("_last", F.last("_v", ignorenulls=True).over(before)).filter("_row is not null")
    return out.select("_row.*", *(F.when(known, F.col(f"_last.{v}")).alias(v) for v in values))


def range_membership(instants: DataFrame, windows: DataFrame, time: str, begin: str, end: str, width: int | None = None) -> DataFrame:
    """Instants with each half-open window [begin, end) that holds them; times are numbers.

    The windows are cut at multiples of `width` and joined by the slot of the instant, so that no side is sent whole;
    the default width is the mean length of a window."""
    if width is None:
        mean = windows.agg(F.avg(F.col(end) - F.col(begin))).first()[0]
        width = max(1, int(mean or 1))
    slots = windows.withColumn("_slot", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor((F.greatest(F.col(end) - 1, F.col(begin))) / width))))
    return instants.withColumn("_slot", F.floor(F.col(time) / width)).join(slots, "_slot").filter((F.col(time) >= F.col(begin)) & (F.col(time) < F.col(end))).drop("_slot")


def linked_pairs(df: DataFrame, id_: str, time: str, keys: Sequence[tuple[str, Column]], window: int) -> DataFrame:
    """left_id and right_id of different rows that agree in any of the keys within `window` of time.

    A disjunction in a join is a nested loop; here every key has an equi-join, also by slot of time, and their union is
    made distinct. A null key, or one for which the given condition is not true, agrees with nothing."""
    out = None
    for key, usable in keys:
        own = df.filter(F.coalesce(usable, F.lit(False)) & F.col(key).isNotNull()).select(F.col(id_).alias("id"), F.col(time).alias("t"), F.col(key).alias("k"), F.floor(F.col(time) / window).alias("slot"))
        left = own.select(F.col("id").alias("left_id"), F.col("t").alias("lt"), "k", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot"))
        right = own.select(F.col("id").alias("right_id"), F.col("t").alias("rt"), "k", "slot")
        pairs = left.join(right, ["k", "slot"]).filter((F.abs(F.col("lt") - F.col("rt")) <= window) & (F.col("left_id") != F.col("right_id"))).select("left_id", "right_id")
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def overlapping_pairs(df: DataFrame, id_: str, begin: str, end: str, keys: Sequence[tuple[str, Column]], window: int) -> DataFrame:
    """As linked_pairs(), for spans: the right span meets the left one widened by `window` on both sides."""
    out = None
    for key, usable in keys:
        own = df.filter(F.coalesce(usable, F.lit(False)) & F.col(key).isNotNull()).select(F.col(id_).alias("id"), F.col(begin).alias("b"), F.col(end).alias("e"), F.col(key).alias("k"))
        slot = lambda b, e: F.explode(F.sequence(F.floor(b / window), F.floor(e / window))).alias("slot")
        left = own.select(F.col("id").alias("left_id"), F.col("b").alias("lb"), F.col("e").alias("le"), "k", slot(F.col("b") - window, F.col("e") + window))
        right = own.select(F.col("id").alias("right_id"), F.col("b").alias("rb"), F.col("e").alias("re"), "k", slot(F.col("b"), F.col("e")))
        pairs = left.join(right, ["k", "slot"]).filter((F.col("rb") <= F.col("le") + window) & (F.col("re") >= F.col("lb") - window) & (F.col("left_id") != F.col("right_id"))).select("left_id", "right_id")
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def first_nonempty_level(df: DataFrame, subject: str, level: str) -> DataFrame:
    """The rows of each subject's least level."""
    least = df.groupBy(subject).agg(F.min(level).alias(level))
    return df.join(least, [subject, level])


def rollup_all(df: DataFrame, fixed: Sequence[str], rolled: str, aggregates: Sequence[Column], label: str = "all") -> DataFrame:
    """Aggregates by the fixed columns and each value of `rolled`, and under `label` for all of them. A null stays null."""
    each = df.groupBy(*fixed, rolled).agg(*aggregates)
    every = df.groupBy(*fixed).agg(*aggregates) if fixed else df.agg(*aggregates)
    return each.unionByName(every.withColumn(rolled, F.lit(label)).select(*each.columns))


def top_groups(df: DataFrame, keys: Sequence[str], k: int, by: Sequence[Column], within: Sequence[str]) -> DataFrame:
    """The first k rows within each partition; Spark cuts each task's rows to k before the shuffle."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*within).orderBy(*by))).filter(F.col("_at") <= k).drop("_at")


def head_and_tail(df: DataFrame, within: Sequence[str], order: Sequence[str], limit: int, half: int) -> DataFrame:
    """All rows of a partition of at most `limit`, else its first and last `half`; adds `at` (from 1) and `n`."""
    n = df.groupBy(*within).agg(F.count("*").alias("n"))
    placed = df.withColumn("at", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
    return placed.join(n, list(within)).filter((F.col("n") <= limit) | (F.col("at") <= half) | (F.col("at") > F.col("n") - half))


def interleave(first: DataFrame, second: DataFrame, subject: str, item: str, rank: str, limit: int) -> DataFrame:
    """Two ranked lists of each subject as one: items in both first, then the rest in turn. Adds position (from 1)."""
    a, b = (d.select(subject, item, F.col(rank).alias(r)) for d, r in ((first, "ra"), (second, "rb")))
    both = a.join(b, [subject, item], "full_outer")
    key = F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), F.struct(F.lit(0).alias("g"), F.col("ra").cast("long").alias("r"))).otherwise(F.struct(F.lit(1).alias("g"), F.coalesce(2 * F.col("ra"), 2 * F.col("rb") + 1).cast("long").alias("r")))
    placed = both.withColumn("position", F.row_number().over(Window.partitionBy(subject).orderBy(key, item)))
    return placed.filter(F.col("position") <= limit).select(subject, item, "position")


def merge_snapshot(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """The stored table after a load. rules give a column from `old.c` and `new.c`; other columns of a key that comes again
    are the new ones, and keys that don't come stay as they are."""
    names = old.columns
    o = old.select(*keys, F.struct(*names).alias("old"))
    n = new.select(*keys, F.struct(*new.columns).alias("new"))
    both = o.join(n, list(keys), "full_outer")
    fresh, kept = F.col("old").isNull(), F.col("new").isNull()
    out = []
    for c in names:
        value = rules.get(c, F.col(f"new.{c}") if c in new.columns else F.col(f"old.{c}"))
        new_value = F.col(f"new.{c}") if c in new.columns else F.lit(None)
        out.append(F.when(kept, F.col(f"old.{c}")).when(fresh, new_value).otherwise(value).alias(c))
    return both.select(*out, F.when(fresh, "new").when(kept, "kept").otherwise("updated").alias("change"))
