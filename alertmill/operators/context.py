"""Context for a reader with a byte budget: values as key=value, lines in order, as many whole lines as fit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters of a value, bytes of a block.
VALUE_CHARACTERS, BLOCK_BYTES = 300, 8192


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used: a branch that names an expression again runs it again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cleaned(value: Column, most: int = VALUE_CHARACTERS) -> Column:
    """A value as one line: control characters and white space folded to single blanks, cut with an ellipsis at so many
    characters (never inside one); null where nothing is left."""
    folded = F.btrim(F.regexp_replace(value.cast("string"), r"[\p{Cc}\p{Z}]+", " "))
    cut = lambda f: F.when(f != "", F.when(F.length(f) > most, F.concat(F.substring(f, 1, most - 1), F.lit("…"))).otherwise(f))
    return named(folded, cut)


def pair(key: str, value: Column, most: int = VALUE_CHARACTERS) -> Column:
    """key=value, quoted where the value has blanks (its own quotes become single ones); null without a value."""
    quoted = lambda x: F.when(F.contains(x, F.lit(" ")), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit("'")), F.lit('"'))).otherwise(x)
    return F.concat(F.lit(f"{key}="), named(cleaned(value, most), quoted))


def line(label: str, fields: dict[str, Column]) -> Column:
    """label: and its pairs, null if none has a value."""
    pairs = F.concat_ws(" ", *(pair(k, v) for k, v in fields.items()))
    return named(pairs, lambda p: F.when(p != "", F.concat(F.lit(f"{label}: "), p)))


def blocks(lines: DataFrame, subject: str, order: Sequence[Column], text: str, most: int = BLOCK_BYTES) -> DataFrame:
    """subject, block, shown and omitted: the lines of each subject in order, joined by line feeds, as many from the first on as
    stay within `most` bytes of UTF-8; null lines say nothing. Where lines are left out, a last line says how many; room for it
    is kept only then.

    A running sum over each subject's lines says what fits, and only lines that fit and the last one, which has the totals, are
    gathered: a block is bounded, however many lines a subject has. Lines are worked out and dealt once."""
    w = Window.partitionBy(subject).orderBy(*order)
    # dealt before null lines are dropped, so that the filter doesn't work the lines out a second time
    size = F.sum(F.octet_length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    at = F.count(text).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = lines.select(subject, F.col(text).alias("_line"), at.alias("_at"), size.alias("_size"), F.lead(F.lit(1)).over(w).isNull().alias("_last"))
    fits = F.col("_line").isNotNull() & (F.col("_size") <= most)
    told = placed.filter(fits | F.col("_last")).groupBy(subject).agg(F.max("_at").cast("int").alias("_n"), F.max("_size").alias("_bytes"), F.array_sort(F.collect_list(F.when(fits, F.struct("_at", "_size", "_line")))).alias("_l"))
    note = lambda n: F.concat(F.lit("("), n.cast("string"), F.lit(" more lines)"))
    room = F.when(F.col("_bytes") > most, F.octet_length(note(F.col("_n"))) + 1).otherwise(0)
    shown = F.transform(F.filter("_l", lambda x: x["_size"] + F.col("_room") <= most), lambda x: x["_line"])
    out = told.filter("_n > 0").withColumn("_room", room).withColumn("_l", shown)
    left = F.col("_n") - F.size("_l")
    said = F.when(left > 0, F.array_append("_l", note(left))).otherwise(F.col("_l"))
    return out.select(subject, F.array_join(said, "\n").alias("block"), F.size("_l").alias("shown"), left.alias("omitted"))
