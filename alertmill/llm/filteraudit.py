"""Audit of five filters in all 120 orders: what each step removes, would have removed, and loses of good documents.

Method: wide packed counters. A document's outcome in all 600 steps depends only on its mask (which filters it fails) and on
its labels, so each of these 128 kinds is one big integer whose fields hold the outcomes of all steps: the integers of a part
are summed, and the fields of the sum are the counts. A field is 64 bits wide, as a count of rows is, so none can run over
into the next.

The filters are DataFrame functions over whole texts; kinds are counted in Spark before the integers are summed, so that a
part is at most 128 rows, however many documents it has. Copies are told apart by the SHA-256 of the text: copies of one
text with equal labels meet as one row, with the smallest id and how many rows have it.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
WORDS = 200
BITS = 64
SPACE = "[\\x20\\x09-\\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: Column) -> list[Column]:
    """The conditions A to D, each true or false."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return [F.size(words) < WORDS, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]


def kinds(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and n: the documents of each part by what they fail (bit k of the mask: the k-th filter) and by
    their labels."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failures(F.col("whole")))), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("whole"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("whole", 256)).alias("same"), mask.alias("mask"))
    rows = rows.groupBy("doc_id", "part", "same", "mask").agg(F.count("*").alias("n"))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # rows without an id have no label; they stay out of the join, where they would be one key
    met = rows.filter("doc_id is not null").join(known, "doc_id", "left").select(*rows.columns, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    met = met.unionByName(rows.filter("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))
    of_text = met.groupBy("same", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without_id"))
    # a text is a row for each of its parts and labels now, so no window is long
    each = of_text.withColumn("smallest", F.min("least.doc_id").over(Window.partitionBy("same")))
    first = F.when(F.col("least.doc_id") == F.col("smallest"), F.col("least.n")).otherwise(F.lit(0)) + F.col("without_id")
    copies = F.explode(F.array(F.struct(F.col("mask").alias("mask"), first.alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - first).alias("n")))).alias("k")
    return each.select("part", "good", "toxic", copies).select("part", "good", "toxic", "k.*").filter("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def orders() -> list[str]:
    return ["".join(p) for p in permutations(FILTERS)]


@lru_cache(None)
def packed(mask: int, good: bool, toxic: bool) -> int:
    """The outcomes of one document in all steps, a field for each order, step and count."""
    fields = bytearray()
    for order in orders():
        gone = False
        for letter in order:
            bit = 1 << FILTERS.index(letter)
            fails = bool(mask & bit)
            removed = fails and not gone
            outcome = (not gone and not fails, removed, fails and gone, mask == bit, removed and good, removed and toxic)
            for x in outcome:
                fields += int(x).to_bytes(BITS // 8, "little")
            gone |= fails
    return int.from_bytes(fields, "little")


def unpacked(total: int) -> list[tuple[int, ...]]:
    """The counts of each order and step, in the order of packed()."""
    wide = BITS // 8
    data = total.to_bytes(len(orders()) * len(FILTERS) * len(COUNTS) * wide, "little")
    flat = [int.from_bytes(data[k : k + wide], "little") for k in range(0, len(data), wide)]
    return [tuple(flat[k : k + len(COUNTS)]) for k in range(0, len(flat), len(COUNTS))]


def part_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """The 600 rows of one part, from its kinds of documents."""
    total = sum(int(n) * packed(int(mask), bool(good), bool(toxic)) for mask, good, toxic, n in zip(pdf["mask"], pdf["good"], pdf["toxic"], pdf["n"], strict=True))
    steps = [(order, k) for order in orders() for k in range(len(FILTERS))]
    out = pd.DataFrame(unpacked(total), columns=COUNTS)
    out.insert(0, "part", pdf["part"].iloc[0])
    out.insert(1, "filter_order", [o for o, _ in steps])
    out.insert(2, "step", [k + 1 for _, k in steps])
    letter = pd.Series([o[k] for o, k in steps])
    out["shapley"] = letter.map(out["removed"].groupby(letter).sum())
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts for every part (lang), order and step, as RESULT names them.

    A null text is empty, a null lang the empty string. A repeated row counts again, and is no copy of itself: E needs a
    smaller id, which a row without an id has not, and is not. Labels of one id are joined by "or"; ids without labels,
    null labels and rows without an id are neither good nor toxic. No documents give no rows; other columns are ignored."""
    return kinds(docs, labels).groupBy("part").applyInPandas(part_counts, RESULT)


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
least AS (SELECT coalesce(text, '') AS t, min(doc_id) AS m FROM documents GROUP BY 1),
f AS (
  SELECT d.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
         len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 3 * length(d.t) AS c,
         regexp_matches(d.t, '[#$%&*|]') AS dd, coalesce(least.m < d.doc_id, false) AS e
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id JOIN least ON least.t = d.t),
m AS (SELECT row_number() OVER () AS kind, part, good, toxic, count(*) AS n, map {'A': a, 'B': b, 'C': c, 'D': dd, 'E': e} AS fails, a::int + b::int + c::int + dd::int + e::int AS n_fails
      FROM f GROUP BY part, good, toxic, a, b, c, dd, e),
x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
      WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
steps AS (SELECT filter_order, k AS step, substr(filter_order, k, 1) AS letter FROM o, range(1, 6) AS g(k)),
each AS (SELECT m.kind, m.part, s.filter_order, s.step, s.letter, m.n, m.good, m.toxic, m.fails[s.letter] AS fails, m.n_fails FROM m, steps s),
met AS (SELECT *, coalesce(bool_or(fails) OVER (PARTITION BY kind, filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM each),
c AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (fails AND n_fails = 1), 0) AS unique_fails,
         coalesce(sum(n) FILTER (NOT gone AND fails AND good), 0) AS good_lost, coalesce(sum(n) FILTER (NOT gone AND fails AND toxic), 0) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
       good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::bigint AS shapley
FROM c
"""
