"""Quality classifier by importance resampling.

Method: two generative models of hashed n-grams, one of target text and one of the raw corpus. The logarithm of their
ratio is a document's importance weight; Gumbel(0, 1) noise is added and the k largest sums are the sample, which draws k
documents without replacement in proportion to their weights.

Two feature sets make a ratio each: `words` (single words without marks: what is said) and `form` (words with their
marks, single and in pairs: how it is written). A bucket counts only where target and raw counts differ by more than
chance. The log weight is that of `weight_tokens` features of either set at the document's mean, so that a long document
isn't drawn or left for its length alone.

The sample asked for is `sample_share` of all documents; where that is not given, `asked` times the share of target
documents among the labelled ones.

Target text: a bounded sample (`label_rows`) of labelled rows with quality 1 and toxic not 1. Raw counts cover every
document. Count vectors have a fixed size and are summed as streams; only they reach the driver. The k-th key is found by
counting in ever narrower bins, so that nothing is sorted in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.llm.common import MARKS, SPACE, pieces_of, row_key, shingles, utf8, word_hashes, written


@dataclass(frozen=True)
class Settings:
    word_buckets: int = 1 << 20
    form_buckets: int = 1 << 16
    word_chance: float = 2.5  # standard deviations that a bucket must differ by
    form_chance: float = 3.0
    prior: float = 0.001  # raw text mixed into the target's counts
    label_rows: int = 20_000
    weight_tokens: int = 256
    sample_share: float | None = None
    asked: float = 0.98
    seed: int = 17


CHUNK = 1 << 12


def features(texts: pa.Array, s: Settings) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows a to b with their features' buckets and bounds, by feature set."""
    data, bounds = utf8(texts)
    for a, b in pieces_of(bounds):
        part, at = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        plain, plain_at = word_hashes(part, at, MARKS)
        full, full_at = word_hashes(part, at, SPACE)
        pairs, pairs_at = shingles(full, full_at, 2)
        n = s.form_buckets
        both = np.empty(len(full) + len(pairs), np.int64)
        both_at = full_at + pairs_at
        both[np.arange(len(full)) + np.repeat(pairs_at[:-1], np.diff(full_at))] = full % np.uint64(n)
        both[np.arange(len(pairs)) + np.repeat(full_at[1:], np.diff(pairs_at))] = (pairs % np.uint64(n)).astype(np.int64) + n
        yield a, b, (plain % np.uint64(s.word_buckets)).astype(np.int64), plain_at, both, both_at


def one_label(labels: DataFrame) -> DataFrame:
    """doc_id and is_good of each labelled document. A document labelled more than once counts by its worst label."""
    own = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return own.select("doc_id", (F.coalesce(F.col("quality") == 1, F.lit(False)) & (F.coalesce("toxic", F.lit(0)) != 1)).alias("is_good"))


def target_rows(labels: DataFrame, s: Settings) -> DataFrame:
    """At most label_rows doc_ids of target text."""
    return one_label(labels).filter("is_good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.label_rows).select("doc_id")


def count_features(docs: DataFrame, s: Settings) -> DataFrame:
    """docs: text, is_target. Rows of chunk, raw and target: counts of CHUNK buckets each, of all documents."""
    size = s.word_buckets + 2 * s.form_buckets
    kind = "chunk int, raw binary, target binary"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            chosen = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for a, b, words, words_at, form, form_at in features(batch.column(0), s):
                for f, at, first in ((words, words_at, 0), (form, form_at, s.word_buckets)):
                    np.add.at(raw, f + first, 1)  # in place: no vector for each run of rows
                    np.add.at(target, f[np.repeat(chosen[a:b], np.diff(at))] + first, 1)
        yield from rows(enumerate(zip(raw.reshape(-1, CHUNK), target.reshape(-1, CHUNK), strict=True)))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, raw, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have = sums.setdefault(k, (np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64)))
                have[0][:] += np.frombuffer(raw, np.int64)
                have[1][:] += np.frombuffer(target, np.int64)
        yield from rows(sums.items())

    def rows(items) -> Iterator[pa.RecordBatch]:
        some = ((k, r.tobytes(), t.tobytes()) for k, (r, t) in items if r.any())
        while part := list(islice(some, 64)):
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*part, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "raw", "target"])

    return docs.select("text", "is_target").mapInArrow(local, kind).repartition("chunk").mapInArrow(total, kind)


def ratios(counts: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The logarithms of target to raw probability, by bucket, for either feature set."""
    size = s.word_buckets + 2 * s.form_buckets
    raw, target = np.zeros(size), np.zeros(size)
    for r in counts.collect():  # a fixed number of rows
        at = slice(r["chunk"] * CHUNK, (r["chunk"] + 1) * CHUNK)
        raw[at], target[at] = np.frombuffer(r["raw"], np.int64), np.frombuffer(r["target"], np.int64)
    out = []
    for at, chance in ((slice(0, s.word_buckets), s.word_chance), (slice(s.word_buckets, size), s.form_chance)):
        r, t = raw[at], target[at]
        q = (r + 1) / (r.sum() + len(r))
        n = t.sum()
        ratio = np.log((t + (s.prior * n + 1) * q) / (n + s.prior * n + 1) / q)
        ratio[np.abs(t - n * q) <= chance * np.sqrt(n * q + 1)] = 0
        out.append(ratio.astype(np.float32))
    return out[0], out[1]


def importance(docs: DataFrame, words, form, s: Settings) -> DataFrame:
    """Adds score_words and score_form, the mean log ratio of the features; 0 for a text without any."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(batch.num_rows), np.zeros(batch.num_rows)]
            for a, b, w, w_at, f, f_at in features(batch.column("text"), s):
                for k, (x, at, table) in enumerate(((w, w_at, words.value), (f, f_at, form.value))):
                    sums = np.concatenate([[0.0], np.cumsum(table[x], dtype=np.float64)])
                    out[k][a:b] = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out)], names=[*batch.schema.names, "score_words", "score_form"])

    kind = docs.limit(0).withColumns({c: F.lit(0.0) for c in ("score_words", "score_form")}).schema
    return docs.mapInArrow(score, kind)


def threshold(keys: DataFrame, k: int) -> float:
    """The k-th largest key. Each round counts the keys in bins and goes into the bin that holds it."""
    if k <= 0:
        return float("inf")
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while low < high:
        width = (high - low) / 1024
        if width <= 0 or low + width == low:
            break
        bins = F.least(F.floor((F.col("key") - low) / width), F.lit(1023))
        found = keys.filter(F.col("key").between(low, high)).groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for r in found.orderBy(F.desc("bin")).collect():  # at most 1024 rows
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
        if r["n"] == 1:
            break
    return low


class Classifier:
    """Models fitted to docs and labels, and the least key of the sample; answers for any rows of docs."""

    def __init__(self, docs: DataFrame, labels: DataFrame, settings: Settings | None = None):
        s = self.settings = settings or Settings()
        spark: SparkSession = docs.sparkSession
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        marked = own.join(F.broadcast(target_rows(labels, s).withColumn("is_target", F.lit(True))), "doc_id", "left")  # at most label_rows
        self.words, self.form = (spark.sparkContext.broadcast(r) for r in ratios(count_features(marked, s), s))
        self.scored = written(importance(own.select("doc_id", *row_key("doc_id", "text"), "text"), self.words, self.form, s).drop("text"), "scores")
        share = s.sample_share
        if share is None:
            labelled, good = one_label(labels).agg(F.count("*"), F.count_if("is_good")).first()
            share = s.asked * good / labelled if good else 1.0
        keyed = self.keyed(self.scored)
        self.least = threshold(keyed, math.ceil(share * keyed.count()))

    def keyed(self, scored: DataFrame) -> DataFrame:
        """Adds log_weight and key to rows with scores, k1 and k2. The noise goes by the row's content."""
        weight = self.settings.weight_tokens * (F.col("score_words") + F.col("score_form"))
        uniform = (F.pmod(F.xxhash64("k1", "k2", F.lit(self.settings.seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        return scored.withColumn("log_weight", weight).withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))

    def answers(self) -> DataFrame:
        return self.keyed(self.scored).select("doc_id", "score_words", "score_form", "log_weight", "key", (F.col("key") >= self.least).alias("keep"))

    def kept(self, docs: DataFrame) -> DataFrame:
        """The rows of docs that are kept. They are scored anew where they lie, which costs less than a join."""
        names = docs.columns
        own = docs.select(F.struct(*names).alias("row"), F.col("text").cast("string").alias("text"), *row_key("doc_id", "text"))
        return self.keyed(importance(own, self.words, self.form, self.settings)).filter(F.col("key") >= self.least).select("row.*")


def classify(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, score_words, score_form, log_weight, key and keep for each row of docs.

    A null or empty text has no features and a log weight of 0; repeated rows get equal answers; ties at the k-th key are
    all kept; without any target label everything is kept; very long texts are counted whole, in pieces of a bounded size.
    Other columns are ignored."""
    return Classifier(docs, labels, settings).answers()


def resample(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of docs that classify() keeps, with their columns."""
    return Classifier(docs, labels, settings).kept(docs)
