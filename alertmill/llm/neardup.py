"""Near-duplicate documents by weighted MinHash.

Method: improved consistent weighted sampling over TF-IDF weights of five-word shingles. Samples are banded; documents
that share a band are candidates, verified by the exact weighted Jaccard similarity of their whole texts (0.8 or more);
classes are the connected components of verified links.

* Document frequencies are counted over all documents in a hashed table of fixed size (as HashingTF and IDF do), so that
  what is sent to the executors is bounded. The weight of a shingle is tf * (1 + log((N+1)/(df+1)) / log(N+1)).
* Texts of equal words collapse to one node before banding, so that copies cost one row each.
* A bucket is not expanded into pairs: its members first meet its leader, the member with the largest buckets altogether,
  that is, the one most alike to the others. That links most of what can be linked.
* No link is lost: in a bucket whose members are still in several classes, every text outside its main class meets all
  texts of other classes, in blocks of bounded size (`BLOCK_BYTES`). A block answers with links between classes only, at
  most one for each two classes, never with pairs.
* With 12 bands of 3 samples a pair of similarity 0.8 shares no band with a chance of 0.0002.

A text of one to four words is one shingle. Texts without words (null and empty ones too) are one class. A class is
named by the least doc_id in it; repeated rows are answered again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import MARKS, MIX_1, components, mix, pieces_of, row_key, shingles, summed_vector, utf8, vector_rows, word_hashes, written

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
BUCKETS = 1 << 18
#: Texts of a block of one side, each counted as at least LEAST_BYTES so that their number is bounded too.
BLOCK_BYTES, LEAST_BYTES = 4 << 20, 8 << 10
#: Features that a block compares at a time.
COLUMNS = 2048

_SAMPLES = BANDS * ROWS
_ODD = mix(np.arange(1, _SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_grid = np.linspace(0, 40, 400_001)
#: Quantiles of Gamma(2, 1), by 16 bits of a hash.
_GAMMA = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + _grid) * np.exp(-_grid), _grid).astype(np.float32)
_LOG_GAMMA = np.log(_GAMMA)
_UNIT = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
del _grid


def text_shingles(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, hashes of its words, hashes of its shingles with repeats)."""
    data, bounds = utf8(texts)
    for a, b in pieces_of(bounds):
        words, at = word_hashes(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], MARKS)
        found, found_at = shingles(words, at, WORDS)
        for i in range(b - a):
            own, w = found[found_at[i] : found_at[i + 1]], words[at[i] : at[i + 1]]
            if len(w) and not len(own):
                own = mix(np.array([np.sum(w * _ODD[: len(w)], dtype=np.uint64)], np.uint64))
            yield a + i, w, own


def frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies by bucket, of all documents."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for _, _, own in text_shingles(batch.column(0)):
                df[np.unique(own & np.uint64(BUCKETS - 1)).astype(np.int64)] += 1
                df[BUCKETS] += 1
        yield from vector_rows(df)

    df = summed_vector(docs.select("text").mapInArrow(local, "chunk int, counts binary"), BUCKETS + 1)
    n = df[BUCKETS]
    return (1 + np.log((n + 1) / (df[:BUCKETS] + 1)) / np.log(n + 2)).astype(np.float32)


def weights(own: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order, and their TF-IDF weights."""
    h, tf = np.unique(own, return_counts=True)
    return h, tf.astype(np.float32) * idf[(h & np.uint64(BUCKETS - 1)).astype(np.int64)]


def samples(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One hash for each consistent weighted sample."""
    log_w = np.log(w)
    best = np.full(_SAMPLES, np.inf, np.float32)
    out = np.zeros(_SAMPLES, np.uint64)
    for at in range(0, len(h), 2048):
        x = h[None, at : at + 2048] * _ODD[:, None]
        x ^= x >> np.uint64(32)
        x *= MIX_1
        r = _GAMMA[(x >> np.uint64(48)).astype(np.int64)]
        log_c = _LOG_GAMMA[((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)]
        beta = _UNIT[((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
        t = np.floor(log_w[None, at : at + 2048] / r + beta)
        log_a = log_c - r * (t - beta + 1)
        k = log_a.argmin(1)
        low = log_a[np.arange(_SAMPLES), k]
        better = low < best
        best[better] = low[better]
        sample = h[at + k] + t[np.arange(_SAMPLES), k].astype(np.int64).view(np.uint64) * MIX_1
        out[better] = sample[better]
    return mix(out)


def bands(sample: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * MIX_1 + sample.reshape(BANDS, ROWS)[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, idf) -> DataFrame:
    """docs: doc_id, k1, k2, text. Adds w1 and w2, which name its sequence of words, and its bands."""
    kind = "doc_id long, k1 long, k2 int, w1 long, w2 long, bands array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            names = np.zeros((n, 2), np.uint64)
            keys: list[np.ndarray] = [np.zeros(0, np.int64)] * n
            for row, words, own in text_shingles(batch.column(3)):
                place = mix(np.arange(1, len(words) + 1, dtype=np.uint64))
                names[row] = np.sum(words * (place | np.uint64(1)), dtype=np.uint64) + np.uint64(len(words)), np.sum(mix(words ^ place), dtype=np.uint64)
                if len(own):
                    keys[row] = bands(samples(*weights(own, idf.value)))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            names = names.view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))], names=["doc_id", "k1", "k2", "w1", "w2", "bands"])

    return docs.select("doc_id", "k1", "k2", "text").mapInArrow(sign, kind)


def star(members: DataFrame) -> DataFrame:
    """members: key, node, alike. (node, alike, leader) for the members of each group of two or more but its leader."""
    leaders = members.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("alike", "node"))["node"].alias("leader")).filter("n > 1")
    return members.join(leaders, "key").filter("node <> leader").select("node", "alike", "leader").distinct()


def verify(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """pairs: node, alike, leader. Adds their similarity. A leader's text comes once for each run of its pairs."""
    kind = "node long, alike long, leader long, similarity double"
    left = pairs.join(texts, "node")
    both = left.join(texts.select(F.col("node").alias("leader"), F.col("text").alias("leader_text")), "leader")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, vector = None, None
        for batch in batches:
            leaders = batch.column(2).to_pylist()
            out = np.zeros(len(leaders))
            for row, _, own in text_shingles(batch.column(3)):
                if leaders[row] != held:
                    held = leaders[row]
                    _, _, theirs = next(text_shingles(batch.column(4).slice(row, 1)))
                    vector = weights(theirs, idf.value)
                (h, w), (g, v) = weights(own, idf.value), vector
                _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
                common = np.minimum(w[i], v[j]).sum(dtype=np.float64)
                out[row] = common / (w.sum(dtype=np.float64) + v.sum(dtype=np.float64) - common)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out)], names=["node", "alike", "leader", "similarity"])

    return both.select("node", "alike", "leader", "text", "leader_text").mapInArrow(compare, kind)


def block_similarities(left: list[np.ndarray], right: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of texts, given as hashes of their shingles with repeats. The k-th repeat of a shingle
    is a feature of its own, so that the common weight of two texts is a product of matrices, made by runs of columns."""
    sides = []
    for texts in (left, right):
        features, weight, owner = [], [], []
        for k, own in enumerate(texts):
            own = np.sort(own)
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
            nth = np.arange(len(own)) - np.repeat(new, np.diff(np.concatenate([new, [len(own)]])))
            features.append(mix(own + nth.astype(np.uint64) * MIX_1))
            weight.append(idf[(own & np.uint64(BUCKETS - 1)).astype(np.int64)])
            owner.append(np.full(len(own), k))
        sides.append((np.concatenate(features), np.concatenate(weight).astype(np.float64), np.concatenate(owner)))
    totals = [np.bincount(owner, weight, len(texts)) for (_, weight, owner), texts in zip(sides, (left, right), strict=True)]
    common = np.intersect1d(sides[0][0], sides[1][0])
    met = []
    for features, weight, owner in sides:
        at = np.searchsorted(common, features)
        near = common[np.minimum(at, len(common) - 1)] == features if len(common) else np.zeros(len(features), bool)
        order = np.argsort(at[near], kind="stable")
        met.append((at[near][order], weight[near][order], owner[near][order]))
    out = np.zeros((len(left), len(right)))
    for first in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - first)
        a, b = np.zeros((len(left), width)), np.zeros((len(right), width))
        for (at, weight, owner), matrix, weighted in zip(met, (a, b), (True, False), strict=True):
            run = slice(*np.searchsorted(at, [first, first + width]))
            matrix[owner[run], at[run] - first] = weight[run] if weighted else 1
        out += a @ b.T
    return out / (totals[0][:, None] + totals[1][None, :] - out)


def links_of_classes(members: DataFrame, roots: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """(a, b): roots of two classes that hold two texts of one bucket alike enough. Every such pair of classes is linked by
    the answers, directly or by others.

    In each bucket, texts outside the class with the most text are the rest. Blocks t of the rest meet blocks u of all."""
    sized = texts.select("node", F.greatest(F.octet_length("text"), F.lit(LEAST_BYTES)).cast("long").alias("size"))
    own = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(sized, "node")
    by_class = own.groupBy("key", "root").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    # a bucket of two is its leader and what the leader has met
    mixed = by_class.groupBy("key").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("size").alias("all"), F.max(F.struct("size", "root")).alias("main")).filter("classes > 1 and n > 2")
    parts = own.join(mixed.select("key", "all", "main"), "key").select("key", "node", "root", (F.col("root") != F.col("main.root")).alias("rest"), F.ceil((F.col("all") - F.col("main.size")) / BLOCK_BYTES).alias("ts"), F.ceil(F.col("all") / BLOCK_BYTES).alias("us"))
    t, u = F.pmod(F.xxhash64("node", F.lit(1)), "ts"), F.pmod(F.xxhash64("node", F.lit(2)), "us")
    as_one = F.transform(F.sequence(F.lit(0).cast("long"), F.col("ts") - 1), lambda k: F.struct(k.alias("pt"), F.col("u").alias("pu")))
    as_rest = F.transform(F.sequence(F.lit(0).cast("long"), F.col("us") - 1), lambda k: F.struct(F.col("t").alias("pt"), k.alias("pu")))
    placed = parts.withColumn("t", t).withColumn("u", u)
    placed = placed.withColumn("p", F.explode(F.when(F.col("rest"), F.array_distinct(F.concat(as_one, as_rest))).otherwise(as_one))).select("key", "p.pt", "p.pu", "node", "root", "rest", "t", "u")

    def compare(key, rows):
        _, pt, pu = key
        shingled: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(rows)
        for row, _, found in text_shingles(pa.array(rows["text"], pa.large_string())):
            shingled[row] = found
        left = np.flatnonzero(rows["rest"].to_numpy() & (rows["t"].to_numpy() == pt))
        right = np.flatnonzero(rows["u"].to_numpy() == pu)
        if not len(left) or not len(right):
            return rows.iloc[:0][["node", "root"]].set_axis(["a", "b"], axis=1)
        root = rows["root"].to_numpy()
        alike = block_similarities([shingled[k] for k in left], [shingled[k] for k in right], idf.value) >= similarity
        i, j = np.nonzero(alike & (root[left][:, None] != root[right][None, :]))
        pairs = np.unique(np.sort(np.stack([root[left[i]], root[right[j]]], 1), axis=1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return placed.join(texts, "node").groupBy("key", "pt", "pu").applyInPandas(compare, "a long, b long")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, k1, k2 (the row by content), root and class_id for each row of docs. root is the class; class_id only names
    it: classes of texts without an id have no name, and an id on several texts can name several classes."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key("doc_id", "text"), F.col("text").cast("string").alias("text"))
    idf = spark.sparkContext.broadcast(frequencies(own))
    signed = written(signatures(own, idf), "signatures")
    nodes = signed.groupBy("w1", "w2").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("k1", "k2")).alias("k"), F.first("bands").alias("bands"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "w1", "w2", "first_id", "k.k1", "k.k2", "bands"), "nodes")

    in_bands = nodes.select(F.explode("bands").alias("key"), "node")
    members = written(in_bands.join(in_bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key"), "members")
    alike = members.groupBy("node").agg(F.sum("n").alias("alike"))
    texts = written(own.select("k1", "k2", "text").join(alike.join(nodes, "node").select("node", "k1", "k2"), ["k1", "k2"]).select("node", "text").dropDuplicates(["node"]), "texts")
    checked = verify(star(members.select("key", "node").join(alike, "node")), texts, idf)
    links = checked.filter(F.col("similarity") >= similarity).select(F.col("node").alias("a"), F.col("leader").alias("b"))
    roots = written(components(links), "roots")
    more = written(components(links_of_classes(members.select("key", "node"), roots, texts, idf, similarity)).select(F.col("node").alias("root"), F.col("root").alias("last")), "roots")

    labelled = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(more, "root", "left").withColumn("root", F.coalesce("last", "root"))
    names = labelled.groupBy("root").agg(F.min("first_id").alias("class_id"))
    by_words = labelled.join(names, "root").select("w1", "w2", "root", "class_id")
    return signed.select("doc_id", "k1", "k2", "w1", "w2").join(by_words, ["w1", "w2"]).select("doc_id", "k1", "k2", "root", "class_id")


def distinct_documents(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class, with its columns: that of the least doc_id, nulls last, then of the least content."""
    order = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "k1", "k2")
    kept = classes(docs, similarity).groupBy("root").agg(F.min(order).alias("k")).select("k.k1", "k.k2")
    keyed = docs.select(F.struct("*").alias("row"), *row_key("doc_id", "text"))
    return keyed.join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")
