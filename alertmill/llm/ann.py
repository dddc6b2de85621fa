"""Approximate nearest neighbours by cosine.

Method: shifted space-filling curves. Vectors are projected by seeded random rotations to a few dimensions, shifted and
put in the order of a Hilbert curve, once for each of several curves. Spark range-partitions each ordering, which gives
every vector a rank; a query meets the vectors within a window of ranks on every curve, and what the curves find is
merged and ranked by the exact cosine.

* Equal vectors collapse to one node, which keeps its `k + 1` least ids: more can't be in an answer. So a frequent vector
  is one row, and ties among its copies go to the least ids. Candidates are cut by the exact score and then the least id,
  with all whose rounded score is near the cut, so that ties among parallel vectors of other lengths go the same way.
* Vectors of each number of components are an index of their own; components keep the precision that they come with.
* The window is a share of the rows, as the recall of a curve depends on the share of the rows that it shows. On vectors
  without structure, in which any index must look at much of the data, 32 curves and 1.5 % to either side have a recall
  of over 0.95; vectors in clusters need much less (`window_share`).
* Ranks are cut into blocks of BLOCK rows, so that no group is larger; a query goes to each block that its window meets.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.llm.common import written

CURVES = 32
DIMENSIONS = 6
BITS = 8
WINDOW_SHARE = 0.015
LEAST_WINDOW = 256
BLOCK = 2048
#: Rounding that the product of unit vectors may have against the exact cosine.
NEAR = 1e-9
SEED = 7


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on a Hilbert curve of each row of cells, whole numbers under 2**bits. Gray-code transposition."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        q = np.uint64(1 << bit)
        low = q - np.uint64(1)
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> np.uint64(bit)) & np.uint64(1) != 0, np.uint64((1 << bit) - 1), np.uint64(0))
    x ^= turn
    place = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << np.uint64(1)) | ((x[i] >> np.uint64(bit)) & np.uint64(1))
    return place


def curve_keys(vectors: np.ndarray, curves: int, dimensions: int, bits: int, seed: int) -> np.ndarray:
    """A key for each vector and curve, by direction alone."""
    width = vectors.shape[1]
    vectors = scaled(vectors)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.empty((len(vectors), curves), np.int64)
    for c in range(curves):
        rng = np.random.default_rng([seed, c])
        d = min(dimensions, width)
        rotation, _ = np.linalg.qr(rng.standard_normal((width, d)))
        # a coordinate of a random unit vector has a deviation of 1/sqrt(width); 3.5 of them to either side, and a shift
        cells = ((unit @ rotation) * math.sqrt(width) + 3.5 + rng.random(d)) / 8 * (1 << bits)
        out[:, c] = hilbert(np.clip(cells, 0, (1 << bits) - 1).astype(np.int64), bits).astype(np.int64)
    return out


def usable(v: Column) -> Column:
    """Not null, with finite components only, not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which changes no cosine, so that no square is infinite or zero."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision; the same for a pair wherever it is met."""
    a, b = scaled(a), scaled(b)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS, window_share: float = WINDOW_SHARE, least_window: int = LEAST_WINDOW, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row for which is_query holds.

    vectors: vec_id, embedding. Rows without an id and vectors that are null, empty, zero, or hold null or non-finite
    numbers take no part; vectors of different lengths never meet. A repeated row counts once; an id with two vectors asks
    with both. Other columns are ignored; fewer rows than k give fewer answers; an empty table gives none."""
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "array<float>" if element == "float" else "array<double>"
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    own = own.groupBy("v", "vec_id").agg(F.lit(1).alias("one")).drop("one")
    asked = own.withColumn("asks", is_query)
    few = asked.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("at") <= k + 1)
    few = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asking = asked.filter("asks").select("v").distinct().withColumn("asks", F.lit(True))
    nodes = few.join(asking, "v", "left").select(F.monotonically_increasing_id().alias("node"), "v", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
    nodes = written(nodes, "vectors")

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, part in frame.groupby(frame["v"].map(len)):
                found = curve_keys(np.stack(part["v"].to_numpy()).astype(np.float64), curves, dimensions, bits, seed)
                yield pd.DataFrame({"curve": np.tile(size * curves + np.arange(curves), len(part)), "key": found.ravel(), "node": np.repeat(part["node"].to_numpy(), curves)})

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for frame in frames:
            for curve, rows in frame.groupby("curve", sort=False):
                at = np.arange(len(rows)) + seen[curve]
                seen[curve] += len(rows)
                yield pd.DataFrame({"curve": curve, "node": rows["node"].to_numpy(), "part": part, "at": at})

    # a curve is one ordering of the vectors of one length; its number tells both
    ordered = nodes.select("node", "v").mapInPandas(keys, "curve long, key long, node long").repartitionByRange("curve", "key", "node").sortWithinPartitions("curve", "key", "node")
    ordered = written(ordered.mapInPandas(number, "curve long, node long, part int, at long"), "curves")
    parts = ordered.groupBy("curve", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("count").over(Window.partitionBy("curve"))
    ranked = ordered.join(parts.select("curve", "part", before.alias("before"), total.alias("total")), ["curve", "part"])
    ranked = ranked.select("curve", "node", (F.col("before") + F.col("at")).alias("place"), "total", F.greatest(F.lit(least_window).cast("long"), F.ceil(window_share * F.col("total"))).alias("window")).join(nodes, "node")

    met = ranked.select("curve", F.floor(F.col("place") / BLOCK).alias("block"), "place", "node", "v", F.col("ids")[0].alias("least"))
    reach = F.sequence(F.floor(F.greatest(F.col("place") - F.col("window"), F.lit(0)) / BLOCK), F.floor(F.least(F.col("place") + F.col("window"), F.col("total") - 1) / BLOCK))
    asks = ranked.filter("asks").select(F.col("curve").alias("q_curve"), F.explode(reach).alias("q_block"), F.col("place").alias("q_place"), F.col("window").alias("q_window"), F.col("node").alias("q_node"), F.col("v").alias("q_v"))
    keep = k + 1

    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "score": np.zeros(0)})
        v = scaled(np.stack(rows["v"].to_numpy()).astype(np.float64))
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        place, node, least = rows["place"].to_numpy(), rows["node"].to_numpy(), rows["least"].to_numpy()
        out = []
        for a in range(0, len(queries), 256):
            part = queries.iloc[a : a + 256]
            q = scaled(np.stack(part["q_v"].to_numpy()).astype(np.float64))
            score = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ unit.T
            score[np.abs(part["q_place"].to_numpy()[:, None] - place) > part["q_window"].to_numpy()[:, None]] = -np.inf
            n = min(len(rows), keep)
            cut = -np.partition(-score, n - 1, axis=1)[:, n - 1 : n]
            row, best = np.nonzero((score >= cut - NEAR) & np.isfinite(score))
            found = pd.DataFrame({"query": part["q_node"].to_numpy()[row], "node": node[best], "score": exact(q[row], v[best]), "least": least[best]})
            found = found.sort_values(["query", "score", "least"], ascending=[True, False, True], kind="stable")
            out.append(found.groupby("query").head(keep)[["query", "node", "score"]])
        return pd.concat(out)

    found = asks.groupBy("q_curve", "q_block").cogroup(met.groupBy("curve", "block")).applyInPandas(search, "query long, node long, score double")
    found = found.groupBy("query", "node").agg(F.max("score").alias("score"))
    names = nodes.select("node", "ids")
    by_node = found.join(names, "node").select("query", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    by_node = by_node.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1).drop("at")
    queries = asked.filter("asks").join(nodes.select("v", F.col("node").alias("query")), "v").select(F.col("vec_id").alias("query_id"), "query")
    answers = queries.join(by_node, "query").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
