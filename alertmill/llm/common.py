"""What several operators share: inputs, scratch tables and word shingles."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_scratch: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by spark.checkpoint.dir. Only a local master may go without one, as in tests."""
    global _own_scratch
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own_scratch = _own_scratch or "file://" + tempfile.mkdtemp(prefix="alertmill-")
        base = _own_scratch
    return f"{base.rstrip('/')}/alertmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and lost executors don't lose it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a scratch table that no later step reads."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/alertmill/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_key(*columns: str) -> list:
    """Two hashes (96 bits) that name a row by its content; rows that repeat share them."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    return [F.xxhash64(*cols).alias("k1"), F.hash(*reversed(cols)).alias("k2")]


MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


#: Bytes that part words: ASCII white space and control characters; with marks, ASCII punctuation too.
SPACE = np.arange(256) <= 32
MARKS = SPACE | (np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = 0xD1342543DE82EF95
KEPT_POWERS = 1 << 20
_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and their inverses. A worker keeps KEPT_POWERS of them; those of a
    longer text are worked out anew, so that one long text doesn't hold memory for good."""
    global _powers
    if n > KEPT_POWERS:
        return _power_row(_BASE, n), _power_row(pow(_BASE, -1, 2**64), n)
    if _powers is None:
        _powers = _power_row(_BASE, KEPT_POWERS), _power_row(pow(_BASE, -1, 2**64), KEPT_POWERS)
    return _powers[0][:n], _powers[1][:n]


def _power_row(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64, out=out)


def prefix_hashes(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """h where (h[e] - h[s]) * inverse power of s names the bytes from s to e; fold: ASCII case doesn't count."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[data] * powers(len(data))[0], dtype=np.uint64, out=out[1:])
    return out


def utf8(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow array and the bounds of each; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def text_bounds(texts) -> np.ndarray:
    """The bounds in bytes of each text of an Arrow array; null is empty."""
    import pyarrow.compute as pc

    return np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))])


def pieces_of(bounds: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of rows with about so many bytes; a longer row stands alone."""
    out, a = [], 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def word_hashes(data: np.ndarray, bounds: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of the texts (ASCII case folded), and the bounds of each text's words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = ~parts[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    h = prefix_hashes(data, fold=True)
    return mix((h[e] - h[s]) * powers(n)[1][s]), np.searchsorted(s, bounds)


def shingles(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of n words that stays in its text, and the bounds of each text's runs."""
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], counts)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = h * np.uint64(_BASE) + words[at + k]
    return mix(h), ends


COUNTS = 1 << 12


def summed_vector(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of vectors of a fixed size that tasks have counted, as rows of count_rows(). Each chunk of the vector is
    summed as a stream; only the sum reaches the driver."""
    import pyarrow as pa

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(counts, np.int64)
        yield from count_rows(sums.items(), pa)

    out = np.zeros(-(-size // COUNTS) * COUNTS, np.int64)
    for r in parts.repartition("chunk").mapInArrow(total, COUNT_ROWS).collect():
        out[r["chunk"] * COUNTS : (r["chunk"] + 1) * COUNTS] = np.frombuffer(r["counts"], np.int64)
    return out[:size]


COUNT_ROWS = "chunk int, counts binary"


def count_rows(items, pa):
    items = [(k, v.tobytes()) for k, v in items if v.any()]
    for k in range(0, len(items), 64):
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in items[k : k + 64]], pa.int32()), pa.array([v for _, v in items[k : k + 64]], pa.binary())], names=["chunk", "counts"])


def vector_rows(vector: np.ndarray):
    """A task's vector as rows for summed_vector()."""
    import pyarrow as pa

    full = np.zeros(-(-len(vector) // COUNTS) * COUNTS, np.int64)
    full[: len(vector)] = vector
    return count_rows(enumerate(full.reshape(-1, COUNTS)), pa)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and root, the least node that it is linked to, for every node of edges (a, b): alternating large and small
    stars. A node with many edges is met in partial minima and joins that Spark can split."""
    spark = edges.sparkSession

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        large = written(large, name)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        after = written(small, name)
        forget(spark, now)
        forget(spark, large)
        now, before = after, seen
        seen = state(now)
        if seen == before:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
