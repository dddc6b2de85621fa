"""Exact removal of repeated passages: every byte covered by a string of 400 bytes that also starts elsewhere.

Method: depth-limited radix sort of suffixes by most-significant-digit passes. A pass deals suffixes into groups by the
hash of their next digit (a run of bytes); suffixes alone in a group are done, equal groups at the full depth are the
repeated windows. Suffixes are not sorted one by one at first:

1. Every window of 400 bytes has an anchor, the place of its least 32-byte hash among its first 352 places, so that equal
   windows have equal anchors; the windows of an anchor are a run. First digit: the 49 bytes from the anchor, which all
   its windows hold. Last digit: the bytes of all its windows together. Both repeat: every window of the run repeats. The
   first doesn't: none does.
2. What is left, the edges of repeated passages, is dealt again in blocks of 16 windows, by what all windows of a block
   hold and by all that they hold together.
3. What is left then is dealt by single windows, at the full depth.

Where a group's members differ further on, one member stands for those that are equal to the end of a pass, so that the
next pass deals an open suffix against one of each kind, not against all copies.

A pass is one count of 64-bit keys (partial sums first, so that a frequent passage is one row a task) and one join back.
No group is ever collected. Pass 1 reads all texts; later ones only those with repeated digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import MIX_1, mix, powers, prefix_hashes, row_key, utf8, written

LENGTH = 400
GRAM = 32
SPREAD = 352
CORE = LENGTH - SPREAD + 1
BLOCK = 16
PLACE_BITS = 22


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """Keys of the bytes from start to end, by their content, length and salt."""
    return mix((h[end] - h[start]) * powers(len(h))[1][start] + (end - start).astype(np.uint64) * MIX_1 + np.uint64(salt))


def least_places(x: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` of x, the place of its least value, the last one of ties. len(x) <= 2**PLACE_BITS."""
    n = len(x)
    places = np.uint64((1 << PLACE_BITS) - 1)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = (x & ~places) | (places - np.arange(n, dtype=np.uint64))
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (places - (least & places)).astype(np.int64)


class Text:
    """The anchors of one text of LENGTH bytes or more, with the first and last window start of each."""

    def __init__(self, data: np.ndarray):
        self.h = h = prefix_hashes(data)
        self.starts = starts = len(data) - LENGTH + 1
        grams = (h[GRAM:] - h[:-GRAM]) * powers(len(h))[1][: len(h) - GRAM]
        grams ^= grams >> np.uint64(32)
        grams *= MIX_1
        step = (1 << PLACE_BITS) - SPREAD
        parts = [first + least_places(grams[first : min(first + step, starts) + SPREAD - 1], SPREAD) for first in range(0, starts, step)]
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        change = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        self.anchor, self.low, self.high = at[change], change, np.concatenate([change[1:], [starts]]) - 1

    def keys(self) -> np.ndarray:
        """Two for each anchor: what its windows share, and all that they hold."""
        core = span_hashes(self.h, self.anchor, self.anchor + CORE, 1)
        return np.stack([core, mix(core ^ span_hashes(self.h, self.low, self.high + LENGTH, 2))], 1).ravel()

    def blocks(self, known: Counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first and last window start) of each block of the anchors that pass 1 deals on. Blocks are cut by the
        distance from the anchor, so that equal passages have equal blocks."""
        on = np.flatnonzero(known.dealt_on(2 * len(self.anchor)))
        near, far = (self.anchor - self.high)[on] // BLOCK, (self.anchor - self.low)[on] // BLOCK
        q = runs(near, far)
        which = np.repeat(on, far - near + 1)
        a = self.anchor[which]
        return a, np.maximum(a - q * BLOCK - BLOCK + 1, self.low[which]), np.minimum(a - q * BLOCK, self.high[which])

    def block_keys(self, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Two for each block: what the windows of a full block would share (a text may have some of them only), and all
        that those here hold. Both name bytes by their place from the anchor."""
        q = (a - high) // BLOCK
        first = a - q * BLOCK
        shared = span_hashes(self.h, first, first - BLOCK + 1 + LENGTH, 3)
        return np.stack([mix(shared ^ q.astype(np.uint64)), mix(span_hashes(self.h, low, high + LENGTH, 4) ^ (a - low).astype(np.uint64))], 1).ravel()

    def window_keys(self, p: np.ndarray) -> np.ndarray:
        return span_hashes(self.h, p, p + LENGTH, 5)


class Counts:
    """What a pass has found of one text: how often its keys are there, where more than once, and whether this text
    stands for the equal ones."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.place, self.own, self.counts = codes & (OWN - 1), codes >= OWN, counts

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        times, own = np.ones(n, np.int64), np.zeros(n, bool)
        times[self.place], own[self.place] = self.counts, self.own
        return times, own

    def dealt_on(self, n: int) -> np.ndarray:
        """Pairs of keys whose first digit repeats in suffixes that differ later, as far as they must meet the others."""
        times, own = self.of(n)
        first, last = times[0::2], times[1::2]
        return (first > 1) & (first != last) & ((last == 1) | own[1::2])

    def whole(self, n: int) -> np.ndarray:
        """Pairs of keys whose windows all repeat."""
        return self.of(n)[0][1::2] > 1


OWN = 1 << 40


def runs(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from low to high, run after run."""
    n = high - low + 1
    return np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)


def first_pass(text: Text, known: list[Counts]) -> np.ndarray:
    return text.keys()


def second_pass(text: Text, known: list[Counts]) -> np.ndarray:
    return text.block_keys(*text.blocks(known[0]))


def open_windows(text: Text, known: list[Counts]) -> np.ndarray:
    _, low, high = text.blocks(known[0])
    on = np.flatnonzero(known[1].dealt_on(2 * len(low)))
    return runs(low[on], high[on])


def third_pass(text: Text, known: list[Counts]) -> np.ndarray:
    return text.window_keys(open_windows(text, known))


def removed(text: Text, known: list[Counts]) -> np.ndarray:
    """Bounds of the maximal removed runs: begins and ends in turn."""
    anchor = known[0].whole(2 * len(text.anchor))
    _, low, high = text.blocks(known[0])
    block = known[1].whole(2 * len(low))
    p = open_windows(text, known)
    p = p[known[2].of(len(p))[0] > 1]
    begins = np.concatenate([text.low[anchor], low[block], p])
    ends = np.concatenate([text.high[anchor], high[block], p]) + LENGTH
    change = np.zeros(text.starts + LENGTH, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, ends, -1)
    covered = np.cumsum(change)[:-1] > 0
    return np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))


def columns_of(passes: int) -> list[str]:
    return [f"{what}{k}" for k in range(1, passes + 1) for what in ("codes", "counts")]


def known_of(batch: pa.RecordBatch, passes: int) -> list[list[Counts]]:
    """The Counts of each row, from the columns of columns_of()."""
    by_pass = []
    for k in range(1, passes + 1):
        codes, counts = (batch.column(batch.schema.get_field_index(f"{what}{k}")) for what in ("codes", "counts"))
        at = np.concatenate([[0], np.cumsum(np.nan_to_num(np.asarray(pc.fill_null(pc.list_value_length(codes), 0))))]).astype(np.int64)
        c, n = np.asarray(codes.flatten()), np.asarray(counts.flatten())
        by_pass.append([Counts(c[at[i] : at[i + 1]], n[at[i] : at[i + 1]]) for i in range(batch.num_rows)])
    return [list(of) for of in zip(*by_pass, strict=True)] if by_pass else [[] for _ in range(batch.num_rows)]


def counted(docs: DataFrame, ids: list[str], passes: int, keys: Callable[[Text, list[Counts]], np.ndarray]) -> DataFrame:
    """ids and the next two of columns_of(): which of a text's keys are there more than once. The keys are made twice,
    once to be counted and once to be looked up: that costs less than to keep them."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    given = columns_of(passes)

    def emit(names: list[str]) -> DataFrame:
        with_place = "place" in names

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, bounds = utf8(batch.column(0))
                known = known_of(batch, passes)
                held: list[tuple[int, np.ndarray]] = []
                size = 0
                for row in range(batch.num_rows):
                    if bounds[row + 1] - bounds[row] >= LENGTH:
                        k = keys(Text(data[bounds[row] : bounds[row + 1]]), known[row])
                        if len(k):
                            held.append((row, k))
                            size += len(k)
                    if size > 1 << 17:
                        yield out(batch, held)
                        held, size = [], 0
                if held:
                    yield out(batch, held)

        def out(batch: pa.RecordBatch, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            n = [len(k) for _, k in held]
            at = pa.array(np.repeat([row for row, _ in held], n))
            columns = [pa.array(np.concatenate([k for _, k in held]).view(np.int64))]
            if with_place:
                columns.append(pa.array(np.concatenate([np.arange(m) for m in n])))
            columns += [batch.column(batch.schema.get_field_index(c)).take(at) for c in ids if c in names]
            return pa.RecordBatch.from_arrays(columns, names=names)

        kind = ", ".join(f"{c} {types.get(c, 'long')}" for c in names)
        return docs.select("text", *given, *[c for c in ids if c in names]).mapInArrow(local, kind)

    twice = emit(["key", ids[0]]).groupBy("key").agg(F.count("*").alias("n"), F.min(ids[0]).alias("owner")).filter("n > 1")
    twice = written(twice, "digits")  # a join of two exchanges, which Spark can split where a key is frequent
    met = emit(["key", "place", *ids]).join(twice, "key")
    code = F.col("place") + F.when(F.col("owner") == F.col(ids[0]), F.lit(OWN)).otherwise(F.lit(0))
    found = met.groupBy(*ids).agg(F.collect_set(F.struct(code.alias("code"), "n")).alias("found"))
    return found.select(*ids, *(F.col(f"found.{c}").alias(name) for c, name in zip(("code", "n"), columns_of(passes + 1)[-2:], strict=True)))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text and removed (begins and ends of the removed runs, in bytes) for each row of docs.

    A null text is empty; texts under 400 bytes lose nothing; a repeated row counts as another occurrence of its text
    and is answered again. Other columns are ignored."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *row_key("doc_id", "text"))
    met = own.join(counted(own, ["k1", "k2"], 0, first_pass), ["k1", "k2"], "left").drop("k1", "k2")
    met = written(met.withColumn("row", F.monotonically_increasing_id()), "repeats")
    some = met.filter("codes1 is not null")
    second = written(counted(some, ["row"], 1, second_pass), "blocks")
    some = some.join(second, "row", "left")
    third = counted(some.filter("codes2 is not null"), ["row"], 2, third_pass)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column(1))
            known = known_of(batch, 3)
            rows = [removed(Text(data[bounds[i] : bounds[i + 1]]), known[i]).tolist() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "text", "removed"])

    full = some.join(third, "row", "left").select("doc_id", "text", *columns_of(3))
    marked = full.mapInArrow(mark, "doc_id long, text string, removed array<long>")
    rest = met.filter("codes1 is null").select("doc_id", "text", F.array().cast("array<long>").alias("removed"))
    return marked.unionByName(rest)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of the bytes that stay."""
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                kept = hashlib.sha256()
                at = gone = 0
                for begin, end in zip(cuts[0::2], cuts[1::2], strict=True):
                    kept.update(data[at:begin])
                    gone += end - begin
                    at = end
                kept.update(data[at:])
                rows.append((doc_id, len(data), gone, len(cuts) // 2, kept.hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    schema = pa.schema([*((n, pa.int64()) for n in names[:4]), ("kept_sha256", pa.string())])
    return found.select("doc_id", "text", "removed").mapInArrow(local, kind)
