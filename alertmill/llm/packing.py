"""Best-fit packing of tokenised documents into sequences of fixed length.

Method: best-two-fit. A bin is filled greedily with the largest document that fits; then its smallest
document is replaced by two unpacked documents whose sum fits the widened gap more tightly.

Spark tokenises where the rows lie, and deals what is shorter than a sequence into groups of a bounded
size by a hash of a row number, so that no key can make a group large. Each group is packed on its own;
a group wastes less than one sequence, against about `group_items / 4` sequences that it makes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import pieces_of, text_bounds, written

CAPACITY = 4096
END_ID = 1
GROUP_ITEMS = 20_000
#: Bytes of words and their ids that a Python worker keeps, in each of two generations, each word counted with WORD_BYTES.
CACHE_BYTES = 50_000_000
WORD_BYTES = 130
#: Bytes of text that are split into words at a time; a longer text stands alone.
SLICE_BYTES = 3 << 20
LONG_WORD = 64
#: Control characters on which libraries disagree whether they are white space.
ODD_SPACE = "[\x1c-\x1f᠎​﻿]"


class WordTokenizer:
    """Token ids by whole words. The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its words in turn; words repeat, so their ids are kept, as bytes of a bounded sum."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def word(self, w: str) -> bytes:
        ids = self.young.get(w)
        if ids is not None:
            return ids
        ids = self.old.get(w)
        if ids is None:
            ids = self._fresh(w)
        if len(w) <= LONG_WORD:
            if self.size >= CACHE_BYTES:
                self.old, self.young, self.size = self.young, {}, 0
            self.young[w] = ids
            self.size += WORD_BYTES + len(ids)
        return ids

    def _fresh(self, w: str) -> bytes:
        if w.isascii() or _latin(w):
            low = w.lower()
            if low != w:
                return self.word(low)
            if len(w) > 1 and w[-1] in ".," and w[:-1].isalpha():
                return self.word(w[:-1]) + self.word(w[-1])
        return self.encode(w).tobytes()

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts)
        words = pc.utf8_split_whitespace(plain)
        ends = np.asarray(words.offsets)
        coded = pc.dictionary_encode(words.flatten())
        out = [np.empty(0, "<u4")] * len(texts)
        if len(coded):
            each = [self.word(w) for w in coded.dictionary.to_pylist()]
            sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
            flat, begins = np.frombuffer(b"".join(each), "<u4"), np.cumsum(sizes) - sizes
            code = np.asarray(coded.indices)
            first = ends[0]
            for i in range(len(texts)):
                of = code[ends[i] - first : ends[i + 1] - first]
                n = sizes[of]
                total = int(n.sum())
                if total:
                    at = np.arange(total) + np.repeat(begins[of] - (np.cumsum(n) - n), n)
                    out[i] = flat[at]
        for i in np.flatnonzero(odd):
            out[i] = self.encode(texts[int(i)].as_py())
        return out


def _latin(w: str) -> bool:
    try:
        w.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker and file; its words stay from task to task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32. A null text is empty (its ids: the end id
    alone); a repeated row gives its pieces again; other columns are ignored."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for a, b in pieces_of(text_bounds(batch.column(1)), SLICE_BYTES):
                part = batch.slice(a, b - a)
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), tokenizer.texts(part.column(1)), strict=True):
                    ids = np.concatenate([ids, end])
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        rows.append((doc_id, k, start, len(own), zlib.crc32(own.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def best_two_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of positions in lengths. All lengths are from 1 to capacity."""
    waiting: dict[int, list[int]] = {}
    for k in range(len(lengths) - 1, -1, -1):
        waiting.setdefault(lengths[k], []).append(k)
    up = sum(1 << n for n in waiting)  # bit n: something of length n waits
    down = sum(1 << (capacity - n) for n in waiting)  # the same, mirrored, to meet pairs of one sum

    def take(n: int) -> int:
        nonlocal up, down
        k = waiting[n].pop()
        if not waiting[n]:
            up ^= 1 << n
            down ^= 1 << (capacity - n)
        return k

    def put(n: int, k: int) -> None:
        nonlocal up, down
        waiting[n].append(k)
        up |= 1 << n
        down |= 1 << (capacity - n)

    def pair(most: int, least: int) -> tuple[int, int] | None:
        for total in range(most, least - 1, -1):
            both = up & (down >> (capacity - total)) & ((1 << total) - 1)
            if total % 2 == 0 and both >> (total // 2) & 1 and len(waiting[total // 2]) < 2:
                both ^= 1 << (total // 2)
            if both:
                a = both.bit_length() - 1
                return a, total - a
        return None

    bins = []
    while up:
        filled: list[int] = []
        gap = capacity
        while fits := up & ((1 << (gap + 1)) - 1):
            n = fits.bit_length() - 1
            filled.append(take(n))
            gap -= n
        while gap and up:
            small = min(filled, key=lambda k: (lengths[k], k))
            n = lengths[small]
            found = pair(gap + n, n + 1)
            if not found:
                break
            filled.remove(small)
            filled += [take(found[0]), take(found[1])]
            put(n, small)
            gap += n - sum(found)
        bins.append(filled)
    return bins


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, group_items: int = GROUP_ITEMS) -> DataFrame:
    """The rows of pieces() with sequence_id and offset; whole sequences stand alone."""
    cut = written(pieces(docs, tokenizer_path, capacity, end_id).withColumn("item", F.monotonically_increasing_id()), "pieces")
    short = cut.filter(F.col("length") < capacity)
    groups = max(1, math.ceil(short.count() / group_items))
    schema = f"{PIECES}, sequence_id long, offset long"

    def fill(key, rows):
        rows = rows.sort_values("item", kind="stable").reset_index(drop=True)
        lengths = rows["length"].tolist()
        bins = best_two_fit(lengths, capacity)
        order = list(chain.from_iterable(bins))
        sequence = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        n = np.array(lengths)[order]
        ends = np.cumsum(n)
        begins = np.concatenate([[0], ends[:-1]])
        first = np.searchsorted(sequence, np.arange(len(bins)))
        out = rows.iloc[order].drop(columns=["item", "g"])
        out["sequence_id"] = int(key[0]) * 2**32 + sequence
        out["offset"] = begins - begins[first][sequence]
        return out

    packed = short.withColumn("g", F.pmod(F.xxhash64("item"), F.lit(groups))).groupBy("g").applyInPandas(fill, schema)
    whole = cut.filter(F.col("length") >= capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)
