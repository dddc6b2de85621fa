"""Benchmark decontamination.

Method: greedy string tiling. Runs of five words that a document shares with a benchmark item are seeds (Karp-Rabin
hashes of word hashes, looked up in the items' table); on each diagonal they join to common runs. The longest run whose
words are all unmarked is marked in both texts, again and again (of equally long ones, that which begins first in the
document, then in the item); the marked share of the item is its coverage. Tiles may come in any order, so that
reordered passages count.

Texts that repeat words have very many seeds in common. Where there are more than PAIRS for each word of both texts, the
same tiles are found without listing seeds: the greatest length at which a common unmarked run is left is searched by
Karp-Rabin hashes of all windows, all runs of that length are marked, and so on with shorter ones.

The benchmark meets the documents in blocks of a bounded size (`block_bytes`), one pass each, so that what is sent to
the executors does not grow. Documents stay where they are; nothing is shuffled.

Words are parted by ASCII white space and punctuation, ASCII case folded. An item of fewer than five words has no seed
and never matches.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import MARKS, pieces_of, powers, shingles, utf8, word_hashes

WORDS = 5
COVERAGE = 0.6
BLOCK_BYTES = 8_000_000
PAIRS = 8


def tiles(hits: list[tuple[int, int]], words: int = WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the document, place in the item, length) from seeds (place, place) of so many words."""
    by_diagonal: dict[int, list[int]] = defaultdict(list)
    for d, i in hits:
        by_diagonal[d - i].append(i)
    runs = []
    for diagonal, places in by_diagonal.items():
        places.sort()
        begin = last = places[0]
        for i in [*places[1:], None]:
            if i is None or i > last + 1:
                runs.append((begin - last - words, begin + diagonal, begin))
                begin = i
            last = i
    heapq.heapify(runs)
    out, in_doc, in_item = [], set(), set()
    while runs:
        n, d, i = heapq.heappop(runs)
        free = [d + k not in in_doc and i + k not in in_item for k in range(-n)]
        if all(free):
            out.append((d, i, -n))
            in_doc.update(range(d, d - n))
            in_item.update(range(i, i - n))
            continue
        begin = None
        for k, is_free in enumerate([*free, False]):
            if is_free and begin is None:
                begin = k
            elif not is_free and begin is not None:
                if k - begin >= words:
                    heapq.heappush(runs, (begin - k, d + begin, i + begin))
                begin = None
    return out


def tiles_of_words(doc: np.ndarray, item: np.ndarray, words: int = WORDS) -> list[tuple[int, int, int]]:
    """The tiles() of two texts of word hashes, in memory of their words, however many seeds they share."""
    marked = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    if min(len(doc), len(item)) < words:
        return []
    inverse = powers(max(len(doc), len(item)))[1]
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(text * powers(len(text))[0], dtype=np.uint64)]) for text in (doc, item)]

    def open_windows(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and hashes of the unmarked windows of both texts: sums of words times powers, moved to a common power."""
        out = []
        for own, marks in zip(sums, marked, strict=True):
            count = np.concatenate([[0], np.cumsum(marks)])
            places = np.flatnonzero(count[n:] == count[:-n])
            out.append((places, (own[places + n] - own[places]) * inverse[places]))
        return out

    def is_common(n: int) -> bool:
        (_, a), (_, b) = open_windows(n)
        return bool(np.isin(a, b).any())

    out, most = [], min(len(doc), len(item))
    while most >= words and is_common(words):
        low, high = words, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if is_common(middle) else (low, middle - 1)
        (places, hashes), (in_item, item_hashes) = open_windows(low)
        order = np.argsort(item_hashes, kind="stable")
        item_hashes, in_item = item_hashes[order], in_item[order]
        first = np.searchsorted(item_hashes, hashes, "left")
        ends = np.searchsorted(item_hashes, hashes, "right")
        following: dict[int, int] = {}  # places of one hash that are marked stay so
        free_from = 0
        for k in np.flatnonzero(ends > first):
            d, begin, end = int(places[k]), int(first[k]), int(ends[k])
            if d < free_from:
                continue
            at = following.get(begin, begin)
            while at < end and marked[1][in_item[at] : in_item[at] + low].any():
                at += 1
            following[begin] = at
            if at < end:
                i = int(in_item[at])
                out.append((d, i, low))
                marked[0][d : d + low] = marked[1][i : i + low] = True
                free_from = d + low
        most = low - 1
    return out


class Items:
    """A block of the benchmark with its table of seeds."""

    def __init__(self, ids: list[int], texts: list[str]):
        data, bounds = utf8(pa.array(texts, pa.large_string()))
        words, at = word_hashes(data, bounds, MARKS)
        seeds, seeds_at = shingles(words, at, WORDS)
        order = np.argsort(seeds, kind="stable")
        self.ids, self.sizes, self.words, self.at = ids, np.diff(at), words, at
        seeds_of = np.repeat(np.arange(len(ids)), np.diff(seeds_at))
        places = (np.arange(len(seeds)) - seeds_at[seeds_of])[order]
        # one entry for each seed of an item, with the slice of its places
        owner, seeds_sorted = seeds_of[order], seeds[order]
        begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(seeds)), bool), (seeds_sorted[1:] != seeds_sorted[:-1]) | (owner[1:] != owner[:-1])]))
        self.seeds, self.owner, self.place = seeds_sorted[begins], owner[begins], places
        self.begins = np.append(begins, len(seeds))
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[seeds & np.uint64((1 << 22) - 1)] = True

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, words covered, tiles) for every pair with a common seed."""
        data, bounds = utf8(texts)
        for a, b in pieces_of(bounds):
            words, at = word_hashes(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], MARKS)
            found, found_at = shingles(words, at, WORDS)
            at_hit = np.flatnonzero(self.maybe[found & np.uint64((1 << 22) - 1)])
            low = np.searchsorted(self.seeds, found[at_hit], "left")
            high = np.searchsorted(self.seeds, found[at_hit], "right")
            hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            rows = np.searchsorted(found_at, at_hit, "right") - 1
            for k in np.flatnonzero(high > low):
                row, place = int(rows[k]), int(at_hit[k] - found_at[rows[k]])
                for s in range(low[k], high[k]):
                    hits[row, int(self.owner[s])].append((place, s))
            for (row, item), seeds in hits.items():
                doc, own = words[at[row] : at[row + 1]], self.words[self.at[item] : self.at[item + 1]]
                if sum(int(self.begins[s + 1] - self.begins[s]) for _, s in seeds) > PAIRS * (len(doc) + len(own)):
                    marked = tiles_of_words(doc, own)
                else:
                    marked = tiles([(place, int(i)) for place, s in seeds for i in self.place[self.begins[s] : self.begins[s + 1]]])
                yield a + row, item, sum(n for _, _, n in marked), len(marked)


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Items]:
    """The items by blocks; a single longer item is a block of its own at worst."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").distinct()
    n = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield Items([r["item_id"] for r in rows], [r["text"] for r in rows])


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, item_words, covered_words, tiles and coverage for each pair that covers enough of the item.

    Null and empty texts match nothing; a repeated row of docs is answered again, a repeated item once; an empty
    benchmark gives no rows. Other columns are ignored."""
    kind = "doc_id long, item_id long, item_words long, covered_words long, tiles long, coverage double"
    types = (pa.int64(),) * 5 + (pa.float64(),)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = own.sparkSession.createDataFrame([], kind)
    for items in blocks(benchmark, block_bytes):
        sent = own.sparkSession.sparkContext.broadcast(items)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for row, item, covered, n in sent.value.matches(batch.column(1)):
                    size = int(sent.value.sizes[item])
                    if covered >= coverage * size:
                        rows.append((batch.column(0)[row].as_py(), sent.value.ids[item], size, covered, n, covered / size))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in kind.split(", ")])

        out = out.unionByName(own.mapInArrow(scan, kind))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that cover enough of no item, with all their columns."""
    out = docs
    for items in blocks(benchmark, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def screen(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, item, covered, _ in sent.value.matches(batch.column("text")):
                    if covered >= coverage * int(sent.value.sizes[item]):
                        keep[row] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(screen, docs.schema)
    return out
