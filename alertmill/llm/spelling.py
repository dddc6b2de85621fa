"""Groups of spelling variants: words one edit apart, found by dynamic programming along the sorted vocabulary.

Method: sorted-list dynamic programming. In a sorted list the words that begin alike are one range, and the rows of an edit
matrix depend on that beginning alone. A query word therefore goes through the list range by range: a band of three cells
for each beginning, worked out once and kept for all words of the range (their common prefix); a range whose band exceeds
one edit is skipped whole. All queries of a block go through its list side by side.

No task meets the whole vocabulary. Two words one edit apart agree in their beginning or their end, by half of the longer
one at least, so the list is dealt by these halves: a group is a sorted list of words that share one (lists by ends hold
words turned round). Groups beyond `group_bytes` are dealt on by half of what is left open, until all but one letter is
shared; such a group has no more words than there are letters. Each pair counts in the one group that its common beginning
names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import forget, written

LEAST_LENGTH = 6
LEAST_COUNT = 5
FACTOR = 5
NOISE = 199
GROUP_BYTES = 1 << 20
HELD_WORDS = 1 << 18
BLOCK_BYTES = 1 << 18
STATES = 1 << 20

#: Letters of words: A-Z become a-z; a-z and U+00C0 to U+00FF stay; all else parts words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def words_in(doc_id, text: str | None, least_length: int = LEAST_LENGTH) -> Counter:
    """The words of one text, in Latin-1, with their counts. A run loses the letter at hash % length where NOISE divides the
    hash of its id and lower-cased form. A null id is written as nothing, a null text has no words."""
    runs = Counter(w for w in (text or "").encode("latin-1", "replace").translate(LETTERS).split() if len(w) >= least_length)
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    changed = []
    for w in runs:
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), begun)
        if not h % NOISE:
            changed.append((w, h % len(w)))
    whole = [(w, k, runs.pop(w)) for w, k in changed]
    for w, k, n in whole:
        if len(w) > least_length:
            runs[w[:k] + w[k + 1 :]] += n
    return runs


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n (long): the words of all texts that occur often enough. Tasks count what they read first, so that a frequent
    word is a row for each task and HELD_WORDS words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                held.update(words_in(doc_id.as_py(), text.as_py(), least_length))
                if len(held) > HELD_WORDS:
                    yield rows(held)
                    held.clear()
        yield rows(held)

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# --- dealing the vocabulary

GROUP = ["longer", "front", "back", "bound", "key"]


def dealt(words: DataFrame, group_bytes: int) -> DataFrame:
    """word and n in every group (GROUP) where the word may have near ones. longer: the length of the longer word of a pair;
    front, back: how many letters a group shares; bound: pairs that agree in so many first letters belong elsewhere."""
    either = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longer")
    left = halves(words.select("word", "n", either).withColumns({"front": F.lit(0), "back": F.lit(0), "bound": F.lit(1 << 30)}))
    found = None
    while True:  # each turn halves what is open, so there are as many as the longest word has bits
        left = written(left, "dealt")
        large = left.groupBy(*GROUP).agg(F.count("*").alias("size")).filter((F.col("size") * F.col("longer") > group_bytes) & (F.col("front") + F.col("back") < F.col("longer") - 1))
        large = written(large.drop("size"), "large")
        if large.isEmpty():
            return left if found is None else found.unionByName(left)
        small = left.join(large, GROUP, "left_anti")
        found = small if found is None else found.unionByName(small)
        left = halves(left.join(large, GROUP, "left_semi"))


def halves(rows: DataFrame) -> DataFrame:
    """Every row in two finer groups: by half of the open letters, rounded up, at the beginning or at the end."""
    step = ((F.col("longer") - F.col("front") - F.col("back")) / 2).cast("int")
    by_front = F.struct((F.col("front") + step).alias("front"), F.col("back").alias("back"), F.col("bound").alias("bound"))
    by_back = F.struct(F.col("front").alias("front"), (F.col("back") + step).alias("back"), F.least("bound", F.col("front") + step).alias("bound"))
    both = rows.select("word", "n", "longer", F.explode(F.array(by_front, by_back)).alias("g")).select("word", "n", "longer", "g.*")
    ends = F.when(F.col("back") > 0, F.expr("right(word, back)")).otherwise("")
    return both.withColumn("key", F.concat_ws("|", F.expr("left(word, front)"), ends))


def turned() -> Column:
    """Whether a group's list is sorted by words turned round."""
    return F.col("back") > F.col("front")


# --- one block of groups


def matrix(words: list[bytes], width: int) -> np.ndarray:
    """A row of letters for each word, filled up with zeros."""
    return np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: which row each of the items belongs to, and its number within the row."""
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def near_in_lists(letters: np.ndarray, length: np.ndarray, first: np.ndarray, last: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) one edit apart. Rows are sorted lists one after another; first and last bound the list of each row,
    whose words share depth letters. Every row is a query of its own list."""
    rows, width = letters.shape
    q, v = [], []
    common = np.minimum.accumulate(letters[1:] == letters[:-1], axis=1).sum(1) if rows > 1 else np.zeros(0, np.int64)
    common = np.concatenate([[0], common])
    begins: dict[int, np.ndarray] = {}

    def beginnings(d: int) -> np.ndarray:
        """Rows where another beginning of d letters starts than in the row before."""
        if d not in begins:
            begins[d] = np.flatnonzero(common < d)
        return begins[d]

    edge = np.pad(letters, ((0, 0), (0, 2)))
    for some in range(0, rows, max(1, STATES >> 8)):
        query = np.arange(some, min(rows, some + max(1, STATES >> 8)))
        for d0 in np.unique(depth[query]):
            s = query[depth[query] == d0]
            lo, hi, d = first[s], last[s], int(d0)
            # cells of the band: edits from the range's first d letters to the query's first d - 1, d and d + 1
            band = np.tile(np.array([1 if d else 2, 0, 1], np.int8), (len(s), 1))
            while len(s):
                ended = length[lo] == d
                off = length[s] - d
                done = ended & (np.abs(off) <= 1)
                one = done.copy()
                one[done] = band[done, off[done] + 1] == 1
                q.append(s[one])
                v.append(lo[one])
                lo = lo + ended
                more = hi > lo
                s, lo, hi, band = s[more], lo[more], hi[more], band[more]
                if not len(s):
                    break
                # the ranges below: one for each letter that follows
                starts = beginnings(d + 1)
                a = np.searchsorted(starts, lo, "right")
                n = np.searchsorted(starts, hi) - a + 1
                at, k = spread(n)
                place = a[at] + k
                s, below, above, old = s[at], np.where(k == 0, lo[at], starts[place - 1]), np.where(k == n[at] - 1, hi[at], starts[np.minimum(place, len(starts) - 1)]), band[at]
                c = letters[below, d]
                new = np.empty_like(old)
                new[:, 0] = np.minimum(old[:, 1] + 1, old[:, 0] + (edge[s, d - 1] != c))  # at d = 0 that cell is 2
                new[:, 1] = np.minimum(np.minimum(old[:, 2], new[:, 0]) + 1, old[:, 1] + (edge[s, d] != c))
                new[:, 2] = np.minimum(new[:, 1] + 1, old[:, 2] + (edge[s, d + 1] != c))
                live = new.min(1) <= 1
                s, lo, hi, band = s[live], below[live], above[live], np.minimum(new[live], 2)
                d += 1
                alone = hi - lo == 1  # a range of one word: the rest is compared at once
                if alone.any():
                    is_near = one_edit(edge, length, s[alone], lo[alone])
                    q.append(s[alone][is_near])
                    v.append(lo[alone][is_near])
                    s, lo, hi, band = s[~alone], lo[~alone], hi[~alone], band[~alone]
    return np.concatenate(q), np.concatenate(v)


def one_edit(edge: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words of rows a and b are one edit apart."""
    out = np.zeros(len(a), bool)
    step = max(1, (1 << 24) // edge.shape[1])
    for i in range(0, len(a), step):
        x, y = a[i : i + step], b[i : i + step]
        swap = length[x] < length[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        gap = length[x] - length[y]
        u, w = edge[x], edge[y]
        same = u == w
        agree = np.minimum.accumulate(same, axis=1)
        # after the first difference: equal at the same places, or one place later in the longer word
        aligned = np.where((gap == 0)[:, None], same, np.concatenate([u[:, 1:] == w[:, :-1], np.ones((len(u), 1), bool)], 1))
        at = agree.sum(1)
        start = np.where(gap == 0, at + 1, at)
        rest = (aligned | (np.arange(u.shape[1]) < start[:, None])).all(1)
        out[i : i + step] = rest & (gap <= 1) & (at < length[x])
    return out


def near_of_block(block: pa.Table) -> pa.RecordBatch | None:
    """The near words of each word of complete, sorted groups: word, n_near and the one that counts most."""
    col = {name: np.asarray(block.column(name)) for name in ("longer", "front", "back", "bound", "n", "group")}
    words = [w.encode("latin-1") for w in block.column("word").to_pylist()]
    flip = col["back"] > col["front"]
    width = max(map(len, words))
    letters = matrix([w[::-1] if f else w for w, f in zip(words, flip.tolist(), strict=True)], width)
    length = np.array([len(w) for w in words])
    edges = np.flatnonzero(np.concatenate([[True], np.diff(col["group"]) != 0, [True]]))
    sizes = np.diff(edges)
    first, last = np.repeat(edges[:-1], sizes), np.repeat(edges[1:], sizes)
    a, b = near_in_lists(letters, length, first, last, np.maximum(col["front"], col["back"]))
    plain = matrix(words, width)
    agree = np.concatenate([np.minimum.accumulate(plain[a[i : i + (1 << 16)]] == plain[b[i : i + (1 << 16)]], axis=1).sum(1) for i in range(0, len(a), 1 << 16)]) if len(a) else np.zeros(0, np.int64)
    own = (np.maximum(length[a], length[b]) == col["longer"][a]) & (agree < col["bound"][a])
    a, b = a[own], b[own]
    if not len(a):
        return None
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(np.array(words, f"S{width}"), kind="stable")] = np.arange(len(words))
    order = np.lexsort([rank[b], -col["n"][b], a])
    a, b = a[order], b[order]
    heads = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    counts = np.diff(np.concatenate([heads, [len(a)]]))
    names = block.column("word").combine_chunks()
    return pa.RecordBatch.from_arrays([names.take(pa.array(a[heads])), pa.array(counts), pa.array(col["n"][b[heads]]), names.take(pa.array(b[heads]))], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """word, n_near (long) and best (less: the negative count, word) of every word of (word, n) with a word one edit apart."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows * int(np.asarray(batch.column("longer")).max(initial=0))
            if size >= BLOCK_BYTES:
                whole = pa.concat_tables(held).combine_chunks()
                change = np.flatnonzero(np.diff(np.asarray(whole.column("group"))) != 0)
                cut = int(change[-1]) + 1 if len(change) else 0
                yield from blocks(whole.slice(0, cut))
                held, size = [whole.slice(cut)], 0
        if held:
            yield from blocks(pa.concat_tables(held))

    def blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Runs of groups of about BLOCK_BYTES."""
        if not table.num_rows:
            return
        ends = np.flatnonzero(np.concatenate([np.diff(np.asarray(table.column("group"))) != 0, [True]])) + 1
        filled = np.cumsum(np.asarray(table.column("longer")).astype(np.int64))
        at = 0
        while at < table.num_rows:
            k = np.searchsorted(filled[ends - 1], (filled[at - 1] if at else 0) + BLOCK_BYTES, "right")
            end = int(ends[max(k - 1, np.searchsorted(ends, at, "right"))])
            if (out := near_of_block(table.slice(at, end - at))) is not None:
                yield out
            at = end

    spelled = F.when(turned(), F.reverse("word")).otherwise(F.col("word"))
    lists = dealt(words, group_bytes).withColumn("group", F.xxhash64(*GROUP)).repartition("group")
    lists = lists.sortWithinPartitions("longer", "front", "back", "group", "key", spelled).drop("key")
    some = lists.mapInArrow(local, "word string, n_near long, best_n long, best string")
    return some.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best"))


# --- forms and roots


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """word and root for each row of (word, form), where no chain has more than so many steps: each turn doubles what a
    pointer has come, up to the last word, which has no form."""
    now = forms.select("word", F.col("form").alias("root"))
    done = 1
    while done < steps:
        now = written(now, "roots")
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        done *= 2
    return now


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of the texts of docs (doc_id, text).

    Words are those of vocabulary(). A word's form is the near word that occurs most (ties: the first by code points) if that
    is at least factor times as often; its root is where the forms lead. Null texts have no words; a repeated row counts
    again; empty tables have no words; other columns are ignored."""
    if factor < 2:
        raise ValueError("factor must be 2 or more, so that forms cannot go in a circle")
    words = written(vocabulary(docs, least_length, least_count), "vocabulary")
    most = words.agg(F.max("n")).first()[0] or 0
    best = near_words(words, group_bytes)
    has_form = -F.col("best.less") >= factor * F.col("n")
    met = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("best.word")).alias("form"), F.when(has_form, -F.col("best.less")).alias("form_n"))
    met = written(met, "forms")
    steps = int(math.log(max(1, most / max(1, least_count)), factor)) + 1
    root = roots(met.filter("form is not null"), steps)
    out = met.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    forget(docs.sparkSession, words)
    return out
