"""The operators on small tables, against brute force, with the odd rows that each must bear."""

import base64
import hashlib
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alertmill.llm import ann, chat, decontam, linededup, neardup, packing, pii, quality, suffixes, warc
from alertmill.llm.common import components
from alertmill.llm.queries import word_tokenizer_path

DOCS = "doc_id long, text string, k1 int, n int, place int, row int, key int, leaf int"


def documents(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6) for i, t in rows], DOCS)


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [(None, "a row without an id"), (901, None), (902, ""), (903, " \n\t"), (904, "one"), (904, "one")]


# --- 1: personal data


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(list("a@.-_ +()01235\n") + ["é", "1.2.3.4", "a@b.co", "4111111111111111", "+1 (974) 555-3436", "://"]), max_size=40).map("".join))
def test_base_spans_are_the_regular_expressions(text):
    assert [s for s in pii.spans(text) if s[0] in pii.BASE] == base_spans(text)


def test_pii_added_spans_and_digest(spark):
    text = 'mail é a.b@c.de token = "04dbebab91ab85687d33" http://u:p@h.com/x iban DE89 3704 0044 0532 0130 00'
    kinds = Counter(k for k, _, _ in pii.spans(text))
    assert kinds["account"] == 2 and kinds["url"] == 1 and kinds["email"] >= 1
    assert "a.b@c.de" not in pii.mask(text, pii.spans(text))
    rows = [(1, text), (2, "1." * 50_000), *ODD]
    got = {(r["doc_id"], r["base_sha256"]): r for r in pii.digest(pii.find_pii(documents(spark, rows))).collect()}
    for i, t in rows:
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(t or ""))
        assert got[i, hashlib.sha256(joined.encode()).hexdigest()]["n_email"] == sum(s[0] == "email" for s in base_spans(t or ""))
    assert pii.digest(pii.find_pii(documents(spark, []))).count() == 0


# --- 2: near-duplicates


def test_near_duplicates_are_the_components_of_exact_links(spark):
    rng = random.Random(4)
    rows = []
    for g in range(25):
        words = prose(rng, rng.randint(30, 120)).split()
        for _ in range(rng.randint(1, 6)):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(800, rows[0][1]), (0, rows[0][1]), *ODD]
    docs = documents(spark, rows)
    idf = neardup.frequencies(docs)
    vectors = {}
    for i, _, own in neardup.text_shingles(pa.array([t for _, t in rows])):
        vectors[i] = neardup.weights(own, idf)
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            (h, w), (g, v) = vectors[a], vectors[b]
            if not len(h) or not len(g):
                same = not len(h) and not len(g)
            else:
                _, i, j = np.intersect1d(h, g, return_indices=True)
                c = np.minimum(w[i], v[j]).sum()
                same = c / (w.sum() + v.sum() - c) >= neardup.SIMILARITY
            if same:
                parent[find(a)] = find(b)
    want = defaultdict(set)
    for i, (d, t) in enumerate(rows):
        want[find(i)].add((d, t))
    found = neardup.classes(docs).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r["class_id"] for r in found}
    for group in want.values():
        ids = {d for d, _ in group}
        assert len({by_id[d] for d in ids}) == 1
        assert by_id[next(iter(ids))] == min((d for d in ids if d is not None), default=None)
    assert len({by_id[next(iter(g))[0]] for g in want.values()}) == len(want)
    kept = neardup.distinct_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)
    assert neardup.classes(documents(spark, [])).count() == 0


def test_different_texts_without_an_id_or_with_one_id_all_stay(spark):
    rng = random.Random(14)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    docs = documents(spark, [(None, a), (None, b), (5, c), (5, d), (None, c), (7, d), (None, a)])
    assert len({r["root"] for r in neardup.classes(docs).collect()}) == 4
    kept = Counter((r["doc_id"], r["text"]) for r in neardup.distinct_documents(docs).collect())
    assert kept == Counter([(None, a), (None, b), (5, c), (5, d)])


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40) if k != 20] + [(50, 60), (60, 50), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert {got[k] for k in range(21)} == {0} and {got[k] for k in range(21, 41)} == {21} and got[60] == 50


# --- 3: packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_bins_hold_everything_once(lengths):
    bins = packing.best_two_fit(lengths, 40)
    assert sorted(k for b in bins for k in b) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in b) <= 40 for b in bins)
    assert len(bins) <= max(2 * -(-sum(lengths) // 40), 1)


def test_pair_replaces_the_smallest():
    # 6 alone leaves a gap of 4 that 3 fills to 9; 2 + 2 in its stead fill it to 10
    lengths = [6, 3, 2, 2]
    assert sorted(sorted(lengths[k] for k in b) for b in packing.best_two_fit(lengths, 10)) == [[2, 2, 6], [3]]


def test_pack_is_an_exact_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = ["Hello, wörld! It's <|endoftext|> ÉÇ", "x\x1cy z　q", "İstanbul Σίσυφος ﬁ é", "don't you'll", "日本語" * 500, prose(rng, 9000), "a" * 5000]
    rows = [*enumerate(texts), *((20 + k, prose(rng, rng.randint(1, 900))) for k in range(30)), *ODD, (5, texts[5])]
    got = packing.pack(documents(spark, rows), word_tokenizer_path(), group_items=10).collect()
    exact = Tokenizer.from_file(word_tokenizer_path())
    want = Counter()
    import zlib

    for d, t in rows:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[d, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(documents(spark, []), word_tokenizer_path()).count() == 0


# --- 4: nearest neighbours


def test_nearest_with_odd_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((300, 16)).astype(np.float32)
    rows = [(k, v[k].tolist(), 1) for k in range(300)] + [(1000 + k, v[7].tolist(), 1) for k in range(40)]
    rows += [(2000, None, 1), (2050, [0.0] * 16, 1), (2100, [float("nan")] + [1.0] * 15, 1), (2150, [None] + [1.0] * 15, 1), (None, v[0].tolist(), 1), (2200, [1.0], 1), (7, v[7].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = defaultdict(dict)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    ids = np.array([k for k in range(300)] + [1000 + k for k in range(40)])
    x = np.vstack([v, np.repeat(v[7:8], 40, 0)]).astype(np.float64)
    n = np.linalg.norm(x, axis=1)
    hits = 0
    for q in range(len(ids)):
        if ids[q] % 50:
            continue
        s = np.round(x @ x[q] / n / n[q], 12)
        order = [k for k in np.lexsort((ids, -s)) if k != q][:5]
        assert sorted(got[ids[q]]) == [1, 2, 3, 4, 5]
        hits += sum(int(ids[k]) in {a for a, _ in got[ids[q]].values()} for k in order)
        for a, score in got[ids[q]].values():
            assert score == pytest.approx(float(s[list(ids).index(a)]), abs=1e-9)
    assert hits >= 0.9 * 5 * sum(i % 50 == 0 for i in ids)
    assert [got[1000][r][0] for r in range(1, 6)] == [7, 1001, 1002, 1003, 1004]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def brute_nearest(vectors, query, k=5):
    """The k nearest by exact cosine, ties to the smaller id."""
    q = vectors[query]
    scores = [(float(ann.exact(q[None], v[None])[0]), i) for i, v in vectors.items() if i != query and len(v) == len(q)]
    return [(i, s) for s, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]]


def test_ties_precision_and_lengths_of_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(8)
    vectors = {i: base * 2.0**i for i in range(60)}
    vectors |= {100 + i: base + 1e-12 * rng.standard_normal(8) for i in range(3)} | {200: base * 1e300, 201: rng.standard_normal(8) * 1e-300}
    vectors |= {300 + i: rng.standard_normal(3) for i in range(8)} | {350: np.array([1.0])}
    rows = [(i, v.tolist()) for i, v in vectors.items()] + [(400, []), (401, None), (402, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {q: brute_nearest(vectors, q) for q in vectors if q % 50 == 0 and len(vectors[q]) > 1}


def test_recall_where_the_window_is_a_small_part(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((150, 24))
    vectors = {i: centres[i % 150] + 0.25 * rng.standard_normal(24) for i in range(6000)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    out = ann.nearest(df, F.col("vec_id") % 50 == 0, window_share=0.0, least_window=60)  # 2 % of the rows on a curve
    got = Counter((r["query_id"], r["vec_id"]) for r in out.collect())
    assert max(got.values()) == 1 and len(got) == 120 * 5
    matrix = np.stack(list(vectors.values()))
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    score = unit[::50] @ unit.T
    score[np.arange(120), np.arange(0, 6000, 50)] = -2
    want = {(50 * q, int(i)) for q in range(120) for i in np.argsort(-score[q])[:5]}
    assert len(want & set(got)) / len(want) >= 0.9


def test_hilbert_neighbours_touch():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    place = ann.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


# --- 5: chat


def test_rotation_against_plain_python(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>yo"), (1, 2, "critic x", None), (1, 2, "critic x", None), (2, 0, None, "é"), (2, None, " ", "first"), (None, 0, "user", "lost"), (3, 5, "a", "x" * 5000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, position int")
    got = chat.rotate(df).collect()
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, (role or "").strip(" ") or "unknown", (text or "").replace("<|", "< |")))
    want = Counter()
    for c, each in by.items():
        for p in {s for _, _, s, _ in each}:
            at = 0
            for k, (_, _, s, text) in enumerate(sorted(each)):
                head = "<|im_start|>assistant\n" if s == p else f"<|im_start|>user name={re.sub('[^A-Za-z0-9_.-]', '_', s)}\n"
                full = f"{head}{text}<|im_end|>\n"
                want[c, p, k, full, at, at + len(full), at + len(head) if s == p else at, at + len(full) - 1 if s == p else at] += 1
                at += len(full)
    assert Counter((r["conv_id"], r["perspective"], r["position"], r["rendered"], r["start"], r["end"], r["mask_start"], r["mask_end"]) for r in got) == want
    assert chat.rotate(df.limit(0)).count() == 0


# --- 6: decontamination


def test_tiles_catch_reordered_passages(spark):
    rng = random.Random(9)
    item = prose(rng, 40).split()
    rows = [(1, " ".join(["a", *item, "b"])), (2, " ".join([*item[20:], "mid", *item[:20]])), (3, " ".join(item[:8]) + " other"), (4, "Xx " + ", ".join(w.upper() for w in item)), (5, " ".join(item) + " " + prose(rng, 20_000)), *ODD]
    bench = spark.createDataFrame([(7, " ".join(item), 1), (7, " ".join(item), 2), (8, "too short", 3), (9, None, 4)], "item_id long, text string, doc_id int")
    docs = documents(spark, rows)
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(docs, bench, block_bytes=50).collect()}
    assert set(got) == {(1, 7), (2, 7), (4, 7), (5, 7)} and got[2, 7]["tiles"] == 2 and got[2, 7]["coverage"] == 1
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 3, 901, 902, 903, 904, 904]
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.decontaminate(documents(spark, []), bench).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.lists(st.integers(0, 2), max_size=30))
def test_tiles_are_disjoint_common_runs_and_longest_first(doc, item):
    hits = [(d, i) for d in range(len(doc) - 2) for i in range(len(item) - 2) if doc[d : d + 3] == item[i : i + 3]]
    found = decontam.tiles(hits, 3)
    assert all(doc[d : d + n] == item[i : i + n] and n >= 3 for d, i, n in found)
    assert all(len(s) == len(set(s)) for s in ([d + k for d, _, n in found for k in range(n)], [i + k for _, i, n in found for k in range(n)]))
    # greedy tiling by the book
    taken_d, taken_i, book = set(), set(), 0
    while True:
        best = 0
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in taken_d and i + n not in taken_i:
                    n += 1
                best = max(best, n)
        if best < 3:
            break
        book = max(book, best)
        break
    assert max((n for *_, n in found), default=0) == book


def tiled(doc, item, least=decontam.WORDS):
    """Greedy string tiling by the book: again and again the longest run of equal words that are all unmarked."""
    in_doc, in_item, out = set(), set(), []
    while True:
        longest = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in in_doc and i + n not in in_item:
                    n += 1
                longest = max(longest, (n, -d, -i))
        n, d, i = longest[0], -longest[1], -longest[2]
        if n < least:
            return out
        out.append((d, i, n))
        in_doc.update(range(d, d + n))
        in_item.update(range(i, i + n))


def test_whole_tilings_and_leaks_are_those_of_the_book(spark):
    rng = random.Random(12)
    items = [(k, [f"v{rng.randrange(9)}" for _ in range(rng.randrange(3, 40))]) for k in range(12)]
    rows = []
    for k in range(60):
        words = [f"v{rng.randrange(9)}" for _ in range(rng.randrange(0, 12))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1]
            cut = rng.randrange(len(w))
            words += w[cut:] + w[:cut]
        rows.append((k, " ".join(words).replace("v1 ", "V1, ")))
    rows += [(99, "v2 " * 3000), *ODD]
    bench = spark.createDataFrame([(k, " ".join(w), 1) for k, w in items] + [(50, None, 1), (51, "", 1), (0, " ".join(items[0][1]), 1)], "item_id long, text string, row int")
    want = set()
    for doc_id, text in rows:
        doc = re.findall(r"[^\s,]+", (text or "").lower())
        for k, w in items:
            n = sum(t[2] for t in tiled(doc[:80], w))  # one long text repeats one word: 80 of them say it all
            if n >= decontam.COVERAGE * len(w) and n:
                want.add((doc_id, k, n))
    got = decontam.leaks(documents(spark, rows), bench).collect()
    assert {(r["doc_id"], r["item_id"], r["covered_words"]) for r in got} == want and len(got) > 20
    kept = {r["doc_id"] for r in decontam.decontaminate(documents(spark, rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {r["doc_id"] for r in got}


def word_row(words):
    return np.array([hash_of_word(w) for w in words], np.uint64)


def hash_of_word(w):
    return int.from_bytes(hashlib.sha256(str(w).encode()).digest()[:8], "little")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=45), st.lists(st.integers(0, 2), max_size=30), st.integers(2, 5))
def test_both_ways_to_tiles_are_the_book(doc, item, least):
    book = tiled(doc, item, least)
    hits = [(d, i) for d in range(len(doc) - least + 1) for i in range(len(item) - least + 1) if doc[d : d + least] == item[i : i + least]]
    assert decontam.tiles(hits, least) == book
    assert decontam.tiles_of_words(word_row(doc), word_row(item), least) == book


def test_texts_of_one_word_are_tiled_without_their_pairs():
    items = decontam.Items([1, 2], ["na " * 5000, "na na na na na hey " * 800])
    began = time.monotonic()
    tracemalloc.start()
    got = {(row, item): (covered, n) for row, item, covered, n in items.matches(pa.array(["na " * 20_000, "na na na na na hey " * 4000, "hey " * 9000]))}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == {(0, 0): (5000, 1), (0, 1): (4000, 800), (1, 0): (5000, 1000), (1, 1): (4800, 1)}
    assert peak < 200e6 and time.monotonic() - began < 30


# --- 7: repeated passages


def kept_by_brute_force(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + 400] for d in data for p in range(len(d) - 399))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - 399):
            if seen[d[p : p + 400]] > 1:
                gone[p : p + 400] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_repeats_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh \n") for _ in range(2500)) for _ in range(3)] + ["ab" * 700, "a" * 900, "é" * 500]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            s = rng.randrange(len(b))
            parts += [b[s : s + rng.choice([100, 380, 399, 400, 401, 405, 420, 450, 700, 1500])], "".join(rng.choice("xyz") for _ in range(rng.randint(0, 200)))]
        rows.append((i, "".join(parts)))
    rows += [(7, rows[7][1]), (None, base[0]), *ODD]
    got = suffixes.digest(suffixes.repeats(documents(spark, rows))).collect()
    want = Counter((d, *v) for (d, _), v in zip(rows, kept_by_brute_force([t for _, t in rows]), strict=True))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert suffixes.digest(suffixes.repeats(documents(spark, []))).count() == 0


# --- 8: lines


def test_recurring_templates_go_but_for_their_first_document(spark):
    rng = random.Random(2)
    rows = []
    for k in range(12):
        own = prose(rng, 12)
        rows.append((k, f"{own}\nPosted by user{rng.randrange(99)} on the main page today\n\nEnd of text {k}\n{own} again"))
    rows += [(50, "Quite another line\nPosted by noon"), *ODD]
    docs = documents(spark, rows)
    out = {(r["row"]["doc_id"], r["row"]["text"]): r for r in linededup.without_lines(docs).collect()}
    assert len(out) == len({(d, t) for d, t in rows})
    first = out[0, rows[0][1]]
    assert first["text"] == rows[0][1] and first["n_dropped"] == 0
    for d, t in rows[1:12]:
        r = out[d, t]
        assert r["n_dropped"] == 2 and "Posted" not in r["text"] and "End of" not in r["text"] and t.split("\n")[0] in r["text"]
    assert out[50, rows[12][1]]["n_dropped"] == 0 and out[901, None]["text"] is None
    kept = linededup.replaced(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert linededup.digest(linededup.without_lines(documents(spark, []))).count() == 0


def kept_lines(spark, rows):
    return {r["row"]["doc_id"]: r["text"].split("\n") for r in linededup.without_lines(documents(spark, rows)).collect()}


def test_a_leaf_holds_several_templates(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choices(letters, k=9))
    lead = "All rights reserved "
    texts = [lead + " ".join(word() for _ in range(7)) for _ in range(3)]  # a third each
    fields = lead + "%s by the %s of old towns"
    rows = [(k, f"{word()} {word()}\n{texts[k % 3]}") for k in range(60)]
    rows += [(100 + k, fields % (word(), word())) for k in range(20)]
    rows += [(200 + k, "Copies of this " + " ".join(word() for _ in range(6))) for k in range(30)]
    verbatim = "Copies of this text are sold at every station"
    rows += [(300 + k, verbatim) for k in range(20)]
    # one document with most of the lines of a leaf
    rows += [(400, "\n".join(f"Items of trade {word()} in the lower harbour" for _ in range(50)))]
    rows += [(401 + k, "Items of trade wool from a northern village") for k in range(9)]
    out = kept_lines(spark, rows)
    for k in range(60):
        assert (texts[k % 3] in out[k]) == (k < 3) and rows[k][1].split("\n")[0] in out[k]
    assert [out[100 + k] != [""] for k in range(20)] == [True] + [False] * 19
    assert all(out[200 + k] == [rows[80 + k][1]] for k in range(30))
    assert [out[300 + k] == [verbatim] for k in range(20)] == [True] + [False] * 19
    assert len(out[400]) == 50 and [out[401 + k] != [""] for k in range(9)] == [True] + [False] * 8


def plain_tree(rows, depth=3, documents=8, agreement=0.5, match=0.6):
    """The kept lines of each document by loops over leaves, templates and lines, as the module's text tells it."""
    masked = lambda ts: tuple("<*>" if re.search("[0-9]", t) else t for t in ts)
    leaves = defaultdict(list)
    for d, (_, text) in enumerate(rows):
        for place, line in enumerate(text.split("\n")):
            if line.strip(" "):
                ts = tuple(re.split("[ \t\r]+", line.strip(" \t\r")))
                leaves[len(ts), masked(ts[:depth])].append((d, place, ts))
    gone = set()
    for own in leaves.values():
        size = len({d for d, _, _ in own})
        if size < documents:
            continue
        have = defaultdict(set)
        for d, _, ts in own:
            for at, t in enumerate(ts):
                have[at, t].add(d)
        count = {k: len(v) for k, v in have.items()}
        n = len(own[0][2])
        main = {}
        for at in range(n):
            c, t = max((c, t) for (a, t), c in count.items() if a == at)
            if c >= agreement * size:
                main[at] = t
        enough = lambda places: len(places) >= match * n and sum(p >= depth for p in places) >= match * (n - depth)
        offers = {}
        for ts in {ts for _, _, ts in own}:
            out = []
            if enough([at for at in range(n) if main.get(at) == ts[at]]):
                out.append("main")
            if sum(not re.search("[0-9]", t) for t in ts) >= match * n:
                out.append(masked(ts))
            chain = sorted((-count[at, t], at, t) for at, t in enumerate(ts) if count[at, t] >= documents)
            for i in range(1, len(chain) + 1):
                if (i == len(chain) or chain[i][0] != chain[i - 1][0]) and enough([at for _, at, _ in chain[:i]]):
                    out.append(("chain", *chain[:i]))
            offers[ts] = out
        recurs = defaultdict(set)
        for d, _, ts in own:
            for o in offers[ts]:
                recurs[o].add(d)
        fits = defaultdict(list)
        for d, place, ts in own:
            best = next((o for o in offers[ts] if len(recurs[o]) >= documents), None)
            if best is not None:
                fits[best].append((d, place))
        for lines in fits.values():
            first = min((d for d, _ in lines), key=lambda d: (rows[d][0] is None, rows[d][0] or 0))
            gone |= {x for x in lines if x[0] != first}
    return {i: [line for place, line in enumerate(text.split("\n")) if (d, place) not in gone] for d, (i, text) in enumerate(rows)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tree_against_plain_loops(spark, seed):
    rng = random.Random(seed)
    few = lambda k: rng.choice("abcdefgh"[:k])
    makers = [
        lambda: f"Posted by {few(8)} on day {rng.randrange(30)} at noon",
        lambda: f"Posted by {few(2)} in the {few(3)} {few(8)} room",
        lambda: " ".join(few(3) for _ in range(rng.randrange(1, 8))),
        lambda: f"one two three {few(2)} {few(2)} {few(8)} {few(8)}",
        lambda: f"  share this page\t{few(2)} {rng.randrange(3)}  ",
        lambda: rng.choice(["", "  ", "\t"]),
    ]
    rows = [(i if i else None, "\n".join(rng.choice(makers)() for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    want = plain_tree(rows)
    assert kept_lines(spark, rows) == {i: kept or [""] for i, kept in want.items()}
    dropped = sum(len(t.split("\n")) for _, t in rows) - sum(map(len, want.values()))
    assert 50 < dropped < sum(len(t.split("\n")) for _, t in rows) - 50


def test_short_lines_with_a_common_opening_stay(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    rows = [(k, f"I want to {word()} {word()}\nSo we will {word()}") for k in range(20)]
    rows += [(100 + k, f"I want to go home\nPage {k} of this book") for k in range(9)]
    out = kept_lines(spark, rows)
    assert all(out[k] == rows[k][1].split("\n") for k in range(20))
    assert out[100] == rows[20][1].split("\n") and all(out[100 + k] == [""] for k in range(1, 9))


# --- 9: quality


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(8)
    good = [" ".join(rng.choice(["the", "of", "and", "to", "in", "that"]) if rng.random() < 0.5 else f"w{rng.randrange(300)}" for _ in range(150)) for _ in range(400)]
    bad = [" ".join(("scum" if rng.random() < 0.1 else w) for w in t.split()) for t in good[:60]] + [" ".join(w + "###" for w in t.split()) for t in good[60:120]]
    rows = [*enumerate(good + bad), *ODD]
    labels = spark.createDataFrame([(i, int(i < 460), int(400 <= i < 460), "x") for i in range(0, 520, 2)] + [(0, 1, 0, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    docs = documents(spark, rows)
    s = quality.Settings(word_buckets=1 << 14, form_buckets=1 << 14)
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs, labels, s).collect()}
    held_out = [i for i in range(1, 520, 2)]
    assert np.mean([got[i] for i in held_out if i < 400]) > 0.9
    assert np.mean([got[i] for i in held_out if i >= 400]) < 0.15
    kept = quality.resample(docs, labels, s)
    assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for r in quality.classify(docs, labels, s).collect())
    assert quality.classify(documents(spark, []), labels, s).count() == 0
    assert quality.classify(docs, labels.limit(0), s).filter("keep").count() == len(rows)


def test_sample_is_that_of_a_brute_force_sampler(spark):
    rng = random.Random(18)
    rows = [(i, prose(rng, rng.randrange(1, 60), 80) + (" scum." * rng.randrange(3) if i % 4 == 0 else "")) for i in range(200)] + ODD
    rows += [(300, prose(rng, 60_000, 90)), (7, rows[7][1])]
    labels = [(i, int(i % 5 > 0), int(i % 4 == 0)) for i in range(0, 200, 2)]
    docs = documents(spark, rows)
    s = quality.Settings(word_buckets=1 << 12, form_buckets=1 << 11, sample_share=0.4, label_rows=30, weight_tokens=20)
    of_labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    target = {r["doc_id"] for r in quality.target_rows(of_labels, s).collect()}
    assert len(target) == 30 and target <= {i for i, q, t in labels if q and not t}
    found = []
    for _, text in rows:
        own = Counter(), Counter()
        for _, _, w, _, f, _ in quality.features(pa.array([text], pa.string()), s):
            own[0].update(w.tolist())
            own[1].update(f.tolist())
        found.append(own)
    weight = np.zeros(len(rows))
    for k, (size, chance) in enumerate(((s.word_buckets, s.word_chance), (2 * s.form_buckets, s.form_chance))):
        raw, good = Counter(), Counter()
        for (doc_id, _), own in zip(rows, found, strict=True):
            raw.update(own[k])
            good.update(own[k] if doc_id in target else {})
        n, total, ratio = sum(good.values()), sum(raw.values()), {}
        for b, r in raw.items():
            q = (r + 1) / (total + size)
            far = abs(good[b] - n * q) > chance * (n * q + 1) ** 0.5
            ratio[b] = np.log((good[b] + (s.prior * n + 1) * q) / (n + s.prior * n + 1) / q) if far else 0
        for i, own in enumerate(found):
            weight[i] += s.weight_tokens * sum(ratio[b] * m for b, m in own[k].items()) / max(1, sum(own[k].values()))
    got = quality.classify(docs, of_labels, s).collect()
    noise = [r["key"] - r["log_weight"] for r in got]
    assert abs(np.mean(noise) - 0.5772) < 0.3 and 0.9 < np.std(noise) < 1.7
    assert np.allclose(sorted(r["log_weight"] for r in got), sorted(weight), atol=1e-3)
    least = sorted((r["key"] for r in got), reverse=True)[int(np.ceil(0.4 * len(rows))) - 1]
    assert all(r["keep"] == (r["key"] >= least) for r in got)
    by_weight = sorted((r["log_weight"] for r in got), reverse=True)[int(np.ceil(0.4 * len(rows))) - 1]
    assert any(r["keep"] != (r["log_weight"] >= by_weight) for r in got)  # the noise takes part


def test_threshold_is_the_kth_key(spark):
    rng = random.Random(3)
    keys = [rng.gauss(0, 1) for _ in range(3000)] + [0.5] * 40
    df = spark.createDataFrame([(k,) for k in keys], "key double")
    for k in (1, 700, 1100, 3040):
        assert quality.threshold(df, k) == sorted(keys, reverse=True)[k - 1]


# --- 10: WARC


def test_archives_round_trip(spark):
    big = "x" * 17_000_000
    rows = [(1, "u", "<p>é</p>"), (2, None, "<p>é</p>"), (-3, "a\r\nb", "<p>é</p>"), (4, "u", None), (5, "u", ""), (6, "u", "\r\n\r\nWARC/1.1\r\n\x00\x1f"), (7, "u", big), (8, "u", big), (9, "u", "y"), (9, "u", "y"), (None, "u", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h in rows:
        p, f = (h or "").encode(), first.get(h or "")
        want[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if f in (None, i) else "revisit", None if f in (None, i) else f] += 1
    assert Counter(tuple(r) for r in warc.round_trip(df).collect()) == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_salvage_goes_on_after_damage(tmp_path, spark):
    records = [warc.record(k, "u", b"<p>%d</p>" % k * 40, "D", None, False) for k in range(6)]
    for packed in (True, False):
        parts = [warc.member(r) if packed else r for r in records]
        whole = b"".join(parts)
        assert len(warc.salvage(whole).records) == 6 and not warc.salvage(whole).gaps
        begin, end = len(parts[0]), len(parts[0] + parts[1])
        bad = bytearray(whole)
        bad[(begin + end) // 2] ^= 0x55
        found = warc.salvage(bytes(bad))
        assert len(found.records) == 5 and [(a, b) for a, b, _ in found.gaps] == [(begin, end)]
        found = warc.salvage(b"junk" + whole[:-7])
        assert len(found.records) == 5 and [(a, b) for a, b, _ in found.gaps] == [(0, 4), (4 + len(whole) - len(parts[5]), 4 + len(whole) - 7)]
    (tmp_path / "part-0").write_bytes(bytes(bad) + warc.member(records[0]))
    assert warc.read_archives(spark, str(tmp_path)).count() == 6
    assert [(r["begin"], r["end"]) for r in warc.quarantine(spark, str(tmp_path)).collect()] == [(begin, end)]


def test_repeats_in_a_text_longer_than_a_piece(spark):
    rng = np.random.default_rng(7)
    text = bytearray(rng.integers(97, 123, (1 << suffixes.PLACE_BITS) + 300_000, dtype=np.uint8).tobytes())
    far = len(text) - 40_000
    text[far - 1 : far + 1001] = b"#" + text[100_000:101_000] + b"#"
    across = (1 << suffixes.PLACE_BITS) - 600  # over the bound of the pieces
    text[across - 1 : across + 801] = b"#" + text[5_000:5_800] + b"#"
    got = suffixes.repeats(documents(spark, [(1, text.decode()), (2, "short")])).collect()
    cuts = {r["doc_id"]: r["removed"] for r in got}
    assert cuts == {1: [5_000, 5_800, 100_000, 101_000, across, across + 800, far, far + 1000], 2: []}


# --- the pipeline


def test_pipeline_bears_odd_rows_and_clashing_names(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    rows = [(i, prose(rng, 60, 300)) for i in range(60)] + [(100 + i, prose(rng, 5, 9) + "\nall rights are kept by the house") for i in range(12)]
    rows += [(200, rows[3][1]), (201, rows[3][1] + " end"), (5, rows[5][1]), (300, prose(rng, 30_000, 5000)), *ODD]
    item = prose(rng, 40, 300)
    rows += [(400, prose(rng, 20, 300) + " " + item)]
    root = str(tmp_path)
    documents(spark, rows).withColumn("n_chars", F.length("text")).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, root), "test")
        assert docs.columns == before.columns and [f.dataType for f in docs.schema] == [f.dataType for f in before.schema], name
        assert docs.count() <= before.count()
    ids = [r["doc_id"] for r in docs.collect()]
    assert 400 not in ids and 300 in ids and ids.count(5) == 1 and len({3, 200, 201} & set(ids)) == 1
    packed = corpus_pipeline.best_fit_packing(spark, docs, root).collect()
    assert sorted({r["doc_id"] for r in packed if r["doc_id"] is not None}) == sorted({i for i in ids if i is not None})
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, root).count() == 0, name
