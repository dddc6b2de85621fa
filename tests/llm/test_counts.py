"""Spelling variants and the filter audit on small tables, against plain loops."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from alertmill.llm import filteraudit, spelling

DOCS = "doc_id long, text string, word string, n int, key int, best int, front int, root int"
ODD = [(None, "a row without an id, commander"), (None, "a row without an id, commander"), (901, None), (902, ""), (903, " \n\t"), (904, "one"), (904, "one")]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4, 5) for i, t in rows], DOCS)


# --- 11: spelling variants


def one_apart(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def plain_words(rows):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 5}


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [v for v in words if one_apart(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def spelled_rows(rng, stems=12, documents=120):
    """Texts in which words have variants, some of which have variants of their own."""
    stems = ["".join(rng.choice("abcé÷") for _ in range(rng.randint(5, 9))) for _ in range(stems)]
    often = {}
    for s in stems:
        often[s] = 400
        for _ in range(8):
            k = rng.randrange(len(s))
            v = rng.choice([s[:k] + s[k + 1 :], s[:k] + rng.choice("abcÉ") + s[k:], s[:k] + rng.choice("abc") + s[k + 1 :]])
            often[v] = rng.choice([6, 30, 60])
            often[v[: len(v) // 2] + "b" + v[len(v) // 2 :]] = rng.choice([5, 7])
    words = [w if rng.random() < 0.8 else w.upper() if w.isascii() else w.capitalize() for w, n in often.items() for _ in range(n)]
    rng.shuffle(words)
    step = len(words) // documents
    return [(i, rng.choice([" ", ", ", "\n", "一", "-"]).join(words[k : k + step])) for i, k in enumerate(range(0, len(words), step))]


@pytest.mark.parametrize("group_bytes", [spelling.GROUP_BYTES, 60])
def test_variants_are_those_of_plain_loops(spark, group_bytes):
    rows = [*spelled_rows(random.Random(3)), *ODD, (7, "commander " * 40_000), (8, "x" * 300_000)]
    got = sorted(map(tuple, spelling.variants(documents(spark, rows), group_bytes=group_bytes).collect()))
    want = plain_variants(rows)
    assert got == want
    assert any(f and r != f for _, f, r, *_ in got) and any(not n for *_, n, _ in got)


def test_words_lose_a_letter_by_their_hash():
    rows = [(i, "commander Commander COMMANDER Éléphant 一éléphants") for i in range(600)]
    total = Counter()
    for i, t in rows:
        total.update(spelling.words_in(i, t))
    assert {w.decode("latin-1"): n for w, n in total.items() if n >= 5} == plain_words(rows) and len(total) > 5


def test_near_in_lists_is_brute_force():
    rng = random.Random(1)
    for _ in range(20):
        words = sorted({"".join(rng.choice("abéc"[: rng.choice([2, 3, 4])]) for _ in range(rng.randint(6, 12))) for _ in range(150)})
        letters = spelling.matrix([w.encode("latin-1") for w in words], 12)
        m = len(words)
        a, b = spelling.near_in_lists(letters, np.array([len(w) for w in words]), np.zeros(m, int), np.full(m, m), np.zeros(m, int))
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(i, j) for i in range(m) for j in range(m) if one_apart(words[i], words[j])]


def test_long_words_and_no_words(spark):
    long = ["b" * 30_000 + c for c in "acde"]
    rows = [(i, " ".join(long)) for i in range(6)]
    got = sorted(map(tuple, spelling.variants(documents(spark, rows)).collect()))
    assert got == plain_variants(rows) and all(n == 3 for *_, n, _ in got)
    assert spelling.variants(documents(spark, [])).count() == 0
    assert spelling.variants(documents(spark, ODD)).count() == 0


# --- 13: the filter audit


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and least[t] < i,
        }
        parts[lang or ""].append((fails, i in good, i in toxic))
    out = []
    for part, members in parts.items():
        steps = {}
        for order in map("".join, permutations("ABCDE")):
            left = members
            for k, x in enumerate(order):
                removed = [m for m in left if m[0][x]]
                left = [m for m in left if not m[0][x]]
                redundant = sum(m[0][x] for m in members) - len(removed)
                unique = sum(m[0][x] and sum(m[0].values()) == 1 for m in members)
                steps[order, k + 1] = (len(left), len(removed), redundant, unique, sum(m[1] for m in removed), sum(m[2] for m in removed))
        for (order, k), counts in steps.items():
            shapley = sum(c[1] for (o, j), c in steps.items() if o[j - 1] == order[k - 1])
            out.append((part, order, k, *counts, shapley))
    return sorted(out)


def test_audit_is_that_of_plain_loops(spark):
    rng = random.Random(5)
    kinds = [" ".join(f"w{rng.randrange(k)}" for _ in range(n)) for k, n in ((50, 40), (9, 300), (4000, 300), (4000, 210))]
    kinds += [kinds[2] + " $", kinds[1] + " #", kinds[3].upper(), "A" * 30, None, "", " \t", "É" * 50, "x y " * 230, "a b " * 90_000]
    rows = [(rng.choice([None, *range(60)]), rng.choice(kinds), rng.choice(["en", "fr", None, ""])) for _ in range(150)]
    rows += [(3, kinds[0], "en"), (3, kinds[0], "en"), (1000, "alone", "new")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(40), 5, 5, 9, None]]
    docs = spark.createDataFrame([(i, t, p, 0, 1, True, 2) for i, t, p in rows], "doc_id long, text string, lang string, n int, mask int, good boolean, part int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, filteraudit.audit(docs, known).collect())) == plain_audit(rows, labels)
    assert filteraudit.audit(docs.limit(0), known).count() == 0
    assert sum(r["n"] for r in filteraudit.kinds(docs, known.limit(0)).collect()) == len(rows)


def test_fields_do_not_run_over():
    n = (1 << 63) - 1
    total = n * filteraudit.packed(31, True, True)
    steps = filteraudit.unpacked(total)
    assert steps[0] == (0, n, 0, 0, n, n) and steps[1] == (0, 0, n, 0, 0, 0) and len(steps) == 600


def test_lines_are_split_into_tokens_once_for_their_paths(spark, monkeypatch):
    from alertmill.llm import linededup

    plans, written = {}, linededup.written
    monkeypatch.setattr(linededup, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and written(df, name))
    docs = spark.createDataFrame([(i, f"same line of text here\nown {i}") for i in range(9)], "doc_id long, text string")
    assert sum(r["n_dropped"] for r in linededup.without_lines(docs).collect()) == 8
    assert "split(" in plans["paths"] and "split(" not in plans["leaves"]
