"""Main text of pages: the reader of blocks, the field against brute force, and accuracy on pages it has not seen."""

import itertools
import random

import numpy as np
import pytest

from alertmill.llm import maintext
from alertmill.llm.maintext import blocks, extract, main_text


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks_are_the_runs_of_text_between_block_tags():
    page = """<!doctype html><html><head><title>no</title><style>p{a:"</p>"}</style></head><body>loose <b>bo</b>ld&amp;
      <script>var t="<p>no</p>";</script><p>one<br>two&nbsp;&#233;<p>three <!-- no <p>no</p> --> four<ul><li>a<li>b</ul>
      <table><tr><td>x<td>y</table><p title="a > b">5 < 6 &lt; 7<noscript>no</noscript><template><p>no</template></body>"""
    assert texts(page) == ["loose bold&", "one two é", "three four", "a", "b", "x", "y", "5 < 6 < 7"]
    found = blocks("<nav><p>a</nav><div><p>b</p>c</div>d")
    assert ["in:nav" in b.features for b in found] == [True, False, False, False] and found[1].features >= {"in:div", "is:p"}


@pytest.mark.parametrize("page, want", [(None, []), ("", []), ("<p>", []), ("plain", ["plain"]), ("a <", ["a <"]), ("<p>a<!-- open", ["a"]), ("<p>a<script>open", ["a"]), ('<p>a<b c="open>d</b>e', ["ade"]), ("</p></div>x<p", ["x"]), ("<head><title>t</title><p>a", ["a"])])
def test_odd_pages(page, want):
    assert texts(page) == want


def test_hostile_pages_take_time_in_proportion():
    for page in ("<div>" * 100_000 + "x", "<" * 300_000, '<a "' * 100_000, "<p>" * 100_000 + "</div>" * 100_000, "<!--" * 100_000, "<li>x" * 50_000, "<p>" + "word " * 400_000):
        blocks(page)
    assert texts("<div>" * 50_000 + "x" + "</div>" * 50_000 + "y") == ["x", "y"]


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(1, 8))
        model = maintext.Field({f"f{k}": float(rng.normal()) for k in range(5)}, float(rng.normal()), rng.normal(size=(2, 2)))
        found = [maintext.Block("x", {f"f{k}" for k in range(5) if rng.random() < 0.5}) for _ in range(n)]

        def score(y, found=found, model=model):
            each = [model.bias + sum(model.weights[f] for f in b.features) for b in found]
            return sum(s for s, l in zip(each, y, strict=True) if l) + sum(model.steps[a, b] for a, b in itertools.pairwise(y))

        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert score(model.labels(found)) == pytest.approx(score(best))


def test_likelihood_and_slopes_are_those_of_all_labellings():
    rng = np.random.default_rng(3)
    length, steps = np.array([4, 1, 3]), rng.normal(size=(2, 2))
    scores, labels = rng.normal(size=(3, 4)), rng.integers(0, 2, (3, 4))

    def plain(scores, steps):
        total = 0.0
        for i, n in enumerate(length):
            value = lambda y: sum(scores[i, t] * y[t] for t in range(n)) + sum(steps[a, b] for a, b in itertools.pairwise(y))  # noqa: E731, B023
            total += value(labels[i, :n]) - np.log(sum(np.exp(value(y)) for y in itertools.product((0, 1), repeat=n)))
        return total

    value, by_score, by_step = maintext.likelihood(scores, steps, labels, length)
    assert value == pytest.approx(plain(scores, steps))
    e = 1e-6
    for at in itertools.product(range(3), range(4)):
        bump = np.zeros_like(scores)
        bump[at] = e
        assert by_score[at] == pytest.approx((plain(scores + bump, steps) - plain(scores - bump, steps)) / 2 / e, abs=1e-5)
    for at in itertools.product(range(2), range(2)):
        bump = np.zeros_like(steps)
        bump[at] = e
        assert by_step[at] == pytest.approx((plain(scores, steps + bump) - plain(scores, steps - bump)) / 2 / e, abs=1e-5)


def test_pages_not_seen_before():
    """Other draws of the layouts: at least 98.5 % of the blocks."""
    model, right, n = maintext.default_field(), 0, 0
    for found, want in maintext.training_pages(200, seed=99):
        right += sum(a == b for a, b in zip(model.labels(found), want, strict=True))
        n += len(want)
    assert right / n > 0.985


# written by hand, not by the layouts; main text is in capitals
HAND = [
    """<body><div id="cookieBanner"><p>we use cookies</p><button>ok</button></div><header role=banner><a href=/>site</a><p>all the news</p></header>
    <nav aria-label=main><a href=/a>a</a> <a href=/b>b</a></nav><main><article><header><h1>A TITLE</h1></header><p>FIRST <i>PARA</i>GRAPH.
    <div class="ad-slot">buy this now.</div><p>SECOND &amp; LAST.<blockquote>SAID SOMEONE.</blockquote><aside class=related><h3>more</h3><ul><li><a href=x>other</a></ul></aside>
    <p>END.</article><section id=comments><h2>2 comments</h2><article><h4>ann</h4><p>nice one.</article><article><p>no.</article></section></main>
    <footer><p>&copy; all rights reserved</p></footer>""",
    """<table><tr><td class=leftmenu><a href=1>one</a><br><a href=2>two</a></td><td id=content><h2>HEAD</h2>TEXT IN A CELL, WITHOUT A PARAGRAPH.<ul><li>POINT<li>POINT TWO</ul>
    <form action=/s><label>search</label><input><button>go</button></form><p>AFTER THE FORM.</td></tr></table><div class="footer">imprint</div>""",
    """<div class=wrapper><div class="top-bar"><ul class=menu><li><a href=a>home</a><li><a href=b>about</a></ul></div><div class="post-content"><h1>IT IS SO</h1>
    <p>YES. IT IS.</p><div class="sponsored">our sponsor says hello.</div><div class="newsletter-signup"><h3>join</h3><p>get our mails.</p></div><p>AND SO ON.</p></div>
    <div class="sidebar"><h3>popular</h3><p>a story about something else.</p></div><ol class="comment-list"><li><p>great.</p><li><p>bad.</p></ol></div>""",
]


@pytest.mark.parametrize("page", HAND)
def test_pages_written_by_hand(page):
    want = " ".join(t for t in texts(page) if t.isupper())
    assert main_text(page, maintext.default_field()) == want


def test_extract_answers_every_row(spark):
    rows = [(1, "u", HAND[0], "x"), (1, "u", HAND[0], "x"), (2, None, None, "x"), (None, "v", "", "x"), (4, "w", "<nav>only</nav>", "x"), (5, "l", "<article>" + "<p>Some words here.</p>" * 30_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in extract(pages).collect()}
    assert extract(pages).count() == len(rows) and extract(pages.limit(0)).count() == 0
    assert extract(pages).columns == ["page_id", "url", "text", "n_chars"]
    assert got[1]["text"].startswith("A TITLE FIRST PARAGRAPH.") and got[2]["text"] == "" and got[None]["n_chars"] == 0
    assert got[5]["n_chars"] == len(got[5]["text"]) == 30_000 * 17 - 1


def test_other_pages_can_be_learnt():
    rng = random.Random(8)
    pages = []
    for _ in range(60):
        order = [1] * 4 + [0] * 3
        rng.shuffle(order)
        pages.append((blocks("".join(f"<h6>{rng.random()}</h6>" if y else "<p>text.</p>" for y in order)), order))
    model = maintext.fit(pages)
    assert main_text("<p>a.</p><h6>b</h6><p>c.</p>", model) == "b"
