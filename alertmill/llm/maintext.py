"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

Method: blocks() reads a page into its leaf blocks, in order: runs of text that no block-level tag parts. A block's features
are the tags and the meanings of class, id and role names of its ancestors, the nearest of them that says what it is for, the
tag that holds it, and its text (words, share of links, how it ends). The field has a weight for each feature and one for
each pair of neighbouring labels; it is fitted to labelled pages by gradient steps on the exact likelihood (forward and
backward sums), and the best labelling of a page is found by Viterbi. Blocks labelled as main text are joined.

Labelled pages: by default TRAINING_PAGES pages that training_pages() lays out (those of at most TRAINING_BLOCKS blocks), in which each piece of text is marked as
article or not; fit() takes any others. Their words are made of random syllables, so no text of a table is learnt.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES = 500
TRAINING_BLOCKS = 60
STEPS = 150

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody "
    "td textarea tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page, up to their end tag.
RAW_TAGS = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements whose text is never shown.
UNSEEN_TAGS = frozenset("head noscript template svg math canvas object audio video".split())
#: What an element ends that is still open, and where the search for it stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
P_STAYS = frozenset("button option optgroup select textarea td th tr tbody thead tfoot caption legend summary body html".split())
P_BOUNDS = frozenset("button td th caption table body html".split())

#: What names of classes, ids and roles say about an element.
MEANINGS = {
    "ad": "ad ads adv advert adverts advertisement advertising adbox adslot adsense adsbygoogle banner commercial promo promoted promotion sponsor sponsored anzeige werbung",
    "nav": "nav navbar navigation menu menubar menuitem breadcrumb breadcrumbs topbar tabs pagination pager toc skip skiplink",
    "side": "side sidebar aside widget widgets rail complementary related recommended recommendations popular trending teaser teasers",
    "foot": "footer foot colophon copyright legal imprint bottom contentinfo",
    "head": "header masthead head logo branding tagline top",
    "comment": "comment comments commentlist respond reply replies disqus discussion reviews review thread guestbook reader readers feedback",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall privacy toast disclaimer warning announcement message",
    "form": "form search searchbox login signin signup register contact captcha",
    "share": "share sharing social follow toolbar tools buttons",
    "content": "content article articlebody post entry story body text main prose hentry maincontent",
    "hidden": "hidden invisible none offscreen",
}
MEANING_OF = {name: meaning for meaning, names in MEANINGS.items() for name in names.split()}
#: Names that also tell in a compound, as in leftmenu.
COMPOUND = "menu sidebar comments comment footer header cookie banner advert sponsor newsletter share search login content article".split()
TAG_MEANINGS = {"nav": "nav", "menu": "nav", "aside": "side", "footer": "foot", "header": "head", "form": "form", "dialog": "notice", "button": "form", "select": "form", "option": "form", "fieldset": "form", "article": "content", "main": "content", "search": "form"}
SAYS = re.compile(r"©|\ball rights reserved\b|\bcookies?\b|\bsubscribe\b|\bnewsletter\b|\badvertisement\b|\bsponsored\b|\blog ?in\b|\bsign (?:in|up)\b|\breply\b|\bread more\b", re.I)
NAMES = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s"'/>]|$)""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW_TAGS}


@dataclass
class Block:
    text: str
    features: set[str]


@dataclass
class Element:
    tag: str
    near: str
    unseen: bool
    features: frozenset[str] = field(default_factory=frozenset)


@lru_cache(1 << 14)
def meaning(name: str) -> str | None:
    return MEANING_OF.get(name) or next((MEANING_OF[c] for c in COMPOUND if name.startswith(c) or name.endswith(c)), None)


def meanings(tag: str, attributes: str) -> list[str]:
    """What an element's tag and names say it is for."""
    found = [TAG_MEANINGS[tag]] if tag in TAG_MEANINGS else []
    if attributes.strip("/ \n"):
        for m in NAMES.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                found.append("hidden")
            elif name in ("class", "id", "role"):
                found += [m for w in WORD.findall(value) if (m := meaning(w.lower()[:40]))]
    return list(dict.fromkeys(found))


class Reader:
    """Reads one page; every character is met a bounded number of times."""

    def __init__(self):
        self.stack = [Element("", "none", False)]
        self.open: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.links = 0

    def text(self, piece: str) -> None:
        if piece and not self.stack[-1].unseen:
            piece = entities.unescape(piece) if "&" in piece else piece
            self.parts.append(piece)
            if self.links:
                self.linked += len("".join(piece.split()))

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.features(text)))
            self.parts, self.linked = [], 0

    def features(self, text: str) -> set[str]:
        top = self.stack[-1]
        words, letters = text.count(" ") + 1, max(1, len(text) - text.count(" "))
        share = self.linked / letters
        out = set(top.features)
        out.add(f"is:{top.tag}")
        out.add(f"near:{top.near}")
        out.add("words:1-2" if words < 3 else "words:3-5" if words < 6 else "words:6-10" if words < 11 else "words:11-25" if words < 26 else "words:26-")
        out.add("links:none" if not self.linked else "links:some" if share < 0.3 else "links:half" if share < 0.8 else "links:all")
        out.add("ends:sentence" if text[-1] in ".!?…:;\"”»)" else "ends:other")
        if SAYS.search(text):
            out.add("says:notice")
        if not any(c.isalpha() for c in text[:1000]):
            out.add("says:no letters")
        return out

    def push(self, tag: str, attributes: str) -> None:
        above = self.stack[-1]
        means = meanings(tag, attributes)
        own = {f"in:{tag}", *(f"for:{m}" for m in means)}
        telling = [m for m in means if m != "content"] or means
        near = telling[0] if telling else above.near
        if near == "head" and "for:content" in above.features:
            near = "head of content"
        self.stack.append(Element(tag, near, above.unseen or tag in UNSEEN_TAGS, above.features | own))
        self.open[tag] += 1

    def pop_to(self, place: int) -> None:
        for e in self.stack[place:]:
            self.open[e.tag] -= 1
        del self.stack[place:]

    def close(self, tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
        """Ends the elements of these tags that are open within the bounds."""
        if not any(self.open[t] for t in tags):
            return
        last = None
        for place in range(len(self.stack) - 1, 0, -1):
            if self.stack[place].tag in bounds or self.stack[place].tag in UNSEEN_TAGS:
                break
            if self.stack[place].tag in tags:
                last = place
                if len(tags) == 1:
                    break
        if last is not None:
            self.pop_to(last)

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
            if self.open["head"]:
                self.pop_to(next(k for k, e in enumerate(self.stack) if e.tag == "head"))
            if tag not in P_STAYS:
                self.close({"p"}, P_BOUNDS)
            if tag in ENDS:
                self.close(*ENDS[tag])
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.links += 1
        if tag in VOID_TAGS or tag in RAW_TAGS:
            return
        if tag in BLOCK_TAGS or tag in UNSEEN_TAGS or tag in ("ins", "span") and not self.parts and meanings(tag, attributes):
            self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        if tag == "a":
            self.links = max(0, self.links - 1)
        if self.open[tag]:
            if tag not in BLOCK_TAGS:
                self.flush()
            place = next(k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k].tag == tag)
            self.pop_to(place)

    def read(self, page: str) -> list[Block]:
        at, quotes = 0, True
        while (lt := page.find("<", at)) >= 0:
            c = page[lt + 1 : lt + 2]
            if c == "!" or c == "?":
                comment = page.startswith("<!--", lt)
                self.text(page[at:lt])
                end = page.find("-->", lt + 2) if comment else page.find(">", lt)
                if end < 0:
                    at = len(page)
                    break
                at = end + (3 if comment else 1)
                continue
            closing = c == "/"
            name = TAG_NAME.match(page, lt + 1 + closing)
            if not name:
                self.text(page[at : lt + 1])
                at = lt + 1
                continue
            self.text(page[at:lt])
            m = QUOTED.match(page, name.end()) if quotes else None
            if m:
                end = m.end()
            else:
                quotes = False  # a quote stays open: from here on a tag ends at the next bracket
                end = page.find(">", name.end()) + 1
                if not end:
                    at = len(page)
                    break
            tag, at = name[0].lower(), end
            if closing:
                self.end(tag)
            else:
                self.start(tag, page[name.end() : end - 1])
                if tag in RAW_TAGS and not (raw := RAW_END[tag].search(page, at)):
                    at = len(page)
                    break
                elif tag in RAW_TAGS:
                    at = raw.start()
        self.text(page[at:])
        self.flush()
        return self.blocks


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in order."""
    return Reader().read(page or "")


# --- the field


@dataclass
class Field:
    """weights: of a feature for main text against the rest; steps[a, b]: of label b after label a; bias: of main text."""

    weights: dict[str, float]
    bias: float
    steps: np.ndarray

    def labels(self, found: list[Block]) -> list[int]:
        """The best labelling of a page's blocks (Viterbi)."""
        (aa, ab), (ba, bb) = self.steps.tolist()
        rest = main = 0.0
        back: list[tuple[int, int]] = []
        for k, b in enumerate(found):
            score = self.bias + sum(self.weights.get(f, 0.0) for f in b.features)
            if k:
                from_rest, from_main = (rest + aa, main + ba), (rest + ab, main + bb)
                back.append((int(from_rest[1] > from_rest[0]), int(from_main[1] > from_main[0])))
                rest, main = max(from_rest), max(from_main) + score
            else:
                main = score
        out = [int(main > rest)] if found else []
        for choice in reversed(back):
            out.append(choice[out[-1]])
        return out[::-1]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def likelihood(scores: np.ndarray, steps: np.ndarray, labels: np.ndarray, length: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The log-likelihood of the labels (pages x blocks, filled up to one length), and its slopes by score and by step."""
    pages, longest = scores.shape
    emit = np.stack([np.zeros_like(scores), scores], 2)
    inside = np.arange(longest) < length[:, None]
    alpha, beta = np.zeros((pages, longest, 2)), np.zeros((pages, longest, 2))
    alpha[:, 0] = emit[:, 0]
    for t in range(1, longest):
        new = log_sum(alpha[:, t - 1, :, None] + steps, 1) + emit[:, t]
        alpha[:, t] = np.where(inside[:, t, None], new, alpha[:, t - 1])
    for t in range(longest - 2, -1, -1):
        new = log_sum(steps + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(inside[:, t + 1, None], new, 0)
    total = log_sum(alpha[:, -1], 1)
    by_label = np.exp(alpha + beta - total[:, None, None]) * inside[..., None]
    both = inside[:, 1:]
    pair = np.exp(alpha[:, :-1, :, None] + steps + (emit + beta)[:, 1:, None, :] - total[:, None, None, None]) * both[..., None, None]
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:, :-1][both], labels[:, 1:][both]), 1)
    value = (scores * labels * inside).sum() + (seen * steps).sum() - total.sum()
    return float(value), labels * inside - by_label[..., 1], seen - pair.sum((0, 1))


def fit(pages: Iterable[tuple[list[Block], list[int]]], turns: int = STEPS, decay: float = 0.003) -> Field:
    """The field that makes the labels of these pages likely (1: main text). The pages are held in memory: give a sample."""
    pages = [p for p in pages if p[0]]
    names = sorted({f for found, _ in pages for b in found for f in b.features})
    place = {f: k for k, f in enumerate(names)}
    longest = max(len(found) for found, _ in pages)
    length = np.array([len(found) for found, _ in pages])
    labels = np.zeros((len(pages), longest), np.int64)
    on = np.zeros((int(length.sum()), len(names) + 1))
    on[:, -1] = 1
    row = 0
    for i, (found, own) in enumerate(pages):
        labels[i, : len(own)] = own
        for b in found:
            on[row, [place[f] for f in b.features]] = 1
            row += 1
    inside = np.arange(longest) < length[:, None]
    scores = np.zeros(labels.shape)
    w = np.zeros(len(names) + 5)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for turn in range(1, turns + 1):  # Adam
        steps = w[-4:].reshape(2, 2)
        scores[inside] = on @ w[:-4]
        _, by_score, by_step = likelihood(scores, steps, labels, length)
        slope = np.concatenate([by_score[inside] @ on, by_step.ravel()]) / len(pages) - decay * w
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w += 0.1 * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    return Field({f: float(w[k]) for f, k in place.items()}, float(w[len(names)]), w[-4:].reshape(2, 2).copy())


# --- labelled pages

MAIN, REST = "", ""


class Layout:
    """Lays out one page. Each piece of text begins with MAIN or REST, which labelled() takes off again."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.syllables = [rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiouyéöñ") + rng.choice(["", "n", "r", "s", "t"]) for _ in range(25)]
        self.mark = REST

    def word(self) -> str:
        return "".join(self.rng.choice(self.syllables) for _ in range(self.rng.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentences(self, low: int = 1, high: int = 5) -> str:
        return " ".join(self.words(*self.rng.choice([(1, 3), (4, 14)])).capitalize() + self.rng.choice(".....!?") for _ in range(self.rng.randint(low, high)))

    def p(self, text: str, tag: str = "p") -> str:
        return f"<{tag}>{self.mark}{text}</{tag}>"

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.mark}{self.words(1, 4)}</a>'

    def links(self, low: int = 3, high: int = 8) -> str:
        n = self.rng.randint(low, high)
        return self.rng.choice([lambda: "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>", lambda: " | ".join(self.link() for _ in range(n)), lambda: "".join(f"<p>{self.link()}</p>" for _ in range(n))])()

    def named(self, tags: str, names: str, inner: str) -> str:
        """inner in one of the tags; one without a meaning of its own gets one of the names."""
        tag = self.rng.choice(tags.split())
        name = self.rng.choice(names.split())
        if self.rng.random() < 0.3:
            name = self.rng.choice([f"{name}-{self.word()}", f"{self.word()}-{name}", f"{name}{self.rng.randint(1, 99)}", name.capitalize() + self.word().capitalize()])
        plain = tag in TAG_MEANINGS and TAG_MEANINGS[tag] != "content" and self.rng.random() < 0.6
        return f"<{tag}>{inner}</{tag}>" if plain else f'<{tag} {self.rng.choice(["class", "class", "id"])}="{name}">{inner}</{tag}>'

    def rest(self, kind: str) -> str:
        before, self.mark, r = self.mark, REST, self.rng
        heading = self.p(self.words(1, 4), r.choice(["h2", "h3", "h4"])) if r.random() < 0.5 else ""
        text = r.choice([lambda: self.p(self.sentences()), lambda: self.mark + self.sentences(), lambda: self.p(self.words(2, 8))])
        out = {
            "nav": lambda: self.named("nav nav div ul", "nav menu navigation navbar breadcrumbs topbar", self.links()),
            "head": lambda: self.named("header header div", "header masthead branding", r.choice(["", self.p(self.words(1, 3), "h1")]) + r.choice(["", text(), self.links(2, 4)]) or text()),
            "ad": lambda: self.named("div div div p section ins aside", "ad ads advert banner sponsored promo", r.choice([text, lambda: self.mark + self.sentences(), self.link])()),
            "side": lambda: self.named("aside aside div section", "sidebar widget related recommended", heading + r.choice([text, self.links])() + r.choice(["", text()])),
            "foot": lambda: self.named("footer footer div", "footer colophon legal", r.choice(["", self.links(2, 5)]) + r.choice([lambda: f"{self.mark}&copy; {self.words(1, 4)} &middot; {self.sentences(1, 2)}", text])()),
            "notice": lambda: self.named("div div section dialog p", "cookie-notice consent notice alert popup newsletter gdpr", heading + text() + r.choice(["", f"<button>{self.mark}{self.word()}</button>"])),
            "form": lambda: f"<form>{heading}<label>{self.mark}{self.words(1, 3)}</label><input name=q>" + r.choice(["", text(), f"<select><option>{self.mark}{self.word()}<option>{self.mark}{self.word()}</select>"]) + f"<button>{self.mark}{self.words(1, 2)}</button></form>",
            "share": lambda: self.named("div ul", "share social follow", self.links(2, 5)),
            "comments": self.comments,
        }[kind]()
        self.mark = before
        return out

    def comments(self) -> str:
        r = self.rng
        outer, inner = r.choice([("section", "article"), ("div", "div"), ("ol", "li"), ("ul", "li"), ("div", "p"), ("aside", "div")])
        name = r.choice(["comments", "comment-list", "discussion", "reader-comments", "responses replies", "disqus_thread"])
        one = lambda: f"<{inner}{r.choice(['', ' class=comment', ' class="comment reply"'])}>" + (self.mark + self.sentences() if inner == "p" else r.choice(["", self.p(self.words(1, 3), "h4"), f"<div>{self.mark}{self.words(1, 3)}</div>"]) + "".join(self.p(self.sentences()) for _ in range(r.randint(1, 2)))) + f"</{inner}>"
        head = "" if outer in ("ol", "ul") else r.choice(["", self.p(self.words(1, 3), "h2"), self.p(self.words(1, 3), "h3")])
        return f'<{outer} {r.choice(["id", "class"])}="{name}">{head}' + "".join(one() for _ in range(r.randint(1, 6))) + f"</{outer}>"

    def article(self) -> str:
        self.mark, r = MAIN, self.rng
        title = self.p(self.words(2, 9), r.choice(["h1", "h1", "h2"]))
        out = [r.choice([title, title, f"<header>{title}</header>", ""])]
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.7:
                text = self.sentences(1, 6)
                out.append(r.choice([self.p(text), self.p(text), f"<p>{self.mark}{text}", f"<p><b>{self.mark}{text}<br>", f"<p>{self.mark}{text} {self.link().replace(self.mark, '')} {self.words(2, 6)}."]))
            elif kind < 0.8:
                out.append(self.p(self.words(1, 7), r.choice(["h2", "h3", "h4"])))
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.mark}{r.choice([self.sentences(1, 2), self.words(1, 6)])}" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{self.p(self.sentences())}</blockquote>")
            elif kind < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.mark}{self.words(1, 3)}" for _ in range(3)) for _ in range(r.randint(1, 3))) + "</table>")
            elif kind < 0.96:
                out.append(f"<figure><img src=x>{self.p(self.sentences(1, 1), 'figcaption')}</figure>")
            else:
                out.append(r.choice([f"<pre>{self.mark}{self.words(4, 20)}</pre>", f"<div>{self.mark}{self.sentences()}</div>"]))
            if r.random() < 0.06:
                out.append(self.rest(r.choice(["ad", "ad", "side", "share", "notice", "form"])))
        return "".join(out)

    def page(self) -> str:
        r = self.rng
        body = self.article()
        late = self.rest("comments") if r.random() < 0.25 else ""
        if late and r.random() < 0.4:
            body, late = body + late, ""
        kind = r.random()
        if kind < 0.4:
            body = f"<article>{body}</article>"
        elif kind < 0.55:
            body = r.choice(["<main>{}</main>", "<main><article>{}</article></main>", "<main><div>{}</div></main>"]).format(body)
        elif kind < 0.9:
            name = r.choice(["content", "post", "entry-content", "story", "articleBody", "main", "post-body", "text"])
            body = f'<{(t := r.choice(["div", "div", "section"]))} {r.choice(["class", "id"])}="{name}">{body}</{t}>'
        kinds = ["nav", "head", "ad", "side", "notice", "form", "share"]
        top = [self.rest(k) for k in r.sample(kinds, r.randint(0, 4))]
        end = [late, *(self.rest(k) for k in r.sample(["ad", "side", "form", "share", "nav", "notice"], r.randint(0, 2))), *([self.rest("foot")] if r.random() < 0.8 else [])]
        whole = "".join([*top, body, *end])
        if r.random() < 0.12:  # a page in a table
            cell = lambda kind: f"<td>{self.rest(kind)}</td>"
            whole = "".join(top) + f"<table><tr>{cell(r.choice(['nav', 'side']))}<td>{body}</td>{r.choice(['', cell('side'), cell('ad')])}</tr></table>" + "".join(end)
        if r.random() < 0.3:
            whole = f'<div {r.choice(["class", "id"])}="{r.choice(["wrap", "page", "container", self.word()])}">{whole}</div>'
        if r.random() < 0.03:
            whole = f'<form action="/">{whole}</form>'
        return f"<html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>{whole}" + r.choice(["</body></html>", ""])


def labelled(page: str) -> tuple[list[Block], list[int]]:
    """The blocks of a marked page without its marks, and their labels."""
    found = blocks(page)
    plain = blocks(page.replace(MAIN, "").replace(REST, ""))
    assert len(found) == len(plain)
    return plain, [int(MAIN in b.text) for b in found]


def training_pages(n: int = TRAINING_PAGES, seed: int = 1) -> list[tuple[list[Block], list[int]]]:
    pages = (labelled(Layout(random.Random(f"{seed} {k}")).page()) for k in range(n))
    return [p for p in pages if len(p[0]) <= TRAINING_BLOCKS]


@lru_cache(1)
def default_field() -> Field:
    return fit(training_pages())


# --- pages


def main_text(page: str | None, model: Field) -> str:
    found = blocks(page)
    return " ".join(b.text for b, main in zip(found, model.labels(found), strict=True) if main)


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages (page_id, url, html).

    A null or empty page and one without main text give an empty text; page_id and url may be null and are kept; repeated
    rows are answered each; other columns are ignored. The fitted field is a few hundred numbers, sent with the tasks."""
    model = model or default_field()
    kept = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(p.as_py(), model) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return kept.mapInArrow(local, f"page_id {kept.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
