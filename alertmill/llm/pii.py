"""Personal data in whole texts.

Method: anchor expansion. One Aho-Corasick pass over a text finds at-signs, schemes, plus signs, digit pairs and
identifier cues; a deterministic local parser expands each anchor to the bounds of an email, address, number or
account, and validates it. A text costs time in proportion to its length, whatever it holds: each parser starts
beyond what it has read. Rows stay where they are; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds that the base rules define, then those that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "account")
KINDS = BASE + ADDED

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = "0123456789"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
#: An address after a scheme is personal where it holds a login: user[:password]@host.
LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=:-]++@[A-Za-z0-9.-]++(?::[0-9]++)?(?:[/?#][^\s\"'<>]*+)?")
#: Cues of an identifier or a secret, in lower case; a longer name may end in one (access_token, apiKey).
CUES = ("iban", "account", "acct", "ssn", "passport", "token", "password", "passwd", "api_key", "api-key", "apikey", "secret", "konto", "cuenta", "compte")
#: Between a cue and its value: an end of a quoted key, a word such as "no.", and a mark.
VALUE = re.compile(r"[\"']?(?:[ _-]?(?:no\.?|number|id|key|#))?[\"']?[ ]{0,2}(?:=>|[:=#])?[ ]{0,2}[\"']?([A-Za-z0-9][A-Za-z0-9_+/.=-]{4,}+)")
IBAN = re.compile(r"[\"']?[ ]{0,2}[:=#]?[ ]{0,2}[\"']?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")

_automaton = None


def automaton():
    """Anchor strings, each with what it is the anchor of and its length."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        anchors = {"@": "email", "://": "url"}
        anchors |= {f"{a}.{b}": "ip" for a in DIGITS for b in DIGITS}
        anchors |= {f"{a}{s}{b}": "card" for a in DIGITS for b in DIGITS for s in ("", " ", "-")}
        anchors |= {f"+{a}": "phone" for a in DIGITS}
        anchors |= {cue: "account" for cue in CUES}
        for s, kind in anchors.items():
            _automaton.add_word(s, (kind, len(s)))
        _automaton.make_automaton()
    return _automaton


_LOWER = {c: c + 32 for c in range(65, 91)}


def _folded(text: str) -> str:
    """The text in small letters, each place as it was. No letter's small form is shorter, so equal lengths tell that none is
    longer; else ASCII letters alone are folded."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def _cue_begins(text: str, at: int) -> bool:
    """Whether a word begins at a place: at its start, after a mark, or at a capital after a small letter (apiToken)."""
    if not at or not (text[at - 1].isalnum()):
        return True
    return text[at].isupper() and text[at - 1].islower()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) <= 3 and int(p or 0) <= 255


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where each kind's parser has read to
    for last, (kind, n) in automaton().iter(_folded(text)):
        at = last - n + 1
        if at < done[kind]:
            continue
        if kind == "email":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                found[kind].append((start, m.end()))
                done[kind] = m.end()
        elif kind == "ip":
            start = at
            while start > done["ip"] and text[start - 1] in DIGITS:
                start -= 1
            m = DOTTED.match(text, start)
            done[kind] = m.end()
            parts = m[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = start + sum(map(len, four)) + 3
                if all(map(_part, four)):
                    found[kind].append((start, end))
                start = end + 1
        elif kind == "card":
            m = NUMBER.match(text, at)
            done[kind] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found[kind].append(m.span())
        elif kind == "phone":
            if m := PHONE.match(text, at):
                done[kind] = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    found[kind].append(m.span())
        elif kind == "url":
            start = at
            while start > done["url"] and text[start - 1] in SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (rest := LOGIN.match(text, at + 3)):
                found[kind].append((start, rest.end()))
                done[kind] = rest.end()
        elif _cue_begins(text, at):
            m = IBAN.match(text, last + 1)
            if not (m and _iban(m[1])):
                m = None if text[last + 1 : last + 2].isalnum() else VALUE.match(text, last + 1)
            if m:
                end = m.end(1)
                while text[end - 1] in ".=" and end > m.start(1):  # the end of a sentence, or padding
                    end -= 1
                if end - m.start(1) >= 5 and sum(c in DIGITS for c in m[1]) >= 4:
                    found[kind].append((m.start(1), end))
                done[kind] = m.end()
    return [(kind, *span) for kind in KINDS for span in found[kind]]


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans, for each row of docs. A null text is empty and has none; a repeated row is answered again;
    other columns are ignored. Bounds are code points, the end exclusive."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, f"doc_id long, spans {SPANS}")


def mask(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind; where spans overlap, one mark with the first one's kind."""
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if text is not None else None


def _joined(which: Column) -> Column:
    return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans and all spans in a string."""

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = {k: of(k) for k in KINDS}
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(count[k] for k in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), *(count[k] for k in ADDED), F.size("spans").cast("long").alias("n_all"))
