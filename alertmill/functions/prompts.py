"""What may stand in a prompt outside its blocks of untrusted data: fixed phrases, closed words, numbers, instants and ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertmill.functions.networks import let
from alertmill.functions.scalar import is_alert_id

#: Marks of tags while a text is parted; characters that no text may hold (they become U+FFFD).
OPEN, CLOSE, END = "﷐", "﷑", "﷒"
#: Separators at the edges of a token, and the shapes of numbers, instants and ids.
EDGES = "·-:,.()[]#→∈∧≠"
SHAPES = (
    r"-?\p{Nd}+",
    r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}T\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}(?:\.\p{Nd}+)?(?:Z|[+-]\p{Nd}{2}:\p{Nd}{2})",
    r"T\p{Nd}{4}(?:\.\p{Nd}{3})?",
    r"[a-z]{2,6}-\p{Nd}{1,2}",
    r"[0-9]{1,3}\.[0-9]{1,3}",
    "=",
)
SHOWN = 40


def outside_blocks(text: Column, nonce: Column) -> Column:
    """The text without its blocks, whose line breaks stay; a tag of this nonce that is in no pair stays, with a mark beside it.
    A block reaches from a tag that opens to the next tag, if that closes; tags of other nonces are text."""
    own = F.concat(F.lit(r"\Q"), F.replace(nonce, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    tags = F.concat(F.lit('(<untrusted_data nonce="'), own, F.lit('"[^>]*>)|(</untrusted_data nonce="'), own, F.lit('">)'))
    clean = F.translate(text, OPEN + CLOSE + END, "�" * 3)
    marked = F.regexp_replace(clean, tags, F.lit(f"{OPEN}$1{CLOSE}$2{END}"))
    # a tag that opens has nothing in its second group, one that closes nothing in its first
    marked = F.replace(F.replace(marked, F.lit(CLOSE + END), F.lit("")), F.lit(OPEN + CLOSE), F.lit(""))
    marked = F.coalesce(marked, clean)  # without a nonce there are no blocks

    def part(p: Column, i: Column) -> Column:
        inside = F.substring_index(p, END, 1)
        rest = F.substr(p, F.length(inside) + 2)
        return F.when(i == 0, p).when(F.contains(p, F.lit(END)), F.concat(F.regexp_replace(inside, "[^\n]", ""), rest)).otherwise(F.concat(F.lit(OPEN), p))

    return F.array_join(F.transform(F.split(marked, OPEN), part), "")


def lint(text: Column, nonce: Column, phrases: Sequence[str], words: Sequence[str]) -> Column:
    """array of struct(kind, line, token, count): `unbalanced_block` for each tag of the nonce that is in no pair, then
    `free_text` for each line that holds other tokens: the first (40 characters of it) and how many. Null text: null; empty: none."""
    whole = f"^(?:{'|'.join(SHAPES)})\\z"

    def is_allowed(token: Column) -> Column:
        return token.isin(*words) | token.rlike(whole) | is_allowed_id(token) if words else token.rlike(whole) | is_allowed_id(token)

    def is_allowed_id(token: Column) -> Column:
        return F.coalesce(is_alert_id(token), F.lit(False))

    def unpaired(left: Column) -> Column:
        lines = F.transform(F.split(left, "\n"), lambda x, i: F.array_repeat(violation("unbalanced_block", i), F.length(F.regexp_replace(x, f"[^{OPEN}{END}]", ""))))
        return F.flatten(lines)

    def violation(kind: str, i: Column, token: Column | None = None, count: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (i + 1).alias("line"), (F.lit(None) if token is None else token).cast("string").alias("token"), (F.lit(None) if count is None else count).cast("int").alias("count"))

    def free(left: Column) -> Column:
        left = F.translate(left, OPEN + END, "")
        for phrase in sorted({p for p in phrases if len(p) > 1}, key=lambda p: (-len(p), p)):
            left = F.replace(left, F.lit(phrase), F.lit(""))
        others = lambda line: F.filter(F.transform(F.split(line, r"(?U)[\s\x1c-\x1f]+"), lambda t: F.btrim(t, F.lit(EDGES))), lambda t: (t != "") & ~is_allowed(t))
        found = F.transform(F.split(left, "\n"), lambda line, i: let(others(line), lambda o: violation("free_text", i, F.substring(F.get(o, F.lit(0)), 1, SHOWN), F.size(o))))
        return F.filter(found, lambda v: v["count"] > 0)

    return let(outside_blocks(text, nonce), lambda left: F.concat(unpaired(left), free(left)))
