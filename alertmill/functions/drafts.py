"""Drafts of knowledge entries held against five rules; a fault is a name of a closed vocabulary, never a value.

v1 fields and their types, v2 the fields that are copied from the decided alert or case, v3 values that identify, v4 what could
pass for a prompt's own structure or orders, v5 lengths and counts. Texts of v3 and v4 are read as they are displayed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.functions import textsafety as T
from alertmill.functions import typed

# The fields of a draft in order, their most characters, and the most items of a list.
FIELDS = ("title", "conclusion", "category", "mitre_ids", "soar_scenario", "rule_ids", "log_source", "tags", "summary", "distinguishing_signals", "check_next_time", "confidence_note")
COPIED_TEXTS, COPIED_LISTS = ("conclusion", "category", "soar_scenario", "log_source"), ("mitre_ids", "rule_ids")
LISTS = ("distinguishing_signals", "check_next_time")
TEXTS = {"title": 120, "summary": 600, "confidence_note": 200}
ITEMS, ITEM_CHARACTERS, SCANNED = 6, 160, 10_000
NOT_EMPTY = ("title", "summary")
FREE = ("title", "summary", *LISTS, "confidence_note")
#: Keys of the prompt's own sections, which no line of a draft may begin with.
SECTION_KEYS = ("level", "key_name", "total", "by_conclusion", "last_seen", "examples", "kb_learned_level", "trung_pct")

CONTROL = r"[\x00-\x08\x0B-\x1F\x7F-\x9F]"
BLANK = r"(?U)^[\s\x1C-\x1F]*\z"
LINE_ENDS = r"\n\r\x0B\f\x1C-\x1E\x85  "
FORGED = rf"(?U)(?:^|[{LINE_ENDS}])[\s\x1C-\x1F]*(?:\[\p{{Nd}}+\]|(?:{'|'.join(SECTION_KEYS)})[^\S{LINE_ENDS}]*:)"
TAG = r"(?U)<[\s\x1C-\x1F]*/?[\s\x1C-\x1F]*untrusted_data"
NONCE = r"(?<![0-9A-Za-z])[0-9a-fA-F]{16}(?![0-9A-Za-z])"


def _is_texts(v: Column) -> Column:
    return typed.is_(v, typed.LIST) & F.forall(typed.items(v), lambda x: typed.is_(x, typed.TEXT))


def _texts(v: Column) -> Column:
    """The texts of a list of nothing else, or of one text; null for other values."""
    return F.when(_is_texts(v), F.transform(typed.items(v), typed.text_of)).when(typed.is_(v, typed.TEXT), F.array(typed.text_of(v)))


def _is_unclean(v: Column) -> Column:
    return F.exists(F.coalesce(_texts(v), F.array().cast("array<string>")), lambda x: x.rlike(CONTROL) | (F.length(T.without_invisible(x)) != F.length(x)))


def _names(text: Column, names: Column) -> Column:
    """Whether a text names one of the row's hosts or users as a whole word, in any case; names of one character are not asked for."""

    def stands(name: Column) -> Column:
        quoted = F.replace(F.trim(name), F.lit(r"\E"), F.lit(r"\E\\E\Q"))
        return (F.length(F.trim(name)) >= 2) & F.rlike(text, F.concat(F.lit(r"(?iU)(?<![\w<-])\Q"), quoted, F.lit(r"\E(?![\w>-])")))

    return F.coalesce(F.exists(names, lambda n: F.coalesce(stands(n), F.lit(False))), F.lit(False))


def _named(*faults: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in faults)), lambda n: n.isNotNull())


def with_faults(rows: DataFrame, draft: Column, source: Column, tags: Sequence[str], into: str = "faults") -> DataFrame:
    """The rows with the faults of a draft (JSON) in the order of the rules, each once; none for a good one.

    source: struct of conclusion, category, mitre_ids, soar_scenario, rule_ids, log_source, hostnames and usernames; a null list is
    equal to a null or absent one only. A draft that is null or no object has the one fault v1_schema:root. Nothing is shuffled."""
    c = F.col
    d = rows.select(F.struct(*rows.columns).alias("row"), draft.alias("text"), source.alias("source"))
    d = d.withColumn("v", F.coalesce(typed.document(c("text")), F.parse_json(F.lit("null"))))
    field = {n: typed.at(c("v"), f"$.{n}") for n in FIELDS}
    d = d.withColumns({f"raw_{n}": F.substring(F.array_join(F.when(_is_texts(field[n]) if n in LISTS else typed.is_(field[n], typed.TEXT), _texts(field[n])), "\n"), 1, SCANNED) for n in FREE})
    d = d.withColumns({f"shown_{n}": T.without_invisible(c(f"raw_{n}")) for n in FREE})
    d = d.withColumns({f"kinds_{n}": T.literal_findings(c(f"shown_{n}")) for n in FREE} | {f"plain_{n}": T.nfkc(c(f"shown_{n}")) for n in FREE})
    d = d.withColumns({f"orders_{n}": F.concat(T.injection_families(c(f"raw_{n}")), T.injection_families(c(f"shown_{n}"))) for n in FREE})

    def broken(n: str) -> Column:
        bad = field[n].isNull()
        if n in TEXTS:
            bad |= ~typed.is_(field[n], typed.TEXT)
        elif n in LISTS or n == "tags":
            bad |= ~_is_texts(field[n])
        return bad if n in (*COPIED_TEXTS, *COPIED_LISTS) else bad | _is_unclean(field[n])

    def differs(n: str) -> Column:
        own = c(f"source.{n}")
        if n in COPIED_TEXTS:
            same = F.when(typed.absent(field[n]), own.isNull()).otherwise(F.coalesce(typed.text_of(field[n]) == own, F.lit(False)))
        else:
            same = F.when(typed.absent(field[n]), own.isNull()).otherwise(_is_texts(field[n]) & own.isNotNull() & F.transform(typed.items(field[n]), typed.text_of).eqNullSafe(own))
        return field[n].isNotNull() & ~same

    def identifying(n: str) -> Column:
        shown = c(f"shown_{n}")
        found = F.array_union(c(f"kinds_{n}"), _named((_names(shown, c("source.usernames")), "account"), (_names(shown, c("source.hostnames")), "hostname")))
        return F.filter(F.array(*(F.when(F.array_contains(found, kind), F.lit(f"v3_{kind}:{n}")) for kind in T.FINDINGS)), lambda x: x.isNotNull())

    items = {n: F.when(_is_texts(field[n]), typed.items(field[n])) for n in LISTS}
    length = {n: F.length(typed.text_of(field[n])) for n in TEXTS}
    found = F.concat(
        _named(*((broken(n), f"v1_schema:{n}") for n in FIELDS), (F.exists(F.json_object_keys(c("text")), lambda k: ~k.isin(*FIELDS)), "v1_schema:unexpected_key"),
               (_is_texts(field["tags"]) & F.exists(_texts(field["tags"]), lambda x: ~x.isin(*tags) if tags else F.lit(True)), "v1_tags:unknown_tag")),
        _named(*((differs(n), f"v2_closed:{n}") for n in FIELDS if n in (*COPIED_TEXTS, *COPIED_LISTS))),
        *map(identifying, FREE),
        *(_named((F.lower(c(f"plain_{n}")).rlike(TAG), f"v4_delimiter:{n}"), (c(f"shown_{n}").rlike(NONCE), f"v4_nonce:{n}"), (c(f"plain_{n}").rlike(FORGED), f"v4_structure:{n}"), (F.size(c(f"orders_{n}")) > 0, f"v4_detector:{n}")) for n in FREE),
        *(_named((length[n] > most, f"v5_length:{n}"), (typed.text_of(field[n]).rlike(BLANK) if n in NOT_EMPTY else F.lit(False), f"v5_empty:{n}")) for n, most in TEXTS.items()),
        *(_named((F.size(items[n]) > ITEMS, f"v5_count:{n}"), (F.exists(items[n], lambda x: F.length(typed.text_of(x)) > ITEM_CHARACTERS), f"v5_length:{n}")) for n in LISTS),
    )
    faults = F.when(typed.is_(c("v"), typed.OBJECT), F.array_distinct(found)).otherwise(F.array(F.lit("v1_schema:root")))
    return d.select("row.*", faults.alias(into))
