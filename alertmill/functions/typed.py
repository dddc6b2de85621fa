"""Typed reads of nested JSON: closed sets, types, and the first fault by name. JSON is parsed once into a VARIANT.

A read is a list of checks in order. The first that fails names its field and its fault, and the row keeps nothing else of the
document; without a fault, fields come out as columns of their types and unknown keys are left behind.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertmill.functions.networks import let

MISSING, WRONG, OUTSIDE = "missing", "wrong type", "outside its vocabulary"
#: Names of types, as a variant's schema begins.
OBJECT, LIST, TEXT, FLAG, WHOLE, NULL = "OBJECT", "ARRAY", "STRING", "BOOLEAN", "BIGINT", "VOID"


def document(text: Column) -> Column:
    """The document of a JSON text; null if it can't be read. What follows a whole document is not looked at."""
    return F.try_parse_json(text)


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """The type of a value; VOID for a JSON null, null for one that is not there."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def is_(v: Column, *kinds: str) -> Column:
    return F.coalesce(kind(v).isin(*kinds), F.lit(False))


def absent(v: Column) -> Column:
    return F.coalesce(kind(v) == NULL, F.lit(True))


def text_of(v: Column) -> Column:
    return F.when(is_(v, TEXT), F.try_variant_get(v, "$", "string"))


def flag_of(v: Column) -> Column:
    return F.when(is_(v, FLAG), F.try_variant_get(v, "$", "boolean"))


def items(v: Column) -> Column:
    """The elements of an array, none for other values."""
    return F.coalesce(F.when(is_(v, LIST), F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def first_fault(*checks: tuple[Column, Column | str, str]) -> Column:
    """struct(field, fault) of the first check (failed, field, fault) that is true, else null."""
    made = [(failed, F.struct((F.lit(f) if isinstance(f, str) else f).alias("field"), F.lit(fault).alias("fault"))) for failed, f, fault in checks]
    out = F.when(F.coalesce(made[0][0], F.lit(False)), made[0][1])
    for failed, answer in made[1:]:
        out = out.when(F.coalesce(failed, F.lit(False)), answer)
    return out


def first_of(elements: Column, fault: Callable[[Column], Column]) -> Column:
    """The fault of the first element that has one."""
    return F.get(F.filter(F.transform(elements, fault), lambda f: f.isNotNull()), F.lit(0))


# --- the enrichment block of an alert --------------------------------------------------------------------

# Vocabularies and the version of the block.
CRITICALITIES = ("high", "medium", "low", "unknown")
VERDICTS = ("clean", "suspicious", "malicious")
VERSION = r"^1\.[0-9]+\z"


def verdict_fault(v: Column, name: str) -> Column:
    return first_fault((~is_(v, TEXT), name, WRONG), (~text_of(v).isin(*VERDICTS), name, OUTSIDE))


def enrichment(text: Column, names_account: Column) -> Column:
    """The context of an alert from its payload's enrichment block: fault (null if there is none), present, criticality, owner,
    role, privileged, reputation, and the status of each lookup. Any fault makes the whole context unknown. names_account: whether
    the alert has an account; without one, a `false` says nothing about its rights."""

    def read(v: Column) -> Column:
        e = lambda path="": at(v, f"$.enrichment{path}")
        asset = lambda name: e(f".asset.{name}")
        ti = lambda entry: F.when(~is_(entry, OBJECT), F.struct(F.lit("enrichment.ti[]").alias("field"), F.lit(WRONG).alias("fault"))).otherwise(verdict_fault(at(entry, "$.verdict"), "enrichment.ti[].verdict"))
        fault = F.coalesce(
            first_fault(
                (absent(e()), "enrichment", MISSING),
                (~is_(e(), OBJECT), "enrichment", WRONG),
                (~F.coalesce(text_of(e(".schema_version")).rlike(VERSION), F.lit(False)), "enrichment.schema_version", "missing or not 1.x"),
                (~absent(e(".asset")) & ~is_(e(".asset"), OBJECT), "enrichment.asset", WRONG),
                (asset("criticality").isNotNull() & ~is_(asset("criticality"), TEXT), "enrichment.asset.criticality", WRONG),
                (~text_of(asset("criticality")).isin(*CRITICALITIES), "enrichment.asset.criticality", OUTSIDE),
                (asset("in_inventory").isNotNull() & ~is_(asset("in_inventory"), FLAG), "enrichment.asset.in_inventory", WRONG),
                *((~absent(asset(n)) & ~is_(asset(n), k), f"enrichment.asset.{n}", WRONG) for n, k in (("owner", TEXT), ("role", TEXT), ("user", TEXT), ("user_is_admin", FLAG))),
                (~absent(e(".ti")) & ~is_(e(".ti"), LIST), "enrichment.ti", WRONG),
            ),
            first_of(items(e(".ti")), ti),
            F.when(~absent(e(".ioc")), first_fault((~is_(e(".ioc"), OBJECT), "enrichment.ioc", WRONG))),
            F.when(is_(e(".ioc"), OBJECT), verdict_fault(e(".ioc.verdict"), "enrichment.ioc.verdict")),
        )
        verdicts = F.concat(F.transform(items(e(".ti")), lambda x: text_of(at(x, "$.verdict"))), F.filter(F.array(text_of(e(".ioc.verdict"))), lambda x: x.isNotNull()))
        rank = F.array_max(F.transform(verdicts, lambda x: F.array_position(F.array(*map(F.lit, VERDICTS)), x)))
        stocked, admin = flag_of(asset("in_inventory")), flag_of(asset("user_is_admin"))
        own = F.when(F.coalesce(names_account, F.lit(False)) | F.coalesce(admin, F.lit(False)), admin)
        values = F.struct(
            F.coalesce(stocked, F.lit(False)).alias("present"),
            F.coalesce(text_of(asset("criticality")), F.lit("unknown")).alias("criticality"),
            text_of(asset("owner")).alias("owner"),
            text_of(asset("role")).alias("role"),
            own.alias("privileged"),
            F.coalesce(F.get(F.array(*map(F.lit, VERDICTS)), (rank - 1).cast("int")), F.lit("skipped")).alias("reputation"),
            F.when(stocked.isNull(), "skipped").when(stocked, "found").otherwise("not_found").alias("asset_status"),
            F.when(own.isNull(), "skipped").otherwise("found").alias("identity_status"),
            F.when(rank.isNotNull(), "found").otherwise("skipped").alias("ioc_status"),
        )
        return let(F.struct(fault.alias("fault"), values.alias("values")), settled)

    def settled(r: Column) -> Column:
        skipped = F.lit("skipped")
        unknown = {"present": F.lit(False), "criticality": F.lit("unknown"), "owner": F.lit(None).cast("string"), "role": F.lit(None).cast("string"), "privileged": F.lit(None).cast("boolean"), "reputation": skipped, "asset_status": skipped, "identity_status": skipped, "ioc_status": skipped}
        bad = r["fault"].isNotNull()
        return F.struct(r["fault"].alias("fault"), *(F.when(bad, x).otherwise(r["values"][n]).alias(n) for n, x in unknown.items()))

    return let(F.coalesce(document(text), F.parse_json(F.lit("null"))), read)


# --- answers of a model -----------------------------------------------------------------------------------

# The closed sets of an answer, in the order in which it is read.
ACTIONS, CONFIDENCES = ("false_positive", "true_positive"), ("low", "medium", "high")
BASIS = {"severity": ("critical", "high", "medium", "low"), "ioc_reputation": (*VERDICTS[::-1], "not_found", "skipped"), "asset_criticality": CRITICALITIES, "identity_privileged": ("true", "false", "unknown")}
SOURCES = ("wazuh_raw_log", "rule_description", "correlation_samples", "kb_playbook", "context", "siem_context")
ANALYST_TEXTS, ANALYST_LIST = ("summary", "reading_attack", "reading_benign", "would_change"), "next_checks"
FIELDS = ("suggested_action", "confidence", "structured_basis", "reasons", "playbook_used", *ANALYST_TEXTS, ANALYST_LIST)


def _in(v: Column, closed: Sequence[str]) -> Column:
    return F.coalesce(text_of(v).isin(*closed), F.lit(False))


def guarded_answer(text: Column) -> Column:
    """fault (null if the answer is good) and answer: its known fields with their types. Nothing is trimmed or rewritten; an
    answer with a fault is null."""

    def read(v: Column) -> Column:
        f = lambda path: at(v, f"$.{path}")
        basis = lambda name: f(f"structured_basis.{name}")
        of = lambda field, what: f"{field}: {what}"
        basis_fields = [*BASIS, "occurrence_count", "playbook_rule_applied"]
        reason = lambda r: F.when(~is_(r, OBJECT), F.lit("reasons[]: expected object")).otherwise(
            reduce(
                lambda out, c: out.when(c[0], c[1]),
                [*((at(r, f"$.{n}").isNull(), f"reasons[].{n}: missing") for n in ("claim", "quote", "source")), *((~is_(at(r, f"$.{n}"), TEXT), f"reasons[].{n}: expected string") for n in ("claim", "quote")), (~_in(at(r, "$.source"), SOURCES), "reasons[].source: invalid")],
                F.when(F.lit(False), F.lit(None).cast("string")),
            )
        )
        before = [
            (~is_(v, OBJECT), "result: expected object"),
            *((f(n).isNull(), of(n, "missing")) for n in FIELDS),
            (~_in(f("suggested_action"), ACTIONS), of("suggested_action", "invalid")),
            (~_in(f("confidence"), CONFIDENCES), of("confidence", "invalid")),
            (~is_(f("structured_basis"), OBJECT), of("structured_basis", "expected object")),
            *((basis(n).isNull(), of(f"structured_basis.{n}", "missing")) for n in basis_fields),
            *((~_in(basis(n), closed), of(f"structured_basis.{n}", "invalid")) for n, closed in BASIS.items()),
            (~is_(basis("occurrence_count"), WHOLE), of("structured_basis.occurrence_count", "expected integer")),
            (~is_(basis("playbook_rule_applied"), TEXT, NULL), of("structured_basis.playbook_rule_applied", "expected string or null")),
            (~is_(f("reasons"), LIST), of("reasons", "expected array")),
        ]
        after = [
            (~is_(f("playbook_used"), TEXT, NULL), of("playbook_used", "expected string or null")),
            *((~is_(f(n), TEXT), of(n, "expected string")) for n in ANALYST_TEXTS),
            (~is_(f(ANALYST_LIST), LIST), of(ANALYST_LIST, "expected array")),
            (F.size(items(f(ANALYST_LIST))) == 0, of(ANALYST_LIST, "expected non-empty array")),
            (F.exists(items(f(ANALYST_LIST)), lambda x: ~is_(x, TEXT)), of(f"{ANALYST_LIST}[]", "expected string")),
        ]
        chain = lambda checks: reduce(lambda out, c: out.when(c[0], F.lit(c[1])), checks, F.when(F.lit(False), F.lit(None).cast("string")))
        fault = F.coalesce(chain(before), first_of(items(f("reasons")), reason), chain(after))
        answer = F.struct(
            *(text_of(f(n)).alias(n) for n in ("suggested_action", "confidence")),
            F.struct(*(text_of(basis(n)).alias(n) for n in BASIS), F.try_variant_get(basis("occurrence_count"), "$", "bigint").alias("occurrence_count"), text_of(basis("playbook_rule_applied")).alias("playbook_rule_applied")).alias("structured_basis"),
            F.transform(items(f("reasons")), lambda r: F.struct(*(text_of(at(r, f"$.{n}")).alias(n) for n in ("claim", "quote", "source")))).alias("reasons"),
            text_of(f("playbook_used")).alias("playbook_used"),
            *(text_of(f(n)).alias(n) for n in ANALYST_TEXTS),
            F.transform(items(f(ANALYST_LIST)), text_of).alias(ANALYST_LIST),
        )
        return let(F.struct(fault.alias("fault"), answer.alias("answer")), lambda r: F.struct(r["fault"].alias("fault"), F.when(r["fault"].isNull(), r["answer"]).alias("answer")))

    return let(F.coalesce(document(text), F.parse_json(F.lit("null"))), read)
