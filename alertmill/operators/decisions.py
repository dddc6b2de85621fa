"""What a decision rests on: checks of a suggestion, what is served of it, reads as of an instant, guards and truths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Answers, reasons and fields as they are stored.
ANSWERS = ("false_positive", "true_positive")
POLICY_FIELDS = ("severity", "ioc_reputation", "asset_criticality", "identity_privileged", "playbook_rule")
BASIS_FIELDS = ("severity", "ioc_reputation", "asset_criticality", "identity_privileged")
BAD_REPUTATIONS, GUARDED_ASSETS = ("malicious", "suspicious"), ("high", "unknown")
STALE_LOCK_S, STALE_TOLERANCE = 120, 20
#: What severity alone says, as the plainest baseline.
BY_SEVERITY = {"low": "false_positive", "medium": "false_positive", "high": "needs_review", "critical": "escalate"}


def _present(*reasons: Column) -> Column:
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())


def held_reasons(flagged: Column, missing: Column, verifier: Column) -> Column:
    """The checks that warned of a suggestion, in the order of the steps. flagged: arrays of step names; missing: fields of the
    policy that failed; verifier: what the verifier's step says. Null arrays name nothing."""
    none = F.array().cast("array<string>")
    steps, fields = F.coalesce(flagged, none), F.filter(F.array_distinct(F.coalesce(missing, none)), lambda f: f.isin(*POLICY_FIELDS))
    said = lambda step: F.array_contains(steps, step)
    before = _present(F.when(said("step2"), F.lit("facts_mismatch")), F.when(said("step3"), F.lit("no_verified_quote")))
    last = _present(F.when(said("step6"), F.when(verifier.eqNullSafe("invalid"), F.lit("verifier_invalid")).otherwise(F.lit("verifier_disagrees"))))
    return F.concat(before, F.transform(fields, lambda f: F.concat(F.lit("fp_policy:"), f)), last)


def served_reasons(held: Column, rule_applied: Column) -> Column:
    """Where knowledge decided, without the reasons that tell what the model itself had answered."""
    return F.when(F.coalesce(rule_applied, F.lit(False)), F.filter(held, lambda r: ~r.isin("verifier_disagrees", "fp_policy:playbook_rule"))).otherwise(held)


def served_action(stored: Column, proposed: Column) -> Column:
    """The stored answer; the proposed one where it was held for review; null where neither is an answer."""
    return F.when(stored.isin(*ANSWERS), stored).when((stored == "needs_review") & proposed.isin(*ANSWERS), proposed)


def knowledge_verdict(percent: Column, side: Column, threshold: int) -> Column:
    """What the nearest knowledge says: an incident at the threshold or above is a true positive and below it a false one; a
    benign entry speaks from the threshold on. Null where it says nothing or no threshold is set."""
    if threshold <= 0:
        return F.lit(None).cast("string")
    near = percent >= threshold
    return F.when(percent.isNotNull() & (side == "incident"), F.when(near, "true_positive").otherwise("false_positive")).when(near & (side == "benign"), F.lit("false_positive"))


def basis_mismatches(said: Mapping[str, Column], facts: Mapping[str, Column]) -> Column:
    """Names of the facts that a suggestion misstates: texts without case, the count as a number where it is known."""
    text = lambda c: F.lower(F.coalesce(c.cast("string"), F.lit("none")))
    out = [F.when(text(said[f]) != text(facts[f]), F.lit(f)) for f in BASIS_FIELDS]
    known = facts["occurrence_count"]
    return _present(*out, F.when(known.isNotNull() & ~said["occurrence_count"].cast("long").eqNullSafe(known.cast("long")), F.lit("occurrence_count")))


def policy_gaps(verdict: Column, severity: Column, reputation: Column, criticality: Column, privileged: Column, rule_holds: Column) -> Column:
    """The conditions of a false positive that fail, all of them; none for any other verdict."""
    low = lambda c: F.lower(c.cast("string"))
    gaps = _present(
        F.when(low(severity) == "critical", F.lit("severity")),
        F.when(low(reputation).isin(*BAD_REPUTATIONS), F.lit("ioc_reputation")),
        F.when(low(criticality).isin(*GUARDED_ASSETS), F.lit("asset_criticality")),
        F.when(low(privileged) == "true", F.lit("identity_privileged")),
        F.when(~F.coalesce(rule_holds, F.lit(False)), F.lit("playbook_rule")),
    )
    return F.when(verdict.eqNullSafe("false_positive"), gaps).otherwise(F.array().cast("array<string>"))


def as_of(df: DataFrame, time: str, instant) -> DataFrame:
    """The rows that were there before an instant (a value, or a column of df)."""
    return df.filter(F.col(time) < instant)


def effective_status(status: Column, before: Column, locked: Column, now, seconds: int = STALE_LOCK_S, unit: int = 1_000_000) -> Column:
    """A row whose lock is stale is what it was before it was taken."""
    return F.when((status == "processing") & (locked < F.lit(now) - seconds * unit), before).otherwise(status)


def is_stale(occurrences: Column, seen: Column, tolerance: int = STALE_TOLERANCE) -> Column:
    """Whether a cluster grew too much since its decider looked at it."""
    return F.coalesce(occurrences - seen > tolerance, F.lit(False))


def case_truth(df: DataFrame, case: str, label: str, positive: str = "TP", negative: str = "FP") -> DataFrame:
    """case and truth: positive if any head is; null if any other head has no label; else negative."""
    return df.groupBy(case).agg(F.when(F.coalesce(F.bool_or(F.col(label) == positive), F.lit(False)), F.lit(positive)).when(F.bool_or(F.col(label).isNull()), F.lit(None)).otherwise(F.lit(negative)).alias("truth"))


def paired(on: DataFrame, off: DataFrame, subject: str, value: str) -> DataFrame:
    """Subjects answered in both runs, with both values."""
    a, b = (d.filter(F.col(value).isNotNull()).select(subject, F.col(value).alias(name)) for d, name in ((on, "on"), (off, "off")))
    return a.join(b, subject)


def most_common(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The commonest value of each group; of equally common ones that met first."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(*keys).agg(F.max_by(F.col(value), F.struct("n", -F.col("first"))).alias(value))


def parents_lookup(found: DataFrame, reference: DataFrame, technique: str, id_: str, name: str) -> DataFrame:
    """Adds name and via ('exact', 'parent' or null) from a reference by a technique's id, else by its parent's. The reference is
    broadcast only if Spark finds it small."""
    r = reference.select(F.col(id_).alias("_id"), F.col(name).alias("_name"))
    exact = found.join(r.select(F.col("_id").alias(technique), F.col("_name").alias("_own")), technique, "left")
    both = exact.withColumn("_parent", F.substring_index(technique, ".", 1)).join(r.select(F.col("_id").alias("_parent"), F.col("_name").alias("_above")), "_parent", "left")
    via = F.when(F.col("_own").isNotNull(), "exact").when(F.col("_above").isNotNull(), "parent")
    return both.select(*found.columns, F.coalesce("_own", "_above").alias("name"), via.alias("via"))
