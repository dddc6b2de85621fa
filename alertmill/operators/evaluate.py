"""Evaluation: confusion, scores, agreement, intervals and tests over predictions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill import params as P

OUTCOMES = ("escalate", "benign", "needs_review", "error")


def outcome(verdict: Column) -> Column:
    """A verdict as one of four outcomes; a missing one is an error."""
    return F.when(verdict.isNull(), "error").when(verdict.isin("escalate", "true_positive"), "escalate").when(verdict.isin("benign", "false_positive"), "benign").when(verdict == "needs_review", "needs_review").otherwise("error")


def confusion(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row for each truth with the count of each outcome."""
    counts = [F.count_if(outcome(F.col("verdict")) == o).alias(o) for o in OUTCOMES]
    return predictions.groupBy(*by, "truth").agg(*counts)


def scores(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, accuracy, and precision, recall and F1 of either class with their macro mean; null where nothing supports one."""
    o, t = outcome(F.col("verdict")), F.col("truth")
    aggs = [F.count("*").alias("n"), F.count_if(o == t).alias("right")]
    for c in ("escalate", "benign"):
        aggs += [F.count_if((o == c) & (t == c)).alias(f"tp_{c}"), F.count_if(o == c).alias(f"said_{c}"), F.count_if(t == c).alias(f"is_{c}")]
    out = predictions.groupBy(*by).agg(*aggs) if by else predictions.agg(*aggs)
    out = out.withColumn("accuracy", F.try_divide(F.col("right"), F.col("n")))
    for c in ("escalate", "benign"):
        out = out.withColumn(f"precision_{c}", F.try_divide(F.col(f"tp_{c}"), F.col(f"said_{c}"))).withColumn(f"recall_{c}", F.try_divide(F.col(f"tp_{c}"), F.col(f"is_{c}")))
        f1 = F.try_divide(2.0 * F.col(f"tp_{c}"), F.col(f"said_{c}") + F.col(f"is_{c}"))
        out = out.withColumn(f"f1_{c}", F.when(F.col(f"is_{c}") > 0, f1))
    known = F.filter(F.array("f1_escalate", "f1_benign"), lambda x: x.isNotNull())
    out = out.withColumn("macro_f1", F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.when(F.size(known) > 0, F.size(known))))
    return out.select(*by, "n", "accuracy", *(f"{m}_{c}" for c in ("escalate", "benign") for m in ("precision", "recall", "f1")), "macro_f1")


def kappa(rated: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """n, observed and expected agreement and Cohen's kappa of two raters; null where chance agreement is complete."""
    both = rated.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = both.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same")) if by else both.agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"))
    pa = both.groupBy(*by, F.col(a).alias("label")).agg(F.count("*").alias("na"))
    pb = both.groupBy(*by, F.col(b).alias("label")).agg(F.count("*").alias("nb"))
    joint = pa.join(pb, [*by, "label"])
    chance = joint.groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("m")) if by else joint.agg(F.sum(F.col("na") * F.col("nb")).alias("m"))
    out = n.join(chance, list(by), "left") if by else n.crossJoin(F.broadcast(chance))  # one row each
    po, pe = F.try_divide(F.col("same"), F.col("n")), F.try_divide(F.coalesce(F.col("m"), F.lit(0)), F.col("n") * F.col("n"))
    return out.select(*by, "n", po.alias("p_o"), pe.alias("p_e"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def attack_success(manifest: DataFrame, predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Targets, those that got away (not escalated and not in error), errors and the rate; a missing prediction is an error."""
    met = manifest.join(predictions, "alert_id", "left")
    o = outcome(F.col("verdict"))
    aggs = [F.count("*").alias("targets"), F.count_if(o == "benign").alias("successes"), F.count_if(o == "error").alias("errors")]
    out = met.groupBy(*by).agg(*aggs) if by else met.agg(*aggs)
    return out.withColumn("rate", F.try_divide(F.col("successes"), F.col("targets")))


def calibration(predictions: DataFrame, score: str, thresholds: Sequence[float]) -> DataFrame:
    """By threshold: how many reach it, how many of them are true, precision and recall. One pass over the rows."""
    each = predictions.select("truth", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda x: F.col(score) >= x)).alias("threshold"))
    positive = predictions.agg(F.count_if(F.col("truth") == "escalate").alias("positives"))
    grid = predictions.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    found = each.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == "escalate").alias("hits"))
    out = grid.join(found, "threshold", "left").na.fill(0, ["n", "hits"]).crossJoin(F.broadcast(positive))  # a row a threshold
    return out.withColumn("precision", F.try_divide(F.col("hits"), F.col("n"))).withColumn("recall", F.try_divide(F.col("hits"), F.col("positives")))


def arm_summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """An arm's numbers. rows: truth_tp, model_tp (null without an answer), held, seen (a lookup was read) and best_pct (null
    without a match). Rates are over the answered; one with nothing to divide is null."""
    said, true = F.col("model_tp"), F.col("truth_tp")
    count = lambda c, name: F.count_if(c).alias(name)
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("model_tp").alias("answered"), count(said == true, "correct"), count(said & true, "hits"), count(said.isNotNull() & true, "truth_tp"), count(said, "said_tp"),
        count(F.col("held") & (said != true), "held_wrong"), count(F.col("held") & (said == true), "held_right"), count(F.col("seen"), "seen"), count(F.col("seen") & F.col("best_pct").isNotNull(), "with_match"),
        F.avg(F.when(F.col("seen"), F.col("best_pct"))).alias("mean_best_pct"),
    )
    rates = {"accuracy": ("correct", "answered"), "tp_recall": ("hits", "truth_tp"), "tp_precision": ("hits", "said_tp")}
    return out.withColumns({name: F.try_divide(F.col(a), F.col(b)) for name, (a, b) in rates.items()})


def leaks(matched: DataFrame, subject_runs: DataFrame, entries: DataFrame, entry_runs: DataFrame, cutoff: int) -> DataFrame:
    """By subject: whether an entry that it matched (subject, entry) comes from one of its own runs, or was approved after the
    cutoff, and how many entries can't be placed (gone, or never approved)."""
    placed = matched.join(entries, "entry", "left")
    times = placed.groupBy("subject").agg(F.coalesce(F.max(F.col("approved") > cutoff), F.lit(False)).alias("after_cutoff"), F.count_if(F.col("approved").isNull()).alias("unplaceable"))
    own = matched.join(entry_runs, "entry").join(subject_runs, ["subject", "run"]).select("subject").distinct().withColumn("same_run", F.lit(True))
    return times.join(own, "subject", "left").select("subject", F.coalesce("same_run", F.lit(False)).alias("same_run"), "after_cutoff", "unplaceable")


def regression_gate(rows: DataFrame, baseline: str, candidate: str, attack: Column) -> DataFrame:
    """rule, baseline, candidate and status of two systems on the same rows: macro-F1 may drop by MACRO_F1_MAX_DROP, no fewer
    attacks may be caught, and no more of the attack rows may pass as benign. n/a where nothing supports a rule."""
    sides = []
    for name in (baseline, candidate):
        p = rows.select("truth", F.col(name).alias("verdict"), attack.alias("attack"))
        true, o = F.col("truth") == "escalate", outcome(F.col("verdict"))
        counts = p.agg(F.count_if(true).alias("support"), F.count_if(true & (o == "escalate")).cast("double").alias("caught"), F.count_if(true & F.col("attack") & (o == "benign")).cast("double").alias("passed"))
        sides.append(scores(p).select(F.col("macro_f1")).crossJoin(counts).select(F.struct("*").alias(f"_{len(sides)}")))  # one row each
    a, b = F.col("_0"), F.col("_1")
    rule = lambda name, x, y, ok, known: F.struct(F.lit(name).alias("rule"), x.alias("baseline"), y.alias("candidate"), F.when(~known, "n/a").when(ok, "PASS").otherwise("FAIL").alias("status"))
    rules = F.array(
        rule("macro_f1", a["macro_f1"], b["macro_f1"], a["macro_f1"] - b["macro_f1"] <= P.MACRO_F1_MAX_DROP, a["macro_f1"].isNotNull() & b["macro_f1"].isNotNull()),
        rule("recall_escalate", a["caught"], b["caught"], b["caught"] >= a["caught"], a["support"] > 0),
        rule("asr", a["passed"], b["passed"], b["passed"] <= a["passed"], F.lit(True)),
    )
    return sides[0].crossJoin(sides[1]).select(F.explode(rules).alias("r")).select("r.*")


def baseline_verdict(severity: Column) -> Column:
    """The verdict by severity alone."""
    return F.when(severity == "critical", "escalate").when(severity == "high", "needs_review").when(severity.isin("low", "medium"), "false_positive")


def mcnemar(pairs: DataFrame, right_a: Column, right_b: Column) -> DataFrame:
    """Discordant counts of two systems on the same rows and the exact two-sided p."""
    counts = pairs.agg(F.count_if(right_a & ~right_b).alias("only_a"), F.count_if(~right_a & right_b).alias("only_b"))

    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([binomial_two_sided(int(x), int(y)) for x, y in zip(a, b, strict=True)])

    return counts.withColumn("p", tail("only_a", "only_b"))


def binomial_two_sided(a: int, b: int) -> float:
    n, k = a + b, min(a, b)
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * math.fsum(map(math.exp, logs)))


def bootstrap(predictions: DataFrame, draws: int = P.BOOTSTRAP_DRAWS, seed: int = P.BOOTSTRAP_SEED) -> DataFrame:
    """The 2.5 and 97.5 percent bounds of macro-F1 by resampling. A draw depends on a row only by its cell (truth and
    outcome), so that draws are multinomial over the eight cells: the rows are counted once, whatever their number."""
    cells = predictions.groupBy("truth", outcome(F.col("verdict")).alias("outcome")).agg(F.count("*").alias("n"))

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["truth", "outcome"])
        n = frame["n"].to_numpy()
        if n.sum() == 0:
            return pd.DataFrame({"low": [None], "high": [None]})
        got = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), size=draws)
        t, o = frame["truth"].to_numpy(), frame["outcome"].to_numpy()
        f1 = []
        for c in ("escalate", "benign"):
            tp, said, is_ = got[:, (t == c) & (o == c)].sum(1), got[:, o == c].sum(1), got[:, t == c].sum(1)
            f1.append(np.where(is_ > 0, 2 * tp / np.maximum(said + is_, 1), np.nan))
        f1 = np.array(f1)
        some = (~np.isnan(f1)).any(0)
        macro = np.nanmean(f1[:, some], axis=0)
        if some.mean() < 0.95:
            return pd.DataFrame({"low": [None], "high": [None]})
        low, high = np.quantile(macro, [0.025, 0.975])
        return pd.DataFrame({"low": [low], "high": [high]})

    return cells.groupBy().applyInPandas(draw, "low double, high double")


def largest_remainder(sizes: dict, total: int) -> dict:
    """Places for each stratum in proportion to its size, that sum to total; ties to the first key."""
    n = sum(sizes.values())
    if n == 0 or total <= 0:
        return dict.fromkeys(sizes, 0)
    exact = {k: total * v / n for k, v in sizes.items()}
    out = {k: min(int(x), sizes[k]) for k, x in exact.items()}
    order = sorted(sizes, key=lambda k: (-(exact[k] - int(exact[k])), k))
    left = min(total, n) - sum(out.values())
    while left > 0:
        for k in order:
            if left > 0 and out[k] < sizes[k]:
                out[k] += 1
                left -= 1
    return out


def stratified(df: DataFrame, strata: Sequence[str], id_: str, total: int, seed: int) -> DataFrame:
    """A sample of about `total` rows with each stratum's share, in the order of a seeded hash of the id."""
    sizes = {tuple(r)[:-1]: r["n"] for r in df.groupBy(*strata).agg(F.count("*").alias("n")).collect()}  # a row a stratum
    places = largest_remainder({k: v for k, v in sorted(sizes.items(), key=str)}, total)
    wanted = df.sparkSession.createDataFrame([(*k, v) for k, v in places.items()], df.select(*strata).schema.add("_places", "integer"))
    from pyspark.sql import Window

    order = Window.partitionBy(*strata).orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string")), 256), id_)
    return df.withColumn("_at", F.row_number().over(order)).join(F.broadcast(wanted), list(strata)).filter("_at <= _places").drop("_at", "_places")


def paired_delta(paired: DataFrame, draws: int = P.BOOTSTRAP_DRAWS, seed: int = P.BOOTSTRAP_SEED) -> DataFrame:
    """The 2.5 and 97.5 percent bounds of how much macro-F1 differs between two runs over the same subjects (truth, first and
    second verdict): low, high and the share of draws in which it is undefined. Both runs share each draw: a draw depends on a
    subject only by its cell of truth and both outcomes, so draws are multinomial over the joint cells, which are counted once.
    Bounds are null where more than 5 % of the draws are undefined on either side."""
    cells = paired.groupBy("truth", outcome(F.col("first")).alias("a"), outcome(F.col("second")).alias("b")).agg(F.count("*").alias("n"))

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["truth", "a", "b"])
        n = frame["n"].to_numpy()
        got = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), size=draws)
        truth = frame["truth"].to_numpy()

        def macro(said: np.ndarray) -> np.ndarray:
            f1 = []
            for c in ("escalate", "benign"):
                tp, claimed, is_ = got[:, (truth == c) & (said == c)].sum(1), got[:, said == c].sum(1), got[:, truth == c].sum(1)
                f1.append(np.where(is_ > 0, 2 * tp / np.maximum(claimed + is_, 1), np.nan))
            known = ~np.isnan(f1)
            return np.where(known.any(0), np.nansum(f1, 0) / np.maximum(known.sum(0), 1), np.nan)

        delta = macro(frame["b"].to_numpy()) - macro(frame["a"].to_numpy())
        undefined = float(np.isnan(delta).mean())
        low, high = (None, None) if undefined > 0.05 else np.nanquantile(delta, [0.025, 0.975])
        return pd.DataFrame({"low": [low], "high": [high], "undefined": [undefined]})

    return cells.groupBy().applyInPandas(draw, "low double, high double, undefined double")


#: The normal quantiles of a two-sided 5 % test and of 80 % power.
Z_ERROR, Z_POWER = 1.959964, 0.841621


def pairs_needed(delta: Column, discordant: Column) -> Column:
    """Pairs that a paired test needs to see a difference of shares at a share of discordant pairs; null where none can be."""
    n = F.pow(Z_ERROR * F.sqrt(discordant) + Z_POWER * F.sqrt(discordant - delta * delta), F.lit(2.0)) / (delta * delta)
    return F.when((delta > 0) & (discordant >= delta * delta), n)


def least_difference(pairs: Column, discordant: Column) -> Column:
    """The smallest difference that so many pairs let such a test see, at most the share of discordant pairs: pairs_needed()
    solved for the difference, a quadratic equation."""
    a, b = Z_ERROR**2, Z_POWER**2
    root = (Z_ERROR * F.sqrt(pairs * discordant) + F.sqrt(a * pairs * discordant - (pairs + b) * discordant * (a - b))) / (pairs + b)
    # below so many pairs there is no solution: nothing can be seen
    return F.when((pairs > 0) & (discordant > 0), F.least(F.when(a * pairs >= (pairs + b) * (a - b), root).otherwise(discordant), discordant))
