"""Judged answers: confusion labels, rates with intervals, cross cuts, audits and threshold studies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.stats import ratio, wilson

LABELS = ("TA", "TC", "FA", "FC", "unknown")
#: Fixed value: the threshold all continuous criteria ship with.
THRESHOLD = 0.625
#: The anchors scores are counted at.
ANCHORS = (0.0, 0.25, 0.5, 0.75, 1.0)


def confusion_label(answerable: Column, abstained: Column, score: Column, threshold: Column | float = THRESHOLD) -> Column:
    """True/false abstention (TA, FA) or commitment (TC, FC); unknown without a score of the abstention judge."""
    held = abstained & (score >= threshold)
    return F.when(score.isNull(), "unknown").when(held, F.when(answerable, "FA").otherwise("TA")).otherwise(F.when(answerable, "TC").otherwise("FC"))


def confusion(answers: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each label, and n, by the given columns."""
    return answers.groupBy(*by).agg(*(F.count_if(F.col("label") == x).alias(x.lower()) for x in LABELS), F.count("*").alias("n"))


def rates(counts: DataFrame) -> DataFrame:
    """counts with hallucination, over-caution, precision, recall and F1; null where undefined."""
    c = {x: F.col(x) for x in ("ta", "tc", "fa", "fc")}
    out = counts.withColumns({"hallucination": ratio(c["fc"], c["fc"] + c["ta"]), "over_caution": ratio(c["fa"], c["fa"] + c["tc"]), "abst_precision": ratio(c["ta"], c["ta"] + c["fa"]), "abst_recall": ratio(c["ta"], c["ta"] + c["fc"])})
    p, r = F.col("abst_precision"), F.col("abst_recall")
    return out.withColumn("f1", F.try_divide(2 * p * r, p + r))


def with_intervals(counts: DataFrame) -> DataFrame:
    """Wilson intervals of hallucination and over-caution."""
    h, o = wilson(F.col("fc"), F.col("fc") + F.col("ta")), wilson(F.col("fa"), F.col("fa") + F.col("tc"))
    return counts.withColumns({"h_lo": h["lo"], "h_hi": h["hi"], "o_lo": o["lo"], "o_hi": o["hi"]})


def quality_means(answers: DataFrame, by: list[str]) -> DataFrame:
    """Means over true commitments (correctness, faithfulness, their product) and over all judged ones (coverage, recovery)."""
    tc, judged = F.col("label") == "TC", F.col("label") != "unknown"
    both = F.col("correctness") * F.col("faithfulness")
    columns = [("correctness", F.when(tc, F.col("correctness"))), ("faithfulness", F.when(tc, F.col("faithfulness"))), ("kc", F.when(tc, both)), ("coverage", F.when(judged, F.col("passage_coverage"))), ("recovery", F.when(judged, F.col("source_recovery")))]
    return answers.groupBy(*by).agg(*(f(x).alias(f"{k}_{name}") for name, x in columns for k, f in (("mean", F.avg), ("n", F.count))))


def cross_cut(answers: DataFrame, strata: DataFrame, key: str, arm: str, attributes: list[str]) -> DataFrame:
    """Counts by arm for all answers (slice 'joint') and by each attribute of strata, whose unmatched answers fall out there only."""
    joined = answers.join(strata.select(key, *attributes), key)
    parts = [confusion(answers, [arm]).withColumns({"slice": F.lit("joint"), "stratum": F.lit("all")})]
    parts += [confusion(joined.withColumn("stratum", F.col(a)), [arm, "stratum"]).withColumn("slice", F.lit(a)) for a in attributes]
    return reduce(lambda a, b: a.unionByName(b), parts)


def disagreements(answers: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Answers whose own abstention and the judge's verdict differ, with the kind; a missing verdict is a judge_error."""
    says, finds = F.col("abstained"), F.col("abstention_score") >= threshold
    kind = F.when(F.col("abstention_score").isNull(), "judge_error").when(says & ~finds, "answerer_only").when(~says & finds, "judge_only")
    return answers.withColumn("kind", kind).filter("kind is not null")


def threshold_sweep(answers: DataFrame, scores: DataFrame, thresholds: list[float], key: str, arm: str) -> DataFrame:
    """Counts per threshold and arm when only questions count all of whose criteria (one at least) reach the threshold.

    Unanswerable questions always count. A question's least score and whether one is missing decide for all thresholds.
    """
    least = scores.groupBy(key).agg(F.min("score").alias("least"), F.count_if(F.col("score").isNull()).alias("missing"))
    joined = answers.join(least, key, "left").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    approved = F.coalesce((F.col("missing") == 0) & (F.col("least") >= F.col("threshold")), F.lit(False))
    return confusion(joined.filter(~F.col("is_answerable") | approved), ["threshold", arm])


def score_histogram(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per criterion: n, mean, how many lie below the threshold, and counts at the nearest anchor (ties: the lower)."""
    near = reduce(lambda acc, a: F.when(F.abs(F.col("score") - a) < F.abs(F.col("score") - acc), F.lit(a)).otherwise(acc), ANCHORS[1:], F.lit(ANCHORS[0]))
    rows = scores.filter("score is not null").withColumn("anchor", near)
    return rows.groupBy("criterion").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.count_if(F.col("score") < threshold).alias("below"), *(F.count_if(F.col("anchor") == a).alias(f"at_{int(100 * a)}") for a in ANCHORS))


def cohorts(answers: DataFrame, scores: DataFrame, key: str, arm: str, threshold: float = THRESHOLD) -> DataFrame:
    """Right outcomes (TC and TA of all four) per arm and cohort of questions: approved, half, half_by_one.

    approved: all scores reach the threshold; half: one at least is 0.5 and none lower; half_by_one: just one is 0.5.
    """
    q = scores.groupBy(key).agg(F.min("score").alias("least"), F.count_if(F.col("score").isNull()).alias("missing"), F.count_if(F.col("score") == 0.5).alias("halves"))
    full = F.col("missing") == 0
    flags = [("approved", full & (F.col("least") >= threshold)), ("half", full & (F.col("least") == 0.5)), ("half_by_one", full & (F.col("least") == 0.5) & (F.col("halves") == 1))]
    q = q.select(key, F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in flags)), lambda x: x.isNotNull())).alias("cohort"))
    counts = confusion(answers.join(q, key), [arm, "cohort"])
    right, all_ = F.col("tc") + F.col("ta"), F.col("tc") + F.col("ta") + F.col("fa") + F.col("fc")
    return counts.select(arm, "cohort", all_.alias("n"), ratio(right, all_).alias("right_share"))


def density(samples: DataFrame, value: str, grid: list[float], width: float) -> DataFrame:
    """A Gaussian kernel density of value at the points of grid, in one pass over the samples."""
    import math

    scale = 1 / (width * math.sqrt(2 * math.pi))
    points = F.explode(F.array(*map(F.lit, grid))).alias("x")
    z = (F.col("x") - F.col(value)) / width
    return samples.filter(F.col(value).isNotNull()).select(value, points).groupBy("x").agg((F.avg(F.exp(-0.5 * z * z)) * scale).alias("density"))


def gold(answers: DataFrame, golden: DataFrame, key: str) -> DataFrame:
    """answers with their gold answer; status is 'failed' for an answerable one without, and unanswerable ones have none."""
    joined = answers.join(golden, key, "left").withColumn("gold", F.when(F.col("is_answerable"), F.col("gold")))
    return joined.withColumn("status", F.when(F.col("is_answerable") & F.col("gold").isNull(), "failed").otherwise("ok"))


def passage_texts(passages: DataFrame, texts: DataFrame, drop_empty: bool = True) -> DataFrame:
    """Passages with their text: their own payload, else the text of their chunk; those without (or, for judging, with an empty one) fall out."""
    joined = passages.join(texts, "chunk_id", "left").withColumn("text", F.coalesce("payload", "chunk_text")).drop("chunk_text")
    return joined.filter(F.col("text") != "" if drop_empty else F.col("text").isNotNull())
