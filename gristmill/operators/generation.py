"""Generation and annotation around external models: task tables, checks, fallbacks and instruments.

Models themselves are scorers: functions from frame to frame. stub_scorer stands in where none is configured.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as tx

from .sampling import shuffled_ids

Scorer = Callable[[DataFrame], DataFrame]
#: How many questions each level of the ladder asks, in order.
LADDER = (("remember", 3), ("understand", 1), ("analyze", 1), ("evaluate", 1))
ATTEMPTS, WARMER = 3, 0.1


def ladder(chunks: DataFrame, key: str) -> DataFrame:
    """A task for each chunk, level and question: level_ord, level, ordinal, and the levels asked before as context."""
    steps = F.array(*(F.struct(F.lit(i).alias("level_ord"), F.lit(level).alias("level"), F.lit(n).alias("n"), F.array(*(F.lit(x) for x, _ in LADDER[:i])).cast("array<string>").alias("context")) for i, (level, n) in enumerate(LADDER)))
    rows = chunks.select(key, F.explode(steps).alias("s"))
    return rows.select(key, "s.level_ord", "s.level", F.explode(F.sequence(F.lit(1), F.col("s.n"))).alias("ordinal"), "s.context")


def answered(questions: DataFrame, key: str, ask: Callable[[str, float], str | None], text: str) -> DataFrame:
    """key, answer, attempts, abstained: up to three attempts, each warmer, then an abstention. ask returns None on failure."""
    kind = dict(questions.dtypes)[key]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t in zip(f[key], f[text], strict=True):
                answer, n = None, 0
                while answer is None and n < ATTEMPTS:
                    answer = ask(t, WARMER * n)
                    n += 1
                rows.append((k, answer, n, answer is None))
            yield pd.DataFrame(rows, columns=[key, "answer", "attempts", "abstained"])

    return questions.select(key, text).mapInPandas(run, f"{key} {kind}, answer string, attempts int, abstained boolean")


def valid_swaps(swaps: DataFrame, labels: DataFrame, corpus_words: DataFrame) -> DataFrame:
    """swaps(question, original, replacement, entity_type) that make a question unanswerable.

    The original is in the question; the replacement is neither a label nor, accents aside, a word of the corpus; and
    neither kind nor a bare year makes a weak swap. Words on both sides are compared, so the corpus isn't broadcast.
    """
    fold = lambda c: F.lower(F.translate(c, "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"))
    s = swaps.filter(F.contains(F.lower("question"), F.lower("original")) & ~F.col("entity_type").isin("DATE", "CARDINAL", "ORDINAL") & ~F.rlike("replacement", F.lit(r"^\d{4}$")))
    s = s.withColumn("__w", fold(F.col("replacement")))
    s = s.join(labels.select(F.lower("label").alias("__w")).distinct(), "__w", "left_anti")
    return s.join(corpus_words.select(fold(F.col("word")).alias("__w")).distinct(), "__w", "left_anti").drop("__w")


def measured(scores: DataFrame, source: str) -> DataFrame:
    """Per source: n, mean of what was scored, and failed, where all scores are errors."""
    return scores.groupBy(source).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.every(F.col("error").isNotNull()).alias("failed"))


def pulled(labels: DataFrame, tasks: DataFrame) -> DataFrame:
    """labels(task_id, user_id, score) with their pair; an unknown task, or a pair a user rated twice, ends the job."""
    j = labels.join(tasks.select("task_id", "pair_id"), "task_id", "left")
    pair = F.when(F.col("pair_id").isNull(), F.raise_error(F.lit("unknown task")).cast("string")).otherwise(F.col("pair_id").cast("string"))
    g = j.withColumn("pair_id", pair).groupBy("user_id", "pair_id").agg(F.max("score").alias("score"), F.count("*").alias("n"))
    return g.select("user_id", "pair_id", F.when(F.col("n") > 1, F.raise_error(F.lit("a pair was rated twice by one user")).cast("int")).otherwise(F.col("score")).alias("score"))


def instrument(sample: DataFrame, key: str, seed: int, shown: list[str], expected: int | None = None) -> DataFrame:
    """Tasks in hash order that show only the given columns; keys must be distinct, and as many as expected."""
    seen = sample.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d")).first()
    if seen["n"] != seen["d"] or expected is not None and seen["n"] != expected:
        raise ValueError(f"{seen['n']} rows with {seen['d']} keys; expected {expected}")
    return shuffled_ids(sample, key, seed).select("task_id", key, *shown)


def spans(docs: DataFrame, text: str) -> DataFrame:
    """The corpus's distinct words of four letters or more."""
    return docs.select(F.explode(tx.tokens(F.col(text))).alias("word")).filter(F.rlike("word", F.lit(r"^\p{L}{4,}$"))).distinct()
