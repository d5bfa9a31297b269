"""Mixing sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small

#: Fractions of 52 bits are exact in a double.
STEPS = float(1 << 52)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, flatten: float = 0.5, source: str = "source", text: str = "text") -> DataFrame:
    """Per source: docs, chars, weight (share of characters wanted), rate (mean repetitions) and cdf (of that Poisson, from `first` repetitions on; fewer have no chance that shows).

    Without weights a source's weight is its characters to the power `flatten`; sources missing from weights get 0.
    The whole mix has as many characters as the input in the mean. A source without characters keeps each row once
    (rate null). A null source is a source of its own.
    """
    stats = docs.groupBy(F.col(source).alias("__source")).agg(F.count("*").alias("docs"), F.sum(F.coalesce(F.length(text), F.lit(0))).alias("chars"))
    raw = F.pow(F.col("chars").cast("double"), F.lit(flatten))
    if weights is not None:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        raw = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("__source")), F.lit(0.0)) if pairs else F.lit(0.0)
    stats = stats.withColumn("raw", F.when(F.col("chars") > 0, raw).otherwise(0.0))
    total = stats.agg(F.sum("raw").alias("raw"), F.sum("chars").alias("chars")).first()
    if not total["raw"]:
        return stats.select("__source", "docs", "chars", F.lit(None).cast("double").alias("weight"), F.lit(None).cast("double").alias("rate"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("array<double>").alias("cdf"))
    weight = F.col("raw") / F.lit(float(total["raw"]))
    rate = F.when(F.col("chars") > 0, weight * F.lit(float(total["chars"])) / F.col("chars"))
    stats = stats.select("__source", "docs", "chars", weight.alias("weight"), rate.alias("rate"))
    # log of the terms of the Poisson distribution, as far to both sides as makes what is left less than one step of the hash
    most = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    first = F.greatest(F.lit(0), F.floor(F.col("rate") - 12 * F.sqrt("rate") - 40)).cast("int")
    x = first + 1.0  # log of first! by Stirling's series, which is exact enough from 40 on
    factorial = F.when(first == 0, 0.0).otherwise((x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x))
    log = first * F.ln("rate") - F.col("rate") - factorial
    start = F.struct(log.alias("log"), F.exp(log).alias("sum"), F.array(F.exp(log)).alias("all"))

    def add(acc, k):
        log = acc["log"] + F.ln("rate") - F.ln(k.cast("double"))
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + F.exp(log))).alias("all"))

    cdf = F.aggregate(F.sequence(first + 1, most), start, add, lambda acc: acc["all"])
    return stats.withColumn("first", F.when(F.col("rate") > 0, first)).withColumn("cdf", F.when(F.col("rate") > 0, cdf).when(F.col("rate") == 0, F.array(F.lit(1.0))))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, flatten: float = 0.5, seed: int = 17, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Each document as often as its draw from a Poisson distribution with its source's rate says, in random order.

    The draw inverts the distribution at a fraction hashed from seed and doc_id, so it doesn't depend on partitions,
    order or retries; rows of one doc_id (repeated rows) are drawn alike, a null doc_id as the empty id. Returns all
    columns of docs, then __rate, __replica (1..count) and __key, by whose hash all rows are dealt over partitions
    and sorted within them. Only per-source sums are gathered, combined before their shuffle; a hot source has no
    task of its own. Columns of docs of those names are replaced.
    """
    docs = docs.drop("__rate", "__replica", "__key", "__cdf", "__first", "__source", "__u", "__count")
    rates = source_rates(docs, weights, flatten, source, text).select("__source", F.col("rate").alias("__rate"), F.coalesce("first", F.lit(0)).alias("__first"), F.col("cdf").alias("__cdf"))
    joined = docs.join(broadcast_if_small(rates, rates.count(), 20_000), F.col(source).eqNullSafe(F.col("__source")), "left").drop("__source")
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(STEPS)
    joined = joined.withColumn("__u", drawn)
    count = F.when(F.col("__cdf").isNull(), F.lit(1)).otherwise(F.size(F.filter("__cdf", lambda x: x <= F.col("__u"))) + F.col("__first"))
    out = joined.withColumn("__count", count).filter("__count > 0").withColumn("__replica", F.explode(F.sequence(F.lit(1), F.col("__count"))))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.col("__replica").cast("string")))
    out = out.withColumn("__key", key).drop("__cdf", "__first", "__u", "__count")
    return out.repartition(F.col("__key")).sortWithinPartitions("__key")
