"""Flat report views: filters, orders, pages, summaries and what charts are drawn from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.stats import pearson, ratio

MOST_PER_PAGE = 250


def dashboard_filter(rows: DataFrame, equal: dict | None = None, score: tuple[str, float | None, float | None] | None = None, search: tuple[list[str], str] | None = None) -> DataFrame:
    """Rows that meet all conditions given: equalities, an inclusive score range (null fails), a part of any of some columns in any case."""
    out = rows
    for name, value in (equal or {}).items():
        if value is not None:
            out = out.filter(F.col(name) == F.lit(value))
    if score:
        name, low, high = score
        if low is not None:
            out = out.filter(F.col(name) >= low)
        if high is not None:
            out = out.filter(F.col(name) <= high)
    if search and search[1]:
        out = out.filter(reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(search[1].lower())) for c in search[0])))
    return out


def order_of(name: str, descending: bool, tie: str) -> list[Column]:
    """A missing value is the greatest: last when ascending, first when descending; ties by another column."""
    return [F.col(name).desc_nulls_first() if descending else F.col(name).asc_nulls_last(), F.col(tie).asc()]


def page(rows: DataFrame, order: list[Column], number: int, per_page: int) -> DataFrame:
    """Page `number` (from 1) of rows in order; per_page is held within 1 and 250."""
    if number < 1:
        raise ValueError("pages are numbered from 1")
    size = min(max(per_page, 1), MOST_PER_PAGE)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(rows: DataFrame, per_page: int) -> DataFrame:
    size = min(max(per_page, 1), MOST_PER_PAGE)
    return rows.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).alias("total_pages"))


def histogram(rows: DataFrame, value: str, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts in bins of equal width; the last includes its upper edge; nulls and what lies outside fall out."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    return rows.filter(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def heatmap(rows: DataFrame, level: str, criteria: list[str], threshold: float) -> DataFrame:
    """Per level and criterion: mean, population deviation, n, and a warning below the threshold; 0 and 'N/A' where empty."""
    long = rows.select(level, F.explode(F.array(*(F.struct(F.lit(c).alias("criterion"), F.col(c).cast("double").alias("v")) for c in criteria))).alias("x"))
    out = long.groupBy(level, "x.criterion").agg(F.avg("x.v").alias("m"), F.stddev_pop("x.v").alias("s"), F.count("x.v").alias("n"))
    return out.select(level, "criterion", F.coalesce("m", F.lit(0.0)).alias("mean"), F.coalesce("s", F.lit(0.0)).alias("std"), "n", F.coalesce(F.col("m") < threshold, F.lit(False)).alias("warn"), F.when(F.col("n") == 0, "N/A").otherwise(F.lit("")).alias("note"))


def correlations(rows: DataFrame, names: list[str]) -> DataFrame:
    """Pearson's coefficient of each pair over rows without nulls: one pass; 0 without spread, the identity below three rows."""
    full = rows.select(*(F.col(n).cast("double").alias(n) for n in names)).dropna()
    pairs = [(a, b) for a in names for b in names]
    got = full.agg(F.count("*").alias("n"), *(pearson(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    r = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.col("n") < 3, float(a == b)).when(F.lit(a == b), 1.0).otherwise(F.col(f"r{i}")).alias("r")) for i, (a, b) in enumerate(pairs)))
    return got.select(F.explode(r).alias("x")).select("x.*")


def distribution(rows: DataFrame, by: str, value: str, missing: str = "Unknown") -> DataFrame:
    """Quartiles, extremes, mean and n of a value by a column."""
    return rows.filter(F.col(value).isNotNull()).groupBy(F.coalesce(by, F.lit(missing)).alias(by)).agg(F.min(value).alias("lo"), *(F.percentile(value, q).alias(n) for n, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))), F.max(value).alias("hi"), F.avg(value).alias("mean"), F.count("*").alias("n"))


def funnel(stages: list[tuple[str, Column]], counts: DataFrame) -> DataFrame:
    """stage, n and dropped (what is missing from the stage before, never negative) of one row of counts."""
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(name).alias("stage"), n.cast("long").alias("n"), (F.greatest(F.lit(0), stages[i - 1][1] - n) if i else F.lit(0)).cast("long").alias("dropped")) for i, (name, n) in enumerate(stages)))
    return counts.select(F.explode(rows).alias("x")).select("x.*")


def success_rate(done: Column, failed: Column) -> Column:
    return F.bround(ratio(100 * done, done + failed), 2)


def consensus(values: Column) -> Column:
    """The one value that all that aren't null share, else null; an aggregate."""
    return F.when(F.count_distinct(values) == 1, F.max(values))


def cost(docs: DataFrame, chars: str, chunk: int, calls_per_chunk: int, tokens_in: int, tokens_out: int, price_in: float, price_out: float) -> DataFrame:
    """Chunks, calls, tokens and price of a generation stage over all documents."""
    chunks = F.sum(F.ceil(F.col(chars) / chunk))
    out = docs.agg(F.count("*").alias("docs"), chunks.alias("chunks")).withColumn("calls", F.col("chunks") * calls_per_chunk)
    return out.withColumns({"tokens_in": F.col("calls") * tokens_in, "tokens_out": F.col("calls") * tokens_out}).withColumn("usd", F.col("tokens_in") / 1e6 * price_in + F.col("tokens_out") / 1e6 * price_out)
