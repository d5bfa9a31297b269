"""Statistics as columns: proportions and intervals, agreement coefficients, correlation."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.96


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """struct(lo, hi): the Wilson interval of k of n, within [0, 1]; (0, 0) for n = 0. Fails for k outside 0..n."""
    p, z2 = ratio(k, n), z * z
    centre, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    scale = 1 + z2 / n
    lo = F.when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (centre - half) / scale))
    hi = F.when(k == n, 1.0).otherwise(F.least(F.lit(1.0), (centre + half) / scale))
    bad = F.raise_error(F.lit("k must lie between 0 and n")).cast("struct<lo:double,hi:double>")
    zero = F.struct(F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    return F.when((k < 0) | (k > n), bad).when(n == 0, zero).otherwise(F.struct(lo.alias("lo"), hi.alias("hi")))


def disagreement(a: Column, b: Column, span: int, weights: str) -> Column:
    """Distance of two labels as a share of the scale's, squared for quadratic weights."""
    share = F.abs(a - b) / float(span)
    return share * share if weights == "quadratic" else share


def checked(ratings: DataFrame, scale: tuple[int, int]) -> DataFrame:
    """Ratings that are present; a label off the scale is an error."""
    low, high = scale
    bad = F.raise_error(F.lit(f"labels must lie between {low} and {high}")).cast("int")
    return ratings.filter("label is not null").withColumn("label", F.when(F.col("label").between(low, high), F.col("label")).otherwise(bad))


def kappa(ratings: DataFrame, a: str, b: str, scale: tuple[int, int] = (1, 5), weights: str = "quadratic") -> DataFrame:
    """Cohen's weighted kappa of raters a and b from ratings(item_id, rater_id, label): coefficient and n, the items both rated.

    Null where no disagreement is expected. Labels are counted by pair first, so what follows is as large as the scale.
    """
    both = checked(ratings, scale).filter(F.col("rater_id").isin(a, b)).groupBy("item_id").agg(F.max(F.when(F.col("rater_id") == a, F.col("label"))).alias("a"), F.max(F.when(F.col("rater_id") == b, F.col("label"))).alias("b"))
    cells = both.filter("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    span = scale[1] - scale[0]
    observed = cells.agg(F.sum(F.col("n") * disagreement(F.col("a"), F.col("b"), span, weights)).alias("o"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    expected = left.join(F.broadcast(right)).agg(F.sum(F.col("na") * F.col("nb") * disagreement(F.col("a"), F.col("b"), span, weights)).alias("e"))  # at most one row a label
    return observed.join(F.broadcast(expected)).select((1 - F.try_divide(F.col("o") * F.col("n"), F.col("e"))).alias("coefficient"), "n")


def alpha(ratings: DataFrame, level: str = "ordinal", scale: tuple[int, int] = (1, 5)) -> DataFrame:
    """Krippendorff's alpha of ratings(item_id, rater_id, label): coefficient and n_items of two ratings or more.

    level: nominal, ordinal (distances from the labels' frequencies) or interval. Null without pairs or where all
    ratings are alike. Each item is counted by label; pairs of labels of an item, not of ratings, are added up.
    """
    counts = checked(ratings, scale).groupBy("item_id", "label").agg(F.count("*").alias("k"))
    items = counts.groupBy("item_id").agg(F.sum("k").alias("m"), F.collect_list(F.struct("label", "k")).alias("labels")).filter("m > 1")
    pairs = items.select("m", F.explode("labels").alias("x"), "labels").select("m", "x", F.explode("labels").alias("y"))
    weight = F.col("x.k") * (F.col("y.k") - (F.col("x.label") == F.col("y.label")).cast("int")) / (F.col("m") - 1)
    matrix = pairs.groupBy(F.col("x.label").alias("c"), F.col("y.label").alias("k")).agg(F.sum(weight).alias("o"))
    sums = matrix.groupBy("c").agg(F.sum("o").alias("n"))
    table = sums.agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("marginals"), F.sum("n").alias("total"))
    n_of = lambda c: F.coalesce(F.try_element_at("marginals", c), F.lit(0.0))
    labels = F.array(*(F.lit(i) for i in range(scale[0], scale[1] + 1)))

    def distance(c: Column, k: Column) -> Column:
        if level == "nominal":
            return (c != k).cast("double")
        if level == "interval":
            return F.pow((c - k).cast("double"), F.lit(2.0))
        between = F.aggregate(F.filter(labels, lambda g: (g >= F.least(c, k)) & (g <= F.greatest(c, k))), F.lit(0.0), lambda acc, g: acc + n_of(g))
        return F.pow(between - (n_of(c) + n_of(k)) / 2, F.lit(2.0))

    observed = matrix.join(F.broadcast(table)).agg(F.sum(F.col("o") * distance(F.col("c"), F.col("k"))).alias("d"), F.max("total").alias("total"))
    other = sums.select(F.col("c").alias("k"), F.col("n").alias("nk"))
    expected = sums.join(F.broadcast(other)).join(F.broadcast(table)).agg(F.sum(F.col("n") * F.col("nk") * distance(F.col("c"), F.col("k"))).alias("e"))
    size = items.agg(F.count("*").alias("n_items"))
    return observed.join(F.broadcast(expected)).join(F.broadcast(size)).select((1 - F.try_divide(F.col("d") * (F.col("total") - 1), F.col("e"))).alias("coefficient"), "n_items")


def ac2(ratings: DataFrame, scale: tuple[int, int] = (1, 5), weights: str = "quadratic") -> DataFrame:
    """Gwet's AC2 of ratings(item_id, rater_id, label): coefficient and n_items of two ratings or more.

    Null if all ratings are alike or chance explains all agreement.
    """
    span, q = scale[1] - scale[0], scale[1] - scale[0] + 1
    counts = checked(ratings, scale).groupBy("item_id", "label").agg(F.count("*").alias("k"))
    items = counts.groupBy("item_id").agg(F.sum("k").alias("r"), F.collect_list(F.struct("label", "k")).alias("labels")).filter("r > 1")
    agree = lambda a, b: 1 - disagreement(a, b, span, weights)
    near = lambda x: F.aggregate("labels", F.lit(0.0), lambda acc, y: acc + agree(x["label"], y["label"]) * y["k"])
    own = F.aggregate("labels", F.lit(0.0), lambda acc, x: acc + x["k"] * (near(x) - 1)) / (F.col("r") * (F.col("r") - 1))
    observed = items.agg(F.avg(own).alias("pa"), F.count("*").alias("n_items"))
    shares = items.select("r", F.explode("labels").alias("x")).groupBy(F.col("x.label").alias("c")).agg(F.sum(F.col("x.k") / F.col("r")).alias("s"))
    total = sum((1 - (abs(a - b) / span) ** (2 if weights == "quadratic" else 1)) for a in range(q) for b in range(q))
    pi = F.col("s") / F.col("n_items")
    chance = shares.join(F.broadcast(observed)).agg(F.sum(pi * (1 - pi)).alias("v"), F.count("*").alias("labels"))
    pe = F.lit(total / (q * (q - 1))) * F.col("v")
    value = F.when((F.col("labels") > 1) & (pe < 1), (F.col("pa") - pe) / (1 - pe))
    return observed.join(F.broadcast(chance)).select(value.alias("coefficient"), "n_items")


def variability(ratings: DataFrame, least: int = 2) -> DataFrame:
    """item_id, spread and high (spread >= least) of items with two ratings or more."""
    items = ratings.filter("label is not null").groupBy("item_id").agg(F.count("*").alias("n"), (F.max("label") - F.min("label")).alias("spread")).filter("n > 1")
    return items.select("item_id", "spread", (F.col("spread") >= least).alias("high"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; 0 without spread."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def percentile_of(values: Sequence[float], percent: float) -> float:
    """Linear interpolation between sorted values."""
    at = (len(values) - 1) * percent / 100
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


def bootstrap(items: DataFrame, groups: list[str], value: str, estimator: Callable[[list], float | None], times: int = 200, seed: int = 7) -> DataFrame:
    """Per group: lo and hi, the 2.5th and 97.5th percentile of estimator over resamples; null for fewer than two items.

    Resamples where the estimator is None are skipped. A group's items are drawn in the order of their values, so the
    draws don't depend on partitions. A group must fit a task.
    """
    types = dict(items.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values, draw, out = sorted(pdf[value].dropna().tolist()), random.Random(seed), []
        if len(values) > 1:
            for _ in range(times):
                got = estimator([values[draw.randrange(len(values))] for _ in values])
                if got is not None:
                    out.append(got)
        out.sort()
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] for g in groups}, "lo": [percentile_of(out, 2.5) if out else None], "hi": [percentile_of(out, 97.5) if out else None]}, dtype=object)

    return items.select(*groups, value).groupBy(*groups).applyInPandas(run, ", ".join(f"{g} {types[g]}" for g in groups) + ", lo double, hi double")
