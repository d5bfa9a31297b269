"""A quality classifier whose evidence is combined with what its site, and its part of the site, are like.

A logistic regression on measures of the text gives each document's evidence. Sites and their parts have posteriors
of their own, shrunk towards their parent by empirical Bayes: the fewer documents, the nearer to the parent. A
document's odds are then moved from the overall prior to the prior of its part of the site.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_name, kept, prepare, release

#: The classifier is fitted on at most so many labelled documents, those of the least hashes.
FIT_ROWS = 20_000
SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\[\]/-]")
DIGIT = re.compile(r"\d")
MEASURES = ("log_words", "word_length", "symbols", "digits", "repeated", "adjacent", "top_word", "bars", "repeated_lines", "line_words", "one_letter", "capitals")


def measures(text: str | None) -> list[float]:
    """What the classifier sees of a text; all zero for an empty one."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(MEASURES)
    lines = [x for x in text.split("\n") if x]
    counts = Counter(words)
    chars = len(text)
    return [
        math.log1p(n), min(chars / n, 50.0) / 10, len(SYMBOL.findall(text)) / n, len(DIGIT.findall(text)) / chars,
        (1 - len(counts) / n) * min(1.0, math.log1p(n) / 6), sum(map(eq, words, words[1:])) / n, max(counts.values()) / n if n > 20 else 0.0, counts.get("|", 0) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0, math.log1p(n / max(1, len(lines))), sum(len(w) == 1 for w in counts) / n, sum(w[0].isupper() for w in counts) / len(counts),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias


def fit_model(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Model:
    """Ridge logistic regression by Newton steps. With labels of one class only, every document gets that prior."""
    prior = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(y) else (np.zeros(len(MEASURES)), np.ones(len(MEASURES)))
    scale = np.where(scale < 1e-9, 1.0, scale)
    w = np.zeros(len(MEASURES) + 1)
    w[-1] = math.log(prior / (1 - prior))
    if len(y) and 0 < y.sum() < len(y):
        z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(y), 1))])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 0
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6), z.T @ (y - p) - penalty * w)
            w += step
            if abs(step).max() < 1e-8:
                break
    return Model(mean, scale, w[:-1], float(w[-1]), float(prior))


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """Fit on labelled documents; labels(doc_id, quality 0/1). Of contradicting labels the lower counts, null ones don't."""
    given = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    given = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(given), "doc_id")  # at most FIT_ROWS pairs of integers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int32()), pa.array([measures(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = rows.mapInArrow(run, "doc_id long, y int, x array<double>").dropDuplicates(["doc_id"]).collect()
    got.sort(key=lambda r: r["doc_id"])
    return fit_model(np.array([r["x"] for r in got]).reshape(len(got), len(MEASURES)), np.array([r["y"] for r in got], float))


def evidence(docs: DataFrame, model: Model, host: Column, path: Column, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, row (a hash of text, host and path), host, path and logit of every document."""
    rows = docs.select(*keys, F.xxhash64(F.col(text), host, path).alias("row"), host.alias("host"), path.alias("path"), F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", logit double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([measures(t.as_py()) for t in b.column(b.num_columns - 1)]).reshape(b.num_rows, len(MEASURES))
            yield pa.RecordBatch.from_arrays(b.columns[:-1] + [pa.array(model.logit(x))], names=[*b.schema.names[:-1], "logit"])
        release()

    return rows.mapInArrow(run, schema)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def strength(groups: DataFrame, most: float = 1000.0) -> float:
    """How many documents a parent's opinion counts as: variance within groups over variance between them (by moments).

    groups: n, s (sum) and q (sum of squares) of its documents' probabilities, and the parent's mean.
    """
    big = groups.filter("n > 1")
    r = big.agg(F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("parent"), 2)).alias("between")).first()
    if not r["g"] or r["n"] <= r["g"]:
        return most
    within = max(r["within"] / (r["n"] - r["g"]), 1e-6)
    between = (r["between"] - r["g"] * within) / r["n"]
    return min(most, within / between) if between > 0 else most


def posteriors(scored: DataFrame) -> tuple[float, float, float, DataFrame]:
    """The overall mean, how many documents the opinions of all and of a site count as, and per (host, path): numbers of documents and sums of their probabilities, of the site (hn, hs) and of its part (n, s).

    Sums by part and then by site are all that is shuffled, combined before it.
    """
    p = sigmoid(F.col("logit"))
    parts = kept(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")), "site-parts")
    total = parts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    overall = min(max((total["s"] or 0.0) / total["n"] if total["n"] else 0.5, 1e-6), 1 - 1e-6)
    hosts = parts.groupBy("host").agg(*(F.sum(c).alias(c) for c in "nsq")).withColumn("parent", F.lit(overall))
    of_all = strength(hosts)
    hosts = hosts.select(F.col("host").alias("__host"), F.col("n").alias("hn"), F.col("s").alias("hs"), ((F.col("s") + of_all * F.col("parent")) / (F.col("n") + of_all)).alias("parent"))
    parts = parts.join(hosts, F.col("host").eqNullSafe(F.col("__host"))).drop("__host")
    return overall, of_all, strength(parts), parts.select("host", "path", "n", "s", "hn", "hs")


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, least: float = 0.5, model: Model | None = None) -> DataFrame:
    """Per row of docs: doc_id, row, host, path, evidence (of the text alone), host_prior, prior, quality and keep.

    host_prior and prior are what the other documents of its site, and of its part of the site, say of a document: its
    own evidence is left out of them. quality is the probability after both levels; keep is quality >= least. A null text counts as empty and has the
    evidence of one; null hosts and paths are groups of their own; repeated rows are judged alike, and count in their
    site. Without labels all documents are as good as each other (0.5, kept). The documents' text is read once, what
    is gathered per row is a few numbers, and priors reach the rows by a join that hot sites don't gather in.
    """
    prepare(docs.sparkSession)
    host, path = host if host is not None else F.col("source"), path if path is not None else F.col("lang")
    model = model or fit(docs, labels)
    scored = kept(evidence(docs, model, host.cast("string"), path.cast("string")), "quality")
    overall, of_all, of_site, priors = posteriors(scored)
    priors = kept(priors, "site-priors")
    priors = broadcast_if_small(priors, priors.count(), 100_000).withColumnsRenamed({"host": "__host", "path": "__path"})
    joined = scored.join(priors, F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path"))).drop("__host", "__path")
    own = sigmoid(F.col("logit"))
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    joined = joined.withColumn("host_prior", clip((F.col("hs") - own + of_all * overall) / (F.col("hn") - 1 + of_all)))
    joined = joined.withColumn("prior", clip((F.col("s") - own + of_site * F.col("host_prior")) / (F.col("n") - 1 + of_site)))
    quality = sigmoid(F.col("logit") + logit(F.col("prior")) - math.log(overall / (1 - overall)))
    return joined.select("doc_id", "row", "host", "path", sigmoid(F.col("logit")).alias("evidence"), "host_prior", "prior", quality.alias("quality"), (quality >= least).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, least: float = 0.5) -> DataFrame:
    """docs without the rows that classify() rejects; all columns stay as they are."""
    host, path = host if host is not None else F.col("source"), path if path is not None else F.col("lang")
    doc, row = free_name(docs, "__doc"), free_name(docs, "__row")
    bad = kept(classify(docs, labels, host, path, least).filter("not keep").select(F.col("doc_id").alias(doc), F.col("row").alias(row)).distinct(), "rejected")
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text"), host.cast("string"), path.cast("string")) == F.col(row))
    return docs.join(broadcast_if_small(bad, bad.count()), same, "left_anti")
