"""Canonical exact fingerprints of documents, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, kept

#: Bytes of the texts at bucket borders that are broadcast at most; beyond, they are joined by a shuffle.
BORDER_BYTES = 64 << 20
#: Bytes of text that a range of keys holds on average at most.
RANGE_BYTES = 128 << 20
NO_ID = -(1 << 63)


def icu(name: str, method: str, *args: Column | bool) -> Column:
    return F.reflect(F.lit(f"com.ibm.icu.{name}"), F.lit(method), *(a if isinstance(a, Column) else F.lit(a) for a in args))


def canonical(text: Column) -> Column:
    """Unicode normalisation (NFKC), full case folding, NFKC again, white space folded to single spaces, trimmed."""
    folded = icu("lang.UCharacter", "foldCase", icu("text.Normalizer", "compose", text, True), True)
    return F.trim(F.regexp_replace(icu("text.Normalizer", "compose", folded, True), r"[\s\p{Z}]+", " "))


def hashes(canon: Column) -> list[Column]:
    """Three 64-bit xxhashes with different seeds."""
    return [F.xxhash64(F.lit(i), canon) for i in range(3)]


def fingerprint(canon: Column) -> Column:
    """192 bits as 48 hexadecimal digits."""
    return F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in hashes(canon)))


def collisions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Canonical texts that share a fingerprint with a different one: (fingerprint, canon, ordinal from 1 on).

    Within each bucket of equal fingerprints the canonical texts themselves are grouped, so their bytes are compared;
    copies are combined before the shuffle, and only buckets of several rows are looked at. The first text of a bucket
    (by its least key) has ordinal 0 and isn't returned; with 192 bits the result is empty but for forged input.
    """
    rows = docs.select(F.coalesce(F.col(key), F.lit(NO_ID)).alias("k"), canonical(F.coalesce(F.col(text), F.lit(""))).alias("canon"))
    marked = kept(rows.select("k", *(h.alias(f"h{i}") for i, h in enumerate(hashes(F.col("canon"))))), "fingerprints")
    several = kept(marked.groupBy("h0", "h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "buckets")
    keys = marked.join(broadcast_if_small(several, several.count()), ["h0", "h1", "h2"], "left_semi").select("k").distinct()
    texts = rows.join(broadcast_if_small(keys, keys.count()), "k", "left_semi")
    groups = texts.groupBy(fingerprint(F.col("canon")).alias("fingerprint"), "canon").agg(F.min("k").alias("k"))
    collided = groups.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    numbered = groups.join(collided, "fingerprint", "left_semi").withColumn("ordinal", F.row_number().over(Window.partitionBy("fingerprint").orderBy("k", "canon")) - 1)
    return numbered.filter("ordinal > 0").select("fingerprint", "canon", "ordinal")


def distinguished(rows: DataFrame, found: DataFrame, canon: str = "canon") -> DataFrame:
    """rows(fingerprint, canon, ...) with the ordinals of found, what collisions() gave, appended to fingerprints."""
    if found.isEmpty():
        return rows
    found = found.withColumnRenamed("canon", canon)
    return rows.join(found, ["fingerprint", canon], "left").withColumn("fingerprint", F.concat("fingerprint", F.coalesce(F.concat(F.lit("-"), F.col("ordinal")), F.lit("")))).drop("ordinal")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with canon and fingerprint, equal exactly where canonical texts are; a null text counts as empty.

    Texts that differ but share a hash get their ordinal appended. Columns canon, fingerprint, ordinal are replaced.
    """
    docs = docs.drop("canon", "fingerprint", "ordinal")
    rows = docs.withColumn("canon", canonical(F.coalesce(F.col(text), F.lit("")))).withColumn("fingerprint", fingerprint(F.col("canon")))
    return distinguished(rows, collisions(docs, key, text))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "next_text", buckets: int | None = None) -> DataFrame:
    """docs with the text of the next row by key, then by text; the last row's next is the first. Null keys come first.

    Rows are dealt to ranges of keys (borders from approximate percentiles, found by two short searches), each ordered
    by itself in one shuffle; only the first text of each range is looked up across ranges. A null text counts as empty.
    There is a range for each shuffle partition or each RANGE_BYTES of text, whichever are more.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("__k", F.coalesce(F.col(key), F.lit(NO_ID))).withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    if not (n := buckets):
        volume = rows.agg(F.sum(F.octet_length("__t"))).first()[0] or 0
        n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // RANGE_BYTES))
    found = rows.select(F.percentile_approx("__k", [i / n for i in range(1, n)], 10 * n).alias("p")).first()["p"] or []
    borders = sorted(set(found))
    step = max(1, math.isqrt(len(borders)))
    parts = [borders[i : i + step] for i in range(0, len(borders), step)] or [[]]
    lits = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda b: b < F.col("__k")))
    coarse = below(lits([p[-1] for p in parts[:-1]]))
    rows = rows.withColumn("__c", coarse).withColumn("__b", F.col("__c") * (step + 1) + below(F.element_at(F.array(*map(lits, parts)), F.col("__c") + 1)))
    firsts = {r["__b"]: r["k"] for r in rows.groupBy("__b").agg(F.min("__k").alias("k")).collect()}  # a row for each range
    order = sorted(firsts)
    after = spark.createDataFrame([(b, firsts[order[(i + 1) % len(order)]]) for i, b in enumerate(order)], "__b int, __first long")
    heads = rows.join(F.broadcast(after.select(F.col("__first").alias("__k")).distinct()), "__k", "left_semi").groupBy("__k").agg(F.min("__t").alias("__head"))
    heads = kept(after.join(heads, after["__first"] == heads["__k"]).select("__b", "__head"), "heads")
    size = heads.agg(F.sum(F.octet_length("__head"))).first()[0] or 0
    rows = rows.repartition(n, "__b")  # as many tasks as ranges, whatever the setting for shuffles
    following = F.lead("__t").over(Window.partitionBy("__b").orderBy("__k", "__t"))
    out = rows.withColumn("__next", following).join(F.broadcast(heads) if size <= BORDER_BYTES else heads, "__b", "left")
    return out.withColumn(name, F.coalesce("__next", "__head")).drop("__k", "__t", "__b", "__c", "__next", "__head")


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of the text with its last quarter replaced by the next document's start, and likeness.

    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next: an exact
    fingerprint is like another (1.0) or not (0.0), held equal only if the canonical texts are too. A null text counts
    as empty; empty texts are all equal. Repeated rows follow each other. Other columns are left aside.
    """
    slim = docs.select(F.col(key), F.col(text))
    rows = with_next(slim, key, text).withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    n = F.length("__t")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.withColumn("__e", F.concat(F.substring("__t", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter)))
    rows = rows.withColumn("canon", canonical(F.col("__t"))).withColumn("__ce", canonical(F.col("__e"))).withColumn("__cn", canonical(F.col("next_text")))
    like = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    rows = rows.select(
        key, n.cast("long").alias("n_chars"), F.sha2(F.col("__e").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("canon")).alias("fingerprint"), fingerprint(F.col("__ce")).alias("edited_fingerprint"),
        like("canon", "__ce").alias("near_edited"), like("canon", "__cn").alias("near_next"), "canon",
    )
    return distinguished(rows, collisions(slim, key, text)).drop("canon")
