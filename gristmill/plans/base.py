"""Frames that the queries run on, made from the driver's tables, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of tables that are known to be tiny whatever the scale: these may be broadcast.
TINY = {"region": 5, "nation": 25, "benchmark": 10_000}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Answers: one for each document; unlabelled ones are unjudged.
ANSWERS = [
    "d.doc_id AS qa_pair_id", "d.source AS arm", "d.lang AS level", "coalesce(l.quality = 1, false) AS is_answerable", "coalesce(l.toxic = 1, d.doc_id % 5 = 0) AS abstained",
    "CASE WHEN l.doc_id IS NOT NULL THEN ((d.doc_id * 7919) % 1000) / 1e3 END AS abstention_score",
    "CASE WHEN d.doc_id % 11 <> 0 THEN ((d.doc_id * 104729) % 1000) / 1e3 END AS correctness", "((d.doc_id * 1299709) % 1000) / 1e3 AS faithfulness",
    "((d.doc_id * 15485863) % 1000) / 1e3 AS passage_coverage", "CASE WHEN d.doc_id % 7 <> 0 THEN ((d.doc_id * 32452843) % 1000) / 1e3 END AS source_recovery",
]
ANSWERS_SQL = f"SELECT {', '.join(ANSWERS)} FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents").alias("d"), table(spark, sf_dir, "labels").alias("l")  # noqa: E741
    return d.join(l, F.col("d.doc_id") == F.col("l.doc_id"), "left").selectExpr(*ANSWERS)


LABEL_SQL = "CASE WHEN abstention_score IS NULL THEN 'unknown' WHEN abstained AND abstention_score >= 0.625 THEN CASE WHEN is_answerable THEN 'FA' ELSE 'TA' END ELSE CASE WHEN is_answerable THEN 'TC' ELSE 'FC' END END"

#: Scores of questions, long: three criteria a document, on quarter steps, some missing.
SCORES_SQL = """SELECT doc_id AS qa_pair_id, criterion, CASE WHEN (doc_id + k) % 13 <> 0 THEN ((doc_id * 31 + (k * doc_id) % 3) % 5) / 4e0 END AS score
FROM documents, (VALUES ('faithfulness', 1), ('bloom', 2), ('informative', 3)) c(criterion, k) WHERE doc_id % 4 <> 0"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("doc_id % 4 <> 0").select("doc_id", F.explode(F.expr("array(named_struct('criterion', 'faithfulness', 'k', 1), named_struct('criterion', 'bloom', 'k', 2), named_struct('criterion', 'informative', 'k', 3))")).alias("c"))
    return d.selectExpr("doc_id AS qa_pair_id", "c.criterion AS criterion", "CASE WHEN (doc_id + c.k) % 13 <> 0 THEN ((doc_id * 31 + (c.k * doc_id) % 3) % 5) / 4e0 END AS score")


#: Ratings: four raters an order, on a scale of 1 to 5, some missing.
RATINGS_SQL = """SELECT o_orderkey AS item_id, 'r' || k AS rater_id, CASE WHEN (o_orderkey + k) % 9 <> 0 THEN (1 + (o_orderkey * 7 + (CASE WHEN (o_orderkey // 3) % 3 = 0 THEN k ELSE 0 END)) % 5)::INTEGER END AS label
FROM orders, (SELECT unnest(range(1, 5)) AS k)"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"))
    return o.selectExpr("o_orderkey AS item_id", "concat('r', k) AS rater_id", "CASE WHEN (o_orderkey + k) % 9 <> 0 THEN CAST(1 + (o_orderkey * 7 + (CASE WHEN (o_orderkey div 3) % 3 = 0 THEN k ELSE 0 END)) % 5 AS INT) END AS label")


#: A graph of named nodes: regions, nations, customers and suppliers, parts; edges by nation, region and order lines.
NODES_SQL = """SELECT 'r' || r_regionkey AS node_id, r_name AS label, 'concept' AS type, NULL::BIGINT AS file_id FROM region
UNION ALL SELECT 'n' || n_nationkey, n_name, 'concept', NULL FROM nation
UNION ALL SELECT 'c' || c_custkey, c_name, 'entity', c_custkey % 50 FROM customer
UNION ALL SELECT 's' || s_suppkey, s_name, 'entity', s_suppkey % 50 FROM supplier
UNION ALL SELECT 'p' || p_partkey, p_name, 'event', p_partkey % 50 FROM part"""
EDGES_SQL = """SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'has_concept' AS relation, 'Concept' AS type FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'has_concept', 'Concept' FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'has_concept', 'Concept' FROM supplier
UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, CASE WHEN (l_suppkey + l_partkey) % 3 = 0 THEN 'is participated by' ELSE 'Supplies' END, 'Relation' FROM lineitem
UNION ALL SELECT DISTINCT 'c' || o_custkey, 'p' || l_partkey, 'orders', 'Relation' FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    parts = [
        t("region").selectExpr("concat('r', r_regionkey) AS node_id", "r_name AS label", "'concept' AS type", "CAST(NULL AS BIGINT) AS file_id"),
        t("nation").selectExpr("concat('n', n_nationkey)", "n_name", "'concept'", "CAST(NULL AS BIGINT)"), t("customer").selectExpr("concat('c', c_custkey)", "c_name", "'entity'", "c_custkey % 50"),
        t("supplier").selectExpr("concat('s', s_suppkey)", "s_name", "'entity'", "s_suppkey % 50"), t("part").selectExpr("concat('p', p_partkey)", "p_name", "'event'", "p_partkey % 50"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def edges(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """As EDGES_SQL. Keys are made distinct before they are written out as names; not if edges needn't occur once."""
    t = lambda n: table(spark, sf_dir, n)
    unique = lambda df: df.distinct() if once else df
    lines = t("lineitem")
    bought = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    parts = [
        t("nation").selectExpr("concat('n', n_nationkey) AS src", "concat('r', n_regionkey) AS dst", "'has_concept' AS relation", "'Concept' AS type"),
        t("customer").selectExpr("concat('c', c_custkey)", "concat('n', c_nationkey)", "'has_concept'", "'Concept'"), t("supplier").selectExpr("concat('s', s_suppkey)", "concat('n', s_nationkey)", "'has_concept'", "'Concept'"),
        unique(lines.select("l_suppkey", "l_partkey")).selectExpr("concat('s', l_suppkey)", "concat('p', l_partkey)", "CASE WHEN (l_suppkey + l_partkey) % 3 = 0 THEN 'is participated by' ELSE 'Supplies' END", "'Relation'"),
        unique(bought.select("o_custkey", "l_partkey")).selectExpr("concat('c', o_custkey)", "concat('p', l_partkey)", "'orders'", "'Relation'"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
