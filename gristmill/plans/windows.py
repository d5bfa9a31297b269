"""Queries on samples, orders and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import estimate_tokens
from gristmill.operators import sampling as op

from .base import table
from .registry import query


def hashed(seed: int, key: str) -> str:
    return f"sha256('{seed}:' || {key})"


@query("win_stratified_topn", f"SELECT o_orderpriority, o_orderkey, slot_id FROM (SELECT *, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY {hashed(1, 'o_orderkey')}, o_orderkey) - 1)::INTEGER AS slot_id FROM orders) WHERE slot_id < 25")
def win_stratified_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stratified(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", 25, 1, strict=True)


@query("win_seed_sample", f"SELECT lang, doc_id, slot_id FROM (SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY {hashed(42, 'doc_id')}, doc_id) - 1)::INTEGER AS slot_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1) WHERE slot_id < 100")
def win_seed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id").select("lang", "doc_id")
    return op.stratified(passed, "lang", "doc_id", 100, 42)


@query("win_shuffle_task_id", f"SELECT o_orderkey, row_number() OVER (ORDER BY {hashed(5, 'o_orderkey')}, o_orderkey) - 1 AS task_id FROM orders")
def win_shuffle_task_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.shuffled_ids(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("win_passage_index", "SELECT user_id, event_id, user_id || ':' || (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS passage_id FROM events")
def win_passage_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.concat_ws(":", F.col("user_id").cast("string"), i.cast("string")).alias("passage_id"))


@query("win_pack_budget", "SELECT conv_id, turn, used FROM (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM (SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 3) END AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 8) WHERE used <= 200")
def win_pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", estimate_tokens(F.col("text")).alias("cost"))
    return op.packed(rows, "conv_id", "turn", "cost", 200, 8).select("conv_id", "turn", "used")


@query("win_prior_pairs", "SELECT conv_id, turn, coalesce(string_agg(text, ' | ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations")
def win_prior_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.prior(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 3)
    return out.select("conv_id", "turn", F.array_join("prior", " | ").alias("context"))


@query("win_latest_run", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def win_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("win_last_write_wins", "SELECT user_id, event_id, first_seen, value FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS first_seen, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def win_last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.last_write(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id")


@query("win_partial_batch", "SELECT user_id, event_id, i // 4 AS batch FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE i < n // 4 * 4")
def win_partial_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.whole_batches(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 4)


@query("win_rank_norm", "SELECT c_nationkey, c_custkey, r AS rank, round(c_acctbal / top, 6) AS score FROM (SELECT *, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1)::INTEGER AS r, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS top FROM customer) WHERE r < 10")
def win_rank_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.operators.graph import ranked

    rows = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS query", "c_custkey", "c_acctbal AS s")
    return ranked(rows, "c_custkey", 10).select(F.col("query").alias("c_nationkey"), "c_custkey", "rank", F.round("score", 6).alias("score"))


@query("lim_top_predicates", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 3")
def lim_top_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_returnflag", "l_linestatus").limit(3)


@query("set_union_questions", "SELECT item_id AS id, text, true AS is_answerable FROM benchmark UNION ALL SELECT conv_id, text, false FROM conversations WHERE turn = 0")
def set_union_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit(True).alias("is_answerable"))
    return a.unionByName(table(spark, sf_dir, "conversations").filter("turn = 0").select(F.col("conv_id").alias("id"), "text", F.lit(False).alias("is_answerable")))


@query("set_union_labels", "SELECT lower(trim(c_name)) AS label FROM customer UNION SELECT lower(trim(s_name)) FROM supplier UNION SELECT lower(trim(n_name)) FROM nation")
def set_union_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lower(F.trim(c)).alias("label")) for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("nation", "n_name"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("set_union_filters", "SELECT source AS x FROM documents UNION SELECT role FROM conversations ORDER BY x")
def set_union_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("x")).union(table(spark, sf_dir, "conversations").select("role")).distinct().orderBy("x")


@query("set_intersect_tokens", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def set_intersect_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))


@query("set_except_endpoints", "SELECT o_custkey AS c FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0")
def set_except_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c")).subtract(table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0").select("c_custkey"))


@query("set_except_users", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def set_except_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").subtract(table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select("c_custkey"))


@query("set_reusable", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS reusable FROM documents")
def set_reusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, done = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.intersect(done).withColumn("reusable", F.lit(True)).union(d.subtract(done).withColumn("reusable", F.lit(False)))
