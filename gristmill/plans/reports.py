"""Queries behind reports and the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.stats import ratio
from gristmill.operators import report as op

from .base import table
from .registry import query


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the dashboard: scores of customers, of whom some have none."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS score")


CUSTOMERS_SQL = "SELECT c_custkey, c_name, c_mktsegment, c_nationkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS score FROM customer"


@query("flt_dashboard_qa", f"SELECT * FROM ({CUSTOMERS_SQL}) WHERE c_mktsegment = 'BUILDING' AND score BETWEEN 0 AND 5000 AND contains(lower(c_name), '1')")
def flt_dashboard_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.dashboard_filter(customers(spark, sf_dir), {"c_mktsegment": "BUILDING", "c_nationkey": None}, ("score", 0, 5000), (["c_name"], "1"))


@query("flt_dashboard_tr", f"SELECT * FROM ({CUSTOMERS_SQL}) WHERE c_nationkey = 3 AND score >= 100 AND (contains(lower(c_name), 'auto') OR contains(lower(c_mktsegment), 'auto'))")
def flt_dashboard_tr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.dashboard_filter(customers(spark, sf_dir), {"c_nationkey": 3}, ("score", 100, None), (["c_name", "c_mktsegment"], "AUTO"))


@query("srt_dashboard", f"SELECT c_custkey, score, row_number() OVER (ORDER BY score DESC NULLS FIRST, c_custkey) AS place FROM ({CUSTOMERS_SQL}) ORDER BY place LIMIT 200")
def srt_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pages of the sorted view, with their places: a report of the top."""
    from pyspark.sql import Window

    top = customers(spark, sf_dir).orderBy(*op.order_of("score", True, "c_custkey")).limit(200)
    return top.select("c_custkey", "score", F.row_number().over(Window.orderBy(*op.order_of("score", True, "c_custkey"))).alias("place"))


@query("lim_page", f"SELECT c_custkey, c_name, score FROM ({CUSTOMERS_SQL}) ORDER BY score ASC NULLS LAST, c_custkey LIMIT 40 OFFSET 80")
def lim_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.page(customers(spark, sf_dir).select("c_custkey", "c_name", "score"), op.order_of("score", False, "c_custkey"), 3, 40)


@query("lim_page_count", f"SELECT count(*) AS total, greatest(1, ceil(count(*) / 40.0))::BIGINT AS total_pages FROM ({CUSTOMERS_SQL})")
def lim_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.page_count(customers(spark, sf_dir), 40)


@query("prj_derived", "SELECT l_returnflag, round(count_if(l_quantity > 25) / count(*), 6) AS validation_rate, round(count(DISTINCT l_linestatus) / count(*), 6) AS relation_diversity, round((0.3 * count_if(l_quantity > 25) / count(*) + 0.3 * least(count(*) / 3e4, 1.0)) / 0.6, 6) AS overall FROM lineitem GROUP BY l_returnflag")
def prj_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates, and an overall score weighted over the parts that are there."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("valid"), F.count("*").alias("n"), F.count_distinct("l_linestatus").alias("kinds"))
    parts = [(0.3, ratio(F.col("valid"), F.col("n"))), (0.2, F.lit(None).cast("double")), (0.3, F.least(F.col("n") / 3e4, F.lit(1.0)))]
    total = sum(F.when(v.isNotNull(), w * v).otherwise(0.0) for w, v in parts) / sum(F.when(v.isNotNull(), w).otherwise(0.0) for w, v in parts)
    return g.select("l_returnflag", F.round(parts[0][1], 6).alias("validation_rate"), F.round(ratio(F.col("kinds"), F.col("n")), 6).alias("relation_diversity"), F.round(total, 6).alias("overall"))


@query("prj_explode_pairs", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS idx, conv_id || ':none:' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS qa_pair_id, role, text FROM conversations")
def prj_explode_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of pairs to a row each, with the identifier that later stages join by."""
    records = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("qa_pairs"))
    rows = records.select("conv_id", F.posexplode("qa_pairs").alias("idx", "p"))
    return rows.select("conv_id", "idx", F.concat_ws(":", F.col("conv_id").cast("string"), F.lit("none"), F.col("idx").cast("string")).alias("qa_pair_id"), "p.role", "p.text")


@query("agg_run_summary", """SELECT source AS run, count(*) AS items, count_if(quality = 1) AS valid, count_if(quality = 0) AS invalid, count_if(quality IS NULL) AS unjudged, coalesce(max(CASE WHEN quality = 1 THEN lang END), max(lang)) AS language FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def agg_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    q = F.col("quality")
    return d.groupBy(F.col("source").alias("run")).agg(F.count("*").alias("items"), F.count_if(q == 1).alias("valid"), F.count_if(q == 0).alias("invalid"), F.count_if(q.isNull()).alias("unjudged"), F.coalesce(F.max(F.when(q == 1, F.col("lang"))), F.max("lang")).alias("language"))


FUNNEL_SQL = "WITH c AS (SELECT count(*) AS a, count_if(quality = 1) AS b, count_if(quality = 1 AND doc_id % 2 = 0) AS c, count_if(toxic = 0) AS d FROM documents LEFT JOIN labels USING (doc_id))"


@query("agg_funnel", f"{FUNNEL_SQL} SELECT 0 AS ord, 'transcriptions' AS stage, a AS n, 0 AS dropped FROM c UNION ALL SELECT 1, 'valid', b, greatest(0, a - b) FROM c UNION ALL SELECT 2, 'qa', c, greatest(0, b - c) FROM c UNION ALL SELECT 3, 'valid_qa', d, greatest(0, c - d) FROM c")
def agg_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    counts = d.agg(F.count("*").alias("a"), F.count_if(F.col("quality") == 1).alias("b"), F.count_if((F.col("quality") == 1) & (F.col("doc_id") % 2 == 0)).alias("c"), F.count_if(F.col("toxic") == 0).alias("d"))
    return op.funnel([("transcriptions", F.col("a")), ("valid", F.col("b")), ("qa", F.col("c")), ("valid_qa", F.col("d"))], counts)


@query("agg_bloom_dist", "SELECT source, count_if(lang = 'de') AS de, count_if(lang = 'en') AS en, count_if(lang = 'es') AS es, count_if(lang = 'it') AS it FROM documents GROUP BY source")
def agg_bloom_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "it"]).count().fillna(0)


@query("agg_participants", "SELECT coalesce(d.p, q.p) AS participant, coalesce(d.n, 0) AS documents, coalesce(q.n, 0) AS pairs FROM (SELECT coalesce(CASE WHEN doc_id % 9 <> 0 THEN source END, 'Unknown') AS p, count(*) AS n FROM documents GROUP BY 1) d FULL JOIN (SELECT 'src' || (conv_id % 25) AS p, count(*) AS n FROM conversations GROUP BY 1) q ON d.p = q.p")
def agg_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy(F.coalesce(F.when(F.col("doc_id") % 9 != 0, F.col("source")), F.lit("Unknown")).alias("participant")).agg(F.count("*").alias("documents"))
    q = table(spark, sf_dir, "conversations").groupBy(F.concat(F.lit("src"), F.col("conv_id") % 25).alias("participant")).agg(F.count("*").alias("pairs"))
    return d.join(q, "participant", "full").fillna(0, ["documents", "pairs"])


@query("agg_location_tree", "SELECT r_name, n_name, count(*) AS n, (grouping(r_name) * 2 + grouping(n_name))::BIGINT AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def agg_location_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.grouping_id().alias("depth"))


@query("agg_multihop", "SELECT count_if(l_linenumber > 1) AS multi, count_if(l_linenumber = 1) AS single FROM lineitem")
def agg_multihop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.count_if(F.col("l_linenumber") > 1).alias("multi"), F.count_if(F.col("l_linenumber") == 1).alias("single"))


@query("agg_hist_quality", "SELECT least(floor(((p_partkey * 7919) % 1001) / 1000e0 / (1.0::DOUBLE / 20)), 19)::INTEGER AS bin, count(*) AS n FROM part WHERE p_partkey % 10 <> 0 GROUP BY 1")
def agg_hist_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("CASE WHEN p_partkey % 10 <> 0 THEN ((p_partkey * 7919) % 1001) / 1000e0 END AS q")
    return op.histogram(p, "q", 20)


@query("agg_hist_conf", "SELECT least(floor(((p_partkey * 104729) % 1001) / 1000e0 / (1.0::DOUBLE / 30)), 29)::INTEGER AS bin, count(*) AS n FROM part GROUP BY 1")
def agg_hist_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.histogram(table(spark, sf_dir, "part").selectExpr("((p_partkey * 104729) % 1001) / 1000e0 AS q"), "q", 30)


@query("agg_validity_rate", "SELECT count_if(quality = 1) AS valid, count_if(quality = 0) AS invalid FROM labels")
def agg_validity_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").agg(F.count_if(F.col("quality") == 1).alias("valid"), F.count_if(F.col("quality") == 0).alias("invalid"))


@query("agg_radar", "SELECT l_shipmode_run AS run, round(coalesce(avg(l_quantity / 50), 0), 6) AS quantity, round(coalesce(avg(l_discount), 0), 6) AS discount, round(coalesce(avg(CASE WHEN l_shipmode_run < 3 THEN l_tax END), 0), 6) AS tax FROM (SELECT *, l_orderkey % 5 AS l_shipmode_run FROM lineitem) GROUP BY 1")
def agg_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumn("run", F.col("l_orderkey") % 5)  # noqa: E741
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return l.groupBy("run").agg(mean(F.col("l_quantity") / 50).alias("quantity"), mean(F.col("l_discount")).alias("discount"), mean(F.when(F.col("run") < 3, F.col("l_tax"))).alias("tax"))


CRITERIA = ["quantity", "discount", "tax"]
LINES = ["l_returnflag AS level", "CASE WHEN l_partkey % 8 <> 0 THEN l_quantity / 50 END AS quantity", "l_discount * 10 AS discount", "CASE WHEN l_suppkey % 6 <> 0 THEN l_tax * 10 END AS tax"]


@query("agg_bloom_heatmap", " UNION ALL ".join(f"SELECT level, '{c}' AS criterion, round(coalesce(avg({c}), 0), 6) AS mean, round(coalesce(stddev_pop({c}), 0), 6) AS std, count({c}) AS n, coalesce(avg({c}) < 0.5, false) AS warn, CASE WHEN count({c}) = 0 THEN 'N/A' ELSE '' END AS note FROM (SELECT {', '.join(LINES)} FROM lineitem) GROUP BY level" for c in CRITERIA))
def agg_bloom_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.heatmap(table(spark, sf_dir, "lineitem").selectExpr(*LINES), "level", CRITERIA, 0.5)
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


CORR_SQL = f"WITH f AS (SELECT {', '.join(LINES)} FROM lineitem), c AS (SELECT * FROM f WHERE {' AND '.join(f'{c} IS NOT NULL' for c in CRITERIA)}) "


@query("agg_corr", CORR_SQL + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({1.0 if a == b else f'coalesce(corr({a}, {b}), 0)'}, 6)::DOUBLE AS r FROM c" + " HAVING count(*) > 0" for a in CRITERIA for b in CRITERIA))
def agg_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.correlations(table(spark, sf_dir, "lineitem").selectExpr(*LINES), CRITERIA).withColumn("r", F.round("r", 6))


@query("agg_violin", "SELECT coalesce(seg, 'Unknown') AS seg, min(c_acctbal) AS lo, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(quantile_cont(c_acctbal, 0.5), 6) AS q2, round(quantile_cont(c_acctbal, 0.75), 6) AS q3, max(c_acctbal) AS hi, round(avg(c_acctbal), 6) AS mean, count(*) AS n FROM (SELECT *, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS seg FROM customer) GROUP BY 1")
def agg_violin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("seg", F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")))
    out = op.distribution(c, "seg", "c_acctbal")
    return out.withColumns({n: F.round(n, 6) for n in ("q1", "q2", "q3", "mean")})


@query("agg_parallel", f"SELECT level, CASE level WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS level_index, {', '.join(CRITERIA)} FROM (SELECT {', '.join(LINES)} FROM lineitem) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in CRITERIA)}")
def agg_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(*LINES).dropna(subset=CRITERIA)
    return rows.withColumn("level_index", (F.array_position(F.array(*map(F.lit, "ANR")), F.col("level")) - 1).cast("int"))


RUNS = "o_custkey AS run, min(o_orderdate) AS started, count(*) AS items, count_if(o_orderstatus = 'F') AS done, count_if(o_orderstatus = 'P') AS failed"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.min("o_orderdate").alias("started"), F.max("o_orderdate").alias("ended"), F.count("*").alias("items"), F.count_if(s == "F").alias("done"), F.count_if(s == "P").alias("failed"))


@query("agg_run_overview", f"SELECT run, items, round_even(100e0 * done / nullif(done + failed, 0), 2) AS success_rate, epoch(ended) - epoch(started) AS duration_s FROM (SELECT {RUNS}, max(o_orderdate) AS ended FROM orders GROUP BY o_custkey)")
def agg_run_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("run", "items", op.success_rate(F.col("done"), F.col("failed")).alias("success_rate"), (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))).cast("double").alias("d")).select("run", "items", "success_rate", (F.col("d") / 1e6).alias("duration_s"))


@query("agg_timeline", f"SELECT run, (started::VARCHAR)[:10] AS day, greatest(8, least(30, 2 * items)) AS marker FROM (SELECT {RUNS} FROM orders GROUP BY o_custkey)")
def agg_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).filter("started is not null").orderBy("started", "run").select("run", F.date_format("started", "yyyy-MM-dd").alias("day"), F.greatest(F.lit(8), F.least(F.lit(30), 2 * F.col("items"))).alias("marker"))


@query("agg_consensus", "SELECT p_brand, CASE WHEN count(DISTINCT p_size % 2) = 1 THEN max(p_size % 2) END AS threshold FROM part GROUP BY p_brand")
def agg_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(op.consensus(F.col("p_size") % 2).alias("threshold"))


@query("agg_distinct_filters", "SELECT 'location' AS filter, list_sort(list(DISTINCT x)) AS found FROM (SELECT source AS x FROM documents UNION SELECT role FROM conversations) UNION ALL SELECT 'level', list_sort(list(DISTINCT lang)) FROM documents")
def agg_distinct_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    one = lambda name, rows: rows.filter("x <> ''").agg(F.lit(name).alias("filter"), F.sort_array(F.collect_set("x")).alias("found"))
    return one("location", d.select(F.col("source").alias("x")).union(c.select("role")).distinct()).union(one("level", d.select(F.col("lang").alias("x"))))


@query("agg_cost_model", "SELECT count(*) AS docs, sum(ceil(n_chars / 4000.0))::BIGINT AS chunks, sum(ceil(n_chars / 4000.0))::BIGINT * 6 AS calls, sum(ceil(n_chars / 4000.0))::BIGINT * 6 * 1500 AS tokens_in, sum(ceil(n_chars / 4000.0))::BIGINT * 6 * 300 AS tokens_out, round(sum(ceil(n_chars / 4000.0)) * 6 * 1500 / 1e6 * 0.5 + sum(ceil(n_chars / 4000.0)) * 6 * 300 / 1e6 * 1.5, 6) AS usd FROM documents")
def agg_cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cost(table(spark, sf_dir, "documents"), "n_chars", 4000, 6, 1500, 300, 0.5, 1.5).withColumn("usd", F.round("usd", 6))
