"""Queries on agreement between raters and other statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import stats

from .base import RATINGS_SQL, ratings, table
from .registry import query


@query("agg_kappa", f"""WITH b AS (SELECT item_id, max(label) FILTER (rater_id = 'r1') AS a, max(label) FILTER (rater_id = 'r2') AS b FROM ({RATINGS_SQL}) GROUP BY item_id),
p AS (SELECT a, b FROM b WHERE a IS NOT NULL AND b IS NOT NULL), na AS (SELECT a, count(*) AS n FROM p GROUP BY a), nb AS (SELECT b, count(*) AS n FROM p GROUP BY b)
SELECT round(1 - (SELECT sum((a - b) * (a - b)) / count(*) FROM p) / nullif((SELECT sum((a - b) * (a - b) * na.n * nb.n)::DOUBLE FROM na, nb) / (SELECT count(*) * count(*) FROM p), 0), 6) AS coefficient, (SELECT count(*) FROM p) AS n""")
def agg_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.kappa(ratings(spark, sf_dir), "r1", "r2").withColumn("coefficient", F.round("coefficient", 6))


ALPHA_SQL = f"""WITH r AS (SELECT item_id, rater_id, label FROM ({RATINGS_SQL}) WHERE label IS NOT NULL), m AS (SELECT item_id, count(*) AS m FROM r GROUP BY item_id HAVING count(*) > 1),
o AS (SELECT x.label AS c, y.label AS k, sum(1e0 / (m - 1)) AS o FROM r x JOIN r y ON x.item_id = y.item_id AND x.rater_id <> y.rater_id JOIN m ON m.item_id = x.item_id GROUP BY 1, 2),
s AS (SELECT c, sum(o) AS n FROM o GROUP BY c),
d AS (SELECT a.c, b.c AS k, pow((SELECT sum(n) FROM s WHERE s.c BETWEEN least(a.c, b.c) AND greatest(a.c, b.c)) - (a.n + b.n) / 2, 2) AS d, a.n AS nc, b.n AS nk FROM s a, s b)"""


@query("agg_alpha", f"""{ALPHA_SQL} SELECT round(1 - (SELECT sum(o.o * d.d) FROM o JOIN d USING (c, k)) * ((SELECT sum(n) FROM s) - 1) / nullif((SELECT sum(nc * nk * d) FROM d), 0), 6) AS coefficient, (SELECT count(*) FROM m) AS n_items""")
def agg_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.alpha(ratings(spark, sf_dir)).withColumn("coefficient", F.round("coefficient", 6))


@query("agg_ac2", f"""WITH r AS (SELECT item_id, label FROM ({RATINGS_SQL}) WHERE label IS NOT NULL), c AS (SELECT item_id, label, count(*) AS k FROM r GROUP BY 1, 2), m AS (SELECT item_id, sum(k) AS r FROM c GROUP BY 1 HAVING sum(k) > 1),
u AS (SELECT c.*, m.r FROM c JOIN m USING (item_id)), star AS (SELECT a.item_id, a.label, any_value(a.k) AS k, any_value(a.r) AS r, sum((1 - pow((a.label - b.label) / 4e0, 2)) * b.k) AS s FROM u a JOIN u b USING (item_id) GROUP BY 1, 2),
pa AS (SELECT avg(p) AS pa, count(*) AS n FROM (SELECT item_id, sum(k * (s - 1)) / (any_value(r) * (any_value(r) - 1)) AS p FROM star GROUP BY 1)),
pi AS (SELECT label, sum(k / r) / (SELECT n FROM pa) AS pi FROM u GROUP BY 1), tw AS (SELECT sum(1 - pow((a - b) / 4e0, 2)) AS t FROM range(1, 6) x(a), range(1, 6) y(b)),
pe AS (SELECT (SELECT t FROM tw) / 20 * sum(pi * (1 - pi)) AS pe FROM pi)
SELECT round((pa - pe) / (1 - pe), 6) AS coefficient, n::BIGINT AS n_items FROM pa, pe""")
def agg_ac2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ac2(ratings(spark, sf_dir)).withColumn("coefficient", F.round("coefficient", 6))


@query("agg_variability", f"SELECT item_id, max(label) - min(label) AS spread, max(label) - min(label) >= 2 AS high FROM ({RATINGS_SQL}) WHERE label IS NOT NULL GROUP BY item_id HAVING count(*) > 1")
def agg_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.variability(ratings(spark, sf_dir))


@query("agg_percentile", "SELECT p_brand, round(quantile_cont(p_retailprice, 0.025), 6) AS p025, round(quantile_cont(p_retailprice, 0.5), 6) AS p50, round(quantile_cont(p_retailprice, 0.975), 6) AS p975 FROM part GROUP BY p_brand")
def agg_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(*(F.round(F.percentile("p_retailprice", p), 6).alias(n) for n, p in (("p025", 0.025), ("p50", 0.5), ("p975", 0.975))))


@query("agg_bootstrap")
def agg_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of Python's generator, which SQL doesn't have; tests hold it against a loop."""
    return stats.bootstrap(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", lambda xs: sum(xs) / len(xs))


BLOOM = ["remember", "understand", "analyze", "evaluate"]
LEVEL_SQL = "CASE o_orderkey % 5 WHEN 0 THEN 'remember' WHEN 1 THEN 'understand' WHEN 2 THEN 'analyze' ELSE 'remember' END"


@query("agg_population", f"SELECT level, count(o_orderkey) AS n FROM (VALUES ('remember'), ('understand'), ('analyze'), ('evaluate')) l(level) LEFT JOIN orders ON {LEVEL_SQL} = level GROUP BY level")
def agg_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each level, 0 for those without; an unknown level is an error."""
    level = F.expr(LEVEL_SQL)
    known = F.when(level.isin(BLOOM), level).otherwise(F.raise_error(F.lit("unknown level")).cast("string"))
    counts = table(spark, sf_dir, "orders").groupBy(known.alias("level")).agg(F.count("*").alias("n"))
    levels = spark.createDataFrame([(x,) for x in BLOOM], "level string")
    return levels.join(counts, "level", "left").fillna(0, ["n"])


@query("agg_record_bloom", f"SELECT o_custkey, {', '.join(f'count_if({LEVEL_SQL} = $${x}$$) AS {x}' for x in BLOOM)} FROM orders GROUP BY o_custkey")
def agg_record_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", F.expr(LEVEL_SQL).alias("level")).agg(F.count("*").alias("n"))
    maps = counts.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("m"))
    return maps.select("o_custkey", *(F.coalesce(F.try_element_at("m", F.lit(x)), F.lit(0)).alias(x) for x in BLOOM))


@query("agg_validated_pairs", "SELECT conv_id, count(*) AS total_pairs, count_if(length(text) % 3 = 0) AS validated_pairs FROM conversations GROUP BY conv_id")
def agg_validated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", (F.length("text") % 3 == 0).alias("is_valid"))).alias("qa_pairs"))
    return pairs.select("conv_id", F.size("qa_pairs").cast("long").alias("total_pairs"), F.size(F.filter("qa_pairs", lambda p: p["is_valid"])).cast("long").alias("validated_pairs"))


@query("agg_pool_hash", """SELECT o_orderpriority AS cell, sha256(string_agg('{"id":' || o_orderkey || '}', chr(10) ORDER BY '{"id":' || o_orderkey || '}')) AS pool_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('7:' || o_orderkey)) AS place FROM orders) WHERE place <= 200 GROUP BY o_orderpriority""")
def agg_pool_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each stratum's drawn pool, 200 of all orders by hash order."""
    entry = F.concat(F.lit('{"id":'), F.col("o_orderkey"), F.lit("}"))
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("o_orderkey")).cast("binary"), 256)))
    pool = table(spark, sf_dir, "orders").withColumn("place", place).filter("place <= 200")
    return pool.groupBy(F.col("o_orderpriority").alias("cell")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), "\n").cast("binary"), 256).alias("pool_sha256"))
