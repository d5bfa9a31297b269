"""Queries on joins and on what is left out before work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.operators import retrieval as rt

from .base import EDGES_SQL, NODES_SQL, RATINGS_SQL, edges, nodes, ratings, table
from .registry import query


@query("flt_not_rejected", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 0")
def flt_not_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.filter(~(F.col("quality") == 1).eqNullSafe(F.lit(False))).select("doc_id")


@query("flt_qa_tasks", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE CASE WHEN quality IS NOT NULL THEN quality = 1 ELSE length(trim(text, E' \\n\\t\\r')) >= 200 AND len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) >= 30 END")
def flt_qa_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged records by their verdict, unjudged ones by their length."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.filter(F.when(F.col("quality").isNotNull(), F.col("quality") == 1).otherwise(tx.content_length(F.col("text")) == 1)).select("doc_id")


@query("flt_approved", "SELECT lang, count_if(quality = 1) AS approved, count_if(quality = 0) AS rejected, count_if(quality IS NULL) AS unjudged FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def flt_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    q = F.col("quality")
    return d.groupBy("lang").agg(F.count_if(q == 1).alias("approved"), F.count_if(q == 0).alias("rejected"), F.count_if(q.isNull()).alias("unjudged"))


@query("flt_scope", "SELECT 'all' AS scope, count(*) AS n FROM documents UNION ALL SELECT 'approved', count(*) FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def flt_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    keep = {"all": F.lit(True), "approved": F.coalesce(F.col("quality") == 1, F.lit(False))}
    return d.agg(*(F.count_if(c).alias(k) for k, c in keep.items())).select(F.expr("stack(2, 'all', `all`, 'approved', approved) AS (scope, n)"))


@query("jn_text_identity", "SELECT p.page_id, m.id FROM (SELECT conv_id AS page_id, text FROM conversations) p JOIN (SELECT text, max(conv_id) AS id FROM conversations GROUP BY text) m USING (text)")
def jn_text_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By equal texts; of repeated ones the last id holds. The join compares hashes first and then the texts."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "text", F.xxhash64("text").alias("h"))
    m = c.groupBy("h", "text").agg(F.max("conv_id").alias("id"))
    return c.select(F.col("conv_id").alias("page_id"), "h", "text").join(m, ["h", "text"]).select("page_id", "id")


@query("jn_catalog_enrich", "SELECT c_nationkey, count(n_name) AS hits, count_if(n_name IS NULL) AS misses FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON c_nationkey = n_nationkey GROUP BY c_nationkey")
def jn_catalog_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").filter("n_nationkey % 4 <> 0")
    j = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("c_nationkey").agg(F.count("n_name").alias("hits"), F.count_if(F.col("n_name").isNull()).alias("misses"))


@query("jn_task_strict", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def jn_task_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task must be known: a miss ends the whole job."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.select("l_orderkey", "l_linenumber", F.when(F.col("o_orderkey").isNull(), F.raise_error(F.lit("unknown task")).cast("long")).otherwise(F.col("o_custkey")).alias("o_custkey"))


ALIAS_SQL = "WITH known AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS r FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0)), fresh AS (SELECT user_id, (SELECT count(*) FROM known) + row_number() OVER (ORDER BY user_id) AS r FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 3 <> 0)) SELECT user_id, 'A' || r AS alias FROM (SELECT * FROM known UNION ALL SELECT * FROM fresh)"


@query("jn_alias_map", ALIAS_SQL)
def jn_alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New users get the next aliases in the order of their ids; known ones keep theirs. Raters are few: one ordering is enough."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    number = F.row_number().over(Window.orderBy("user_id"))
    known = users.filter("user_id % 3 = 0").select("user_id", number.alias("r"))
    fresh = users.join(known, "user_id", "left_anti").select("user_id", number.alias("r"))
    most = known.agg(F.max("r").alias("most"))
    fresh = fresh.join(F.broadcast(most)).select("user_id", (F.col("r") + F.coalesce("most", F.lit(0))).alias("r"))
    return known.union(fresh).select("user_id", F.concat(F.lit("A"), F.col("r")).alias("alias"))


@query("jn_emic_human", f"SELECT a.item_id, a.label AS judge, b.rater_id, b.label AS human FROM ({RATINGS_SQL}) a JOIN ({RATINGS_SQL}) b USING (item_id) WHERE a.rater_id = 'r1' AND b.rater_id <> 'r1' AND a.label IS NOT NULL AND b.label IS NOT NULL")
def jn_emic_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings(spark, sf_dir).filter("label is not null")
    judge = r.filter("rater_id = 'r1'").select("item_id", F.col("label").alias("judge"))
    return judge.join(r.filter("rater_id <> 'r1'").select("item_id", "rater_id", F.col("label").alias("human")), "item_id")


@query("jn_paired_twin", "SELECT a.turn, a.conv_id, b.text AS parent_text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1")
def jn_paired_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    parent = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("parent_text"))
    return c.select("turn", "conv_id").join(parent, ["conv_id", "turn"]).select("turn", "conv_id", "parent_text")


@query("jn_resume_anti", "SELECT source || '::' || doc_id AS work FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn_resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("::", "source", F.col("doc_id").cast("string")).alias("work"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("work")


@query("jn_seeds_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1)")
def jn_seeds_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    done = labels.filter("quality = 1").select("doc_id").union(labels.filter("toxic = 1").select("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@query("jn_orphan_endpoints", f"WITH n AS (SELECT * FROM ({NODES_SQL}) WHERE file_id IS NULL OR file_id % 7 <> 0), e AS ({EDGES_SQL}) SELECT node_id, label, type FROM n UNION ALL SELECT x, x, 'entity' FROM (SELECT src AS x FROM e UNION SELECT dst FROM e) WHERE x NOT IN (SELECT node_id FROM n)")
def jn_orphan_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of edges that no node stands for are added as entities."""
    n, e = nodes(spark, sf_dir).filter("file_id is null or file_id % 7 <> 0"), edges(spark, sf_dir)
    ends = e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct().join(n, "node_id", "left_anti")
    return n.select("node_id", "label", "type").unionByName(ends.select("node_id", F.col("node_id").alias("label"), F.lit("entity").alias("type")))


@query("jn_phantom_semi", f"SELECT c_custkey FROM customer WHERE 'c' || c_custkey IN (SELECT src FROM ({EDGES_SQL}) WHERE type = 'Relation')")
def jn_phantom_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = edges(spark, sf_dir).filter("type = 'Relation'").select(F.col("src").alias("id"))
    return table(spark, sf_dir, "customer").withColumn("id", F.concat(F.lit("c"), "c_custkey")).join(ends, "id", "left_semi").select("c_custkey")


@query("jn_concept_trim", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def jn_concept_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(done, "p_partkey", "left_anti")


@query("jn_absence", "WITH cand AS (SELECT DISTINCT lower(split_part(text, ' ', 2)) AS word FROM benchmark), corpus AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS word FROM documents) SELECT word FROM cand WHERE regexp_full_match(word, '[a-zà-ÿ]{3,}') AND word NOT IN (SELECT word FROM corpus) AND word NOT IN (SELECT lower(n_name) FROM nation)")
def jn_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements that neither a node's label nor a whole word of the corpus equals: words on both sides, two anti joins."""
    word = F.lower(F.split_part("text", F.lit(" "), F.lit(2)))
    cand = table(spark, sf_dir, "benchmark").select(word.alias("word")).distinct().filter(F.rlike("word", F.lit("^[a-zà-ÿ]{3,}$")))
    corpus = table(spark, sf_dir, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("word")).distinct()
    labels = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("word"))
    return cand.join(F.broadcast(labels), "word", "left_anti").join(corpus, "word", "left_anti")


@query("jn_range_overlap", "SELECT c.doc_id, c.s AS start_char, c.e AS end_char FROM (SELECT doc_id, s, least(s + 512, n) AS e FROM (SELECT doc_id, length(text) AS n, unnest(range(0, greatest(0, ceil((length(text) - 512) / 448.0))::BIGINT + 1)) * 448 AS s FROM documents WHERE length(text) > 0)) c JOIN (SELECT doc_id, 100 AS a, 700 AS b FROM documents) q ON c.doc_id = q.doc_id AND c.s < q.b AND c.e > q.a")
def jn_range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open overlap within a file: an equality on the file, the rest a condition of the join."""
    d = table(spark, sf_dir, "documents")
    c = rt.window_chunks(d, "doc_id", "text", "token_512")
    q = d.select(F.col("doc_id").alias("source_file_id"), F.lit(100).alias("a"), F.lit(700).alias("b"))
    return c.join(q, "source_file_id").filter("start_char < b and end_char > a").select(F.col("source_file_id").alias("doc_id"), "start_char", "end_char")


LOCATE_SQL = "SELECT doc_id, doc_id AS passage_id, CASE WHEN doc_id % 5 = 0 THEN 'not in there' ELSE substring(text, 11, 40) END AS needle FROM documents"


@query("jn_substring_locate", f"SELECT p.doc_id, passage_id, CASE WHEN strpos(text, needle) > 0 THEN strpos(text, needle) - 1 END AS start, CASE WHEN strpos(text, needle) > 0 THEN strpos(text, needle) - 1 + length(needle) END AS \"end\", CASE WHEN strpos(text, needle) > 0 THEN 'exact' ELSE 'unmatched' END AS how FROM ({LOCATE_SQL}) p JOIN documents d ON d.doc_id = p.doc_id WHERE needle <> ''")
def jn_substring_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    p = d.select("doc_id", F.col("doc_id").alias("passage_id"), F.when(F.col("doc_id") % 5 == 0, "not in there").otherwise(F.substring("text", 11, 40)).alias("needle")).filter("needle <> ''")
    return rt.located(p, d, "doc_id")


@query("jn_postings", "WITH q AS (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))) AS token FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))) AS token FROM documents) SELECT item_id, doc_id, count(*) AS shared FROM q JOIN d USING (token) GROUP BY 1, 2")
def jn_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("token"))
    return d.join(q, "token").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))


@query("jn_arms_questions", "SELECT arm, item_id FROM benchmark, (VALUES ('bm25'), ('khop'), ('null')) a(arm)")
def jn_arms_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms by questions: the arms are a fixed list, so each question is repeated in place."""
    return table(spark, sf_dir, "benchmark").select(F.explode(F.array(*map(F.lit, ("bm25", "khop", "null")))).alias("arm"), "item_id")


@query("jn_file_attrib", f"SELECT node_id, trim(f) AS file_id FROM (SELECT node_id, unnest(string_split(file_id || ', ' || (file_id + 1), ',')) AS f FROM ({NODES_SQL}) WHERE file_id IS NOT NULL)")
def jn_file_attrib(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.operators.graph import attributed

    n = nodes(spark, sf_dir).filter("file_id is not null").withColumn("file_id", F.concat(F.col("file_id"), F.lit(", "), F.col("file_id") + 1))
    return attributed(n)
