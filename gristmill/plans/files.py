"""Queries that write record files and read them back, and those around external models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import generation as gen
from gristmill.sources import records as rec
from gristmill.streaming import resume

from .base import EDGES_SQL, NODES_SQL, edges, nodes, table
from .registry import query


@query("src_catalog_csv", "SELECT 'f' || c_custkey AS file_id, c_name AS name, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey * 10 END AS size_bytes, c_custkey % 2 AS n_parents FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0")
def src_catalog_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    raw = c.selectExpr("CASE WHEN c_custkey % 3 <> 0 THEN concat('f', c_custkey) END AS file_id", "CASE WHEN c_custkey % 3 = 0 THEN concat('f', c_custkey) END AS gdrive_id", "CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS name", "CASE WHEN c_custkey % 5 <> 0 THEN 'audio/mpeg' ELSE 'text/plain' END AS mime_type", "CASE WHEN c_custkey % 9 <> 0 THEN concat(c_custkey * 10, '.0') ELSE 'many' END AS size_bytes", "CASE WHEN c_custkey % 2 = 1 THEN '[''a'']' ELSE 'none' END AS parents")
    rec.write_records(raw, path := rec.work_folder(spark, "catalog"), form="csv")
    return rec.catalog(spark, path).select("file_id", "name", "size_bytes", F.size("parents").cast("long").alias("n_parents"))


@query("src_json_records", "SELECT 'd' || doc_id AS file_id, source AS name, text, lang AS language FROM documents")
def src_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr("concat('d', doc_id) AS file_id", "source AS name", "text", "lang AS language")
    rec.write_records(d, path := rec.work_folder(spark, "records"))
    return spark.read.schema(rec.RECORD).json(path).select("file_id", "name", "text", "language")


CEP_SQL = "SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations"


def cep(spark: SparkSession, sf_dir: str) -> str:
    pair = F.struct("turn", F.col("text").alias("question"), F.col("role").alias("answer"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("k"), "turn")).alias("chunk_id"), F.lit("remember").alias("bloom_level"), F.when(F.col("turn") % 3 != 0, F.col("turn") % 3 == 1).alias("is_valid"))
    r = table(spark, sf_dir, "conversations").groupBy(F.concat(F.lit("s"), "conv_id").alias("source_gdrive_id")).agg(F.array_sort(F.collect_list(pair)).alias("qa_pairs"))
    rec.write_records(r, path := rec.work_folder(spark, "cep"))
    return path


@query("src_cep", f"SELECT 's' || conv_id || ':' || CASE WHEN turn % 2 = 0 THEN 'k' || turn ELSE 'none' END || ':' || idx AS qa_pair_id, text AS question, true AS is_answerable FROM ({CEP_SQL}) WHERE turn % 3 <> 2")
def src_cep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.questions_of(spark.read.schema(rec.CEP).json(cep(spark, sf_dir)))


@query("src_nonanswerable", "SELECT 'q' || item_id AS qa_pair_id, text AS question, 's' || item_id AS source_file_id, CASE WHEN item_id % 2 = 0 THEN 'cep_4k' ELSE 'unknown' END AS chunker_id FROM benchmark")
def src_nonanswerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("q"), "item_id")
    item = F.struct(F.when(F.col("item_id") % 3 == 0, key).alias("qa_pair_id"), F.when(F.col("item_id") % 3 != 0, key).alias("id"), F.col("text").alias("question"), F.concat(F.lit("s"), "item_id").alias("source_gdrive_id"), F.when(F.col("item_id") % 2 == 0, "cep_4k").alias("chunker_id"))
    rec.write_records(table(spark, sf_dir, "benchmark").groupBy((F.col("item_id") % 4).alias("k")).agg(F.collect_list(item).alias("items")).drop("k"), path := rec.work_folder(spark, "nonanswerable"))
    return rec.nonanswerable(spark.read.schema(rec.NONANSWERABLE).json(path))


@query("src_partitioned_records", "SELECT lang AS arm, source, doc_id FROM documents WHERE lang = 'en'")
def src_partitioned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders are keys, so one arm's files are all that is read."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("arm"), "source", "doc_id")
    rec.write_records(d, path := rec.work_folder(spark, "arms"), by=("arm", "source"), form="parquet")
    return spark.read.parquet(path).filter("arm = 'en'").select("arm", "source", "doc_id")


@query("src_kg_jsonl", "SELECT (user_id || ':' || (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)) AS passage_id, user_id::VARCHAR AS id, event_type || event_id AS text FROM events WHERE event_id % 8 <> 0")
def src_kg_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 8 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), F.concat("event_type", F.col("event_id")).alias("original_text")))).alias("value"))
    e.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("value").write.text(path := rec.work_folder(spark, "kg"))
    return rec.passages(spark, path)


@query("src_lenient_json", "SELECT count(*) AS records, sum(n) AS total FROM (SELECT event_id AS n FROM events WHERE event_id % 8 <> 0)")
def src_lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 8 == 0, "{broken").when(F.col("event_id") % 8 == 1, F.concat(F.lit('{\n "n": '), F.col("event_id"), F.lit("\n}"))).otherwise(F.concat(F.lit('{"n": '), F.col("event_id"), F.lit("}"))).alias("value"))
    e.write.text(path := rec.work_folder(spark, "lenient"))
    got = rec.lenient_json(spark, path).filter("record is not null")
    return got.agg(F.count("*").alias("records"), F.sum(F.get_json_object("record", "$.n").cast("long")).alias("total"))


@query("src_graphml", "SELECT 'n' || n_nationkey AS node_id, n_name AS label, 'r' || n_regionkey AS dst FROM nation")
def src_graphml(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    node = F.format_string('<node id="n%d"><data key="d0">%s</data></node>', "n_nationkey", "n_name")
    edge = F.format_string('<edge source="n%d" target="r%d"><data key="d1">in</data></edge>', "n_nationkey", "n_regionkey")
    body = n.select(F.concat(node, edge).alias("x")).agg(F.concat(F.lit("<graphml><graph>"), F.array_join(F.collect_list("x"), ""), F.lit("</graph></graphml>")).alias("value"))  # 25 nations
    body.write.text(path := rec.work_folder(spark, "graphml"))
    nodes_, edges_ = rec.graphml(spark, path)
    return nodes_.join(edges_, F.col("node_id") == F.col("src")).select("node_id", nodes_["data"]["d0"].alias("label"), "dst")


@query("src_triple_csv", f"WITH n AS (SELECT * FROM ({NODES_SQL}) WHERE type <> 'event') SELECT node_id, type FROM n UNION ALL SELECT x, 'entity' FROM (SELECT src AS x FROM ({EDGES_SQL}) UNION SELECT dst FROM ({EDGES_SQL})) WHERE x NOT IN (SELECT node_id FROM n)")
def src_triple_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec.write_records(nodes(spark, sf_dir).filter("type <> 'event'").select(F.col("node_id").alias("name:ID"), "type"), a := rec.work_folder(spark, "triples"), form="csv")
    rec.write_records(edges(spark, sf_dir).select(F.col("src").alias(":START_ID"), F.col("dst").alias(":END_ID"), "relation", F.col("type").alias(":TYPE")), b := rec.work_folder(spark, "triples"), form="csv")
    return rec.triple_csv(spark, a, b)[0]


@query("src_runs", "SELECT 'run' || o_orderkey AS run_id, (o_orderkey % 10)::INTEGER AS completed_items FROM orders")
def src_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("concat('run', o_orderkey) AS run_id", "'qa' AS pipeline_type", "o_orderdate AS started_at", "CAST(o_orderkey % 10 AS INT) AS completed_items")
    rec.write_records(o, path := rec.work_folder(spark, "runs"))
    return spark.read.schema(rec.RUN).json(path).select("run_id", "completed_items")


EXPORTED = "concat('{\"id\": ', item_id, ', \"data\": {\"task_id\": ', item_id, '}, \"annotations\": [{\"completed_by\": 7, \"was_cancelled\": ', CASE WHEN item_id % 5 = 0 THEN 'true' ELSE 'false' END, ', \"result\": [{\"from_name\": \"score\", \"value\": {\"choices\": [\"', item_id % 5 + 1, ' - ok\"]}}]}]}')"


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "benchmark").select(F.expr(EXPORTED).alias("value")).write.text(path := rec.work_folder(spark, "export"))
    return rec.labels(spark, path, lines=True)


@query("src_annotation_export", "SELECT item_id::INTEGER AS task_id, 7 AS user_id, (item_id % 5 + 1)::INTEGER AS score FROM benchmark WHERE item_id % 5 <> 0")
def src_annotation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export(spark, sf_dir).select("task_id", "user_id", "score")


@query("op_pull_labels", "SELECT 7 AS user_id, 'p' || item_id AS pair_id, (item_id % 5 + 1)::INTEGER AS score FROM benchmark WHERE item_id % 5 <> 0")
def op_pull_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("task_id"), F.concat(F.lit("p"), "item_id").alias("pair_id"))
    return gen.pulled(export(spark, sf_dir), tasks)


@query("op_build_instrument", "SELECT row_number() OVER (ORDER BY sha256('9:' || item_id), item_id) - 1 AS task_id, item_id, text FROM benchmark")
def op_build_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gen.instrument(table(spark, sf_dir, "benchmark"), "item_id", 9, ["text"])


@query("op_cep_generate", "SELECT doc_id, level_ord, level, unnest(range(1, n + 1))::INTEGER AS ordinal FROM documents, (VALUES (0, 'remember', 3), (1, 'understand', 1), (2, 'analyze', 1), (3, 'evaluate', 1)) l(level_ord, level, n)")
def op_cep_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gen.ladder(table(spark, sf_dir, "documents"), "doc_id").drop("context")


@query("op_answer_fallback", "SELECT item_id, CASE WHEN item_id % 5 < 3 THEN 'answer to ' || length(text) END AS answer, least(item_id % 5 + 1, 3)::INTEGER AS attempts, item_id % 5 >= 3 AS abstained FROM benchmark")
def op_answer_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stub that fails as often as a number in front of the question says."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.col("item_id") % 5, F.lit("|"), F.col("text")).alias("asked"))

    def ask(text: str, temperature: float) -> str | None:
        fails, _, question = text.partition("|")
        return f"answer to {len(question)}" if round(temperature * 10) >= int(fails) else None

    return gen.answered(rows, "item_id", ask, "asked")


@query("op_nonanswerable", "WITH s AS (SELECT item_id, text AS question, split_part(text, ' ', 1) AS original, CASE item_id % 3 WHEN 0 THEN 'Zzyqx' || item_id WHEN 1 THEN '1999' ELSE 'FRANCE' END AS replacement FROM benchmark) SELECT item_id, replacement FROM s WHERE item_id % 3 = 0")
def op_nonanswerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    swaps = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"), F.split_part("text", F.lit(" "), F.lit(1)).alias("original"), F.expr("CASE item_id % 3 WHEN 0 THEN concat('Zzyqx', item_id) WHEN 1 THEN '1999' ELSE 'FRANCE' END").alias("replacement"), F.lit("PERSON").alias("entity_type"))
    names = spark.createDataFrame([("FRANCE",)], "label string")
    return gen.valid_swaps(swaps, names, gen.spans(table(spark, sf_dir, "documents"), "text")).select("item_id", "replacement")


@query("op_emic_measure", "SELECT user_id, count(*) AS n, round(avg(CASE WHEN event_id % 3 <> 0 AND user_id % 10 <> 0 THEN (event_id % 5 + 1) END), 6) AS mean, bool_and(event_id % 3 = 0 OR user_id % 10 = 0) AS failed FROM events GROUP BY user_id")
def op_emic_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("event_id") % 3 == 0) | (F.col("user_id") % 10 == 0)
    s = table(spark, sf_dir, "events").select("user_id", F.when(~bad, F.col("event_id") % 5 + 1).alias("score"), F.when(bad, "failed").alias("error"))
    return gen.measured(s, "user_id").withColumn("mean", F.round("mean", 6))


@query("op_build_kg", f"WITH e AS ({EDGES_SQL}), n AS (SELECT * FROM ({NODES_SQL}) WHERE type <> 'event') SELECT type, count(*) AS n FROM (SELECT node_id, type FROM n UNION ALL SELECT x, 'entity' FROM (SELECT src AS x FROM e UNION SELECT dst FROM e) WHERE x NOT IN (SELECT node_id FROM n)) WHERE type <> 'concept' OR node_id IN (SELECT src FROM e UNION SELECT dst FROM e) GROUP BY type")
def op_build_kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweeps over extracted triples: missing ends are added, concepts that nothing names are dropped, then nodes are counted."""
    e = edges(spark, sf_dir)
    all_nodes = src_triple_csv(spark, sf_dir)
    ends = e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct()
    kept = all_nodes.filter("type <> 'concept'").unionByName(all_nodes.filter("type = 'concept'").join(ends, "node_id", "left_semi"))
    return kept.groupBy("type").agg(F.count("*").alias("n"))


@query("op_incremental", "SELECT event_id, upper(event_type) AS kind FROM events WHERE event_id % 10 <> 0")
def op_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, run until there is nothing new; failed keys are set aside."""
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    work = lambda rows: rows.select("event_id", F.upper("event_type").alias("kind"))
    done, _ = resume.process_new(spark, sf_dir, schema, "events.parquet", rec.work_folder(spark, "stream"), "event_id", work, F.col("event_id") % 10 == 0)
    return done
