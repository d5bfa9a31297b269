"""Queries on parsing, formatting and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import parsing as px
from gristmill.functions import text as tx

from .base import EDGES_SQL, NODES_SQL, edges, nodes, table
from .registry import query

PEOPLE = {"ana": "Ana Costa", "bruno": "Bruno Dias", "carla m": "Carla Melo"}
PLACES = {"porto": "Porto Velho", "porto velho": "Porto Velho", "serra": "Serra"}

VALUE = "CASE event_id % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN '1.7' WHEN 2 THEN '-0.2' WHEN 3 THEN CAST((event_id % 50) / 10e0 AS {s}) WHEN 4 THEN '4' ELSE NULL END"
V_SPARK, V_SQL = VALUE.format(s="STRING"), VALUE.format(s="VARCHAR")
NUM = f"try_cast({V_SQL} AS DOUBLE)"


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{V_SPARK} AS v")


@query("fn_clamp_score", f"SELECT event_id, least(greatest(coalesce({NUM}, 0.5), 0.0), 1.0) AS score FROM events")
def fn_clamp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, sf_dir).select("event_id", px.clamp_score(F.col("v")).alias("score"))


@query("fn_clamp_ordinal", f"SELECT event_id, least(greatest(coalesce(CASE WHEN {NUM} = floor({NUM}) THEN {NUM} ELSE 3 END, 3), 1), 5)::INTEGER AS score FROM events")
def fn_clamp_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, sf_dir).select("event_id", px.clamp_ordinal(F.col("v")).alias("score"))


@query("fn_round_half_up_ordinal", f"SELECT event_id, CASE WHEN floor({NUM} + 0.5) BETWEEN 1 AND 5 THEN floor({NUM} + 0.5)::INTEGER END AS score FROM events")
def fn_round_half_up_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, sf_dir).select("event_id", px.round_half_up(F.col("v")).alias("score"))


SAID = "concat('<think> a', conv_id, ' </think>', CASE WHEN turn % 2 = 0 THEN '<think>b</think>' ELSE '' END, ' ```json\n{\"', CASE turn % 3 WHEN 0 THEN 'score' WHEN 1 THEN 'rating' ELSE 'level' END, '\": ', (conv_id * 7 + turn) % 10, ', \"reason\": \"r', turn, '\"}\n```')"


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("said", F.expr(SAID.replace("\n", "\\n")))


@query("fn_extract_thinking", "SELECT conv_id, turn, 'a' || conv_id || CASE WHEN turn % 2 = 0 THEN chr(10) || 'b' ELSE '' END AS thinking FROM conversations")
def fn_extract_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir).select("conv_id", "turn", px.thinking(F.col("said")).alias("thinking"))


@query("fn_strip_fence", "SELECT conv_id, turn, '{\"' || CASE turn % 3 WHEN 0 THEN 'score' WHEN 1 THEN 'rating' ELSE 'level' END || '\": ' || (conv_id * 7 + turn) % 10 || ', \"reason\": \"r' || turn || '\"}' AS body FROM conversations")
def fn_strip_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir).select("conv_id", "turn", px.without_fence(px.without_thinking(F.col("said"))).alias("body"))


@query("fn_parse_llm_json", "SELECT conv_id, turn, ((conv_id * 7 + turn) % 10)::DOUBLE AS score, 'r' || turn AS rationale FROM conversations")
def fn_parse_llm_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir).select("conv_id", "turn", px.model_json(F.col("said")).alias("j")).select("conv_id", "turn", "j.*")


@query("fn_parse_reasoning", "SELECT event_id, event_id % 3 <> 0 AS is_multi_hop, CASE WHEN event_id % 3 <> 0 AND event_id % 6 BETWEEN 1 AND 3 THEN (event_id % 6)::INTEGER END AS hop_count FROM events")
def fn_parse_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('{\"is_multi_hop\": ', CASE event_id % 3 WHEN 0 THEN 'false' WHEN 1 THEN '\"Yes\"' ELSE 'true' END, ', \"hop_count\": ', event_id % 6, '}')")
    return table(spark, sf_dir, "events").select("event_id", px.reasoning(text).alias("r")).select("event_id", "r.*")


@query("fn_bloom_qtype", "SELECT event_id, CASE WHEN event_id % 4 IN (1, 2) THEN 'conceptual' ELSE 'factual' END AS question_type FROM events")
def fn_bloom_qtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.expr("CASE event_id % 4 WHEN 0 THEN 'remember' WHEN 1 THEN 'analyze' WHEN 2 THEN 'evaluate' ELSE 'odd' END")
    return table(spark, sf_dir, "events").select("event_id", px.question_type(level).alias("question_type"))


@query("fn_tokenize_ws", "SELECT doc_id, list_filter(string_split_regex(lower(nfc_normalize(text)), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS tokens FROM documents")
def fn_tokenize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.tokens(tx.nfkc(F.col("text"))).alias("tokens"))


@query("fn_tokenize_khop", f"SELECT conv_id, turn, list_filter(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+')), lambda w: length(w) >= 3 AND w NOT IN ({', '.join(f'$${w}$$' for w in tx.STOPWORDS)})).list_sort() AS tokens FROM conversations")
def fn_tokenize_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sort_array(tx.query_tokens(F.col("text"))).alias("tokens"))


@query("fn_spacy_lemma", "SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS tokens FROM benchmark")
def fn_spacy_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a lemma model, which isn't part of this engine, the plain tokenizer is what counts."""
    return table(spark, sf_dir, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("tokens"))


@query("fn_accent_fold", "SELECT doc_id, lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')) AS folded FROM documents")
def fn_accent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.ascii_fold(F.col("text")).alias("folded"))


@query("fn_corpus_spans", "SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM documents) WHERE regexp_full_match(word, '\\p{L}{4,}')")
def fn_corpus_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("word"))
    return words.filter(F.rlike("word", F.lit(r"^\p{L}{4,}$"))).distinct()


@query("fn_estimate_tokens", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 3) END AS tokens FROM documents")
def fn_estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


@query("fn_format_passages", "SELECT conv_id, string_agg('[Passage ' || i || ']: ' || text, chr(10) || chr(10) ORDER BY i) AS block FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY conv_id")
def fn_format_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return rows.select("conv_id", px.passages_block(F.transform("p", lambda x: x["text"])).alias("block"))


@query("fn_format_triple", f"SELECT '[' || a.type || '] ' || a.label || ' --[' || relation || ']--> [' || coalesce(b.type, '?') || '] ' || coalesce(b.label, dst) AS triple FROM ({EDGES_SQL}) JOIN ({NODES_SQL}) a ON a.node_id = src LEFT JOIN (SELECT * FROM ({NODES_SQL}) WHERE type <> 'concept') b ON b.node_id = dst")
def fn_format_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    a = n.select(F.col("node_id").alias("src"), F.col("label").alias("al"), F.col("type").alias("at"))
    b = n.filter("type <> 'concept'").select(F.col("node_id").alias("dst"), F.col("label").alias("bl"), F.col("type").alias("bt"))
    rows = edges(spark, sf_dir).drop("type").join(a, "src").join(b, "dst", "left")
    return rows.select(px.triple(F.col("al"), F.col("at"), F.col("relation"), F.coalesce("bl", "dst"), F.col("bt")).alias("triple"))


@query("fn_safe_name", "SELECT page_id, replace(replace(url, ':', '_'), '/', '_') AS one, replace(replace(url, ':', '__'), '/', '_') AS two FROM pages")
def fn_safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", px.safe_name(F.col("url")).alias("one"), px.safe_name(F.col("url"), "__").alias("two"))


@query("fn_relabel", f"SELECT src, dst, CASE WHEN src LIKE 's1%' AND relation = 'is participated by' THEN 'envolve' ELSE relation END AS relation FROM ({EDGES_SQL}) WHERE type = 'Relation'")
def fn_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.when(F.startswith(F.col("src"), F.lit("s1")), "pt").otherwise("en")
    return edges(spark, sf_dir).filter("type = 'Relation'").select("src", "dst", px.relabelled(F.col("relation"), language, px.PARTICIPATION).alias("relation"))


@query("fn_segments_sanitize", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE event_id / 10 END AS start, greatest(CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE event_id / 10 END, CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE event_id / 10 END ELSE event_id / 10 - 1 + event_id % 4 END) AS \"end\" FROM events")
def fn_segments_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.expr("array(named_struct('text', event_type, 'start', CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id / 10 AS STRING) END, 'end', CASE WHEN event_id % 4 <> 0 THEN CAST(event_id / 10 - 1 + event_id % 4 AS STRING) END))")
    return table(spark, sf_dir, "events").select("event_id", F.get(px.sanitized(one), F.lit(0)).alias("s")).select("event_id", "s.start", "s.end")


@query("prj_redact", "SELECT event_id, '***' AS api_token, 'v' || event_id AS home FROM events")
def prj_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = F.create_map(F.lit("API_TOKEN"), F.concat(F.lit("s"), "event_id"), F.lit("HOME"), F.concat(F.lit("v"), "event_id"))
    return table(spark, sf_dir, "events").select("event_id", px.redacted(env).alias("e")).select("event_id", F.col("e")["API_TOKEN"].alias("api_token"), F.col("e")["HOME"].alias("home"))


@query("prj_metadata_header", "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'Place: ' || source || chr(10) ELSE '' END || 'Language: ' || lang || chr(10) || '---' || chr(10) AS header, substring(text, 1, 50) AS body FROM documents")
def prj_metadata_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = px.header([("Place", F.when(F.col("doc_id") % 3 != 0, F.col("source"))), ("Language", F.col("lang")), ("Note", F.lit(""))])
    d = table(spark, sf_dir, "documents").select("doc_id", head.alias("header"), F.substring("text", 1, 50).alias("t"))
    return d.select("doc_id", "header", px.without_header(F.concat("header", "t")).alias("body"))


@query("prj_detail", "SELECT conv_id, left(string_agg(text, ' ' ORDER BY turn), 500) AS preview, count(*)::INTEGER AS segments, max(turn) AS last FROM conversations GROUP BY conv_id")
def prj_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"))
    return c.select("conv_id", F.left(F.array_join(F.transform("s", lambda x: x["text"]), " "), F.lit(500)).alias("preview"), F.size("s").alias("segments"), F.array_max(F.transform("s", lambda x: x["turn"])).alias("last"))


@query("op_legacy_migrate", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'old' END AS validation FROM events")
def op_legacy_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A retired key counts where the new one is missing and its content has the new form; else it is dropped."""
    record = F.expr("CASE event_id % 3 WHEN 0 THEN '{\"validation\": {\"stage_results\": {}, \"by\": \"new\"}, \"transcription_quality\": {\"stage_results\": {}, \"by\": \"old\"}}' WHEN 1 THEN '{\"transcription_quality\": {\"stage_results\": {}, \"by\": \"old\"}}' ELSE '{\"transcription_quality\": {\"overall\": 1}}' END")
    get = lambda p: F.get_json_object(record, p)
    old = F.when(get("$.transcription_quality.stage_results").isNotNull(), get("$.transcription_quality.by"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(get("$.validation.by"), old).alias("validation"))


#: File names of every kind that is told apart, made from documents.
NAMES = "CASE doc_id % 6 WHEN 0 THEN concat('Ana_D.Lia_03-0', doc_id % 9 + 1, '-2024_PORTO_', 10 + doc_id % 80, '.mp4') WHEN 1 THEN concat('[Tablet]Bruno - Dona Rita ', 10 + doc_id % 19, '-11-24.mp3') WHEN 2 THEN concat('VID_202411', 10 + doc_id % 19, '_101010~3.mp4') WHEN 3 THEN concat('MVI_', doc_id, '.MOV') WHEN 4 THEN 'Seu Joel Parte II.wav' ELSE 'Serra - Lia 5 de out.mp3' END"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(NAMES).alias("name"))
    path = F.expr("CASE WHEN doc_id % 2 = 0 THEN concat('acervo/MEDIA/Porto Velho - Fotos, Vídeos/AUDIOS/Entrevista D. Lia ', 10 + doc_id % 19, '-11-2024 Porto/a.mp3') ELSE 'acervo/x/b.mp3' END")
    return d.withColumns({"f": px.from_file_name(F.col("name"), PEOPLE, PLACES), "p": px.from_path(path, "MEDIA", PEOPLE, PLACES)})


@query("fn_meta_filename", "SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'Tablet' END AS device, CASE doc_id % 6 WHEN 0 THEN '03-0' || (doc_id % 9 + 1) || '-2024' WHEN 2 THEN (10 + doc_id % 19) || '-11-2024' WHEN 5 THEN '5 de out' END AS date, CASE WHEN doc_id % 6 = 4 THEN 'Parte II' END AS sequence_label, CASE doc_id % 6 WHEN 0 THEN (10 + doc_id % 80)::VARCHAR WHEN 1 THEN '24' WHEN 2 THEN '3' END AS sequence_number, CASE doc_id % 6 WHEN 0 THEN 'Ana Costa' WHEN 1 THEN 'Bruno Dias' END AS researcher, CASE doc_id % 6 WHEN 0 THEN 'Porto Velho' WHEN 5 THEN 'Serra' END AS location, CASE doc_id % 6 WHEN 0 THEN 'D.Lia' WHEN 1 THEN 'Dona Rita ' || (10 + doc_id % 19) WHEN 4 THEN 'Seu Joel' WHEN 5 THEN 'Lia' END AS participant FROM documents")
def fn_meta_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two digits of a dashed date at the end count as a number, as they are taken off first; the date goes with them."""
    return named(spark, sf_dir).select("doc_id", "f.*")


@query("fn_meta_path", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Porto Velho' END AS location, CASE WHEN doc_id % 2 = 0 THEN 'Entrevista D. Lia ' || (10 + doc_id % 19) || '-11-2024 Porto' END AS event_context, CASE WHEN doc_id % 2 = 0 THEN (10 + doc_id % 19) || '-11-2024' END AS date, CASE WHEN doc_id % 2 = 0 THEN 'D. Lia' END AS participant FROM documents")
def fn_meta_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("doc_id", "p.location", "p.event_context", "p.date", "p.participant")


@query("fn_meta_merge", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Porto Velho' WHEN 5 THEN 'Serra' WHEN 2 THEN 'Porto Velho' WHEN 4 THEN 'Porto Velho' END AS location, CASE doc_id % 6 WHEN 0 THEN 'D.Lia' WHEN 4 THEN 'Seu Joel' WHEN 5 THEN 'Lia' WHEN 1 THEN 'Dona Rita' WHEN 2 THEN 'D. Lia' END AS participant, CASE doc_id % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.75 WHEN 3 THEN 0.25 WHEN 4 THEN 0.75 WHEN 5 THEN 0.75 END AS confidence FROM documents")
def fn_meta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file's name first, its path for what is missing, the catalog's date last; then people's names are cleaned."""
    person = lambda c: px.clean_name(pick(c))
    pick = lambda c: F.coalesce(F.col(f"f.{c}"), F.col(f"p.{c}"))
    date = F.coalesce(pick("date"), F.lit("2024-11-01"))
    return named(spark, sf_dir).select("doc_id", pick("location").alias("location"), person("participant").alias("participant"), px.confidence(person("researcher"), person("participant"), pick("location"), date).alias("confidence"))


@query("fn_meta_date", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '03-11-2024' WHEN 1 THEN '15 de out' WHEN 2 THEN '20.05' END AS date FROM pages")
def fn_meta_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE page_id % 4 WHEN 0 THEN 'a 15 de out 03-11-2024 b' WHEN 1 THEN 'em 20.05, 15 de out x' WHEN 2 THEN 'dia 20.05 ok' ELSE 'sem data' END")
    return table(spark, sf_dir, "pages").select("page_id", px.date_in(text).alias("date"))


SAID_NAMES = "CASE p_partkey % 8 WHEN 0 THEN 'Dona Gilda 1' WHEN 1 THEN 'Problemas urbanos' WHEN 2 THEN '2025VID' WHEN 3 THEN ' - Ana, ' WHEN 4 THEN 'D.lia da Silva' WHEN 5 THEN ' -_' WHEN 6 THEN 'bruno' END"


@query("fn_meta_sanitize", "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Dona Gilda' WHEN 3 THEN 'Ana' WHEN 4 THEN 'D.lia da Silva' WHEN 6 THEN 'bruno' END AS name FROM part")
def fn_meta_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", px.clean_name(F.expr(SAID_NAMES)).alias("name"))


@query("fn_meta_match", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Porto Velho' WHEN 1 THEN 'Serra' WHEN 2 THEN 'Porto Velho' END AS place FROM part")
def fn_meta_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place as written, within more words, and with its words run together."""
    text = F.expr("CASE p_partkey % 4 WHEN 0 THEN ' PORTO VELHO ' WHEN 1 THEN 'na Serra do sul' WHEN 2 THEN 'vistaPortoVelho' ELSE 'nowhere' END")
    return table(spark, sf_dir, "part").select("p_partkey", px.known(text, PLACES).alias("place"))
