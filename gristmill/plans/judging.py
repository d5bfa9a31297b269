"""Queries on heuristic criteria and judge pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.operators import judge as op

from .base import table
from .registry import query

DURATION = "CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN 0 ELSE 60 * n_chars END"
WORDS_SQL = "SELECT *, list_filter(string_split_regex(text, '[\\s\\x1C-\\x1F\\x85\\p{Z}]+'), lambda w: w <> '') AS w FROM documents"
STRIP_SQL = "trim(text, E' \\n\\t\\r')"
LENGTH_SQL = f"CASE WHEN length({STRIP_SQL}) < 200 OR len(w) < 30 THEN 0.0 ELSE 1.0 END"
ALPHA, LATIN, CJK = (f"length(regexp_replace(text, '{c}', '', 'g'))" for c in ("[^\\p{L}]", "[^\\p{Latin}]|[\\x{AA}\\x{BA}]", "[^\\p{Han}\\p{Hiragana}\\p{Katakana}]"))
SCRIPT_SQL = f"CASE WHEN {ALPHA} = 0 THEN 0.5 WHEN {CJK} / {ALPHA} > 0.5 THEN 0.0 WHEN ({ALPHA} - {LATIN}) / {ALPHA} > 0.1 THEN 0.2 ELSE 1.0 END"
DENSITY_SQL = f"(SELECT CASE WHEN ms IS NULL THEN 0.5 WHEN ms <= 0 THEN 0.3 WHEN n / (ms / 6e4) < 30 THEN n / (ms / 6e4) / 30 WHEN n / (ms / 6e4) > 300 THEN greatest(0.0, 2 - n / (ms / 6e4) / 300) ELSE 1.0 END FROM (SELECT len(w) AS n, {DURATION} AS ms))"
REPEAT_SQL = f"""(WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\\s\\x1C-\\x1F\\x85\\p{{Z}}]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, len(w) AS n, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS g FROM d, (VALUES (1), (3), (4), (5)) v(k) WHERE len(w) >= 5),
c AS (SELECT doc_id, n, k, g, count(*) AS c FROM g GROUP BY ALL),
x AS (SELECT doc_id, max(CASE WHEN k = 1 AND c / n > 0.15 THEN c / n WHEN k > 1 AND c >= 4 THEN c * k / n ELSE 0.0 END) AS worst FROM c GROUP BY 1)
SELECT doc_id, CASE WHEN worst IS NULL THEN 0.7 ELSE greatest(0.0, 1 - worst) END AS repetition FROM documents LEFT JOIN x USING (doc_id))"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("duration_ms", F.expr(DURATION))


@query("fn_content_length", f"SELECT doc_id, {LENGTH_SQL} AS score FROM ({WORDS_SQL})")
def fn_content_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.content_length(F.col("text")).alias("score"))


@query("fn_script_match", f"SELECT doc_id, {SCRIPT_SQL} AS score FROM documents")
def fn_script_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", tx.script_match(F.col("text"), F.col("lang")).alias("score"))


@query("fn_content_density", f"SELECT doc_id, round({DENSITY_SQL}, 6) AS score FROM ({WORDS_SQL})")
def fn_content_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.round(tx.content_density(F.size(tx.words(F.col("text"))), F.col("duration_ms")), 6).alias("score"))


@query("fn_repetition", f"SELECT doc_id, round(repetition, 6) AS score FROM {REPEAT_SQL}")
def fn_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.repetition(docs(spark, sf_dir), "doc_id", "text").select("doc_id", F.round("repetition", 6).alias("score"))


#: Segments of a user: their events in time order, on whole seconds of a few minutes, some without text.
SEGMENTS_SQL = """SELECT user_id, event_id, (event_id // 10) % 60 + CASE WHEN user_id % 3 = 0 THEN 0 ELSE (event_id % 4) / 4e0 END AS start, CASE WHEN event_id % 4 <> 0 THEN event_type ELSE '' END AS text FROM events"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "(event_id div 10) % 60 + CASE WHEN user_id % 3 = 0 THEN 0 ELSE (event_id % 4) / 4e0 END AS start", "CASE WHEN event_id % 4 <> 0 THEN event_type ELSE '' END AS text")


RUNS_SQL = f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS i, start - lag(start) OVER (PARTITION BY user_id ORDER BY start, event_id) AS gap FROM ({SEGMENTS_SQL})),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS island FROM s WHERE abs(gap - 1) <= 0.1),
r AS (SELECT user_id, max(n) AS longest FROM (SELECT user_id, island, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT user_id, count(*) AS n, count_if(text = '') / count(*) AS empty FROM s GROUP BY 1)
SELECT user_id, coalesce(longest, 0) AS longest, empty FROM e LEFT JOIN r USING (user_id)"""


@query("win_segment_runs", f"SELECT user_id, longest FROM ({RUNS_SQL})")
def win_segment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of gaps of a second, by gaps and islands."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("start", "event_id")
    s = segments(spark, sf_dir).select("user_id", F.row_number().over(w).alias("i"), (F.col("start") - F.lag("start").over(w)).alias("gap"))
    hit = s.filter("abs(gap - 1) <= 0.1").withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("user_id").orderBy("i")))
    longest = hit.groupBy("user_id", "island").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))
    return s.select("user_id").distinct().join(longest, "user_id", "left").fillna(0, ["longest"])


@query("fn_segment_quality", f"SELECT user_id, greatest(0.0, 1.0 - CASE WHEN empty > 0.2 THEN 0.3 ELSE 0.0 END - CASE WHEN longest >= 5 THEN 0.5 ELSE 0.0 END) AS score FROM ({RUNS_SQL})")
def fn_segment_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("start", "event_id", "text"))).alias("segments"))
    return s.select("user_id", F.round(tx.segment_quality(F.col("segments")), 6).alias("score"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).withColumn("repetition", tx.repetition(F.col("text")))
    none = F.lit(None).cast("array<struct<text:string,start:double,end:double>>")
    drift = F.when(F.col("doc_id") % 23 != 0, ((F.col("doc_id") * 7919) % 1000) / 1000.0)
    broken = F.when(F.col("doc_id") % 29 == 0, "scorer failed")
    llm = op.Stage("llm_filter", "filter", [op.Criterion("language_drift", drift, 0.2), op.Criterion("hallucination_loop", F.lit(0.9), 0.2, broken)])
    return op.judge(d, [op.heuristic_stage(F.col("text"), F.col("lang"), F.col("duration_ms"), none), llm])


NAMES = ["content_length", "script_match", "repetition", "content_density", "segment_quality", "language_drift", "hallucination_loop"]
JUDGED_SQL = f"""WITH h AS (SELECT doc_id, {LENGTH_SQL} AS content_length, {SCRIPT_SQL} AS script_match, r.repetition, {DENSITY_SQL} AS content_density, 0.5 AS segment_quality,
  CASE WHEN doc_id % 23 <> 0 THEN ((doc_id * 7919) % 1000) / 1e3 END AS drift, CASE WHEN doc_id % 29 <> 0 THEN 0.9 END AS loop FROM ({WORDS_SQL}) d JOIN {REPEAT_SQL} r USING (doc_id)),
p AS (SELECT *, content_length >= 0.5 AND script_match >= 0.6 AND repetition >= 0.5 AND content_density >= 0.4 AND segment_quality >= 0.4 AS ok FROM h),
q AS (SELECT *, CASE WHEN ok THEN drift END AS language_drift, CASE WHEN ok THEN loop END AS hallucination_loop, CASE WHEN NOT ok THEN 'heuristic_filter' WHEN NOT coalesce(drift >= 0.2 AND loop IS NOT NULL, false) THEN 'llm_filter' END AS rejected_at FROM p)"""


@query("op_transcription_judge", f"{JUDGED_SQL} SELECT doc_id, rejected_at IS NULL AS passed, rejected_at FROM q")
def op_transcription_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("doc_id", "passed", "rejected_at")


@query("op_judge_pipeline", f"{JUDGED_SQL} SELECT coalesce(rejected_at, 'none') AS rejected_at, count(*) AS n FROM q GROUP BY 1")
def op_judge_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).groupBy(F.coalesce("rejected_at", F.lit("none")).alias("rejected_at")).agg(F.count("*").alias("n"))


@query("op_judge_step", f"{JUDGED_SQL}, u AS (UNPIVOT (SELECT doc_id, ok, content_length::DOUBLE AS content_length, script_match::DOUBLE AS script_match, repetition::DOUBLE AS repetition, content_density::DOUBLE AS content_density, segment_quality::DOUBLE AS segment_quality FROM q) ON content_length, script_match, repetition, content_density, segment_quality INTO NAME criterion VALUE score) SELECT criterion, count(*) AS n, round(avg(score), 6) AS mean, count_if(score >= CASE criterion WHEN 'script_match' THEN 0.6 WHEN 'content_density' THEN 0.4 WHEN 'segment_quality' THEN 0.4 ELSE 0.5 END) AS passing FROM u GROUP BY 1")
def op_judge_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.long_scores(judged(spark, sf_dir), "doc_id").filter("stage = 'heuristic_filter'")
    return rows.groupBy("criterion").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.count_if("passed").alias("passing"))


@query("prj_pivot_scores_tr", f"{JUDGED_SQL} SELECT doc_id, {', '.join(f'round({n}::DOUBLE, 6) AS {n}' for n in NAMES)}, round(list_avg([{', '.join(f'{n}::DOUBLE' for n in NAMES)}]), 6) AS overall FROM q")
def prj_pivot_scores_tr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.pivot_scores(op.long_scores(judged(spark, sf_dir), "doc_id"), "doc_id", NAMES)
    return out.select("doc_id", *(F.round(n, 6).alias(n) for n in [*NAMES, "overall"]))


#: Judged pairs: remember needs two criteria, other levels four.
QA = ["faithfulness", "bloom_calibration", "informativeness", "self_containedness"]
LEVEL = "CASE turn % 4 WHEN 0 THEN 'remember' WHEN 1 THEN 'understand' WHEN 2 THEN 'analyze' ELSE 'evaluate' END"
QA_SQL = f"""SELECT conv_id, turn, {LEVEL} AS level, {', '.join(f"CASE WHEN {i} < 2 OR turn % 4 <> 0 THEN CASE WHEN (conv_id + turn + {i}) % 17 <> 0 THEN ((conv_id * 31 + turn * 7 + {i} * 13) % 9) / 8e0 END END AS {n}" for i, n in enumerate(QA))} FROM conversations"""


def qa_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{LEVEL} AS level", *(f"CASE WHEN (conv_id + turn + {i}) % 17 <> 0 THEN ((conv_id * 31 + turn * 7 + {i} * 13) % 9) / 8e0 END AS s{i}" for i in range(4)))
    return c.withColumn("key", F.concat_ws(":", "conv_id", "turn"))


def qa_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = qa_scores(spark, sf_dir)
    stage = lambda k: op.Stage("cep_validation", "filter", [op.Criterion(n, F.col(f"s{i}"), 0.625, F.when(F.col(f"s{i}").isNull(), "scorer failed")) for i, n in enumerate(QA[:k])])
    return op.judge(c.filter("level = 'remember'"), [stage(2)]).unionByName(op.judge(c.filter("level <> 'remember'"), [stage(4)]))


PASS_SQL = " AND ".join(f"(({i} >= 2 AND level = 'remember') OR coalesce({n} >= 0.625, false))" for i, n in enumerate(QA))


@query("op_qa_judge", f"SELECT conv_id, turn, level, {PASS_SQL} AS passed FROM ({QA_SQL})")
def op_qa_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_judged(spark, sf_dir).select("conv_id", "turn", "level", "passed")


@query("prj_pivot_scores_qa", f"SELECT conv_id, turn, {', '.join(QA)}, round(list_avg([{', '.join(QA)}]), 6) AS overall FROM ({QA_SQL})")
def prj_pivot_scores_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = qa_judged(spark, sf_dir)
    out = op.pivot_scores(op.long_scores(judged, "key"), "key", QA, "cep_validation")
    return judged.select("key", "conv_id", "turn").join(out, "key").select("conv_id", "turn", *QA, F.round("overall", 6).alias("overall"))


@query("prj_is_valid", f"SELECT conv_id, turn, CASE WHEN conv_id % 5 <> 0 THEN {PASS_SQL} END AS is_valid, coalesce(CASE WHEN conv_id % 5 <> 0 THEN {PASS_SQL} END = false, false) AS is_judge_rejected FROM ({QA_SQL})")
def prj_is_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = F.when(F.col("conv_id") % 5 != 0, F.col("passed"))
    return qa_judged(spark, sf_dir).select("conv_id", "turn", valid.alias("is_valid"), valid.eqNullSafe(F.lit(False)).alias("is_judge_rejected"))


@query("prj_rationale", f"SELECT conv_id, turn, nullif(concat_ws(chr(10), {', '.join(f'CASE WHEN {n} < 0.625 THEN $${n}: below$$ END' for n in QA)}), '') AS rationale FROM ({QA_SQL})")
def prj_rationale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name: rationale of each criterion that has one, a line each."""
    c = F.flatten(F.transform("stages", lambda s: s["criteria"]))
    lines = F.transform(F.filter(c, lambda x: x["error"].isNull() & ~x["passed"]), lambda x: F.concat(x["criterion"], F.lit(": below")))
    joined = F.array_join(lines, "\n")
    return qa_judged(spark, sf_dir).select("conv_id", "turn", F.when(joined != "", joined).alias("rationale"))


@query("op_ordinal_guard", "SELECT mode, mode <> 'filter' AS accepted FROM (VALUES ('filter'), ('score'), ('always')) m(mode)")
def op_ordinal_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for mode in op.MODES:
        try:
            op.Stage("s", mode, [op.Criterion("c", F.lit(3))])
            rows.append((mode, True))
        except ValueError:
            rows.append((mode, False))
    return spark.createDataFrame(rows, "mode string, accepted boolean")


ANSWER_SQL = """SELECT doc_id, (doc_id % 4 = 0) AS abstained, (doc_id % 3 <> 0) AS is_answerable, ((doc_id * 7919) % 1000) / 1e3 AS s1, ((doc_id * 104729) % 1000) / 1e3 AS s2 FROM documents"""


@query("op_answer_judge", f"""SELECT doc_id, CASE WHEN NOT is_answerable THEN 'answerability_gate' WHEN abstained THEN 'commitment_gate' END AS rejected_at, s1 AS abstention, CASE WHEN is_answerable THEN s2 END AS passage_coverage, CASE WHEN is_answerable AND NOT abstained THEN s1 END AS correctness FROM ({ANSWER_SQL})""")
def op_answer_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstention, gate on answerability, evidence, gate on commitment, answer: gates are filters of 0 and 1."""
    a = table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id % 4 = 0 AS abstained", "doc_id % 3 <> 0 AS is_answerable", "((doc_id * 7919) % 1000) / 1e3 AS s1", "((doc_id * 104729) % 1000) / 1e3 AS s2")
    gate = lambda c: F.when(c, 1.0).otherwise(0.0)
    stages = [
        op.Stage("abstention", "score", [op.Criterion("abstention", F.col("s1"), 0.625)]), op.Stage("answerability_gate", "filter", [op.Criterion("answerability", gate(F.col("is_answerable")), 0.5)]),
        op.Stage("evidence", "score", [op.Criterion("passage_coverage", F.col("s2"), 0.625)]), op.Stage("commitment_gate", "filter", [op.Criterion("commitment", gate(~F.col("abstained")), 0.5)]),
        op.Stage("answer", "score", [op.Criterion("correctness", F.col("s1"), 0.625)]),
    ]
    judged = op.judge(a, stages)
    wide = op.pivot_scores(op.long_scores(judged, "doc_id"), "doc_id", ["abstention", "passage_coverage", "correctness"])
    return judged.select("doc_id", "rejected_at").join(wide.drop("overall"), "doc_id")
