"""Queries over judged answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.stats import wilson
from gristmill.operators import answers as op

from .base import ANSWERS_SQL, LABEL_SQL, SCORES_SQL, answers, scores, table
from .registry import query

LABELLED_SQL = f"SELECT *, {LABEL_SQL} AS label FROM ({ANSWERS_SQL})"
COUNTS = "count_if(label = 'TA') AS ta, count_if(label = 'TC') AS tc, count_if(label = 'FA') AS fa, count_if(label = 'FC') AS fc, count_if(label = 'unknown') AS unknown, count(*) AS n"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).withColumn("label", op.confusion_label(F.col("is_answerable"), F.col("abstained"), F.col("abstention_score")))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.confusion(labelled(spark, sf_dir), ["arm"])


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query("agg_classify", f"SELECT qa_pair_id, arm, label FROM ({LABELLED_SQL})")
def agg_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("qa_pair_id", "arm", "label")


@query("agg_confusion", f"SELECT arm, {COUNTS} FROM ({LABELLED_SQL}) GROUP BY arm")
def agg_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spark, sf_dir)


RATES_SQL = f"""SELECT *, 2 * abst_precision * abst_recall / nullif(abst_precision + abst_recall, 0) AS f1 FROM (
SELECT *, fc / nullif(fc + ta, 0) AS hallucination, fa / nullif(fa + tc, 0) AS over_caution, ta / nullif(ta + fa, 0) AS abst_precision, ta / nullif(ta + fc, 0) AS abst_recall
FROM (SELECT arm, {COUNTS} FROM ({LABELLED_SQL}) GROUP BY arm))"""


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    p, c = f"({k} / ({n})::DOUBLE)", f"3.8416 / ({n})"
    half = f"1.96 * sqrt({p} * (1 - {p}) / ({n}) + 3.8416 / (4.0 * ({n}) * ({n})))"
    lo = f"CASE WHEN ({n}) = 0 OR {k} = 0 THEN 0.0 ELSE greatest(0.0, ({p} + {c} / 2 - {half}) / (1 + {c})) END"
    hi = f"CASE WHEN ({n}) = 0 THEN 0.0 WHEN {k} = ({n}) THEN 1.0 ELSE least(1.0, ({p} + {c} / 2 + {half}) / (1 + {c})) END"
    return lo, hi


H, O = wilson_sql("fc", "fc + ta"), wilson_sql("fa", "fa + tc")


@query("agg_proportions", f"SELECT arm, ta, tc, fa, fc, unknown, n, round(hallucination, 6) AS hallucination, round(over_caution, 6) AS over_caution, round(abst_precision, 6) AS abst_precision, round(abst_recall, 6) AS abst_recall, round(f1, 6) AS f1, round({H[0]}, 6) AS h_lo, round({H[1]}, 6) AS h_hi, round({O[0]}, 6) AS o_lo, round({O[1]}, 6) AS o_hi FROM ({RATES_SQL})")
def agg_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.with_intervals(op.rates(counts(spark, sf_dir)))
    return out.select("arm", "ta", "tc", "fa", "fc", "unknown", "n", *r6("hallucination", "over_caution", "abst_precision", "abst_recall", "f1", "h_lo", "h_hi", "o_lo", "o_hi"))


W = wilson_sql("k", "n")


@query("agg_wilson", f"SELECT k, n, round({W[0]}, 6) AS lo, round({W[1]}, 6) AS hi FROM (SELECT doc_id % 21 AS k, (20 + doc_id % 3)::BIGINT AS n FROM documents)")
def agg_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr("doc_id % 21 AS k", "20 + doc_id % 3 AS n")
    w = wilson(F.col("k"), F.col("n"))
    return d.select("k", "n", F.round(w["lo"], 6).alias("lo"), F.round(w["hi"], 6).alias("hi"))


MEANS = [("correctness", "label = 'TC'", "correctness"), ("faithfulness", "label = 'TC'", "faithfulness"), ("kc", "label = 'TC'", "correctness * faithfulness"), ("coverage", "label <> 'unknown'", "passage_coverage"), ("recovery", "label <> 'unknown'", "source_recovery")]
MEANS_SQL = ", ".join(f"round(avg(CASE WHEN {c} THEN {e} END), 6) AS mean_{n}, count(CASE WHEN {c} THEN {e} END) AS n_{n}" for n, c, e in MEANS)


@query("agg_quality_means", f"SELECT arm, {MEANS_SQL} FROM ({LABELLED_SQL}) GROUP BY arm")
def agg_quality_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.quality_means(labelled(spark, sf_dir), ["arm"])
    return out.select("arm", *(F.round(f"mean_{n}", 6).alias(f"mean_{n}") for n, _, _ in MEANS), *(f"n_{n}" for n, _, _ in MEANS))


STRATA_SQL = "SELECT doc_id AS qa_pair_id, lang AS bloom_level, CASE WHEN doc_id % 3 = 0 THEN 'factual' ELSE 'conceptual' END AS question_type FROM documents WHERE doc_id % 6 <> 0"


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id % 6 <> 0").selectExpr("doc_id AS qa_pair_id", "lang AS bloom_level", "CASE WHEN doc_id % 3 = 0 THEN 'factual' ELSE 'conceptual' END AS question_type")


@query("agg_cross_cut", f"""WITH a AS ({LABELLED_SQL}), j AS (SELECT a.*, s.bloom_level, s.question_type FROM a JOIN ({STRATA_SQL}) s USING (qa_pair_id))
SELECT arm, 'joint' AS slice, 'all' AS stratum, {COUNTS} FROM a GROUP BY arm
UNION ALL SELECT arm, 'bloom_level', bloom_level, {COUNTS} FROM j GROUP BY arm, bloom_level
UNION ALL SELECT arm, 'question_type', question_type, {COUNTS} FROM j GROUP BY arm, question_type""")
def agg_cross_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cross_cut(labelled(spark, sf_dir), strata(spark, sf_dir), "qa_pair_id", "arm", ["bloom_level", "question_type"])


@query("jn_cross_cut", f"SELECT arm, bloom_level, question_type, qa_pair_id FROM ({LABELLED_SQL}) JOIN ({STRATA_SQL}) USING (qa_pair_id)")
def jn_cross_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).join(strata(spark, sf_dir), "qa_pair_id").select("arm", "bloom_level", "question_type", "qa_pair_id")


LEVELS = ["de", "en", "es", "fr"]


@query("agg_tables_md", f"SELECT arm, {', '.join(f'coalesce(round(avg(correctness * faithfulness) FILTER (label = $$TC$$ AND level = $${x}$$), 4)::VARCHAR, $$n/a$$) AS {x}' for x in LEVELS)} FROM ({LABELLED_SQL}) GROUP BY arm")
def agg_tables_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    kc = F.when(F.col("label") == "TC", F.col("correctness") * F.col("faithfulness"))
    out = labelled(spark, sf_dir).groupBy("arm").pivot("level", LEVELS).agg(F.round(F.avg(kc), 4))
    return out.select("arm", *(F.coalesce(F.col(x).cast("string"), F.lit("n/a")).alias(x) for x in LEVELS))


@query("agg_disagreement", f"""SELECT qa_pair_id, arm, kind FROM (SELECT *, CASE WHEN abstention_score IS NULL THEN 'judge_error' WHEN abstained AND abstention_score < 0.625 THEN 'answerer_only' WHEN NOT abstained AND abstention_score >= 0.625 THEN 'judge_only' END AS kind FROM ({ANSWERS_SQL})) WHERE kind IS NOT NULL""")
def agg_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.disagreements(answers(spark, sf_dir)).select("qa_pair_id", "arm", "kind")


@query("agg_threshold_sweep", f"""WITH q AS (SELECT qa_pair_id, min(score) AS least, count_if(score IS NULL) AS missing FROM ({SCORES_SQL}) GROUP BY 1),
j AS (SELECT a.*, q.least, q.missing, t.threshold FROM ({LABELLED_SQL}) a LEFT JOIN q USING (qa_pair_id), (VALUES (0.5e0), (0.625e0), (0.75e0)) t(threshold))
SELECT threshold, arm, {COUNTS} FROM j WHERE NOT is_answerable OR coalesce(missing = 0 AND least >= threshold, false) GROUP BY threshold, arm""")
def agg_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.threshold_sweep(labelled(spark, sf_dir), scores(spark, sf_dir), [0.5, 0.625, 0.75], "qa_pair_id", "arm")


ANCHOR_SQL = "CASE WHEN score <= 0.125 THEN 0.0 WHEN score <= 0.375 THEN 0.25 WHEN score <= 0.625 THEN 0.5 WHEN score <= 0.875 THEN 0.75 ELSE 1.0 END"


@query("agg_score_hist", f"SELECT criterion, count(*) AS n, round(avg(score), 6) AS mean, count_if(score < 0.625) AS below, {', '.join(f'count_if({ANCHOR_SQL} = {a}) AS at_{int(100 * a)}' for a in op.ANCHORS)} FROM ({SCORES_SQL}) WHERE score IS NOT NULL GROUP BY criterion")
def agg_score_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.score_histogram(scores(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query("agg_cohorts", f"""WITH q AS (SELECT qa_pair_id, min(score) AS least, count_if(score IS NULL) AS missing, count_if(score = 0.5) AS halves FROM ({SCORES_SQL}) GROUP BY 1),
c AS (SELECT qa_pair_id, 'approved' AS cohort FROM q WHERE missing = 0 AND least >= 0.625 UNION ALL SELECT qa_pair_id, 'half' FROM q WHERE missing = 0 AND least = 0.5 UNION ALL SELECT qa_pair_id, 'half_by_one' FROM q WHERE missing = 0 AND least = 0.5 AND halves = 1)
SELECT arm, cohort, ta + tc + fa + fc AS n, round((ta + tc) / nullif(ta + tc + fa + fc, 0), 6) AS right_share FROM (SELECT arm, cohort, {COUNTS} FROM ({LABELLED_SQL}) JOIN c USING (qa_pair_id) GROUP BY arm, cohort)""")
def agg_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cohorts(labelled(spark, sf_dir), scores(spark, sf_dir), "qa_pair_id", "arm").withColumn("right_share", F.round("right_share", 6))


@query("agg_kde", "SELECT x, round(avg(exp(-0.5 * ((x - score) / 0.08) * ((x - score) / 0.08))) / (0.08 * sqrt(2 * pi())), 6) AS density FROM (SELECT unnest(range(0, 21)) / 20e0 AS x), (" + SCORES_SQL + ") WHERE score IS NOT NULL GROUP BY x")
def agg_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.density(scores(spark, sf_dir), "score", [i / 20 for i in range(21)], 0.08).withColumn("density", F.round("density", 6))


@query("jn_gold", f"""SELECT qa_pair_id, CASE WHEN is_answerable THEN g.gold END AS gold, CASE WHEN is_answerable AND g.gold IS NULL THEN 'failed' ELSE 'ok' END AS status
FROM ({ANSWERS_SQL}) a LEFT JOIN (SELECT item_id AS qa_pair_id, text AS gold FROM benchmark WHERE item_id % 4 <> 1) g USING (qa_pair_id)""")
def jn_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "benchmark").filter("item_id % 4 <> 1").selectExpr("item_id AS qa_pair_id", "text AS gold")
    return op.gold(answers(spark, sf_dir), g, "qa_pair_id").select("qa_pair_id", "gold", "status")


@query("jn_passage_text", """SELECT conv_id, turn, coalesce(payload, chunk_text) AS text FROM (SELECT conv_id, turn, conv_id AS chunk_id, CASE WHEN turn % 2 = 0 THEN text WHEN turn % 5 = 0 THEN '' END AS payload FROM conversations) p
LEFT JOIN (SELECT doc_id AS chunk_id, text AS chunk_text FROM documents WHERE doc_id % 3 = 0) t USING (chunk_id) WHERE coalesce(payload, chunk_text) <> ''""")
def jn_passage_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "conv_id AS chunk_id", "CASE WHEN turn % 2 = 0 THEN text WHEN turn % 5 = 0 THEN '' END AS payload")
    t = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").selectExpr("doc_id AS chunk_id", "text AS chunk_text")
    return op.passage_texts(p, t).select("conv_id", "turn", "text")
