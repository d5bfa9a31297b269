"""The queries of the training-data operators over the driver's tables, and DuckDB SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, fingerprint, licences, mixing, neardup, pitman_yor, quality, warc, wrapper
from .common import table


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return wrapper.extract(table(spark, sf_dir, "pages"))


OP1_SQL = r"""
WITH found AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
pieces AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', ' ', 'g')) AS parts FROM found),
plain AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM pieces)
SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text, length(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)))::BIGINT AS n_chars FROM plain
"""


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as 8-bit audio with its segments and tensors, and what is read back of them; tail_crc32 is of the last 32 bytes."""
    return audio.read_back(audio.store(table(spark, sf_dir, "documents")), tail=32)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded."""
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    return warc.through_archives(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP4_SQL = """
WITH rows AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
last AS (SELECT html, max(page_id) AS last FROM rows WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, strlen(rows.html)::BIGINT AS payload_bytes, sha1(rows.html) AS payload_digest,
       CASE WHEN page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to, url
FROM rows LEFT JOIN last ON rows.html = last.html
"""


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates among all documents."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 85 * (n + m - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, component_id, component_id = sets.doc_id AS kept FROM sets JOIN least USING (doc_id)
"""


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact fingerprints of all documents and of their edited texts."""
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, given their sources and languages."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources, flattened to the square root of their size."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "n_chars", "text", F.round("__rate", 9).alias("rate"), F.col("__replica").alias("replica"), F.col("__key").alias("shuffle_key"))


def mix_sql(docs: str, columns: str) -> str:
    """DuckDB SQL for mixing.mix() of the relation docs(doc_id, source, text, ...) with its defaults."""
    return f"""
WITH stats AS (SELECT source, sum(coalesce(length(text), 0)) AS chars FROM {docs} GROUP BY source),
raw AS (SELECT source, chars, CASE WHEN chars > 0 THEN pow(chars::DOUBLE, 0.5) ELSE 0 END AS raw FROM stats),
rates AS (SELECT source, CASE WHEN chars > 0 THEN raw / (SELECT sum(raw) FROM raw) * (SELECT sum(chars) FROM raw)::DOUBLE / chars END AS rate FROM raw),
terms AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma((k + 1)::DOUBLE)) AS p
          FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM rates WHERE rate > 0)),
sums AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM terms),
cdfs AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM sums GROUP BY source),
drawn AS (SELECT d.*, r.rate, CASE WHEN r.rate IS NULL THEN 1 ELSE
            len(list_filter(coalesce(c.cdf, [1.0]), lambda x: x <= (('0x' || left(md5('17:' || coalesce(doc_id::VARCHAR, '')), 13))::BIGINT)::DOUBLE / 4503599627370496.0)) END AS n
          FROM {docs} d LEFT JOIN rates r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN cdfs c ON d.source IS NOT DISTINCT FROM c.source),
copies AS (SELECT *, unnest(range(1, n + 1))::INTEGER AS replica FROM drawn)
SELECT {columns} FROM copies
"""


OP9_SQL = mix_sql("documents", "doc_id, source, lang, n_chars, text, round(rate, 9) AS rate, replica, md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || replica) AS shuffle_key")


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents."""
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_main_text, op2_media_columns, op3_byte_bpe, op4_warc, op5_near_duplicates, op6_fingerprints, op7_quality, op8_licences, op9_mixing, op10_pitman_yor)}


def oracle_sql() -> dict[str, str]:
    return {"op1_main_text": OP1_SQL, "op5_near_duplicates": OP5_SQL, "op4_warc": OP4_SQL, "op9_mixing": OP9_SQL}
