"""Chunks and their retrieval: windows of text, BM25, entity links, vectors."""

from __future__ import annotations

import hashlib
import logging
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.functions.stats import ratio
from gristmill.tables import drop_kept, kept

#: The names, sizes and overlaps of the chunkers that cut by length, in characters.
WINDOWS = {"token_512": (512, 64), "token_1024": (1024, 128)}
#: The sizes of the chunkers that cut at delimiters.
RECURSIVE = {"cep_4k": 4000, "bm25_4k": 4000, "nx_2k": 2000}
DELIMITERS = ("\n\n", "\n", ". ", " ")
#: Labels that a word may stand in and still have all of them weighed.
COMMON = 256


def chunk_id(source: Column, chunker: Column, start: Column, end: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", source.cast("string"), chunker, start.cast("string"), end.cast("string")).cast("binary")), 1, 16)


def window_chunks(docs: DataFrame, key: str, text: str, chunker: str) -> DataFrame:
    """Windows of fixed length that overlap; the last ends with the text; an empty text has none."""
    size, overlap = WINDOWS[chunker]
    step, n = size - overlap, F.length(F.col(text))
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")), lambda i: i * step)
    rows = docs.filter(n > 0).select(F.col(key).alias("source_file_id"), n.alias("n"), F.explode(starts).alias("start_char"))
    rows = rows.withColumns({"end_char": F.least(F.col("start_char") + size, F.col("n")), "chunker_id": F.lit(chunker)}).drop("n")
    return rows.withColumn("chunk_id", chunk_id(F.col("source_file_id"), F.col("chunker_id"), F.col("start_char"), F.col("end_char")))


def split_at(text: str, size: int, delimiters: tuple[str, ...] = DELIMITERS) -> list[tuple[int, int]]:
    """Spans that cover text, each of `size` at most: cut at the first delimiter that helps, pieces joined while they fit."""

    def cut(start: int, end: int, level: int) -> Iterator[tuple[int, int]]:
        if end - start <= size:
            yield start, end
        elif level == len(delimiters):
            yield from ((i, min(i + size, end)) for i in range(start, end, size))
        else:
            at, mark = start, delimiters[level]
            while at < end:
                found = text.find(mark, at, end)
                stop = end if found < 0 else found + len(mark)
                yield from cut(at, stop, level + 1)
                at = stop

    out: list[tuple[int, int]] = []
    for a, b in cut(0, len(text), 0):
        if out and b - out[-1][0] <= size:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return [(a, b) for a, b in out if b > a]


def recursive_chunks(docs: DataFrame, key: str, text: str, chunker: str) -> DataFrame:
    """Chunks cut at paragraphs, lines, sentences, words; offsets only."""
    size, kind = RECURSIVE[chunker], dict(docs.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, s, e) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s, e in split_at(t or "", size)]
            ids = [hashlib.sha1(f"{k}|{chunker}|{s}|{e}".encode()).hexdigest()[:16] for k, s, e in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([chunker] * len(rows)), pa.array(ids, pa.string())], names=["source_file_id", "start_char", "end_char", "chunker_id", "chunk_id"])

    return docs.select(key, text).mapInArrow(run, f"source_file_id {kind}, start_char int, end_char int, chunker_id string, chunk_id string")


def resolve(chunks: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """chunks(source_file_id, start_char, end_char, source_text_sha256, ...) with their text; a changed source is an error."""
    d = docs.select(F.col(key).alias("source_file_id"), F.col(text).alias("__text"))
    joined = chunks.join(d, "source_file_id")
    same = F.sha2(F.col("__text").cast("binary"), 256) == F.col("source_text_sha256")
    body = F.substring("__text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    return joined.withColumn("text", F.when(same, body).otherwise(F.raise_error(F.lit("the source has changed since it was cut")).cast("string"))).drop("__text")


def bm25_index(docs: DataFrame, key: str, text: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """postings(term, key, w) and terms(term, df, idf); a negative idf counts as epsilon times the mean one.

    Counts by term and document, document lengths and two numbers of the whole corpus; w is the saturated frequency.
    """
    tokens = docs.select(key, F.explode(tx.tokens(F.col(text))).alias("term"))
    tf = kept(tokens.groupBy(key, "term").agg(F.count("*").alias("tf")), "terms-of-documents")
    length = tf.groupBy(key).agg(F.sum("tf").alias("dl"))
    corpus = docs.select(key).agg(F.count("*").alias("n"))
    mean = length.agg(F.sum("dl").alias("words"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(corpus)).withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    average = raw.agg(F.avg("raw").alias("mean_idf"))
    terms = raw.join(F.broadcast(average)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    avg = F.col("words") / F.col("n")
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avg))
    postings = tf.join(length, key).join(F.broadcast(corpus)).join(F.broadcast(mean)).select("term", key, weight.alias("w"))
    return postings, terms


def bm25(questions: DataFrame, index: tuple[DataFrame, DataFrame], key: str, k: int, docs: DataFrame | None = None) -> DataFrame:
    """(query, key, rank, score) of the k best documents of questions(query, text); repeated words count again.

    Only postings of the questions' words are joined. With docs(key, ...) documents without any of them score 0 and are
    ranked as well, in order of their keys: no more than the first few can be among the best, so only these are added.
    """
    postings, terms = index
    words = questions.select("query", F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    hits = words.join(terms, "term").join(postings, "term")
    scored = hits.groupBy("query", key).agg(F.round(F.sum(F.col("times") * F.col("idf") * F.col("w")), 6).alias("score"))
    if docs is not None:
        scored = kept(scored, "scores")
        found = questions.select("query").join(scored.groupBy("query").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 0).alias("good")), "query", "left").fillna(0, ["n", "good"])
        short = found.filter(F.col("good") < k)
        most = k + (short.agg(F.max("n")).first()[0] or 0)
        first = F.broadcast(docs.select(key).orderBy(key).limit(most))  # as many as the longest list that lacks some
        none = short.select("query").join(first).join(scored.select("query", key), ["query", key], "left_anti")
        scored = scored.unionByName(none.withColumn("score", F.lit(0.0)))
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)


def label_index(nodes: DataFrame) -> DataFrame:
    """(token, node_id) of nodes that a question can be linked to."""
    n = nodes.filter(F.col("type").isin("entity", "event", "concept"))
    return n.select("node_id", F.explode(F.array_distinct(F.regexp_extract_all(tx.nfkc_casefold(F.col("label")), F.lit(r"(?U)(\w+)"), F.lit(1)))).alias("token"))


def link_entities(questions: DataFrame, nodes: DataFrame, k: int = 50, common: int = COMMON) -> DataFrame:
    """(query, node_id, weight, place) of the k nodes whose labels share the rarest words with a question.

    Written once. Nodes that share a word of at most `common` labels with a question are all weighed. The others' weights
    come from common words alone, so nodes whose labels have the same ones weigh the same, and of these only the first k
    can be among the best; and questions that have the same ones share what they find.
    """
    by_weight = lambda *by: Window.partitionBy(*by).orderBy(F.desc("weight"), "node_id")
    words = kept(questions.select("query", F.explode(tx.query_tokens(F.col("text"))).alias("token")).groupBy("query", "token").agg(F.count("*").alias("asked")), "words")
    index = label_index(nodes).join(words.select("token").distinct(), "token", "left_semi")
    n = nodes.filter(F.col("type").isin("entity", "event", "concept")).agg(F.count("*").alias("n"))
    df = index.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n))
    df = kept(df.select("token", "df", F.ln((F.col("n") + 1) / (F.col("df") + 1)).alias("idf")), "frequencies")
    rare, often = df.filter(F.col("df") <= common), df.filter(F.col("df") > common)
    held = kept(index.join(df.select("token", (F.col("df") > common).alias("often")), "token").groupBy("node_id", "token", "often").agg(F.count("*").alias("times")), "labels")
    of = lambda rows: rows.groupBy("query", "node_id").agg(F.round(F.sum(F.col("asked") * F.col("times") * F.col("idf")), 6).alias("weight"))

    # what a rare word finds
    pairs = kept(words.join(rare.select("token"), "token").join(held.filter("not often").select("token", "node_id"), "token").select("query", "node_id").distinct(), "pairs")
    near = kept(of(pairs.join(held, "node_id").join(words, ["query", "token"]).join(df, "token")), "near")

    # what common words find: classes of nodes by classes of questions
    bag = lambda count: F.sort_array(F.collect_list(F.struct("token", count)))
    firsts = held.filter("often").groupBy("node_id").agg(bag("times").alias("has"))
    firsts = firsts.withColumn("place", F.row_number().over(Window.partitionBy("has").orderBy("node_id"))).filter(F.col("place") <= k)
    firsts = kept(firsts, "firsts")
    asks = kept(words.join(often.select("token"), "token").groupBy("query").agg(bag("asked").alias("asks")), "asks")
    ask = asks.select("asks").distinct().select("asks", F.inline("asks")).join(often, "token")
    classes = firsts.filter("place = 1").select("has", "node_id", F.inline("has"))
    scored = ask.join(classes, "token").groupBy("asks", "has", "node_id").agg(F.round(F.sum(F.col("asked") * F.col("times") * F.col("idf")), 6).alias("weight"))
    scored = scored.withColumn("at", F.row_number().over(by_weight("asks"))).filter(F.col("at") <= k)
    best = scored.select("asks", "has", "weight").join(firsts.select("has", "node_id"), "has")
    best = best.withColumn("at", F.row_number().over(by_weight("asks"))).filter(F.col("at") <= k)
    most = best.groupBy("asks").agg(F.collect_list(F.struct("node_id", "weight")).alias("best"))
    far = asks.join(most, "asks").select("query", F.inline("best")).join(pairs, ["query", "node_id"], "left_anti")

    out = near.unionByName(far).withColumn("place", F.row_number().over(by_weight("query"))).filter(F.col("place") <= k)
    out = kept(out, "links")
    drop_kept(words, df, held, pairs, near, firsts, asks)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def nearest(probes: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query, vec_id, rank, score): the k nearest by cosine of probes(query, v), a few, among vectors(vec_id, embedding)."""
    v = vectors.select("vec_id", "embedding", F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("norm"))
    p = probes.select("query", "v", F.sqrt(dot(F.col("v"), F.col("v"))).alias("pn"))
    scored = v.join(F.broadcast(p), F.col("vec_id") != F.col("query")).select("query", "vec_id", F.round(F.try_divide(dot(F.col("v"), F.col("embedding")), F.col("norm") * F.col("pn")), 6).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)


def source_recovery(retrieved: Column, context: Column, is_prose: Column) -> Column:
    """Share of the retrieved words that the context has; null for what isn't prose and where either is empty."""
    a, b = F.array_distinct(retrieved), F.array_distinct(context)
    return F.when(is_prose & (F.size(a) > 0) & (F.size(b) > 0), ratio(F.size(F.array_intersect(a, b)), F.size(a)))


def gathered(ranked: DataFrame, arm: str, chunk: str) -> DataFrame:
    """(arm, query, passages): ranked rows as an array of chunk, rank and score for each question."""
    return ranked.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(chunk).cast("string").alias("chunk_id"), "score"))).alias("passages")).withColumn("arm", F.lit(arm))


PASSAGES = "array<struct<rank:int,chunk_id:string,score:double>>"


def retrieved(questions: DataFrame, arms: dict[str, Callable[[DataFrame, int], DataFrame]], k: int, done: DataFrame | None = None) -> DataFrame:
    """(query, arm, passages, elapsed_s, error): each arm's k passages for each of questions(query, text), written arm by arm.

    An arm gets the questions that done(query, arm) doesn't have and gives (query, passages), see gathered(); questions
    it leaves out have no passages. If an arm fails, its questions have its error and null passages, and the other arms
    go on. elapsed_s is the whole arm's time, as all its questions run as one job.
    """
    if not arms or k < 1:
        raise ValueError("at least one arm and one passage are needed")
    out = None
    for name, arm in arms.items():
        began = time.monotonic()
        asked = questions if done is None else questions.join(done.filter(F.col("arm") == name), "query", "left_anti")
        error = F.lit(None).cast("string")
        try:
            passages = kept(arm(asked, k).select("query", F.col("passages").cast(PASSAGES)), f"passages-{name}")
            rows = asked.select("query").join(passages, "query", "left").withColumn("passages", F.coalesce("passages", F.array().cast(PASSAGES)))
        except Exception as e:  # whatever an arm may fail by, the others' answers are wanted
            logging.getLogger(__name__).exception("arm %s failed", name)
            rows, error = asked.select("query", F.lit(None).cast(PASSAGES).alias("passages")), F.lit(f"{type(e).__name__}: {e}"[:500])
        rows = rows.select("query", F.lit(name).alias("arm"), "passages", F.lit(time.monotonic() - began).alias("elapsed_s"), error.alias("error"))
        out = rows if out is None else out.unionByName(rows)
    return out


def located(passages: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """passages(key, passage_id, needle) with start and end in their source: exactly, else with white space folded, else null."""
    joined = passages.join(docs.select(key, F.col("text").alias("__text")), key, "left")
    at = F.instr(F.col("__text"), F.col("needle"))
    found = joined.withColumn("at", F.coalesce(at, F.lit(0)))
    exact = found.filter("at > 0").select(key, "passage_id", (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.length("needle")).alias("end"), F.lit("exact").alias("how"))
    rest = found.filter("at = 0").select(key, "passage_id", "needle", "__text")
    kinds = dict(rest.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for b in batches:
            spans = []
            for needle, source in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = (needle or "").split()
                m = re.search(r"\s+".join(map(re.escape, words)), source) if words and source else None
                spans.append((m.start(), m.end(), "folded") if m else (None, None, "unmatched"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s[0] for s in spans], pa.int32()), pa.array([s[1] for s in spans], pa.int32()), pa.array([s[2] for s in spans])], names=[key, "passage_id", "start", "end", "how"])

    return exact.unionByName(rest.mapInArrow(run, f"{key} {kinds[key]}, passage_id {kinds['passage_id']}, start int, end int, how string"))
