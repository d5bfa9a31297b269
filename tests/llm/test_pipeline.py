"""The pipeline's stages, one by one and together."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import mixing, quality

from ..conftest import SF
from .test_operators import brute_links, plain_tokenizer


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 4
    good = stages["quality_classifier"](spark, docs, SF).cache()
    keep = {r["doc_id"] for r in quality.classify(docs, labels).filter("keep").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == keep and 0 < len(keep) < docs.count()
    once = stages["minhash_near_dedup"](spark, good, SF).cache()
    links = brute_links([(r["doc_id"], r["text"]) for r in good.collect()], 80)
    assert once.columns == docs.columns and sorted(r["doc_id"] for r in once.collect()) == sorted(i for i, (_, c) in links.items() if i == c)
    mixed = stages["mixing_sources"](spark, once, SF).cache()
    assert mixed.columns == docs.columns and Counter(r["doc_id"] for r in mixed.collect()) == Counter(r["doc_id"] for r in mixing.mix(once).collect())
    library = plain_tokenizer()
    for r in stages["byte_bpe"](spark, mixed.limit(20), SF).collect():
        assert r["ids"] == library.encode_ordinary(r["decoded"]) and r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()


def test_run_is_the_stages_in_turn(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and "ids_sha256" in got.columns


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, stage, tmp_path):
    rng = random.Random(1)
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (None, "x y", "en", "a", 3), (3, "same words here in a row", "en", "a", 1), (3, "same words here in a row", "en", "a", 1), (4, " ".join(str(rng.random()) for _ in range(3000)), "en", "b", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("key", "__key", "__doc", "__row", "__rate", "__replica")})
    spark.createDataFrame([(3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    f = dict(corpus_pipeline.STAGES)[stage]
    out = f(spark, d, str(tmp_path))
    assert stage == "mixing_sources" or out.count() <= len(rows)
    if stage != "byte_bpe":
        assert out.columns == d.columns
    assert f(spark, d.limit(0), str(tmp_path)).count() == 0
