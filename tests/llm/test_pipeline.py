import zlib

import numpy as np
import public_tokenizers
import pytest
from test_op1 import brute
from test_op3_op4_op5 import check_packing

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage, each from Parquet."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stage')}/{name}"
        stage(spark, docs, SMALL).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns_and_the_clean(spark, stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == COLUMNS and 0.5 * before.count() < after.count() <= before.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = ids(stages["quality_classifier"][1])
    assert np.mean([(labels[d] == 1) == (d in kept) for d in labels]) > 0.95


def test_near_duplicates_leave_one(stages):
    before, after = stages["jaccard_join"]
    want = brute([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == {d for d, (_, c) in want.items() if c == d}


def test_decontaminated(spark, stages):
    from glyphguard.llm.op2_decontamination import find_leaks

    _, after = stages["decontamination"]
    assert find_leaks(after, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0


def test_lines_and_lengths(stages):
    before, after = stages["line_dedup"]
    assert before.count() == after.count() and all(r.n_chars == len(r.text) for r in after.collect())


def test_run_is_the_stages(spark, stages):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: plain.encode(r.text, add_special_tokens=False).ids + [2] for r in stages["decontamination"][1].collect()}
    from pyspark.sql import functions as F

    check_packing(corpus_pipeline.run(spark, SMALL).withColumn("ids_crc32", F.crc32("ids")).collect(), want)
    assert zlib.crc32(b"") == 0 and corpus_pipeline.ORACLE_SQL is None


def test_edges_go_through_every_stage(spark, edge_docs):
    docs = edge_docs.select(*COLUMNS)
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, SMALL).columns == COLUMNS
            stage(spark, df, SMALL).collect()
