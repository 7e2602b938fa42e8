"""The corpus pipeline: documents that the quality classifier rejects go, repeated lines go, one
document of each near-duplicate group stays, documents with benchmark passages go, and the rest is
packed into sequences. Every stage reads all that its predecessor kept, from Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphguard.llm import op1_jaccard_join, op2_decontamination, op5_packing, op6_quality, op7_line_dedup
from glyphguard.llm.common import cut, if_small


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op6_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op6_quality.classify(docs, model).filter("accepted").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; n_chars follows the text."""
    out = op7_line_dedup.dedup_lines(docs).select(docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less those in ``gone`` (doc_id)."""
    gone = cut(gone.select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(if_small(gone, 16), F.col("doc_id") == F.col("_gone"), "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group stays; documents without shingles stay."""
    return _without(docs, op1_jaccard_join.jaccard_join(docs).filter("component_id <> doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, op2_decontamination.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op5_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: Classifiers, alignments and token ids are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
