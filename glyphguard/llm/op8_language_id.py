"""Language ID by compression: a text is encoded with one zstandard raw-content dictionary per
language, and the language whose dictionary leaves the fewest bytes is chosen.

A dictionary is raw text of training documents. Text is compared as letters only, lower-cased, in
blocks, and every block follows a short primer from the dictionary's end, so that even a single word
is coded as a continuation rather than as an incompressible frame; only the bytes beyond the
primer's count. Prediction is a per-row function over dictionaries of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches

NOT_LETTERS = re.compile(r"[\W\d_]+")
BLOCK_BYTES = 8192
PRIMER_BYTES = 512
LEVEL = 6
UNDETERMINED = "und"
HASHES = 1 << 40


def letters(text: str) -> str:
    """Lower-cased words of letters, one space between."""
    return NOT_LETTERS.sub(" ", text).strip().lower()


def first_letters(text: str, size: int):
    """The first ``size`` bytes of a text's letters and a space, as ``part``."""

    @F.arrow_udf("binary")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([(letters(t.as_py()).encode("utf-8", "replace") + b" ")[:size] for t in texts], pa.binary())

    return cut(text).alias("part")


def train(docs: DataFrame, sample_docs: int = 400, dictionary_bytes: int = 1 << 17) -> list[tuple[str, int, bytes]]:
    """(language, training documents, dictionary) of each language in ``docs`` (doc_id, text, lang).

    The documents of a language are counted over all rows. Its dictionary is filled, up to
    ``dictionary_bytes``, from the ``sample_docs`` documents with the smallest hashes of their ids:
    a bounded, repeatable sample that does not depend on partitions. Rows without language, text or
    id are not learned from.
    """
    docs = bounded_batches(docs).filter("lang is not null and text is not null and doc_id is not null")
    spark = docs.sparkSession
    counts = {r.lang: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    # The smallest hashes of a language lie under this bound, which about 2 * sample_docs rows meet:
    # so few, not a language's rows, are ranked.
    bound = spark.createDataFrame([(lang, min(HASHES, 2 * sample_docs * HASHES // n + 1)) for lang, n in counts.items()], "lang string, bound long")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(HASHES))
    low = docs.select("doc_id", "lang", place.alias("place")).join(F.broadcast(bound), "lang").filter("place < bound")
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = low.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= sample_docs)
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min("turn").alias("turn"))
    # At most sample_docs ids a language, and no more of a text than its dictionary can take.
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    texts = texts.select("lang", "turn", first_letters("text", dictionary_bytes))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        parts, size = [], 0
        for part in rows.sort_values(["turn", "part"]).part:
            parts.append(part)
            size += len(part)
            if size >= dictionary_bytes:
                break
        return pd.DataFrame({"lang": rows.lang[:1], "dictionary": [b"".join(parts)[:dictionary_bytes]]})

    filled = {r.lang: bytes(r.dictionary) for r in texts.groupBy("lang").applyInPandas(fill, "lang string, dictionary binary").collect()}
    return [(lang, counts[lang], d) for lang, d in sorted(filled.items())]


class Compressors:
    def __init__(self, model: list[tuple[str, int, bytes]]):
        import zstandard

        self.coders = []
        for lang, n, content in sorted(model, key=lambda m: (-m[1], m[0])):
            if len(content.strip()) < 8:  # too short for zstandard to take as a dictionary
                content = (content + b" ") * 8
            content_dict = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            options = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK_BYTES, dict_size=len(content))
            content_dict.precompute_compress(compression_params=options)
            coder = zstandard.ZstdCompressor(compression_params=options, dict_data=content_dict)
            primer = content[-PRIMER_BYTES:]
            self.coders.append((lang, coder, primer, len(coder.compress(primer))))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin). The margin is how much larger the runner-up's code is, as a
        share of it; equal codes go to the language with more training documents."""
        body = letters(text or "").encode("utf-8", "replace")
        if not body or not self.coders:
            return UNDETERMINED, 0.0, 0.0
        blocks = [body[i : i + BLOCK_BYTES] for i in range(0, len(body), BLOCK_BYTES)]
        sizes = [sum(max(0, len(coder.compress(primer + b)) - base) for b in blocks) for _, coder, primer, base in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [s for k, s in enumerate(sizes) if k != best]
        margin = (min(others) - sizes[best]) / max(min(others), 1) if others else 1.0
        return self.coders[best][0], min(1.0, max(0.0, 0.5 + margin / 2)), margin


def identify(docs: DataFrame, model: list[tuple[str, int, bytes]], narrow: float = 0.02) -> DataFrame:
    """``docs`` plus lang_pred, score (0 to 1) and rejected.

    ``rejected`` marks a margin under ``narrow``: the smallest code is not clearly the smallest. The
    language is given all the same. A text that is null or has no letter is ``und`` with score 0,
    rejected. Input columns of these three names are replaced. Only ``text`` is looked at.
    """
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coders = Compressors(shared.value)
        for batch in texts:
            found = [coders.predict(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] < narrow for f in found], pa.bool_())],
                ["lang_pred", "score", "rejected"],
            )

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return docs.select(*kept, predict("text").alias("_found")).select(*kept, "_found.lang_pred", "_found.score", "_found.rejected")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from rows that are not held out. A row
    without doc_id is not held out, and not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = train(docs.filter(fold != 0))
    return identify(docs.select("doc_id", "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
