"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over
the threshold, reassemble by position.

Only hashes travel: a line's key goes through the shuffle as 128 bits plus the document id, once a
document. Counting is a two-level aggregate (first by key and document, then by key), so a line
that stands in a third of all documents is pre-aggregated on the map side and never meets in one
task. The text itself is read again and rewritten in place: the hot lines, a key and its keeper each,
are broadcast when they were counted to fit, and a line goes when it is hot and its document is not
the keeper. Only where the hot lines are too many for that, keys to drop are listed per document and
joined to the texts by doc_id, which shuffles both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import ascii_lower, bounded_batches, cut, drop_cut, text_slices

WHITE = " \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int) -> bytes | None:
    """128-bit hash of the normalised line; None for a line too short to count."""
    line = line.strip(WHITE)
    if len(line) < min_chars:
        return None
    return xxhash.xxh3_128_digest(ascii_lower(line).encode("utf-8", "surrogatepass"))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key), each key once a row of ``docs``."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                ids, keys = [], []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    found = {line_key(x, min_chars) for x in (text or "").split("\n")} - {None}
                    ids += [doc_id] * len(found)
                    keys += found
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(explode, "doc_id long, key binary")


class HotLines:
    """Keys and keepers of hot lines, for lookup of many keys at once."""

    def __init__(self, keys: bytes, keepers: np.ndarray):
        parts = np.frombuffer(keys, "<u8").reshape(-1, 2)
        order = np.argsort(parts[:, 0], kind="stable")
        self.first, self.second, self.keepers = parts[order, 0], parts[order, 1], keepers[order]
        # Keys with the same first half stand together; so many at most.
        self.same = int(np.unique(self.first, return_counts=True)[1].max(initial=0))

    def lost(self, keys: list[bytes | None], docs: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Whether each line, with its document and whether that has an id, is hot and kept elsewhere."""
        out, some = np.zeros(len(keys), bool), np.flatnonzero([k is not None for k in keys])
        if not len(some) or not len(self.first):
            return out
        parts = np.frombuffer(b"".join(keys[i] for i in some), "<u8").reshape(-1, 2)
        at = np.searchsorted(self.first, parts[:, 0])
        for _ in range(self.same):
            place = np.minimum(at, len(self.first) - 1)
            hot = (self.first[place] == parts[:, 0]) & (self.second[place] == parts[:, 1])
            out[some] |= hot & ~(known[some] & (docs[some] == self.keepers[place]))
            at = at + 1
        return out


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``text`` rebuilt from the lines kept, plus n_lines (before)
    and n_dropped.

    A key (line stripped of ASCII white space, A-Z lower-cased) of at least ``min_chars`` code
    points found in at least ``min_docs`` distinct documents keeps its lines only in the largest
    doc_id that holds it; repeats inside that document stay. Null or empty text is one empty line
    and gives an empty text. A row without doc_id is not counted as a document and loses every line
    that is dropped anywhere. Rows that repeat a doc_id are one document. Input columns named
    n_lines or n_dropped are replaced; all others pass through.
    """
    pairs = cut(line_hashes(bounded_batches(docs), min_chars), "line_hashes")
    hot = (
        pairs.groupBy("key")
        .agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
        .select("key", "keeper")
    )
    hot = cut(hot, "hot_lines")
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    doc_id = F.col("doc_id").cast("long")
    if hot.count() * 24 <= common.BROADCAST_BYTES:
        # A counted table of 24 bytes a row.
        table = hot.toArrow()
        keys = b"".join(x.as_py() for x in table["key"])
        lines = docs.sparkSession.sparkContext.broadcast(HotLines(keys, table["keeper"].to_numpy()))
        drop_cut(pairs)
        drop_cut(hot)

        @F.arrow_udf(REBUILT)
        def rebuild(text: pa.Array, ids: pa.Array) -> pa.Array:
            known = np.array(ids.is_valid().to_pylist(), bool)
            numbers, split = ids.fill_null(0).to_numpy(), [(t.as_py() or "").split("\n") for t in text]
            of = np.repeat(np.arange(len(split)), [len(x) for x in split])
            gone = lines.value.lost([line_key(x, min_chars) for parts in split for x in parts], numbers[of], known[of])
            return rebuilt(split, gone)

        new = docs.select(*own, rebuild("text", doc_id).alias("_new"))
    else:
        # A row without id has no keeper's line, so all its hot lines go; it is known by a hash of its text,
        # which deals such rows over all tasks, and texts that share a hash may share their list.
        by_text = F.when(doc_id.isNull(), F.xxhash64("text"))
        unnamed = docs.filter(doc_id.isNull()).select(F.xxhash64("text").alias("doc_id"), "text")
        lost = (
            pairs.filter("doc_id is not null")
            .join(hot, "key")
            .filter("doc_id <> keeper")
            .select(F.col("doc_id").alias("_lost_doc"), F.lit(None).cast("long").alias("_lost_text"), "key")
            .unionByName(line_hashes(unnamed, min_chars).join(hot, "key").select(F.lit(None).cast("long").alias("_lost_doc"), F.col("doc_id").alias("_lost_text"), "key"))
            .groupBy("_lost_doc", "_lost_text")
            .agg(F.collect_set("key").alias("_lost"))
        )
        meets = doc_id.eqNullSafe(F.col("_lost_doc")) & by_text.eqNullSafe(F.col("_lost_text"))

        @F.arrow_udf(REBUILT)
        def rebuild(text: pa.Array, lost: pa.Array) -> pa.Array:
            split, gone = [(t.as_py() or "").split("\n") for t in text], []
            for parts, keys in zip(split, lost):
                keys = set(keys.as_py()) if keys.is_valid else ()
                gone += [bool(keys) and line_key(x, min_chars) in keys for x in parts]
            return rebuilt(split, np.array(gone, bool))

        new = docs.join(lost, meets, "left").select(*own, rebuild("text", "_lost").alias("_new"))
    return new.select(
        *[F.col("_new.text") if c == "text" else F.col(c) for c in docs.columns if c in own or c == "text"],
        "_new.n_lines",
        "_new.n_dropped",
    )


REBUILT = "struct<text:string,n_lines:long,n_dropped:long>"


def rebuilt(split: list[list[str]], gone: np.ndarray) -> pa.Array:
    """Lines of many texts joined again without those that are gone."""
    texts, dropped, at = [], [], 0
    for parts in split:
        lost = gone[at : at + len(parts)]
        at += len(parts)
        dropped.append(int(lost.sum()))
        texts.append("\n".join(x for x, g in zip(parts, lost.tolist()) if not g) if dropped[-1] else "\n".join(parts))
    lines = pa.array([len(x) for x in split], pa.int64())
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), lines, pa.array(dropped, pa.int64())], ["text", "n_lines", "n_dropped"])


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), keyed AS (
  SELECT *, CASE WHEN length(bare) >= 40
                 THEN translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS k
  FROM lines
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT a.*, b.k IS NOT NULL AND a.doc_id <> b.keeper AS gone FROM keyed a LEFT JOIN hot b ON a.k = b.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
