"""Exact verification of pairs of shingle sets, known by their digests, and the bound before it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, if_small, text_slices
from .shingles import shingle_sets

#: Text bytes hashed at once, and 64-bit words of a bitmap.
SLICE = 1 << 20
WORDS = 32


def digest(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(tokens, digest_size=16).digest()


def bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[(tokens >> np.uint64(20)) % np.uint64(64 * WORDS)] = 1
    return np.packbits(bits).view(np.int64)


def popcount(expression) -> Column:
    """Population count over the words of a bitmap expression of the word's number."""
    total = F.lit(0)
    for k in range(WORDS):
        total = total + F.bit_count(expression(k))
    return total


def close(a: str, b: str, percent: int) -> Column:
    """A bound on two sets (structs n, bits): false only where they cannot reach the threshold.
    Intersection >= percent / (100 + percent) of the sizes' sum leaves so many tokens unmatched, and
    every bit in which the bitmaps differ is an unmatched token."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = popcount(lambda k: F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k]))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (differ * (100 + percent) <= (n + m) * (100 - percent))


def set_key(of: bytes) -> int:
    """The first 64 bits of a digest: short enough to stand beside every token. Two sets may share one, so
    it only leads to candidates."""
    return int.from_bytes(of[:8], "little", signed=True)


def set_table(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, tokens) of the sets in ``wanted`` (id, digest, and the doc_id of a row that has the set)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text", SLICE):
                sets = shingle_sets(batch.column("text"), words)
                yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in sets], pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["digest", "tokens"])

    ids = wanted.select("doc_id").distinct()
    found = docs.join(if_small(wanted, 16, ids), "doc_id", "left_semi").mapInArrow(read, "digest binary, tokens array<long>")
    return found.join(if_small(wanted, 48, wanted.select("digest", "id")), "digest").groupBy("id").agg(F.first("tokens").alias("tokens"))


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) of ids whose exact similarity reaches the threshold, as a
    written table. ``classes`` has the id, digest and a doc_id of each set. Nothing after the joins needs
    their partitioning, so Spark may split a set of very many pairs."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = cut(classes.select("id", "doc_id", "digest").join(ids, "id", "left_semi"), "wanted")
    sets = cut(set_table(docs, wanted, words), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = cut(both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")
    drop_cut(sets)
    drop_cut(wanted)
    return links
