"""Name vectors learned from the names: n-grams that stand in the same names get similar vectors.

Pairs of n-grams are counted over the distinct names and weighted by positive pointwise mutual
information. The sparse symmetric matrix of weights is factorised at low rank by a randomised subspace
iteration: it meets a narrow table of vectors, one per n-gram, in a join and a sum, and only the inner
products of that table's columns, a matrix as narrow as the vectors, reach the driver. A name's vector
is the weighted sum of its n-grams' vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize
from ..sources.scratch import drop_stored, stored


def name_grams(name: Column, low: int = 1, high: int = 2) -> Column:
    """Character n-grams of the lower-cased name between two marks of its ends."""
    text = F.concat(F.lit("^"), F.lower(name), F.lit("$"))
    n = F.char_length(text)
    of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(k)))
    return F.concat(*[of(k) for k in range(low, high + 1)])


def gram_pairs(names: DataFrame, low: int = 1, high: int = 2) -> DataFrame:
    """(gram, other, n): in how many of the distinct names (name) two n-grams stand together; a gram with
    itself counts its names. Counted per task first; a name has its length squared of pairs."""
    grams = F.array_distinct(name_grams(F.col("name"), low, high))
    rows = names.select("name").dropna().distinct().select(F.explode(grams).alias("gram"), grams.alias("all"))
    return rows.select("gram", F.explode("all").alias("other")).groupBy("gram", "other").agg(F.count("*").alias("n"))


def mutual_information(pairs: DataFrame, names: int) -> DataFrame:
    """(gram, other, weight) of the pairs that stand together more often than by chance."""
    own = pairs.filter("gram = other").select("gram", F.col("n").alias("own"))
    both = pairs.join(own, "gram").join(own.select(F.col("gram").alias("other"), F.col("own").alias("others")), "other")
    return both.select("gram", "other", F.log(F.col("n") * float(names) / (F.col("own") * F.col("others").cast("double"))).alias("weight")).filter("weight > 0")


def _times(weights: DataFrame, table: DataFrame, width: int) -> DataFrame:
    """The matrix of ``weights`` times a table (gram, v). Sums of arrays go by place, pre-aggregated."""
    terms = weights.join(table.withColumnRenamed("gram", "other"), "other").select("gram", F.transform("v", lambda x: x * F.col("weight")).alias("v"))
    return terms.groupBy("gram").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(width)]).alias("v"))


def _inner(a: DataFrame, b: DataFrame | None, width: int) -> np.ndarray:
    """The sum over all grams of the outer products of their vectors in two tables, or in one."""
    both = a.select("gram", "v", F.col("v").alias("w")) if b is None else a.join(b.withColumnRenamed("v", "w"), "gram")

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for f in frames:
            if len(f):
                total += np.stack(f.v.to_numpy()).T @ np.stack(f.w.to_numpy())
        yield pd.DataFrame({"row": range(width), "sums": list(total)})

    rows = both.select("v", "w").mapInPandas(part, "row int, sums array<double>").groupBy("row").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")).collect()
    out = np.zeros((width, width))
    for r in rows:
        out[r.row] = r.sums
    return out


def _turned(table: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Every vector of a table times a narrow matrix."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"gram": f.gram, "v": list(np.stack(f.v.to_numpy()) @ matrix)})

    return table.mapInPandas(run, "gram string, v array<double>")


def _orthonormal(table: DataFrame, width: int) -> DataFrame:
    """The table's columns made orthonormal through their inner products; columns that say nothing new
    become zero."""
    values, vectors = np.linalg.eigh(_inner(table, None, width))
    scale = np.where(values > values.max(initial=0) * 1e-12, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return stored(_turned(table, vectors * scale), "basis")


def gram_vectors(names: DataFrame, dim: int = 16, low: int = 1, high: int = 2, passes: int = 3, extra: int = 8) -> DataFrame:
    """(gram, vector) learned from a table of names (name): the ``dim`` strongest directions of the weights
    of ``gram_pairs``. ``passes``: times that the matrix is applied before; ``extra``: more directions
    that are carried on the way."""
    width = dim + extra
    distinct = names.select("name").dropna().distinct()
    pairs = stored(gram_pairs(distinct, low, high), "gram_pairs")
    weights = stored(mutual_information(pairs, distinct.count()), "weights")
    # The start: numbers between -1 and 1 by hashes of the gram, the same however rows are dealt.
    seed = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.pmod(F.xxhash64("gram", k), F.lit(1 << 20)).cast("double") / (1 << 19) - 1)
    basis = _orthonormal(stored(pairs.filter("gram = other").select("gram", seed.alias("v")), "start"), width)
    for _ in range(passes):
        product = stored(_times(weights, basis, width), "product")
        basis, old = _orthonormal(product, width), basis
        drop_stored(product, old)
    small = _inner(basis, _times(weights, basis, width), width)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    first = np.argsort(-np.abs(values))[:dim]
    out = stored(_turned(basis, vectors[:, first] * np.sqrt(np.abs(values[first]))).withColumnRenamed("v", "vector"), "gram_vectors")
    drop_stored(pairs, weights, basis)
    return out


def learned_vectors(names: DataFrame, vectors: DataFrame, distinct_names: int, own: DataFrame, low: int = 1, high: int = 2) -> DataFrame:
    """(name, embedding) of each distinct name: the sum of its n-grams' vectors, each as often as it occurs
    and weighted by ln((1 + N) / (1 + names of the gram)) + 1 (``own``: gram, n), as a unit vector. N-grams
    never seen add nothing; a name without any known one has a vector of zeros."""
    width = len((vectors.select("vector").first() or [[]])[0])
    weight = (F.log((1.0 + distinct_names) / (1.0 + F.col("n"))) + 1.0).alias("weight")
    known = vectors.join(own, "gram").select("gram", "vector", weight)
    grams = names.select("name").dropna().distinct().select("name", F.explode(name_grams(F.col("name"), low, high)).alias("gram"))
    rows = grams.groupBy("name", "gram").agg(F.count("*").alias("tf")).join(known, "gram", "left")
    sums = rows.groupBy("name").agg(F.array(*[F.coalesce(F.sum(F.col("tf") * F.col("weight") * F.col("vector")[i]), F.lit(0.0)) for i in range(width)]).cast("array<double>").alias("v"))
    return sums.select("name", l2_normalize(F.col("v")).alias("embedding"))


def embed_learned(pairs: DataFrame, dim: int = 16) -> DataFrame:
    """fraud_emb and real_emb of each pair (fraudulent_name, real_name), by vectors learned from the pairs'
    own names; labels are not looked at."""
    from .tables import attach_vectors, unique_names

    names = stored(unique_names(pairs), "names")
    vectors = gram_vectors(names, dim)
    own = gram_pairs(names).filter("gram = other").select("gram", "n")
    return attach_vectors(pairs, learned_vectors(names, vectors, names.count(), own))
