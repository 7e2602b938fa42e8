"""Vector search by coarse cells: an inverted list of unit vectors per k-means cell.

A vector stands in the list of its nearest centroid, beside its distance to it (its residual). A query
probes its nearest cells for candidates; for an exact answer it then opens every cell, and within a
cell every stretch of residuals, that can still hold a better one: by the triangle inequality a vector
of residual r in a cell at distance d is at least |d - r| away. Lists stand in files by cell and
residual, a large cell in many; a task streams them past a block of queries and scores, by matrix
products, what each query opens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import drop_stored, stored
from . import search
from .vector_tiles import Best, kinds, units, usable

#: Rows of a cell's list that go to one file, about; vectors that distances to all centroids are held for.
BLOCK, CHUNK = 65_536, 512
#: Slack of a comparison between float distances.
EPS = 1e-6


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * (x @ centroids.T)
    return np.sqrt(np.maximum(d, 0))


@dataclass
class CellIndex:
    """Centroids; the lists (cell, ref_id, v, residual) by cell and residual; per cell its size and least and greatest residual."""

    centroids: np.ndarray
    lists: DataFrame
    sizes: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def stats(self) -> DataFrame:
        rows = [(k, int(n)) for k, n in enumerate(self.sizes) if n]
        return self.lists.sparkSession.createDataFrame(rows, "cell int, size long")


def fit_cells(refs: DataFrame, cells: int | None = None, sample: int = 50_000, seed: int = 42) -> CellIndex:
    """An index of refs (ref_id, ref_vec); rows without a vector, or with a
    component that is missing or not finite, are left out. Centroids are fitted by
    Spark's k-means on at most ``sample`` rows, those with the least hash of their id; every row is
    indexed. ``cells``: the square root of the rows, 2048 at most, if not given."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from ..functions.vectors import l2_normalize

    # Read several times below: vectors may be dear to make.
    refs = stored(refs.filter(usable("ref_vec")).select("ref_id", "ref_vec"), "refs")
    n = refs.count()
    if not n:
        return CellIndex(np.zeros((0, 0)), stored(refs.select(F.lit(0).alias("cell"), "ref_id", F.col("ref_vec").cast("array<double>").alias("v"), F.lit(0.0).alias("residual")), "lists"), *np.zeros((3, 0)))
    cells = min(cells or int(np.ceil(np.sqrt(n))), 2048, n)
    if cells > 1:
        some = refs.orderBy(F.xxhash64("ref_id"), "ref_id").limit(sample)
        # A limit leaves one partition: k-means would be one task.
        some = some.repartition(refs.sparkSession.sparkContext.defaultParallelism).select(array_to_vector(l2_normalize(F.col("ref_vec"))).alias("features"))
        centroids = np.array(KMeans(k=cells, maxIter=10, seed=seed).fit(some).clusterCenters())
    else:
        centroids = np.zeros((1, len(refs.first().ref_vec)))
    shared = refs.sparkSession.sparkContext.broadcast(centroids)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), CHUNK):
                v = units(f.ref_vec.iloc[at : at + CHUNK])
                d = distances(v, shared.value)
                cell = d.argmin(axis=1)
                yield pd.DataFrame({"cell": cell, "ref_id": f.ref_id.to_numpy()[at : at + CHUNK], "v": list(v), "residual": d[np.arange(len(v)), cell]})

    kind = refs.schema["ref_id"].dataType.simpleString()
    placed = stored(refs.mapInPandas(place, f"cell int, ref_id {kind}, v array<double>, residual double"), "placed")
    drop_stored(refs)
    sizes, least, most = np.zeros(len(centroids), np.int64), np.full(len(centroids), np.inf), np.zeros(len(centroids))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("residual").alias("least"), F.max("residual").alias("most")).collect():
        sizes[r.cell], least[r.cell], most[r.cell] = r.n, r.least, r.most
    index = CellIndex(centroids, placed, sizes, least, most)
    # A cell is cut at its hashes, so that one with most of the rows is many tasks.
    parted = placed.join(F.broadcast(index.stats()), "cell").withColumn("block", F.pmod(F.xxhash64("ref_id"), F.ceil(F.col("size") / BLOCK)))
    index.lists = stored(parted.repartition("cell", "block").sortWithinPartitions("cell", "residual").drop("size", "block"), "lists")
    drop_stored(placed)
    return index


def _planned(queries: DataFrame, index: CellIndex, probes: int) -> DataFrame:
    """queries plus ``opened``: the nearest ``probes`` cells that have rows, as bits."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.sizes))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, sizes = shared.value
        for f in frames:
            for at in range(0, len(f), CHUNK):
                some = f.iloc[at : at + CHUNK]
                d = np.where(sizes > 0, distances(units(some.query_vec), centroids), np.inf)
                chosen = (np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1) < probes) & (sizes > 0)
                yield pd.DataFrame({"query_id": some.query_id, "query_vec": some.query_vec, "within": some.within, "opened": [x.tobytes() for x in np.packbits(chosen, axis=1)]})

    kind, vector = queries.schema["query_id"].dataType.simpleString(), queries.schema["query_vec"].dataType.simpleString()
    return queries.mapInPandas(run, f"query_id {kind}, query_vec {vector}, within double, opened binary")


def _scored(queries: DataFrame, index: CellIndex, probes: int, k: int, rest: bool, score: bool = True) -> DataFrame:
    """(query_id, ref_id, cosine, pairs) as ``Best.frames``, task by task, of a block of queries (query_id,
    query_vec, within) in their nearest ``probes`` cells, or with ``rest`` of what the other cells hold
    at a distance of ``within`` or less by the triangle inequality. Without ``score`` the latter is only
    counted: in the order of residuals it is a stretch of each list."""
    got = _planned(queries, index, probes).toArrow()
    if not len(got):
        return _empty(queries, index)
    opened = np.frombuffer(b"".join(got["opened"].to_pylist()), np.uint8).reshape(len(got), -1)
    shared = queries.sparkSession.sparkContext.broadcast(
        (got["query_id"].to_numpy(zero_copy_only=False), units(got["query_vec"].to_pylist()), got["within"].to_numpy(zero_copy_only=False), opened, index.centroids, index.least, index.most)
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, u, within, opened, centroids, least, most = shared.value
        # A query's best so far has a cosine of 1 - within^2 / 2 at least.
        best = Best(ids, k, 1 - within * within / 2 - EPS)
        for f in frames:
            if not len(f):
                continue
            v, cells, refs, residual = np.stack(f.v.to_numpy()) if score else None, f.cell.to_numpy(), f.ref_id.to_numpy(), f.residual.to_numpy()
            # A cell may go on in another file, where residuals begin anew.
            cuts = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(residual) < 0)) + 1), len(cells)]
            for start, end in zip(cuts, cuts[1:]):
                cell = cells[start]
                mine = (opened[:, cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)
                if not rest:
                    best.add(np.flatnonzero(mine), u, refs[start:end], v[start:end])
                    continue
                apart = distances(u, centroids[cell : cell + 1])[:, 0]
                bound = np.maximum(np.maximum(apart - most[cell], least[cell] - apart), 0)
                rows, far = np.flatnonzero(~mine & (bound <= within + EPS)), residual[start:end]
                best.add(rows, u, refs[start:end], v[start:end] if score else None, stretch=lambda some, part: (np.searchsorted(far[part], apart[some] - within[some] - EPS), np.searchsorted(far[part], apart[some] + within[some] + EPS, side="right")), score=score)
        yield from best.frames()

    return index.lists.select("cell", "ref_id", *(["v"] if score else []), "residual").mapInPandas(run, kinds(queries, index.lists))


def _empty(queries: DataFrame, index: CellIndex) -> DataFrame:
    return queries.sparkSession.createDataFrame([], kinds(queries, index.lists))


def search_cells(queries: DataFrame, index: CellIndex, k: int, probes: int, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """The k nearest of each query (query_id, query_vec), other than itself, as (query_id, ref_id, cosine,
    rank), and the pairs that were scored as (query_id, pairs). Without ``exact`` only the ``probes``
    nearest cells are read; with it, also whatever may hold a better one than those found there.
    Queries go in blocks of ``search.BLOCK_ROWS``."""
    near, rest = _searched(queries, index, k, probes, exact)
    found = near.union(rest)
    order = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "ref_id")
    rows = found.filter("ref_id is not null").select("query_id", "ref_id", "cosine").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return rows, found.filter("ref_id is null").groupBy("query_id").agg(F.sum("pairs").alias("pairs"))


def _searched(queries: DataFrame, index: CellIndex, k: int, probes: int, exact: bool, score: bool = True) -> tuple[DataFrame, DataFrame]:
    """What the probed cells give, and with ``exact`` the others, as ``_scored``."""
    queries = queries.filter(usable("query_vec")).select("query_id", "query_vec")
    order = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "ref_id")
    found, more = _empty(queries, index), _empty(queries, index)
    for block in search.query_blocks(queries, "query_id") if index.sizes.sum() else []:
        near = stored(_scored(block.withColumn("within", F.lit(2.0)), index, probes, k, False), "probed")
        found = found.union(near)
        if exact:
            kth = near.filter("ref_id is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(2 - 2 * F.col("cosine"), F.lit(0.0))).alias("within"))
            asks = block.join(kth, "query_id", "left").fillna(2.0, ["within"])
            more = more.union(stored(_scored(asks, index, probes, k, True, score), "searched"))
    return found, more


def pairs_of(queries: DataFrame, index: CellIndex, k: int, probes: int) -> tuple[int, int]:
    """The pairs that ``search_cells`` scores for all queries, with and without ``exact``: (probed, exact).
    The probed cells are searched once; what an exact answer opens beyond them is counted, not scored."""
    probed, rest = (x.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0] for x in _searched(queries, index, k, probes, True, score=False))
    return probed, probed + rest


def tuned_probes(index: CellIndex, queries: DataFrame, k: int, least: float = 0.9, sample: int = 200) -> tuple[int, float]:
    """The fewest probed cells, by doubling, that give a recall of ``least`` on at most ``sample`` queries
    (those with the least hash of their id) against the exact answer, and that recall. A row of that
    answer is found as soon as its cell is probed, so the places of these cells tell all recalls."""
    some = stored(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample), "tuning")
    true = search_cells(some, index, k, 1, exact=True)[0].select("query_id", "ref_id")
    cells = true.join(index.lists.select("ref_id", "cell"), "ref_id").join(some, "query_id")
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids, index.sizes))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, sizes = shared.value
        for f in frames:
            for at in range(0, len(f), CHUNK):
                part = f.iloc[at : at + CHUNK]
                d = np.where(sizes > 0, distances(units(part.query_vec), centroids), np.inf)
                rank = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1)
                yield pd.DataFrame({"query_id": part.query_id, "ref_id": part.ref_id, "place": rank[np.arange(len(part)), part.cell.to_numpy()]})

    kind = kinds(queries, index.lists).split(", cosine")[0]
    places = cells.select("query_id", "ref_id", "cell", "query_vec").mapInPandas(place, f"{kind}, place long")
    counts = places.groupBy("query_id", "ref_id").agg(F.min("place").alias("place")).groupBy("place").count().collect() if index.sizes.sum() else []
    drop_stored(some)
    wanted, probes = sum(r["count"] for r in counts), 1
    while True:
        hit = sum(r["count"] for r in counts if r.place < probes)
        if hit >= least * wanted or probes >= len(index.centroids):
            return probes, hit / wanted if wanted else 1.0
        probes *= 2
