"""Exact k-means by Shallot search.

Every vector keeps, between rounds, its nearest and second-nearest centroid, an upper bound of the
distance to the first and a lower bound of the distances to all others. When centroids have moved, the
bounds are widened by how far; a vector whose upper bound is still under its lower bound, or under half
the way from its centroid to that one's nearest neighbour, stays without a distance being computed.
The others measure both remembered centroids and scan the neighbours of the closer one, nearest first:
a neighbour can matter only if it lies within the distance to the scan's centre plus the distance to the
second-nearest so far, a ball that shrinks with every better second. Survivors are compared by exact
squared distances in whole numbers, ties by the smaller number.

A round is one pass without a shuffle: each task also returns a row of sums per centroid, which Spark
adds up; the driver holds the centroids alone. Vectors and bounds are written between rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut
from .whole_vectors import floors, packed, squares, unpacked, usable

#: Bounds are floats; they are widened by so much, relatively, before they decide anything.
SLACK = 1e-9


def between(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances between centroids, and each one's neighbours, nearest first."""
    apart = np.sqrt(squares(centroids, centroids).astype(np.float64))
    order = np.argsort(apart + np.where(np.eye(len(centroids), dtype=bool), -1.0, 0.0), axis=1, kind="stable")[:, 1:]
    return apart, order


def full_search(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest and second-nearest centroid of each row with their squared distances (second: -1 if there
    is one centroid only)."""
    all_squares = squares(x, centroids)
    rank = np.argsort(all_squares, axis=1, kind="stable")
    at = np.arange(len(x))
    first = rank[:, 0]
    if len(centroids) == 1:
        return first, np.full(len(x), -1), all_squares[at, first], np.zeros(len(x), np.int64)
    return first, rank[:, 1], all_squares[at, first], all_squares[at, rank[:, 1]]


def shallot_search(x: np.ndarray, centroids: np.ndarray, first: np.ndarray, second: np.ndarray, apart: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """As ``full_search``, scanning from the closer of two remembered centroids; also how many squared
    distances were computed."""
    measure = lambda rows, c: ((x[rows] - centroids[c]) ** 2).sum(1)
    every = np.arange(len(x))
    a, b = first.copy(), second.copy()
    da, db = measure(every, a), measure(every, b)
    swap = (db < da) | ((db == da) & (b < a))
    a[swap], b[swap], da[swap], db[swap] = b[swap], a[swap], db[swap], da[swap]
    centre, to_centre = a.copy(), np.sqrt(da.astype(np.float64))
    known, alive, computed = b.copy(), every, 2 * len(x)
    for rank in range(order.shape[1]):
        c = order[centre[alive], rank]
        inside = apart[centre[alive], c] <= (to_centre[alive] + np.sqrt(db[alive].astype(np.float64))) * (1 + SLACK)
        alive, c = alive[inside], c[inside]
        if not len(alive):
            break
        new = c != known[alive]
        rows, c = alive[new], c[new]
        d = measure(rows, c)
        computed += len(rows)
        best = (d < da[rows]) | ((d == da[rows]) & (c < a[rows]))
        next_best = ~best & ((d < db[rows]) | ((d == db[rows]) & (c < b[rows])))
        won = rows[best]
        b[won], db[won] = a[won], da[won]
        a[won], da[won] = c[best], d[best]
        b[rows[next_best]], db[rows[next_best]] = c[next_best], d[next_best]
    return a, b, da, db, computed


STATE = "vec_id long, v binary, cluster int, second int, upper double, lower double, distance long, part int, n long, sums array<long>, computed long"


def assign(rows: DataFrame, read, centroids: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """One round: rows (vec_id, v, and after the first round their bounds) with their clusters anew, and
    one row per task and cluster (part, n, sums, computed) with vec_id and v null. ``moved``: how far each
    centroid went since the bounds were taken."""
    k, width = centroids.shape
    apart, order = between(centroids)
    others = np.array([np.delete(moved, j).max(initial=0.0) for j in range(k)]) if moved is not None else None
    nearest = np.array([apart[j, order[j, 0]] / 2 if k > 1 else np.inf for j in range(k)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, computed = np.zeros((k, width), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            x = read(batch)
            if not len(x):
                continue
            if moved is None or k == 1:
                first, second, da, db = full_search(x, centroids)
                upper, lower = np.sqrt(da.astype(np.float64)), np.sqrt(db.astype(np.float64)) if k > 1 else np.full(len(x), np.inf)
                computed += k * len(x)
            else:
                first, second, upper, lower = (np.array(batch.column(c)) for c in ("cluster", "second", "upper", "lower"))
                upper, lower = upper + moved[first], lower - others[first]
                loose = np.flatnonzero(upper * (1 + SLACK) + SLACK >= np.maximum(lower, nearest[first]) * (1 - SLACK))
                a, b, da, db, n = shallot_search(x[loose], centroids, first[loose], second[loose], apart, order)
                first[loose], second[loose], upper[loose], lower[loose] = a, b, np.sqrt(da.astype(np.float64)), np.sqrt(db.astype(np.float64))
                computed += n
            own = ((x - centroids[first]) ** 2).sum(1)
            np.add.at(sums, first, x)
            counts += np.bincount(first, minlength=k)
            none = pa.nulls(len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(packed(x), pa.binary()), pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower), pa.array(own), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64())), none.cast(pa.int64())],
                ["vec_id", "v", "cluster", "second", "upper", "lower", "distance", "part", "n", "sums", "computed"],
            )
        none = pa.nulls(k)
        yield pa.RecordBatch.from_arrays(
            [none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.float64()), none.cast(pa.float64()), none.cast(pa.int64()), pa.array(range(k), pa.int32()), pa.array(counts), pa.array(list(sums), pa.list_(pa.int64())), pa.array([computed] + [0] * (k - 1), pa.int64())],
            ["vec_id", "v", "cluster", "second", "upper", "lower", "distance", "part", "n", "sums", "computed"],
        )

    return rows.mapInArrow(run, STATE)


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """Centroids of an assigned table, floor of the mean in each component (an empty one stays), and how
    many distances the round computed. One row per centroid reaches the driver."""
    parts = state.filter("part is not null")
    sums = parts.select("part", F.posexplode("sums")).groupBy("part", "pos").agg(F.sum("col").alias("s")).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("pos", "s"))).alias("sums"))
    found = parts.groupBy("part").agg(F.sum("n").alias("n"), F.sum("computed").alias("computed")).join(sums, "part").collect()
    out = centroids.copy()
    for r in found:
        if r.n:
            out[r.part] = [r.sums[i] // r.n for i in range(centroids.shape[1])]
    return out, sum(r.computed for r in found)


def shallot_kmeans(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, cluster, distance) of each usable row of ``vectors`` (vec_id, embedding), the final
    centroids, and the squared distances computed in each pass.

    Usable: exactly ``width`` components, none null or non-finite; others are left out. Components become
    floor(scale * x), held to 2**27 either way. The first centroids are the k vectors with the smallest
    sha256 of "1:<vec_id>" (ties by components; rows without vec_id come last); fewer than k vectors give
    as many centroids as there are. Repeated rows are rows of their own. An empty table gives no rows.
    """
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter((F.size("embedding") == width) & usable(F.col("embedding")))
    order = (F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "embedding")
    seeds = kept.orderBy(*order).limit(k).collect()
    if not seeds:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), np.zeros((0, width), np.int64), []
    centroids = floors(pa.array([r.embedding for r in seeds], pa.list_(pa.float64())), width, scale)
    state = cut(assign(kept, lambda batch: floors(batch.column("embedding"), width, scale), centroids, None), "assigned")
    work = []
    for _ in range(rounds):
        new, computed = moved_centroids(state, centroids)
        work.append(computed)
        moved = np.sqrt(((new - centroids) ** 2).sum(1).astype(np.float64))
        rows = state.filter("part is null").select("vec_id", "v", "cluster", "second", "upper", "lower")
        state, old = cut(assign(rows, lambda batch: unpacked(batch.column("v"), width), new, moved), "assigned"), state
        drop_cut(old)
        centroids = new
    work.append(state.agg(F.sum("computed").alias("n")).first().n)
    return state.filter("part is null").select("vec_id", "cluster", "distance"), centroids, work


def op12_shallot_kmeans(spark, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector. The
    table joined to the rows has a row per centroid."""
    rows, centroids, _ = shallot_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    by_cluster = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    whole = by_cluster.agg(F.sum("total").cast("long").alias("inertia"))
    named = by_cluster.join(spark.createDataFrame(digests, "_cluster int, centroid_sha256 string"), F.col("cluster") == F.col("_cluster")).crossJoin(whole)
    per = named.select("cluster", F.col("total").cast("long").alias("cluster_inertia"), "inertia", "centroid_sha256")
    return rows.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds: int = 3) -> str:
    """Each assignment and each centroid table spelled out as a step."""
    nearest = lambda c: f"SELECT vec_id, v, c AS cluster, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS rn FROM (SELECT rid, vec_id, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - w[i]) * (v[i] - w[i])))::BIGINT AS d FROM kept, {c})) WHERE rn = 1"
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, embedding) - 1 AS c, v AS w FROM (SELECT v, embedding, sha256('1:' || vec_id) AS h FROM kept ORDER BY h NULLS LAST, embedding LIMIT 16))",
    ]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest(f'c{r}')})")
        steps.append(f"m{r} AS (SELECT cluster, i, (sum(v[i])::HUGEINT - ((sum(v[i])::HUGEINT % count(*)) + count(*)) % count(*)) // count(*) AS m FROM a{r}, range(1, 65) t(i) GROUP BY cluster, i)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(any_value(x), any_value(w)) AS w FROM c{r} LEFT JOIN (SELECT cluster, list(m::BIGINT ORDER BY i) AS x FROM m{r} GROUP BY cluster) ON cluster = c GROUP BY c)")
    steps.append(f"a{rounds} AS MATERIALIZED ({nearest(f'c{rounds}')})")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c = cluster"""


SQL = _sql()
