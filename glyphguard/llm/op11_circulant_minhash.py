"""Near-duplicate classes by circulant MinHash.

1. Every document becomes the set of its 3-word shingle hashes. Equal sets are one class, known by a
   128-bit digest. The same pass takes the set's signature: a first permutation sends a token to a place
   on a circle of 2**20, a second one orders the circle's places, and coordinate k is the least rank
   among the set's places when the second permutation is shifted by k. The ranks that a token meets
   under all shifts lie side by side in one array, so a signature is a minimum over windows of it.
2. Banding: 42 bands of 6 coordinates. Sets of similarity 0.85 miss every band once in 4 * 10**8 pairs.
3. Within a bucket all members are paired with one leader, the member whose buckets are the fullest (the
   original that others are edits of); pairs that pass an exact bound are verified on the whole sets.
   Their components resolve most buckets.
4. In buckets that still hold several components, members of different ones are paired, again under the
   bound, and verified. Nothing is capped: a bucket of any size is paired with its leader, and members
   that stay apart are compared with those of the other components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop_cut, text_slices
from .components import components
from .near_sets import SLICE, bitmap, close, digest, verified
from .shingles import shingle_sets

#: The circle of places, bands, and coordinates of a band.
CIRCLE = 1 << 20
BANDS, ROWS = 42, 6
#: Tokens whose windows are held at once.
WINDOW = 4096

_random = np.random.Generator(np.random.PCG64(11))
_first = _random.integers(1, 1 << 63, 1, np.uint64) * np.uint64(2) + np.uint64(1)
_by_row = _random.integers(1, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_by_band = _random.integers(1, 1 << 63, BANDS, np.uint64)
_ranks: list[np.ndarray] = []


def _windows() -> np.ndarray:
    """Row p: the ranks of place p under shifts 0, 1, 2, ..., a view of one array of the circle's size."""
    if not _ranks:
        order = np.random.Generator(np.random.PCG64(12)).permutation(CIRCLE).astype(np.int32)
        _ranks.append(np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: BANDS * ROWS]]), BANDS * ROWS))
    return _ranks[0]


def signature(tokens: np.ndarray) -> np.ndarray:
    """The circulant MinHash of a set that is not empty."""
    windows = _windows()
    places = ((tokens * _first) >> np.uint64(44)).astype(np.int64)
    out = windows[places[:WINDOW]].min(axis=0)
    for at in range(WINDOW, len(places), WINDOW):
        np.minimum(out, windows[places[at : at + WINDOW]].min(axis=0), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    return ((sig.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _by_row).sum(axis=1) * np.uint64(0x9E3779B97F4A7C15) ^ _by_band


def describe(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, digest, bits, bands) of every document; bits and bands are given once per set and task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for whole in batches:
            for batch in text_slices(whole, "text", SLICE):
                n, digests, bits, keys = [], [], [], []
                for tokens in shingle_sets(batch.column("text"), words):
                    digests.append(digest(tokens))
                    n.append(len(tokens))
                    new = len(tokens) > 0 and digests[-1] not in seen
                    seen.add(digests[-1])
                    bits.append(bitmap(tokens) if new else None)
                    keys.append(bands(signature(tokens)).view(np.int64) if new else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(digests, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n", "digest", "bits", "bands"],
                )

    return docs.mapInArrow(read, "doc_id long, n int, digest binary, bits array<long>, bands array<long>")


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_shingles, component_id, kept, n_links.

    Documents are linked when 100 * |A & B| >= percent * |A | B| over their sets of distinct shingles
    of ``words`` words; with fewer words the whole sequence is one shingle. component_id is the smallest
    doc_id reachable, kept tells whether that is the row's own. n_links counts the verified links of the
    row's class to classes of other sets (an original's edits each count; edits are not paired among
    each other once the original joins them). Null, empty and white-space texts have no shingles and are
    linked with nothing. A row without doc_id is linked with nothing, has a null component and is kept.
    Rows that repeat a doc_id are judged row by row, each with its own text. Extra columns are not read.
    """
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = cut(describe(docs, words), "described")
    one = described.filter("n > 0 and doc_id is not null").groupBy("digest")
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    # The table is written, so the numbers stay.
    classes = cut(one.agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), first("bits"), first("bands")).withColumn("id", F.monotonically_increasing_id()), "classes")
    by_id = classes.select("id", "doc_id", "digest", F.struct("n", "bits").alias("of"))

    # Buckets of several classes, and each one's leader.
    cells = classes.select("id", F.explode("bands").alias("key"))
    several = cells.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = cut(cells.join(several, "key"), "shared")
    weight = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    leads = cut(shared.select("key", "id").join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", "id")).alias("lead")), "leads")
    side = lambda c, name: by_id.select(F.col("id").alias(c), F.col("of").alias(name))
    stars = shared.join(leads, "key").filter("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    stars = stars.join(side("a", "p"), "a").join(side("b", "q"), "b").filter(close("p", "q", percent)).select("a", "b")
    stars = cut(stars, "stars")
    links = verified(stars, docs, by_id, words, percent)

    # Buckets that the leaders' links leave in several components.
    roots = components(links)
    member = shared.select("key", "id").join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    open_keys = member.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("key")
    left = cut(member.join(open_keys, "key", "left_semi").join(by_id.select("id", "of"), "id"), "unresolved")
    p = left.select("key", F.col("id").alias("a"), F.col("root").alias("ra"), F.col("of").alias("p"))
    q = left.select(F.col("key").alias("_key"), F.col("id").alias("b"), F.col("root").alias("rb"), F.col("of").alias("q"))
    pairs = p.join(q, (F.col("key") == F.col("_key")) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & close("p", "q", percent)).select("a", "b").distinct()
    known = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = cut(pairs.join(known, ["a", "b"], "left_anti"), "pairs")
    late = verified(pairs, docs, by_id, words, percent)
    both = cut(links.union(late).distinct(), "all_links")
    roots = components(both)

    degree = both.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    of_class = classes.select("id", "digest", "doc_id").join(roots, "id", "left").select("id", "digest", "doc_id", F.coalesce("root", "id").alias("root"))
    least = of_class.groupBy("root").agg(F.min("doc_id").alias("component"))
    final = cut(of_class.join(least, "root").join(degree, "id", "left").select(F.col("digest").alias("_digest"), "component", F.coalesce("n_links", F.lit(0)).alias("n_links")), "final")
    for done in (shared, leads, stars, left, pairs, links, late, both, classes, roots):
        drop_cut(done)
    out = described.select("doc_id", "n", "digest").join(final, (F.col("digest") == F.col("_digest")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op11_circulant_minhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_links")


SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM worded)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) IS NOT DISTINCT FROM d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least ON a = d.doc_id
"""
