"""N-gram Jaccard join by a token-group matrix.

1. Every document becomes the set of its 5-word shingle hashes. One pass over the texts keeps, per
   document, the set's size, a 128-bit digest (equal sets: exact copies, one class) and a bitmap
   of 2048 bits of the tokens present; the same pass counts tokens in a sketch of fixed size.
2. Prefix tokens. For a similarity of 0.8 a set shares at least ceil(0.8 n) tokens with a partner,
   so two partners have a token in common among the n - ceil(0.8 n) + 1 rarest of each, under any
   order that is the same for all sets. The order is (sketch count, hash): tokens of passages that
   many documents share come last and hardly occur in prefixes. Towards a partner that is no smaller,
   n - ceil(1.6 / 1.8 n) + 1 tokens do: these are indexed, the longer prefix only asks.
3. Groups. Of the documents that share a prefix token, each is linked, where the exact count confirms
   it, to the one whose own prefix is the most common (the original that others are edits of has no
   rare tokens); the components of these links partition similar documents into groups.
4. Token-group matrix. Its cells are (prefix token, group), each once however many members hold the
   token; beside it each group's token union is kept as the OR of its members' bitmaps. A query
   document meets a group only where one of its tokens is an indexed cell of members no larger. Of two prefixes, the one that ends first under
   the order has all its unshared tokens missing from the other set, so partners share at least
   1 + overlap - ceil(0.8 larger) cells; and at least popcount(q AND NOT union) of the query's tokens
   are not in the union. Groups that miss either bound are not opened.
5. Opened groups' members are compared by size and bitmap, then by exact intersection. New links
   join the groups.

Every filter is a bound, so no pair at or over the threshold is lost. Copies and groups are never
expanded into pairs: within a class or a group nothing more is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop_cut, text_slices
from .components import components
from .near_sets import SLICE, WORDS, bitmap, close, digest, popcount, set_key, verified
from .shingles import shingle_sets

#: Counters of the sketch: fixed sizes, whatever the input.
SKETCH = 1 << 18
PART = 1 << 14
#: Groups of at most so many members are opened on their union's bound alone.
FEW = 4


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """Rarest tokens to ask with, towards any partner, and to index, towards partners no smaller."""
    return n - (percent * n + 99) // 100 + 1, n + (-2 * percent * n) // (100 + percent) + 1


def describe(docs: DataFrame, words: int) -> DataFrame:
    """One row a document (doc_id, n, digest, key, bits) and, with n null, the sketch of each task in
    parts (part, counts)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen, waiting, size = np.zeros(SKETCH, np.int64), set(), [], 0
        for whole in batches:
            for batch in text_slices(whole, "text", SLICE):
                n, ids, bits = [], [], []
                for tokens in shingle_sets(batch.column("text"), words):
                    n.append(len(tokens))
                    ids.append(digest(tokens))
                    bits.append(bitmap(tokens))
                    if ids[-1] not in seen:
                        seen.add(ids[-1])
                        waiting.append((tokens & np.uint64(SKETCH - 1)).astype(np.int32))
                        size += len(tokens)
                if size > SKETCH:
                    sketch += np.bincount(np.concatenate(waiting), minlength=SKETCH)
                    waiting, size = [], 0
                none = pa.nulls(len(n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(ids, pa.binary()), pa.array([set_key(x) for x in ids], pa.int64()), pa.array(bits, pa.list_(pa.int64())), none.cast(pa.int32()), none.cast(pa.binary())],
                    ["doc_id", "n", "digest", "key", "bits", "part", "counts"],
                )
        if waiting:
            sketch += np.bincount(np.concatenate(waiting), minlength=SKETCH)
        parts = range(SKETCH // PART)
        none = pa.nulls(len(parts))
        yield pa.RecordBatch.from_arrays(
            [none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64())), pa.array(parts, pa.int32()), pa.array([sketch[PART * k : PART * (k + 1)].astype("<u4").tobytes() for k in parts], pa.binary())],
            ["doc_id", "n", "digest", "key", "bits", "part", "counts"],
        )

    return docs.mapInArrow(read, "doc_id long, n int, digest binary, key long, bits array<long>, part int, counts binary")


def merged_sketch(parts: DataFrame) -> np.ndarray:
    """Counts of the whole corpus: SKETCH numbers, whatever the input. Tasks' parts are summed on the
    executors, first in 64 salted groups."""

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = sum((np.frombuffer(x, "<u8" if len(x) == 8 * PART else "<u4").astype(np.uint64) for x in rows.counts), np.zeros(PART, np.uint64))
        return pd.DataFrame({"part": [key[0]], "counts": [counts.astype("<u8").tobytes()]})

    kind = "part int, counts binary"
    salted = parts.groupBy("part", F.pmod(F.xxhash64("counts"), F.lit(64))).applyInPandas(total, kind)
    rows = salted.groupBy("part").applyInPandas(total, kind).collect()
    out = np.zeros(SKETCH, np.uint64)
    for r in rows:
        out[PART * r.part : PART * (r.part + 1)] = np.frombuffer(r.counts, "<u8")
    return out


def prefixes(docs: DataFrame, counts: np.ndarray, words: int, percent: int) -> DataFrame:
    """(token, key, mark) of the rarest tokens of each set, each distinct set once a task; mark is twice the
    mean count of the set's prefix tokens, plus 1 on tokens that are indexed."""
    order = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 24) - 1) << np.uint64(40))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, common = set(), order.value
        for whole in batches:
            for batch in text_slices(whole, "text", SLICE):
                keys, found, sizes, marks = [], [], [], []
                for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), words)):
                    n = len(tokens)
                    if not n or doc_id is None or (key := digest(tokens)) in seen:
                        continue
                    seen.add(key)
                    rank = common[tokens & np.uint64(SKETCH - 1)] | (tokens >> np.uint64(24))
                    asked, indexed = prefix_lengths(n, percent)
                    first = np.argsort(rank, kind="stable")[:asked]
                    keys.append(set_key(key))
                    mark = np.full(len(first), 2 * int((rank[first] >> np.uint64(40)).mean()), np.int32)
                    mark[:indexed] += 1
                    marks.append(mark)
                    sizes.append(len(first))
                    found.append(tokens[first])
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), sizes)), pa.array(np.concatenate(marks))], ["token", "key", "mark"])

    return docs.mapInArrow(read, "token long, key long, mark int")


def _cells(n: F.Column, m: F.Column, percent: int) -> F.Column:
    """Fewest prefix tokens that sets of n and m tokens share when they reach the threshold."""
    overlap = F.ceil((n + m) * percent / (100 + percent) - 1e-6)
    return 1 + overlap - F.ceil(F.greatest(n, m) * percent / 100 + 1e-6)


def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_shingles, component_id, n_equal.

    Two documents are linked when 100 * |A & B| >= percent * |A | B| over their shingle sets.
    component_id is the smallest doc_id reachable; n_equal is the number of rows with the same
    set, this one included (0 without shingles or id). Null, empty and white-space texts have no shingles and are linked with
    nothing, not even with each other. A row without doc_id is linked with nothing and has a null
    component. Rows that repeat a doc_id are judged row by row, each with its own text. Extra columns are
    not read.
    """
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = cut(describe(docs, words), "described")
    counts = merged_sketch(described.filter("part is not null").select("part", "counts"))
    rows = described.filter("part is null").select("doc_id", "n", "digest", "key", "bits")
    one = rows.filter("n > 0 and doc_id is not null").groupBy("digest")
    one = one.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_equal"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("key").alias("key"))
    # The table is written, so the numbers stay.
    classes = cut(one.withColumn("id", F.monotonically_increasing_id()), "classes")
    of = classes.select("id", F.struct("n", "bits").alias("of"))

    # Tokens that stand in the prefixes of two sets or more, with the most common of these. Counts and
    # leaders are pre-aggregated; the joins back to the tokens' sets are open to being split.
    asked = prefixes(docs, counts, words, percent)
    several = asked.groupBy("token").agg(F.count("*").alias("holders")).filter("holders > 1").select("token")
    held = cut(asked.join(several, "token", "left_semi"), "held_tokens")
    leads = held.groupBy("token").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max_by("key", F.struct("mark", "key")).alias("lead"))
    shared = held.join(leads.filter("first < last"), "token")
    shared = cut(shared.select("token", "key", "lead", (F.col("mark") % 2 == 1).alias("indexed")), "shared")
    drop_cut(held)
    reps = cut(classes.select("key", "id").join(shared.select("key").distinct(), "key", "left_semi"), "reps")

    # Links to the leading set of each token. A third of the cells that a link needs is asked for
    # here: a link that is passed over is found below.
    stars = shared.filter("key <> lead").groupBy("key", "lead").agg(F.count("*").alias("cells"))
    stars = stars.join(reps.withColumnRenamed("id", "a"), "key").join(reps.select(F.col("key").alias("lead"), F.col("id").alias("b")), "lead")
    near = stars.join(of.select(F.col("id").alias("a"), F.col("of").alias("p")), "a").join(of.select(F.col("id").alias("b"), F.col("of").alias("q")), "b").filter((3 * F.col("cells") >= _cells(F.col("p.n"), F.col("q.n"), percent)) & close("p", "q", percent)).select("a", "b")
    stars = cut(near, "stars")
    links = verified(stars, docs, classes, words, percent)
    groups = components(links)

    # The token-group matrix over sets, and each group's token union, size range and members.
    member = classes.join(groups, "id", "left").withColumn("group", F.coalesce("root", "id"))
    member = cut(member.select("id", "group", "n", "bits"), "members")
    union = member.groupBy("group").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("members"), F.array(*[F.bit_or(F.col("bits")[k]) for k in range(WORDS)]).alias("union")
    )
    held = shared.select("token", "key", "indexed").join(reps, "key").select("token", "id", "indexed").join(member.select("id", "group", "n"), "id")
    held = cut(held.distinct(), "held")
    index = held.filter("indexed").groupBy("token", "group").agg(F.min("n").alias("smallest"))
    asking = held.select("token", F.col("id").alias("a"), F.col("group").alias("own"), "n")
    meets = asking.join(index, "token").filter("own <> group and smallest <= n").select("a", "group").distinct()

    # Bounds on a group: sizes, tokens that its union lacks, and, where opening it means many comparisons,
    # cells. The bound on cells is least at the
    # ends of the range of sizes that may be linked.
    bound = meets.join(member.select(F.col("id").alias("a"), F.struct("n", "bits").alias("p")), "a").join(union, "group")
    absent = popcount(lambda k: F.col("p.bits")[k].bitwiseAND(F.bitwise_not(F.col("union")[k])))
    n, nearest = F.col("p.n"), (F.greatest("least", F.floor(F.col("p.n") * percent / 100)), F.least("most", F.ceil(F.col("p.n") * 100 / percent)))
    fits = (100 * (n - absent) >= percent * n) & (100 * F.col("most") >= percent * n) & (100 * n >= percent * F.col("least"))
    bound = cut(bound.filter(fits).select("a", "group", "members", "p", (F.least(*[_cells(n, m, percent) for m in nearest]) - 1).alias("need")), "bound")
    cells = bound.filter(F.col("members") > FEW).select("a", "group").distinct().join(held.select(F.col("id").alias("a"), "token").distinct(), "a")
    cells = cells.join(held.select("token", "group").distinct(), ["token", "group"]).groupBy("a", "group").agg(F.count("*").alias("cells"))
    opened = bound.filter(F.col("members") > FEW).join(cells, ["a", "group"]).filter("cells >= need").select("a", "p", "group")
    few = bound.filter(F.col("members") <= FEW).select("a", "p", "group")
    others = member.select("group", F.col("id").alias("b"), F.struct("n", "bits").alias("q"))
    near = lambda groups: groups.join(others, "group").filter(close("p", "q", percent)).select("a", "b", _cells(F.col("p.n"), F.col("q.n"), percent).alias("need"))
    # Members of small groups that the bitmaps leave, mostly long texts, are held to their own cells.
    few = cut(near(few).groupBy("a", "b").agg(F.min("need").alias("need")), "few")
    tokens = held.select("id", "token").distinct()
    both = few.join(tokens.withColumnRenamed("id", "a"), "a").join(tokens.withColumnRenamed("id", "b"), ["b", "token"])
    some = both.groupBy("a", "b").agg(F.count("*").alias("cells"), F.first("need").alias("need")).filter("cells >= need")
    pairs = cut(near(opened).select("a", "b").union(some.select("a", "b")).distinct(), "pairs")
    late = verified(pairs, docs, classes, words, percent)
    for done in (shared, stars, reps, held, member, bound, few, pairs):
        drop_cut(done)
    both = cut(links.union(late).distinct(), "all_links")
    roots = components(both)

    of_class = classes.select("id", "digest", "doc_id", "n_equal").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = of_class.groupBy("root").agg(F.min("doc_id").alias("component"))
    final = cut(of_class.join(least, "root").select("digest", "component", "n_equal"), "components")
    for done in (classes, links, late, both, groups, roots):
        drop_cut(done)
    out = rows.select("doc_id", "n", "digest").join(final.withColumnRenamed("digest", "_digest"), (F.col("digest") == F.col("_digest")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("n_equal", F.lit(0)).alias("n_equal"),
    )


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id (and n_equal) of every document."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM worded)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b, common = x.n AND common = y.n AS equal FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, coalesce(min(r.b), d.doc_id) AS component_id,
  CASE WHEN any_value(s.n) IS NULL THEN 0 ELSE 1 + (SELECT count(*) FROM links l WHERE l.a = d.doc_id AND l.equal) END AS n_equal
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""
