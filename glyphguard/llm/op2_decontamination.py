"""Benchmark decontamination: rare n-gram seeds join training passages to test items, then
Smith-Waterman alignment scores exact, edited and paraphrased copies.

Seeds lose no copy. An alignment of score s over an item of L words has at most L - s edits, which
part its matches into runs, so it keeps at least s - (q - 1) - (q - 2) (L - s) of the item's q-grams.
An item's q is the longest, up to n, of which a passing alignment must keep one (2 for a least score
of half). Of its places all but so many less one, those rarest in the corpus, are seeds: whatever the
edits break, one seed is left.

Two passes over the corpus for each block of test items. The first counts, over all documents, in
how many each n-gram of the items occurs; rank is within the item, so an item that leaked into a
third of the corpus keeps its seeds. The second pass looks seeds up in every text and aligns the
item's words with those neighbourhoods of hits that hold enough of its n-grams close together.
Both are maps with the items at hand; documents are not shuffled, however many hold an item. Items
come in blocks of bounded size, so the broadcast does not grow with the test set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_slices
from .shingles import NOT_ALNUM, grams, words

SLICE = 1 << 20
#: Text bytes of test items at hand in one pass.
BLOCK_BYTES = 16 << 20


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment (match 1, mismatch -1, gap -1): score, and its end in item and window.
    A row of the table at a time: gaps along the row are a running maximum."""
    place = np.arange(len(window) + 1)
    row, best = np.zeros(len(window) + 1, np.int64), (0, 0, 0)
    for i, word in enumerate(item):
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(window == word, 1, -1), row[1:] - 1)
        new = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + place) - place, 0)
        j = int(new.argmax())
        if new[j] > best[0]:
            best = (int(new[j]), i + 1, j)
        row = new
    return best


def span(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Score, first word and end word in ``window`` of the best local alignment."""
    score, i, j = align(item, window)
    if not score:
        return 0, 0, 0
    _, _, back = align(item[:i][::-1], window[:j][::-1])
    return score, j - back, j


def gram_length(words: int, n: int, least: float) -> tuple[int, int]:
    """Length of the n-grams to look for in an item of so many words, up to ``n``, and at how many of
    its places they are kept by every alignment that scores ``least``. Items shorter than ``n`` words
    are one n-gram."""
    if words < n:
        return words, 1
    score = max(1, math.ceil(least * words - 1e-9))
    for q in range(n, 1, -1):
        kept = score - (q - 1) - (q - 2) * (words - score)
        if kept >= 1:
            return q, kept
    return 1, score


class Items:
    """Words and n-grams of a block of items, for lookup in texts."""

    def __init__(self, ids: list[int], texts: list[str], n: int, least: float):
        word, _, _, bounds = words(pa.array(texts, pa.string()), NOT_ALNUM)
        self.ids, self.least = ids, least
        self.words = [word[a:b] for a, b in zip(bounds, bounds[1:])]
        self.length, self.kept = zip(*(gram_length(len(w), n, least) for w in self.words)) if ids else ((), ())
        self.lengths = sorted(set(self.length) - {0})
        every = [grams(w, q) if q else w for w, q in zip(self.words, self.length)]
        self.grams = np.unique(np.concatenate(every)) if every else np.empty(0, np.uint64)
        #: Numbers of the n-grams at each item's places, and the distinct hashes.
        self.places = [np.searchsorted(self.grams, g) for g in every]
        self.own = [np.unique(g) for g in every]
        self.choose_seeds(np.zeros(len(self.grams), np.int64))

    def choose_seeds(self, counts: np.ndarray) -> None:
        """Look, for each item, only for the n-grams at its rarest places from now on: as many as leave
        out fewer places than a passing alignment keeps (and all that tie with the last of them)."""
        pairs = []
        for k, (places, kept) in enumerate(zip(self.places, self.kept)):
            if len(places):
                own = counts[places]
                seeds = np.unique(places[own <= np.sort(own)[len(own) - kept]])
                pairs.append((seeds, np.full(len(seeds), k)))
        gram, item = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 2
        order = np.argsort(gram, kind="stable")
        #: Items of which n-gram g is a seed: seed_items[first[g] : first[g + 1]].
        self.seed_items = item[order]
        self.first = np.searchsorted(gram[order], np.arange(len(self.grams) + 1))
        self.chosen = np.diff(self.first) > 0
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.grams[self.chosen] & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def hits(self, word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, place in ``word`` and number of every looked-for n-gram that lies within one text."""
        texts, places, numbers = [], [], []
        for length in self.lengths:
            every = grams(word, length)
            at = np.flatnonzero(self.maybe[(every & np.uint64(0xFFFFF)).astype(np.int64)])
            if len(at):
                g = np.minimum(np.searchsorted(self.grams, every[at]), len(self.grams) - 1)
                text = np.searchsorted(bounds, at, side="right") - 1
                ok = (self.grams[g] == every[at]) & self.chosen[g] & (at + length <= bounds[text + 1])
                texts.append(text[ok])
                places.append(at[ok])
                numbers.append(g[ok])
        if not places:
            return (np.empty(0, np.int64),) * 3
        return np.concatenate(texts), np.concatenate(places), np.concatenate(numbers)

    def candidates(self, texts: np.ndarray, places: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(text, item, places, n-grams) for each text and item with seeds in it."""
        some = np.diff(self.first)[numbers]
        hit = np.repeat(np.arange(len(numbers)), some)
        item = self.seed_items[np.repeat(self.first[numbers], some) + np.arange(len(hit)) - np.repeat(np.cumsum(some) - some, some)]
        order = np.lexsort((places[hit], item, texts[hit]))
        hit, item = hit[order], item[order]
        text = texts[hit]
        edges = np.flatnonzero((np.diff(text) != 0) | (np.diff(item) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, len(hit)]) if len(hit) else ():
            yield int(text[a]), int(item[a]), places[hit[a:b]], numbers[hit[a:b]]

    def match(self, k: int, word: np.ndarray, places: np.ndarray) -> tuple[int, int, int]:
        """Score, first word and end word of item ``k`` in one text with seeds at ``places`` (sorted)."""
        item, q, kept = self.words[k], self.length[k], self.kept[k]
        least = max(1, math.ceil(self.least * len(item) - 1e-9))
        reach = 2 * len(item) - least  # no passing alignment takes more words of the text
        best = (0, 0, 0)
        for low, high in stretches(places - reach, places + reach, len(word)):
            at = low + np.flatnonzero(np.isin(grams(word[low:high], q), self.own[k]))
            if len(at) < kept:
                continue
            dense = np.flatnonzero(at[kept - 1 :] - at[: len(at) - kept + 1] <= reach - q)
            for a, b in stretches(at[dense] - reach, at[dense + kept - 1] + reach, len(word)):
                if np.isin(item, word[a:b]).sum() < least:  # the score is at most this
                    continue
                score, first, last = span(item, word[a:b])
                if score > best[0]:
                    best = (score, a + first, a + last)
        return best if best[0] >= least else (0, 0, 0)


def stretches(starts: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Ranges, both ends in order, cut to a text of so many words; those that meet are one."""
    if len(starts):
        cuts = np.flatnonzero(starts[1:] > ends[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(starts)]):
            yield max(0, int(starts[a])), min(length, int(ends[b - 1]))


def _texts(batches: Iterator[pa.RecordBatch]):
    """(doc_id, words) of each row with an id; word arrays of one slice share memory."""
    for whole in batches:
        for batch in text_slices(whole, "text", SLICE):
            word, _, _, bounds = words(batch.column("text"), NOT_ALNUM)
            yield batch.column("doc_id").to_pylist(), word, bounds


def gram_counts(docs: DataFrame, shared) -> DataFrame:
    """(gram, n): documents that hold each n-gram of the block; counted per task before the shuffle."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        counts = np.zeros(len(items.grams), np.int64)
        for _, word, bounds in _texts(batches):
            doc, _, numbers = items.hits(word, bounds)
            counts += np.bincount(np.unique(doc * len(items.grams) + numbers) % len(items.grams), minlength=len(items.grams))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["gram", "n"])

    return docs.mapInArrow(read, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


MATCH = "doc_id long, item_id long, score double, start_word long, end_word long, n_seeds long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.5) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, score, start_word, end_word,
    n_seeds.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. score is the
    best local alignment (match 1, mismatch -1, gap -1) over the item's number of words, 1 for a
    whole copy; rows have ``least`` or more, and no text with such an alignment is passed over. Items shorter than ``n`` words are sought whole. Null
    and empty texts and items without words match nothing; rows without id are left out. Repeated
    rows give repeated results. Extra columns are not read.
    """
    spark = bounded_batches(docs).sparkSession
    docs = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    benchmark = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    out = spark.createDataFrame([], MATCH)
    for block in range(blocks):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        items = Items([r.item_id for r in rows], [r.text for r in rows], n, least)
        if not len(items.grams):
            continue
        shared = spark.sparkContext.broadcast(items)
        counts = np.zeros(len(items.grams), np.int64)
        for r in gram_counts(docs, shared).collect():
            counts[r.gram] = r.n
        items.choose_seeds(counts)
        out = out.union(_leaks(docs, spark.sparkContext.broadcast(items)))
    return out


def _leaks(docs: DataFrame, shared) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for ids, word, bounds in _texts(batches):
            rows = []
            for d, k, places, numbers in items.candidates(*items.hits(word, bounds)):
                score, first, last = items.match(k, word[bounds[d] : bounds[d + 1]], places - bounds[d])
                if score:
                    rows.append((ids[d], items.ids[k], score / len(items.words[k]), first, last, len(np.unique(numbers))))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in MATCH.split(", ")])

    return docs.mapInArrow(read, MATCH)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score and span of every leak."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
