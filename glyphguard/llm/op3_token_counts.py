"""Token counts by a trie-shared forward pass.

Pre-tokens are words after white space, each with the word mark before it. Under a unigram model a
word's best segmentation is found by a forward pass over its characters: the best score of a prefix
is the best over the pieces that end there. The score of a prefix does not depend on what follows,
so the distinct new words of a slice of texts form a trie, every node is scored once, a level at a
time for all words together, and a word's token count is stored at its end. Sorted words lay the
trie out without pointers: a node is a run of rows with the same first characters. Words too long for a
table of levels go down the same trie one after the other, in order: the scores along the path that
a word shares with the one before stay. A worker keeps the counts of words between tasks and starts afresh when they are too many, which bounds memory and
changes no count. The plan is a narrow map: no shuffle.
"""

from __future__ import annotations

import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MARK = "▁"
#: Words whose counts a worker keeps before it starts afresh.
MAX_WORDS = 400_000
#: Longer words go down the trie one after the other, not a level at a time.
MAX_LETTERS = 48
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Size of the bitmap asked before a piece is looked up, and the shift of a hash to its place there.
FILTER, SHIFT = 1 << 18, np.uint64(46)


def best_count(word: str, pieces: dict[str, float], byte_score: float) -> int:
    """A single word's token count by a plain forward pass: what the trie must give."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + pieces[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in pieces]
        if word[end - 1] not in pieces:
            n = len(word[end - 1].encode("utf-8", "replace"))
            options.append((best[end - 1][0] + n * byte_score, best[end - 1][1] - n))
        best.append(max(options))
    return -best[-1][1]


def code_points(words: list[str]) -> np.ndarray:
    """A column of code points a word, zeros below its end: one row a place."""
    wide = np.array(words)
    return np.ascontiguousarray(wide.view(np.uint32).reshape(len(words), -1).T)


def prefix_hashes(points: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... characters of each column, from which any part's hash follows."""
    out = np.zeros((len(points) + 1, points.shape[1]), np.uint64)
    for k, row in enumerate(points):
        out[k + 1] = out[k] * BASE + row * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    return out


class UnigramTrie:
    """``pieces``: scores (log probabilities) by piece. A character without a piece is coded as its
    UTF-8 bytes, one token each, at ``byte_score``. Of segmentations with equal scores the one with
    fewer tokens counts."""

    def __init__(self, pieces: dict[str, float], byte_score: float):
        self.pieces, self.byte_score = pieces, byte_score
        self.longest = max(map(len, pieces), default=1)
        self.powers = np.power(BASE, np.arange(self.longest + 1, dtype=np.uint64))
        self.by_length = {}
        for n in range(1, self.longest + 1):
            some = [p for p in pieces if len(p) == n]
            if some:
                hashes = prefix_hashes(code_points(some))[n]
                order = np.argsort(hashes)
                maybe = np.zeros(FILTER, bool)
                maybe[hashes >> SHIFT] = True
                self.by_length[n] = hashes[order], np.array([pieces[p] for p in some])[order], maybe
        self.counts: dict[str, int] = {}

    def learn_in_order(self, words: list[str]) -> None:
        """Store the token counts of sorted words, depth first."""
        pieces, before, score, tokens = self.pieces, "", [0.0], [0]
        for word in words:
            shared = len(os.path.commonprefix((before, word)))
            del score[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, count = -math.inf, 0
                for start in range(max(0, end - self.longest), end):
                    part = word[start:end]
                    if part in pieces:
                        value, n = score[start] + pieces[part], tokens[start] + 1
                        if value > best or value == best and n < count:
                            best, count = value, n
                if word[end - 1] not in pieces:
                    n = len(word[end - 1].encode("utf-8", "replace"))
                    value, n = score[end - 1] + n * self.byte_score, tokens[end - 1] + n
                    if value > best or value == best and n < count:
                        best, count = value, n
                score.append(best)
                tokens.append(count)
            self.counts[word], before = tokens[-1], word

    def learn(self, words: list[str]) -> None:
        """Store the token counts of words (with their mark)."""
        self.learn_in_order(sorted(w for w in words if len(w) > MAX_LETTERS or "\0" in w))
        words = sorted({w for w in words if len(w) <= MAX_LETTERS and "\0" not in w})
        if not words:
            return
        points, size = code_points(words), np.array([len(w) for w in words])
        hashes, width = prefix_hashes(points), int(size.max())
        begins = np.ones((width, len(words)), bool)
        np.logical_or.accumulate(points[:, 1:] != points[:, :-1], axis=0, out=begins[:, 1:])
        begins &= np.arange(1, width + 1)[:, None] <= size
        node = np.zeros((width + 1, len(words)), np.int32)
        node[1:] = np.cumsum(begins, axis=1, dtype=np.int32) - 1
        score, tokens = [np.zeros(1)], [np.zeros(1, np.int64)]
        for level in range(1, width + 1):
            rows = np.flatnonzero(begins[level - 1])
            whole, letters = hashes[level][rows], points[level - 1][rows]
            best, count = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int64)

            def offer(places, value, n):
                better = (value > best[places]) | (value == best[places]) & (n < count[places])
                best[places[better]], count[places[better]] = value[better], n[better]

            for n in range(1, min(level, self.longest) + 1):
                found = np.zeros(len(rows), bool)
                if n in self.by_length:
                    known, scores, maybe = self.by_length[n]
                    part = whole - hashes[level - n][rows] * self.powers[n]
                    places = np.flatnonzero(maybe[part >> SHIFT])
                    at = np.minimum(np.searchsorted(known, part[places]), len(known) - 1)
                    same = known[at] == part[places]
                    places, at = places[same], at[same]
                    found[places] = True
                    before = node[level - n][rows[places]]
                    offer(places, score[level - n][before] + scores[at], tokens[level - n][before] + 1)
                if n == 1 and not found.all():
                    places = np.flatnonzero(~found)
                    letter = letters[places]
                    n_bytes = 1 + (letter >= 0x80).astype(np.int64) + (letter >= 0x800) + (letter >= 0x10000)
                    before = node[level - 1][rows[places]]
                    offer(places, score[level - 1][before] + n_bytes * self.byte_score, tokens[level - 1][before] + n_bytes)
            score.append(best)
            tokens.append(count)
        ends = np.empty(len(words), np.int64)
        for level in range(1, width + 1):
            at = np.flatnonzero(size == level)
            ends[at] = tokens[level][node[level][at]]
        self.counts.update(zip(words, ends.tolist()))

    def count_texts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(words, tokens) of each text."""
        if len(self.counts) > MAX_WORDS:
            self.counts.clear()
        split = [[MARK + w for w in t.split()] for t in texts]
        self.learn(list({w for words in split for w in words} - self.counts.keys()))
        get = self.counts.__getitem__
        return [(len(words), sum(map(get, words))) for words in split]


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log probabilities by Zipf's law from the vocabulary's order (most frequent first)."""
    total = math.log(sum(1 / (k + 1) for k in range(len(pieces))) or 1)
    return {p: -math.log(k + 1) - total for k, p in enumerate(pieces)}


def load_vocabulary(model_path: str) -> tuple[dict[str, float], float]:
    """Scores by piece, and a byte's score, for a sentencepiece vocabulary: its pieces in order of
    their stored scores, scored by Zipf's law; bytes rank after the last piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces = [sp.id_to_piece(i) for i in sorted(ids, key=lambda i: (-sp.get_score(i), i))]
    scores = zipf_scores(pieces)
    return scores, min(scores.values()) - math.log(2)


_tries: dict[str, UnigramTrie] = {}


def trie(model_path: str) -> UnigramTrie:
    """One trie a worker process."""
    if model_path not in _tries:
        _tries[model_path] = UnigramTrie(*load_vocabulary(model_path))
    return _tries[model_path]


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` plus n_words and n_tokens (longs). Null, empty and white-space texts have 0 of both.
    Input columns of these names are replaced; others pass through."""

    @F.arrow_udf("struct<n_words:long,n_tokens:long>")
    def counted(texts: pa.Array) -> pa.Array:
        model, found, waiting, size = trie(model_path), [], [], 0
        for t in texts:
            waiting.append(t.as_py() or "")
            size += len(waiting[-1])
            if size > 1 << 20:
                found += model.count_texts(waiting)
                waiting, size = [], 0
        found += model.count_texts(waiting)
        words, tokens = [f[0] for f in found], [f[1] for f in found]
        return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["n_words", "n_tokens"])

    kept = [c for c in docs.columns if c not in ("n_words", "n_tokens")]
    return bounded_batches(docs).select(*kept, counted("text").alias("_n")).select(*kept, "_n.n_words", "_n.n_tokens")


def tokens_by_source(docs: DataFrame, model_path: str) -> DataFrame:
    """Documents, words and tokens per source, pre-aggregated before the shuffle."""
    counted = count_tokens(docs, model_path)
    return counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), F.sum("n_tokens").alias("n_tokens"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_words", "n_tokens")
