"""Packing by power-of-two decomposition: every document's ids are split into pieces of binary
lengths (4096 as often as it goes, then the set bits of the rest), and pieces of equal length form
one bucket. A piece is a whole sequence, so no sequence crosses documents and none is padded.

Tokenising is the cost. This vocabulary's pre-tokenizer splits a text into words without looking
further, so a slice of texts is split and hashed as one byte array, each of its distinct words is
looked up once, and only words that a worker has not met are given to the tokenizer, many in one
call. The plan is one narrow map over the scan: no shuffle at any size.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, text_slices
from .shingles import column_bytes, span_hashes

#: Words a worker remembers before it forgets those not at hand (memory bound, no effect on ids).
CACHE_WORDS = 400_000
SPACE, LETTER, DIGIT, MARK, ODD = range(5)
#: Kinds of ASCII bytes; other white space and controls, like all else not named below, are odd.
KINDS = np.full(256, ODD, np.uint8)
KINDS[33:127] = MARK
KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
KINDS[48:58] = DIGIT
KINDS[[32, *range(9, 14)]] = SPACE
#: Second bytes, after 0xC2, of the marks inverted !, inverted ?, and angle quotes; third bytes, after 0xE2
#: 0x80, of dashes, curly quotes, bullet and ellipsis.
MARKS_C2 = np.isin(np.arange(256), [0xA1, 0xAB, 0xBB, 0xBF])
MARKS_E2 = np.isin(np.arange(256), [0x93, 0x94, 0x98, 0x99, 0x9C, 0x9D, 0xA2, 0xA6])


def kinds_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kind of each byte and the bytes in lower case. Letters are those of Basic Latin and Latin-1."""
    kinds, low = KINDS[data], data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # but for the times and division signs
    kinds[lead] = kinds[lead + 1] = LETTER
    low[(lead + 1)[data[lead + 1] < 0x9F]] += 32
    lead = np.flatnonzero(data[:-1] == 0xC2)
    lead = lead[MARKS_C2[data[lead + 1]]]
    kinds[lead] = kinds[lead + 1] = MARK
    lead = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
    lead = lead[MARKS_E2[data[lead + 2]]]
    kinds[lead] = kinds[lead + 1] = kinds[lead + 2] = MARK
    # A special token's string is taken as such wherever it stands.
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    kinds[special] = ODD
    return kinds, low


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and oddness of every word of texts that lie end to end, and the bytes in lower case.

    Words are as in the vocabulary's own rule: a contraction ('s 't 're 've 'm 'll 'd), a run of
    letters, one digit, or a run of other marks. A chunk between spaces or line feeds that holds
    anything but letters, digits, common marks and ASCII white space is odd: one span, not lowered.
    """
    n = len(data)
    kinds, low = kinds_of(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    odd = kinds == ODD
    if odd.any():
        gap = (data == 32) | (data == 10)
        begins = edge[:-1] | gap
        begins[1:] |= gap[:-1]
        chunks = np.flatnonzero(begins)
        chunk_odd = np.logical_or.reduceat(odd, chunks)
        odd = np.repeat(chunk_odd, np.diff(np.r_[chunks, n]))
        kinds[odd], low[odd] = ODD, data[odd]
    inside = kinds != SPACE
    change = np.ones(n + 1, bool)
    change[1:-1] = kinds[1:] != kinds[:-1]
    change |= edge
    first = inside & (change[:-1] | (kinds == DIGIT))
    # Contractions: an apostrophe alone between a word's edge and letters.
    at = np.flatnonzero(first & (low == 39) & (kinds == MARK))
    at = at[(at + 1 < n)]
    at = at[first[at + 1] & (kinds[at + 1] == LETTER) & ~edge[at + 1]]
    one = low[at + 1]
    after = np.minimum(at + 2, n - 1)
    two = np.where((at + 2 < n) & ~change[after], low[after], 0)
    size = np.where(np.isin(one, list(b"stmd")), 1, 0)
    size[(two == 101) & ((one == 114) | (one == 118)) | (one == 108) & (two == 108)] = 2
    at, size = at[size > 0], size[size > 0]
    first[at + 1] = False
    rest = at + 1 + size
    rest = rest[rest < n]
    rest = rest[(kinds[rest] == LETTER) & ~change[rest]]
    first[rest] = True
    closes = np.ones(n + 1, bool)
    closes[:-1] = ~inside & change[:-1] | first
    bounds = np.flatnonzero(closes)
    start = np.flatnonzero(first)
    return start, bounds[np.searchsorted(bounds, start) + 1] if len(start) else start, odd[start], low


class WordEncoder:
    """Ids of whole texts, equal to the tokenizer's own."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        # The same model for words that are normalised and split already.
        self.words_only = Tokenizer(self.tokenizer.model)
        self.words_only.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        #: Number of each word; its ids are flat[bounds[number] : bounds[number + 1]]. An odd chunk is known
        #: by its text, a word by its bytes.
        self.numbers: dict[bytes | str, int] = {}
        self.flat, self.bounds = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, words: list[bytes], odd: list[str]) -> None:
        parts, sizes = [self.flat], []
        if words:
            ids = np.array(self.words_only.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            assert len(ends) == len(words), "a word must be one pre-token"
            parts.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        if odd:
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
            parts += found
            sizes.append(np.array([len(x) for x in found]))
        start = len(self.numbers)
        self.numbers.update(zip([*words, *odd], range(start, start + len(words) + len(odd))))
        self.flat = np.concatenate(parts)
        self.bounds = np.r_[self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(sizes))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) end to end, and how many each has."""
        data, offsets = column_bytes(texts)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        start, end, odd, low = spans(data, offsets)
        _, where, which = np.unique(span_hashes(low, start, end), return_index=True, return_inverse=True)
        raw = low.tobytes()
        words = [raw[a:b].decode() if o else raw[a:b] for a, b, o in zip(start[where].tolist(), end[where].tolist(), odd[where].tolist())]
        if len(self.numbers) > CACHE_WORDS:
            self.forget()
        new = [w for w in words if w not in self.numbers]
        if new:
            self._learn([w for w in new if isinstance(w, bytes)], [w for w in new if isinstance(w, str)])
        number = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))[which]
        begin = self.bounds[number]
        size = self.bounds[number + 1] - begin
        upto = np.cumsum(size)
        ids = self.flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin - upto + size, size)]
        per_text = np.diff(np.r_[0, upto][np.searchsorted(start, offsets)])
        return ids, per_text


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def binary_lengths(n: int, longest: int) -> list[int]:
    """``longest`` as often as it fits, then the set bits of the rest, largest first."""
    return cut_lengths(np.array([n]), longest)[1].tolist()


def cut_lengths(totals: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary lengths of texts of so many ids: each text's number of pieces, and all pieces' lengths."""
    bits = 1 << np.arange(longest.bit_length() - 1, -1, -1)
    # Of each length, longest first, how many pieces a text has: any number of the longest, one of others.
    times = np.where(bits == longest, totals[:, None] // longest, totals[:, None] // bits & 1)
    return times.sum(1), np.repeat(np.tile(bits, len(totals)), times.ravel())


def pack(docs: DataFrame, tokenizer_path: str, longest: int = 4096, end_id: int = 2) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id,
    offset.

    Every row of ``docs`` is one document (null text: empty, so just ``end_id``); rows that repeat
    an id give their pieces again under other sequence ids; extra columns are not read. A sequence
    is one piece, ``longest`` is a power of two, so padding is nil. sequence_id holds, from the
    highest bit down, the length bucket, the input partition and a running number there: unique
    without a global count, and equal lengths are neighbours when sorted by it. It depends on how the
    input is split, so another layout of the same table gives the same pieces other ids.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, number = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer_path)
        for whole in batches:
            for batch in text_slices(whole, "text", 1 << 20):
                found, per_text = enc.encode(batch.column("text"))
                totals = per_text + 1
                ids = np.full(len(found) + len(totals), end_id, "<u4")
                own = np.ones(len(ids), bool)
                own[np.cumsum(totals) - 1] = False
                ids[own] = found
                counts, lengths = cut_lengths(totals, longest)
                of = np.repeat(np.arange(len(totals)), counts)
                ends = np.cumsum(lengths)
                starts = ends - lengths - np.repeat(np.cumsum(totals) - totals, counts)
                sequence = (np.floor(np.log2(lengths)).astype(np.int64) + 1) << 57 | partition << 34 | number + np.arange(len(of))
                number += len(of)
                ids = pa.Array.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(4 * np.r_[0, ends]), pa.py_buffer(ids)]).cast(pa.binary())
                columns = [batch.column("doc_id").take(pa.array(of)), starts, lengths, ids, totals[of], sequence, np.zeros(len(of), np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], NAMES)
        # The worker lives on, maybe in other stages.
        enc.forget()
        give_back()

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(
        pieces, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces as one Parquet folder a length, ready to be read as unpadded batches."""
    pieces.write.partitionBy("length").parquet(path)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    import public_tokenizers

    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
