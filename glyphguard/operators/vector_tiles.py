"""The k best references of each query of a block, by matrix products over the rows of a task.

A block of queries is held by every task (``search.BLOCK_ROWS`` at most); references stream past it in
tiles. Only what can still be among a query's k best leaves a tile, and a task gives k rows a query at
most, so neither memory nor what is shuffled grows with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries and references of a tile; candidates that wait for being sorted.
QUERIES, REFS, WAITING = 512, 2048, 200_000
#: Cosines are equal if they are to 9 places; slack of the comparisons before rounding.
SLACK = 2e-9


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd, F.lit(False))


def units(column) -> np.ndarray:
    """Vectors divided by their lengths; those of length 0 stay."""
    x = np.stack(list(column)).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Best:
    """The k best (greatest cosine to 9 places, then smallest id) of each query so far, other than itself."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.k, n = ids, k, len(ids)
        self.kth = np.full(n, -np.inf) if floor is None else floor.copy()
        self.kth_id: list = [None] * n
        self.pairs = np.zeros(n, np.int64)
        self.own: dict = {}
        for row, i in enumerate(ids):
            self.own.setdefault(i, []).append(row)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, rows: np.ndarray, u: np.ndarray, ids: np.ndarray, v: np.ndarray, allowed: Callable | None = None, stretch: Callable | None = None, score: bool = True) -> None:
        """Score queries ``rows`` (ascending places; ``u`` has all queries) against references; ``at`` being a
        slice of these, ``allowed(rows, at)`` says which pairs of a tile count, or ``stretch(rows, at)`` from
        which place of the tile to which, for each query: nothing outside it can be among its k best.
        Without ``score`` pairs are only counted, and must have a stretch."""
        for at in range(0, len(ids), REFS):
            part = slice(at, at + REFS)
            same = [(row, c) for c, i in enumerate(ids[part]) for row in self.own.get(i, ())]
            same_row, same_col = np.array(same, np.int64).reshape(-1, 2).T
            mine = rows
            if stretch is not None and len(rows):
                first, last = stretch(rows, part)
                place = np.minimum(np.searchsorted(rows, same_row), len(rows) - 1)
                own = (rows[place] == same_row) & (first[place] <= same_col) & (same_col < last[place])
                self.pairs[rows] += last - first
                np.subtract.at(self.pairs, same_row[own], 1)
                mine = rows[last > first] if score else rows[:0]
            for first in range(0, len(mine), QUERIES):
                some = mine[first : first + QUERIES]
                scores = u[some] @ v[part].T
                off = None if allowed is None else ~allowed(some, part)
                place = np.minimum(np.searchsorted(some, same_row), len(some) - 1)
                own = some[place] == same_row
                if stretch is None:
                    self.pairs[some] += scores.shape[1] - (0 if off is None else off.sum(axis=1))
                    self_off = own if off is None else own & ~off[place, same_col]
                    np.subtract.at(self.pairs, same_row[self_off], 1)
                if off is not None:
                    scores[off] = -np.inf
                scores[place[own], same_col[own]] = -np.inf
                self._keep(some, scores, ids[part])

    def _keep(self, some: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        hit = score >= (self.kth[some] - SLACK)[:, None]
        if score.shape[1] > self.k and np.count_nonzero(hit) > 2 * self.k * len(some):
            least = np.maximum(self.kth[some], np.partition(score, -self.k, axis=1)[:, -self.k])
            hit = score >= (least - SLACK)[:, None]
        r, c = np.divmod(np.flatnonzero(hit), score.shape[1])
        there = score[r, c] > -np.inf
        r, c = r[there], c[there]
        if not len(r):
            return
        cosine, row = np.round(score[r, c], 9), some[r]
        tied = np.flatnonzero(cosine <= self.kth[row])
        lost = [t for t in tied if cosine[t] < self.kth[row[t]] or (e := self.kth_id[row[t]]) is not None and ids[c[t]] >= e]
        keep = np.ones(len(r), bool)
        keep[lost] = False
        self.kept.append((row[keep], cosine[keep], ids[c[keep]]))
        self.waiting += int(keep.sum())
        if self.waiting > WAITING:
            self._sort()

    def _sort(self) -> None:
        if not self.kept:
            return
        row, cosine, ids = (np.concatenate(x) for x in zip(*self.kept))
        order = np.lexsort((ids, -cosine, row))
        row, cosine, ids = row[order], cosine[order], ids[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
        for i in np.flatnonzero(rank == self.k - 1):
            self.kth[row[i]], self.kth_id[row[i]] = cosine[i], ids[i]
        top = rank < self.k
        self.kept, self.waiting = [(row[top], cosine[top], ids[top])], 0

    def frames(self) -> Iterator[pd.DataFrame]:
        """(query_id, ref_id, cosine, pairs): the best, and a row without reference with the number of
        scored pairs of each query."""
        self._sort()
        for row, cosine, ids in self.kept:
            yield pd.DataFrame({"query_id": self.ids[row], "ref_id": pd.Series(ids, dtype=object), "cosine": cosine, "pairs": 0})
        seen = np.flatnonzero(self.pairs)
        yield pd.DataFrame({"query_id": self.ids[seen], "ref_id": pd.Series([None] * len(seen), dtype=object), "cosine": None, "pairs": self.pairs[seen]})


def kinds(queries: DataFrame, refs: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, ref_id {refs.schema['ref_id'].dataType.simpleString()}, cosine double, pairs long"


def topk_by_tiles(block: DataFrame, refs: DataFrame, k: int, buckets: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query_id, ref_id, cosine, pairs) as ``Best.frames`` of a block of queries (query_id, query_vec)
    against refs (ref_id, ref_vec), task by task; all vectors usable and of one length. With
    ``buckets``, (rows, tables) numbers of unit vectors, a pair counts if it shares one."""
    got = block.select("query_id", "query_vec").toArrow()
    shared = refs.sparkSession.sparkContext.broadcast((got["query_id"].to_numpy(zero_copy_only=False), units(got["query_vec"].to_pylist()) if len(got) else None))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, u = shared.value
        if u is None:
            return
        best, rows = Best(ids, k), np.arange(len(ids))
        mine = buckets(u) if buckets else None
        for f in frames:
            if len(f):
                v = units(f.ref_vec)
                theirs = buckets(v) if buckets else None

                def allowed(some: np.ndarray, part: slice) -> np.ndarray:
                    return np.logical_or.reduce([mine[some, t][:, None] == theirs[part, t][None, :] for t in range(mine.shape[1])])

                best.add(rows, u, f.ref_id.to_numpy(), v, allowed if buckets else None)
        yield from best.frames()

    return refs.select("ref_id", "ref_vec").mapInPandas(run, kinds(block, refs))
