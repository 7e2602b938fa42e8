"""Partial ratios of many pairs at once: every window of every pair is a lane of 64 bits.

Where the shorter text's characters stand is found once per character of the longer text; neighbouring
windows read these match bits at shifted places. A step takes the j-th character of all windows of all
pairs together, so the cost is a few array operations per character of the shorter text.
"""

from __future__ import annotations

import numpy as np

#: Places of the shorter text that a lane holds, and lanes that are worked on at once.
BITS, LANES = 63, 1 << 18


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def partial_ratios(a: list[str | None], b: list[str | None]) -> list[int | None]:
    """Best ratio of the shorter text of each pair against every window of its length in the longer one,
    windows cut off at the end; null with a null text, 100 for equal texts, 0 where only one is empty."""
    out: list[int | None] = [None] * len(a)
    batch, lanes = [], 0
    for k, (x, y) in enumerate(zip(a, b)):
        if x is None or y is None:
            continue
        short, long = (x, y) if len(x) <= len(y) else (y, x)
        if x == y or not short:
            out[k] = 100 if x == y else 0
        elif len(short) > BITS:
            out[k] = _long(short, long)
        else:
            batch.append((k, _codes(short), _codes(long)))
            lanes += len(long) + len(short)
            if lanes > LANES:
                _lanes(batch, out)
                batch, lanes = [], 0
    if batch:
        _lanes(batch, out)
    return out


def _lanes(batch: list, out: list) -> None:
    batch.sort(key=lambda r: -len(r[1]))
    sizes, lengths = np.array([len(s) for _, s, _ in batch]), np.array([len(t) for _, _, t in batch])
    # Longer texts end to end, each followed by room for its last windows, whose match bits are 0.
    starts = np.concatenate([[0], np.cumsum(lengths + sizes)])
    text = np.full(starts[-1], -1, np.int64)
    for at, (_, _, t) in zip(starts, batch):
        text[at : at + len(t)] = t
    owner = np.repeat(np.arange(len(batch)), lengths + sizes)
    match = np.zeros(len(text), np.uint64)
    for k in range(sizes[0]):
        # Only pairs whose shorter text has so many characters, which come first.
        upto = starts[np.searchsorted(-sizes, -k, side="left")]
        char = np.array([int(s[k]) for _, s, _ in batch if len(s) > k], np.int64)
        match[:upto] |= (text[:upto] == char[owner[:upto]]).astype(np.uint64) << np.uint64(k)
    window = np.concatenate([np.arange(at, at + n) for at, n in zip(starts, lengths)])
    mine = owner[window]
    ones = (np.uint64(1) << sizes.astype(np.uint64)) - np.uint64(1)
    free = ones[mine]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for j in range(sizes[0]):
        upto = ends[np.searchsorted(-sizes, -j, side="left")]
        met = free[:upto] & match[window[:upto] + j]
        free[:upto] = (free[:upto] + met) | (free[:upto] - met)
    common = sizes[mine] - np.bitwise_count(free & ones[mine]).astype(np.int64)
    width = np.minimum(sizes[mine], lengths[mine] - (window - starts[mine]))
    scores = np.rint(200.0 * common / (sizes[mine] + width)).astype(np.int64)
    for k, best in zip([r[0] for r in batch], np.maximum.reduceat(scores, ends[:-1])):
        out[k] = int(best)


def _long(short: str, long: str) -> int:
    """One pair with a long shorter text, by whole numbers of as many bits. A window shares at most one
    character more than the one before it, so as many windows are skipped as the best is ahead."""
    n, best = len(short), 0
    places: dict[str, int] = {}
    for k, c in enumerate(short):
        places[c] = places.get(c, 0) | 1 << k
    match, ones, most, at = [places.get(c, 0) for c in long], (1 << n) - 1, 0, 0
    while at < len(long):
        width = min(n, len(long) - at)
        if width < n and round(200 * width / (n + width)) <= best:
            break
        free = ones
        for m in match[at : at + width]:
            met = free & m
            free = (free + met) | (free - met)
        common = n - (free & ones).bit_count()
        best = max(best, round(200 * common / (n + width)))
        most = max(most, common)
        at += max(1, most - common) if at + n + most - common <= len(long) else 1
    return best
