"""String similarities as built-in expressions; only ``partial_ratio`` goes through Python, in batches.

``ratio`` is 100 * 2 * LCS / (|a| + |b|), rounded half to even. The longest common subsequence is
counted in the bits of one long (a set bit of V for each place of the shorter text that is not
matched yet, and a table of each character's places); texts of over 62 code points on both sides go
through an array table instead. ``let`` evaluates what is used more than once a single time.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 62


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lev_dist(a: Column, b: Column) -> Column:
    """Unit-cost edit distance in code points."""
    return F.levenshtein(a, b)


def lev_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1.0 for two empty texts; null with a null one."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when((longest == 0) & a.isNotNull() & b.isNotNull(), 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def _chars(x: Column) -> Column:
    return F.when(F.char_length(x) == 0, F.array().cast("array<string>")).otherwise(F.split(x, ""))


def _places(chars: Column) -> Column:
    """For each character of a text (an array of at most BITS), the bits of its places."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def bits(c: Column) -> Column:
        return F.aggregate(F.transform(chars, lambda x, i: F.when(x == c, F.call_function("shiftleft", one, i)).otherwise(none)), none, lambda m, x: m.bitwiseOR(x))

    return let(F.array_distinct(chars), lambda d: F.map_from_arrays(d, F.transform(d, bits)))


def _lcs_bits(n: Column, places: Column, b: Column) -> Column:
    """From the length and the places of one text and the other text."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def count(ones: Column) -> Column:
        def step(v: Column, c: Column) -> Column:
            met = v.bitwiseAND(F.coalesce(places[c], none))
            return let(met, lambda x: (v + x).bitwiseOR(v - x).bitwiseAND(ones))

        return F.bit_count(ones.bitwiseAND(F.bitwise_not(F.aggregate(_chars(b), ones, step))))

    return let(F.call_function("shiftleft", one, n) - one, count)


def _lcs_one(a: Column, b: Column) -> Column:
    return let(_places(_chars(a)), lambda places: _lcs_bits(F.char_length(a), places, b))


def _lcs_table(a: Column, b: Column) -> Column:
    """Row by row: a cell is the running maximum of the row above and of its diagonal at a match."""
    other = _chars(b)
    width = F.char_length(b)
    zero = F.array_repeat(F.lit(0), width + 1)

    def row(above: Column, c: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            here = F.greatest(F.element_at(done, -1), F.element_at(above, j + 1), F.when(F.element_at(other, j) == c, F.element_at(above, j) + 1).otherwise(0))
            return F.concat(done, F.array(here))

        return F.when(width == 0, zero).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), F.array(F.lit(0)), cell))

    return F.element_at(F.aggregate(_chars(a), zero, row), -1)


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, in code points."""
    la, lb = F.char_length(a), F.char_length(b)
    return F.when(la <= F.least(lb, F.lit(BITS)), _lcs_one(a, b)).when(lb <= BITS, _lcs_one(b, a)).when(la <= BITS, _lcs_one(a, b)).otherwise(_lcs_table(a, b))


def _percent(common: Column, both: Column) -> Column:
    return F.bround(200.0 * common / both).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """0-100; 100 for equal texts (two empty ones too), else 0 when either is empty."""

    def of(x: Column, y: Column) -> Column:
        lx, ly = F.char_length(x), F.char_length(y)
        return F.when(x == y, 100).when((lx == 0) | (ly == 0), 0).otherwise(_percent(lcs(x, y), lx + ly))

    return let(a, lambda x: let(b, lambda y: of(x, y)))


def prepare(x: Column) -> Column:
    """Drop U+0080-U+00FF, turn what is no word character into spaces, lower-case, trim."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(x, "[\\x{80}-\\x{ff}]", ""), "(?U)\\W", " ")))


def _tokens(x: Column) -> Column:
    return F.filter(F.split(x, "\\s+"), lambda t: t != "")


def prepared_tokens(x: Column) -> Column:
    return _tokens(prepare(x))


def sorted_tokens(x: Column) -> Column:
    return F.array_join(F.array_sort(_tokens(prepare(x))), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(sorted_tokens(a), sorted_tokens(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best ratio among the shared tokens, these and a's rest, these and b's rest, each sorted and joined;
    0 where a side has no tokens."""

    def joined(x: Column) -> Column:
        return F.array_join(F.array_sort(x), " ")

    def of(ta: Column, tb: Column) -> Column:
        def best(shared: Column) -> Column:
            sides = [F.trim(F.concat(shared, F.lit(" "), joined(F.array_except(x, y)))) for x, y in ((ta, tb), (tb, ta))]
            return let(sides[0], lambda sa: let(sides[1], lambda sb: F.greatest(ratio(shared, sa), ratio(shared, sb), ratio(sa, sb))))

        return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0).otherwise(let(joined(F.array_intersect(ta, tb)), best))

    return let(F.array_distinct(_tokens(prepare(a))), lambda ta: let(F.array_distinct(_tokens(prepare(b))), lambda tb: of(ta, tb)))


def partial_ratio(a: Column, b: Column) -> Column:
    """Best ratio of the shorter text against every window of its length in the longer one; windows
    are cut off at the end. Batches of pairs go through ``sliding.partial_ratios``."""
    from .sliding import partial_ratios

    @F.arrow_udf("int")
    def best(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(partial_ratios(x.to_pylist(), y.to_pylist()), pa.int32())

    return best(a, b)


#: Scorers by name, each giving a similarity from 0 to 1.
SCORERS = {
    "levenshtein": lev_similarity,
    "token-set": lambda a, b: token_set_ratio(a, b) / 100.0,
    "token-sort": lambda a, b: token_sort_ratio(a, b) / 100.0,
    "partial": lambda a, b: partial_ratio(a, b) / 100.0,
    "ratio": lambda a, b: ratio(a, b) / 100.0,
}


def scorer(name: str):
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; one of {', '.join(SCORERS)}")
    return SCORERS[name]


def string_features(df, a: str = "fraudulent_name", b: str = "real_name"):
    """``df`` plus lev_dist, token_set_ratio, partial_ratio and token_sort_ratio, in one projection."""
    x, y = F.col(a), F.col(b)
    return df.withColumns(
        {"lev_dist": lev_dist(x, y), "token_set_ratio": token_set_ratio(x, y) / 100.0, "partial_ratio": partial_ratio(x, y) / 100.0, "token_sort_ratio": token_sort_ratio(x, y) / 100.0}
    )
