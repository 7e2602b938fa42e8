import random

import pytest
from pyspark.sql import functions as F

from glyphguard.functions import names, strings

ALPHABET = "abcde éß1 -.😀𝐀"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def ratio(a, b):
    if a == b:
        return 100
    return round(200 * lcs(a, b) / (len(a) + len(b))) if a and b else 0


def some(rng, low, high):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(low, high)))


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(5)
    rows = [(some(rng, 0, 14), some(rng, 0, 14)) for _ in range(200)] + [(some(rng, 60, 80), some(rng, 60, 80)) for _ in range(6)] + [("", ""), ("a", ""), ("x" * 70, "x" * 70), ("x" * 5, "y" * 70)]
    return rows, spark.createDataFrame(rows, "a string, b string")


def test_lcs_ratio_and_distance(pairs):
    rows, df = pairs
    found = df.select("a", "b", strings.lcs(F.col("a"), F.col("b")), strings.ratio(F.col("a"), F.col("b")), strings.lev_dist(F.col("a"), F.col("b"))).collect()
    for a, b, n, r, d in found:
        assert (n, r, d) == (lcs(a, b), ratio(a, b), distance(a, b)), (a, b)


def test_partial_ratio_is_the_best_window(pairs):
    rows, df = pairs
    for a, b, got in df.filter("length(a) < 20 and length(b) < 20").select("a", "b", strings.partial_ratio(F.col("a"), F.col("b"))).collect():
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        want = 100 if a == b else 0 if not short else max(ratio(short, long[i : i + len(short)]) for i in range(len(long)))
        assert got == want, (a, b)


def test_token_ratios(spark):
    rows = [("New York Mets", "mets YORK new"), ("fuzzy fuzzy was a bear", "fuzzy was a bear"), ("", "x"), ("", ""), ("--", "!"), ("a_b c", "c a_b"), ("café", "cafe")]
    df = spark.createDataFrame(rows, "a string, b string")
    found = df.select(strings.token_sort_ratio(F.col("a"), F.col("b")), strings.token_set_ratio(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in found] == [(100, 100), (84, 100), (0, 0), (100, 0), (100, 0), (100, 100), (86, 86)]


def test_levenshtein_counts_code_points(spark):
    row = spark.createDataFrame([("adlıftl", "adlift", "", "")], "a string, b string, c string, d string")
    assert row.select(strings.lev_dist(F.col("a"), F.col("b"))).first()[0] == 2
    assert row.select(strings.lev_similarity(F.col("c"), F.col("d"))).first()[0] == 1.0


def test_nulls_stay_null_and_unknown_scorers_fail(spark):
    df = spark.createDataFrame([(None, "a")], "a string, b string")
    for name, f in strings.SCORERS.items():
        assert df.select(f(F.col("a"), F.col("b"))).first()[0] is None, name
    with pytest.raises(ValueError):
        strings.scorer("soundex")


def test_normalise_names(spark):
    raw = ["--Acme.COM ", " -acme", "a.com.br", "éx.com", None, " b "]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, name string")
    found = [r.name for r in names.normalize_names(df, "name").orderBy("i").collect()]
    assert found == ["Acme", "-acme", "a.com.br", "éx", None, "b"]


def test_com_detection_and_tiers(spark):
    df = spark.createDataFrame([("a.com", "b"), ("c", None)], "x string, y string")
    assert names.detect_com_suffix(df, "x", "y").first()[0] is True
    assert names.detect_com_suffix(df.filter("x = 'c'"), "x", "y").first()[0] is False
    assert names.detect_com_suffix(df, "x", disable=True).first()[0] is False
    tiers = spark.createDataFrame([(0.90,), (0.80,), (0.7999,)], "s double").select(names.decision(F.col("s"))).collect()
    assert [r[0] for r in tiers] == ["block", "review", "allow"]
