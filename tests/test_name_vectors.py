import numpy as np
from pyspark.sql import functions as F

from glyphguard.operators import evaluate as ev
from glyphguard.operators import name_vectors
from glyphguard.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_learned_vectors_beat_hashed_ones(spark):
    area = {q: ev.roc_auc(ev.score_counts(QUERIES[q](spark, SMALL))).first().roc_auc for q in ("embed_unique_names", "embed_learned_names")}
    assert area["embed_learned_names"] > max(0.75, area["embed_unique_names"] + 0.1)


def test_factors_are_the_matrix_s_strongest(spark):
    rng = np.random.default_rng(3)
    names = sorted({"".join(rng.choice(list("abcd" if i % 2 else "wxyz"), 4)) for i in range(60)})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = name_vectors.gram_pairs(df)
    rows = name_vectors.mutual_information(pairs, len(names)).collect()
    grams = sorted({r.gram for r in pairs.select("gram").distinct().collect()})
    at = {g: i for i, g in enumerate(grams)}
    dense = np.zeros((len(grams), len(grams)))
    for r in rows:
        dense[at[r.gram], at[r.other]] = r.weight
    values = np.linalg.eigvalsh(dense)
    top = values[np.argsort(-np.abs(values))[:4]]
    found = {r.gram: r.vector for r in name_vectors.gram_vectors(df, dim=4, passes=6, extra=20).collect()}
    # N-grams without a weight have no row.
    u = np.array([found.get(g, [0.0] * 4) for g in grams])
    assert {g for g in grams if dense[at[g]].any()} == set(found) and np.allclose(np.sort((u * u).sum(0))[::-1], np.sort(np.abs(top))[::-1], rtol=0.05)
    assert np.allclose(dense @ u, u * ((u * (dense @ u)).sum(0) / (u * u).sum(0)), atol=0.2 * np.abs(top).max() ** 1.5)


def test_unknown_and_missing_names(spark):
    df = spark.createDataFrame([("abc",), ("abd",), (None,)], "name string")
    vectors = name_vectors.gram_vectors(df, dim=2)
    own = name_vectors.gram_pairs(df).filter("gram = other").select("gram", "n")
    out = {r.name: r.embedding for r in name_vectors.learned_vectors(df.union(spark.createDataFrame([("é9",)], "name string")), vectors, 2, own).collect()}
    assert set(out) == {"abc", "abd", "é9"} and all(len(v) == 2 for v in out.values())
    assert np.isclose(np.linalg.norm(out["abc"]), 1) and name_vectors.gram_pairs(df.filter(F.lit(False))).count() == 0
