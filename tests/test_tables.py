import json

import pytest
from pyspark.sql import functions as F

from glyphguard.functions import vectors
from glyphguard.operators import hooks
from glyphguard.operators import tables as ops
from glyphguard.sources import tables as src


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([('a "b"', "c,d", 1), ("new\nline", None, 0)], src.PAIRS)
    for name in ("t.csv", "t.parquet"):
        src.save_table(df, f"{tmp_path}/{name}")
        assert sorted(map(str, src.load_table(spark, f"{tmp_path}/{name}", src.PAIRS).collect())) == sorted(map(str, df.collect()))
    src.write_metrics(spark.range(1).select(F.lit(0.5).alias("accuracy")), f"{tmp_path}/m", "run1")
    lines = [json.loads(x) for p in (tmp_path / "m").glob("*.json") for x in p.read_text().splitlines()]
    assert lines == [{"accuracy": 0.5, "run": "run1"}]
    src.write_trials(spark.range(2).withColumnRenamed("id", "trial_number"), f"{tmp_path}/trials.csv")
    assert src.load_table(spark, f"{tmp_path}/trials.csv").count() == 2


def test_columns(spark):
    df = spark.createDataFrame([("a", "b", 1.0)], "name1 string, name2 string, label double")
    assert src.typed_pairs(src.canonical_columns(df)).dtypes == [("fraudulent_name", "string"), ("real_name", "string"), ("label", "int")]
    with pytest.raises(ValueError):
        src.canonical_columns(df.drop("name2"))
    with pytest.raises(ValueError):
        src.require_columns(df)
    assert src.concat_tables(df, df, df).count() == 3
    assert src.first_rows(df.withColumn("pair_id", F.lit(1)), None).count() == 1


def test_renamed_by_place_and_prefix(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id int, e_0 int, other int")
    assert src.rename_columns(df, {0: "name"}, {"e_": "emb_"}).columns == ["name", "emb_0", "other"] and src.rename_columns(df).columns == df.columns


def test_wide_vectors_by_name_and_position(spark):
    named = spark.createDataFrame([("a", "b", 1, 1.0, 2.0, 3.0, 4.0)], "x string, y string, label int, fraud_emb_0 float, fraud_emb_1 float, real_emb_0 float, real_emb_1 float")
    placed = named.toDF("x", "y", "label", "e0", "e1", "r0", "r1")
    for df in (named, placed):
        row = src.wide_to_vectors(df, 2).first()
        assert (row.fraud_emb, row.real_emb) == ([1.0, 2.0], [3.0, 4.0])
    with pytest.raises(ValueError):
        src.wide_to_vectors(placed, 3)


def test_first_rows_win(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 5, "z"), (None, 3, "n")], "k string, i int, v string")
    assert sorted(map(tuple, ops.dedup_keep_first(df, "k", "i").collect()), key=str) == sorted([("a", 1, None), ("b", 5, "z"), (None, 3, "n")], key=str)


def test_vectors_attached_and_looked_up(spark):
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "c", "z")], "pair_id int, fraudulent_name string, real_name string")
    vecs = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "name string, embedding array<double>")
    both = ops.attach_vectors(pairs, vecs)
    assert {r.pair_id: (r.fraud_emb, r.real_emb) for r in both.collect()} == {1: ([1.0], [2.0]), 2: ([2.0], [1.0]), 3: (None, None)}
    found = ops.self_lookup_vectors(both.drop("real_emb"))
    assert {r.pair_id: r.real_emb for r in found.collect()} == {1: [2.0], 2: [1.0]}
    assert ops.drop_missing_vectors(both, "real_emb").count() == 2
    assert sorted(r.name for r in ops.unique_names(pairs).collect()) == ["a", "b", "c", "z"]


def test_finite_and_unit_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [0.0, 0.0])], "i int, v array<double>")
    assert sorted(r.i for r in ops.nonfinite_vectors(df, "v").collect()) == [2, 3]
    rows = {r.i: r.u for r in df.select("i", vectors.l2_normalize(F.col("v")).alias("u")).collect()}
    assert rows[1] == [0.6, 0.8] and rows[4] == [0.0, 0.0]


def test_encoder_sees_each_name_once(spark):
    pairs = spark.createDataFrame([(i, "ab" if i % 2 else "abc", "zz") for i in range(50)] + [(99, None, "ab")], "pair_id int, fraudulent_name string, real_name string")
    seen = spark.sparkContext.accumulator(0)

    def make():
        plain = hooks.HashedNgramEncoder(16)

        def encode(names):
            seen.add(len(names))
            return plain(names)

        return encode

    rows = hooks.embed_names(pairs, make).collect()
    assert len(rows) == 51 and all(len(r.real_emb) == 16 for r in rows) and [r.fraud_emb for r in rows if r.pair_id == 99] == [None]
    assert seen.value % 3 == 0  # three distinct names, however often the plan runs the table


def test_latency_and_leaderboard(spark):
    runs = spark.createDataFrame([("a", i, v) for i, v in enumerate([100.0, 1.0, 3.0])] + [("b", i, 2.0) for i in range(3)], "model string, run int, ms double")
    found = ops.latency_report(runs, "model", "run", "ms", skip_first=1, batch=10).collect()
    assert [(r.model, r.n_runs, r.mean_ms, r.std_ms, r.throughput) for r in found] == [("a", 2, 2.0, 1.0, 5000.0), ("b", 2, 2.0, 0.0, 5000.0)]
    trials = spark.createDataFrame([(0, 0.5), (1, 0.4), (2, 0.5), (3, 0.9)], "trial_number int, test_auc double")
    assert [(r.best_so_far, r.best_trial) for r in ops.trial_leaderboard(trials).orderBy("trial_number").collect()] == [(0.5, 0), (0.5, 0), (0.5, 0), (0.9, 3)]
