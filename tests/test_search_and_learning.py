import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphguard.operators import evaluate as ev
from glyphguard.operators import learn, search
from glyphguard.streaming.scores import score_stream


def names(rng, n):
    return ["".join(rng.choice("abcdeé") for _ in range(rng.randint(3, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def lists(spark):
    rng = random.Random(8)
    refs = names(rng, 120)
    queries = [x[:-1] + "z" if rng.random() < 0.5 else x for x in refs[:50]] + names(rng, 20)
    q = spark.createDataFrame(list(enumerate(queries)) + [(900, None)], "query_id int, query_name string")
    return q, spark.createDataFrame(list(enumerate(refs)) + [(901, None)], "ref_id int, ref_name string")


@pytest.mark.parametrize("least", [0.6, 0.75, 0.9])
def test_blocking_loses_nothing(lists, least):
    exact = {r.query_id: (r.best_real_name, r.lev_similarity) for r in search.nearest_name_exact(*lists).collect() if r.lev_similarity >= least}
    blocked = {r.query_id: (r.best_real_name, r.lev_similarity) for r in search.nearest_name_blocked(*lists, least=least).collect()}
    assert blocked == exact and exact


def test_query_blocks_cover_all(lists, monkeypatch):
    whole = sorted(map(str, search.nearest_name_exact(*lists).collect()))
    monkeypatch.setattr(search, "BLOCK_ROWS", 9)
    monkeypatch.setattr(search, "query_blocks", lambda q, key, rows=9: [q.filter(F.pmod(F.xxhash64(key), F.lit(3)) == k) for k in range(3)])
    assert sorted(map(str, search.nearest_name_exact(*lists).collect())) == whole


def test_tfidf_weights_by_hand(spark):
    refs = spark.createDataFrame([(0, "abcd"), (1, "abc"), (2, "xy")], "ref_id int, ref_name string")
    idf = {r.gram: r.idf for r in search.idf_table(refs).collect()}
    assert idf["abc"] == pytest.approx(np.log(4 / 3) + 1) and idf["bcd"] == pytest.approx(np.log(4 / 2) + 1) and "xy" not in idf
    top = search.tfidf_topk(refs.toDF("query_id", "query_name"), refs, 5).collect()
    assert {(r.query_id, r.ref_id) for r in top} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_fuzzy_lookup(spark):
    texts = spark.createDataFrame([(1, "BLUE bolt"), (2, "qqq"), (3, None)], "text_id int, text string")
    refs = spark.createDataFrame([(7, "bolt blue"), (8, "red gear")], "ref_id int, ref_name string")
    found = {r.text_id: (r.best_match, r.score, r.is_match) for r in search.fuzzy_lookup(texts, refs).collect()}
    assert found[1] == ("bolt blue", 100, True) and found[2][2] is False and found[3] == (None, 0, False)
    assert {tuple(r)[1:] for r in search.fuzzy_lookup(texts, refs.limit(0)).collect()} == {(None, 0, False)}


def test_lsh_recall(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + 0.1 * rng.normal(size=16)).tolist()) for i in range(400)]
    refs = spark.createDataFrame(rows, "ref_id int, ref_vec array<double>")
    queries = refs.filter("ref_id % 50 = 0").toDF("query_id", "query_vec")
    exact = {(r.query_id, r.ref_id) for r in search.vector_topk(queries, refs, 5).collect()}
    near = {(r.query_id, r.ref_id) for r in search.vector_topk_lsh(queries, refs, 5).collect()}
    assert len(exact) == 40 and len(exact & near) / len(exact) >= 0.9


def test_minhash_recall(lists):
    queries, refs = lists
    edited = {r.query_id for r in queries.filter("query_id < 50 and length(query_name) >= 6").collect()}
    near = {(r.query_id, r.ref_id) for r in search.minhash_topk(queries.filter("query_name is not null"), refs.filter("ref_name is not null"), 3).collect()}
    assert np.mean([(q, q) in near for q in edited]) >= 0.9


SMALL = "/root/testdata/sf0.001"


def test_registered_lsh_recall(spark):
    from glyphguard.plans.queries import QUERIES

    exact = {(r.query_id, r.ref_id) for r in QUERIES["vector_topk"](spark, SMALL).collect()}
    near = {(r.query_id, r.ref_id) for r in QUERIES["vector_topk_lsh"](spark, SMALL).collect()}
    assert exact and len(exact & near) / len(exact) >= 0.9


def test_registered_minhash_recall(spark):
    from glyphguard.plans.queries import QUERIES
    from glyphguard.plans.views import part_refs

    def grams(name):
        name = name.lower()
        return {name} | {name[i : i + n] for n in (3, 4, 5) for i in range(len(name) - n + 1)}

    queries, refs = ({r[0]: grams(r[1]) for r in side.collect()} for side in part_refs(spark, SMALL))
    k, want = search.neighbours(part_refs(spark, SMALL)[1]), set()
    for q, a in queries.items():
        best = sorted(((round(len(a & b) / len(a | b), 9), -r) for r, b in refs.items()), reverse=True)[:k]
        want |= {(q, -r) for score, r in best if score > 0.1}
    found = {(r.query_id, r.ref_id) for r in QUERIES["minhash_topk"](spark, SMALL).collect()}
    assert want and len(want & found) / len(want) >= 0.9


def test_a_failing_trial_is_an_error_row(separable, monkeypatch):
    trials = learn.random_trials(2)
    trials[0].optimizer = "rmsprop"
    monkeypatch.setattr(learn, "random_trials", lambda n, seed: trials)
    rows = learn.sweep(separable, separable, 6, n_trials=2, epochs=1).orderBy("trial_number").collect()
    assert "rmsprop" in rows[0].error and rows[0].test_auc is None and rows[1].error is None and rows[1].test_auc > 0


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    head, x, y, label = learn.Head.random(5, 4, 3), rng.normal(size=(6, 5)), rng.normal(size=(6, 5)), np.array([1, 0, 1, 0, 0, 1.0])
    _, gradient = learn.loss_and_gradient(head, x, y, label, 1.2)
    for a, g in zip(head.arrays(), gradient):
        for at in [(0,) * a.ndim, tuple(n - 1 for n in a.shape)]:
            values = []
            for step in (1e-6, -2e-6):
                a[at] += step
                values.append(learn.loss_and_gradient(head, x, y, label, 1.2)[0])
            a[at] += 1e-6
            assert (values[0] - values[1]) / 2e-6 == pytest.approx(g[at], abs=1e-4)


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(200):
        x, same = rng.normal(size=6), i % 2
        rows.append((i, x.tolist(), (x + 0.1 * rng.normal(size=6) if same else rng.normal(size=6)).tolist(), same))
    return spark.createDataFrame(rows, "pair_id long, fraud_emb array<double>, real_emb array<double>, label int")


def test_training_lowers_the_loss(spark, separable, tmp_path):
    head, history = learn.train_head(separable, separable, learn.Head.random(6, 8, 4), epochs=3, batches=2, optimiser=learn.Optimiser("adam", 0.02))
    assert history[-1][2] < history[0][2]
    again, _ = learn.train_head(separable.repartition(5), separable, learn.Head.random(6, 8, 4), epochs=3, batches=2, optimiser=learn.Optimiser("adam", 0.02))
    assert np.allclose(head.w1, again.w1)
    head.save(spark, f"{tmp_path}/head")
    assert np.allclose(learn.Head.load(spark, f"{tmp_path}/head").w2, head.w2)
    assert ev.evaluate(learn.score_with_head(separable, head)).first().roc_auc > 0.8
    with pytest.raises(ValueError):
        learn.Optimiser("rmsprop").step([np.zeros(1)], [np.zeros(1)])


def test_trials_at_once_are_trials_one_by_one(separable, monkeypatch):
    """Fits of different sizes and batches, in pieces and salted groups, equal a plain loop over the rows."""
    monkeypatch.setattr(learn, "SLOTS", 17)
    rows = [(r.pair_id, np.array(r.fraud_emb), np.array(r.real_emb), r.label) for r in separable.collect()]
    make = lambda: [learn.Fit(learn.Head.random(6, h, 3), b, m, learn.Optimiser(kind, 0.05, 1e-3)) for h, b, m, kind in ((8, 2, 1.0, "adam"), (5, 3, 0.5, "sgd"), (4, 1, 1.5, "rmsprop"))]
    together = learn.train_heads(separable.repartition(7), separable, make(), epochs=2)
    share = {(r.pair_id, e, b): getattr(r, f"b{e}_{b}") for r in separable.select("pair_id", *[F.pmod(F.xxhash64("pair_id", F.lit(e)), F.lit(b)).alias(f"b{e}_{b}") for e in range(2) for b in (2, 3)]).collect() for e in range(2) for b in (2, 3)}
    for fit, got in zip(make()[:2], together):
        for epoch in range(2):
            for batch in range(fit.batches):
                mine = [r for r in rows if share[r[0], epoch, fit.batches] == batch]
                x, y, label = (np.array([r[k] for r in mine]) for k in (1, 2, 3))
                _, gradient = learn.loss_and_gradient(fit.head, x, y, label, fit.margin)
                fit.optimiser.step(fit.head.arrays(), [g / len(mine) for g in gradient])
        assert all(np.allclose(a, b) for a, b in zip(fit.head.arrays(), got.head.arrays())) and len(got.history) == 2
    assert "rmsprop" in together[2].error and not together[2].history


def test_the_driver_gets_each_weight_once(separable, monkeypatch):
    """Rows collected in a step do not depend on the number of tasks."""
    collected, plain = [], type(separable).collect
    monkeypatch.setattr(type(separable), "collect", lambda df: collected.append(plain(df)) or collected[-1])
    for parts in (1, 9):
        learn.gradient_sums(separable.repartition(parts), {0: learn.Fit(learn.Head.random(6, 8, 4), 1)}, 0, 0)
    assert [len(x) for x in collected] == [1, 1]


def test_sweep_has_real_scores(separable):
    rows = learn.sweep(separable, separable, 6, n_trials=2, epochs=1).collect()
    assert len(rows) == 2 and all(0 < r.test_auc <= 1 and 0 < r.test_accuracy <= 1 for r in rows)
    assert learn.random_trials(3) == learn.random_trials(3)


def test_ensemble_is_as_good_as_its_best_feature(spark):
    rng = random.Random(3)
    rows = [(i, y, y * 0.3 + rng.random(), y * 0.2 + rng.random(), rng.randint(0, 5)) for i in range(400) for y in [i % 2]]
    df = spark.createDataFrame(rows, "pair_id int, label int, similarity double, token_set_ratio double, lev_dist int")
    model = learn.fit_ensemble(df.filter("pair_id % 5 > 0"), trees=5, depth=3)
    report = learn.ensemble_report(model, df.filter("pair_id % 5 = 0")).collect()
    assert {r.feature for r in report} == set(learn.FEATURES) and sum(r.importance for r in report) == pytest.approx(1)
    single = ev.roc_auc(ev.score_counts(df.filter("pair_id % 5 = 0"))).first().roc_auc
    assert report[0].roc_auc >= single - 0.1


def test_ensemble_pipeline_saves_model_and_metrics(spark, tmp_path):
    import json

    from pyspark.ml import PipelineModel

    rows = [(f"name{i}", f"name{i}" if i % 2 else f"other{i * 7}", i % 2, 0.5 + 0.4 * (i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "fraudulent_name string, real_name string, label int, similarity double")
    _, report = learn.ensemble_pipeline(df, df, str(tmp_path), "run7", trees=2)
    assert report.first().roc_auc == 1.0 and len(PipelineModel.load(f"{tmp_path}/model").stages) == 2
    saved = [json.loads(x) for p in (tmp_path / "metrics").glob("*.json") for x in p.read_text().splitlines()]
    assert saved[0]["run"] == "run7" and set(saved[0]["importance"]) == set(learn.FEATURES)
    assert learn.best_losses([(0, 2.0, 1.0), (1, 3.0, 1.0)]) == [(0, 2.0, 1.0, 2.0), (1, 3.0, 1.0, 2.0)]


def test_scoring_a_stream(spark, tmp_path):
    pairs = spark.createDataFrame([("paypa1", "paypal"), (None, "x")], "fraudulent_name string, real_name string")
    pairs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(pairs.schema).parquet(f"{tmp_path}/in")
    run = score_stream(stream, "levenshtein").writeStream.format("memory").queryName("scored").start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r.decision or "") for r in spark.table("scored").collect()) == ["", "review"]


def test_sums_travel_from_as_many_tasks_as_cores(spark, monkeypatch):
    """A table in many partitions gives the same sums, from at most one task a core."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist(), rng.normal(size=4).tolist(), i % 2) for i in range(60)]
    pairs = spark.createDataFrame(rows, "pair_id long, fraud_emb array<double>, real_emb array<double>, label int")
    fit, seen = learn.Fit(learn.Head.fixed(4, 3, 2), batches=1), []
    monkeypatch.setattr(type(pairs), "mapInPandas", lambda df, *a, _old=type(pairs).mapInPandas: seen.append(df.rdd.getNumPartitions()) or _old(df, *a))
    many, one = (learn.gradient_sums(pairs.repartition(n), {0: fit}, 0, 0)[0] for n in (40, 1))
    assert max(seen) <= spark.sparkContext.defaultParallelism and many[1] == one[1] == 60
    assert all(np.allclose(a, b) for a, b in zip(many[2], one[2]))


def test_ensemble_rows_are_weighed_and_features_taken_once_a_pair_of_names(spark):
    """Copies of rows are one weighted row of the fit, and features are joined to every copy."""
    rng = random.Random(4)
    few = [(rng.random(), rng.random(), float(rng.randrange(9))) for _ in range(40)]
    rows = spark.createDataFrame([(int(a + 0.2 * rng.random() > 0.6), a, b, c) for a, b, c in few for _ in range(5)], "label int, similarity double, token_set_ratio double, lev_dist double")
    model = learn.fit_ensemble(rows, trees=3)
    assert model.stages[1].getWeightCol() == "weight" and learn.score_ensemble(model, rows).count() == 200
    named = spark.createDataFrame([(i, *pair) for i, pair in enumerate([("a b", "b a"), ("x", "xy"), (None, "q")] * 3)], "pair_id int, fraudulent_name string, real_name string")
    found = {r.pair_id: (r.lev_dist, r.token_set_ratio) for r in learn.name_features(named).collect()}
    assert len(found) == 9 and found[0] == found[3] == found[6] and found[1][0] == 1
