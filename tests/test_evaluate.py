import random

import pytest
from pyspark.sql import functions as F

from glyphguard.functions import names
from glyphguard.operators import evaluate as ev
from glyphguard.operators import tables as ops
from glyphguard.sources import tables as src


def literal(rows, drop=True):
    """ROC points, area and thresholds by plain loops."""
    p, n = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    points = [(float("inf"), 0, 0)]
    for t in sorted({s for s, _ in rows}, reverse=True):
        points.append((t, sum(y for s, y in rows if s >= t), sum(1 - y for s, y in rows if s >= t)))
    area = sum((b[2] - a[2]) * (b[1] + a[1]) for a, b in zip(points, points[1:])) / (2 * p * n)
    kept = points
    if drop:
        inner = [b for a, b, c in zip(points[1:], points[2:], points[3:]) if (b[1] - a[1], b[2] - a[2]) != (c[1] - b[1], c[2] - b[2])]
        kept = points[:1] + sorted(set(points[1:2] + inner + points[-1:]), reverse=True)
    youden = max(kept, key=lambda q: (q[1] * n - q[2] * p, q[0]))[0]
    best = {}
    for name, quality in (("accuracy", lambda tp, fp: (tp + n - fp) / (p + n)), ("precision", lambda tp, fp: tp / (tp + fp) if tp + fp else 0.0)):
        top, at = 0.0, 0.0
        for t, _, _ in kept:
            q = quality(sum(y for s, y in rows if s > t), sum(1 - y for s, y in rows if s > t))
            if q > top:
                top, at = q, t
        best[name] = (at, top)
    return kept, area, youden, best


@pytest.mark.parametrize("seed,values,parts", [(1, 6, 1), (2, 300, 4), (3, 300, 37), (4, 3, 2)])
def test_against_plain_loops(spark, seed, values, parts):
    rng = random.Random(seed)
    rows = [(rng.randint(0, values) / values, rng.randint(0, 1)) for _ in range(200)]
    df = spark.createDataFrame([(s, y) for s, y in rows] + [(None, 1), (0.5, None)], "similarity double, label int").repartition(parts)
    counts = ev.score_counts(df)
    for drop in (True, False):
        kept, area, youden, best = literal(rows, drop)
        points = ev.roc_points(counts, drop)
        assert sorted((r.threshold, r.tp, r.fp) for r in points.collect()) == sorted(kept)
        assert ev.youden_threshold(points).first().threshold == youden
        for name, f in (("accuracy", ev.best_accuracy_threshold), ("precision", ev.best_precision_threshold)):
            row = f(points).first()
            assert (row.threshold, row[name]) == pytest.approx(best[name])
        for strict in (True, False):
            row = ev.evaluate(df, strict=strict, drop_intermediate=drop).first()
            hit = lambda s: s > youden if strict else s >= youden
            assert row.roc_auc == pytest.approx(area) and row.threshold == (None if youden == float("inf") else youden)
            assert row.accuracy == pytest.approx(sum(hit(s) == (y == 1) for s, y in rows) / len(rows))
            assert row.recall == pytest.approx(sum(hit(s) and y for s, y in rows) / sum(y for _, y in rows))
            assert (row.best_accuracy_threshold, row.best_accuracy) == (None if best["accuracy"][0] == float("inf") else best["accuracy"][0], pytest.approx(best["accuracy"][1]))
    assert ev.roc_auc(counts).first().roc_auc == pytest.approx(area)
    wins = sum((a > b) + (a == b) / 2 for a, y in rows for b, z in rows if y and not z)
    assert area == pytest.approx(wins / (sum(y for _, y in rows) * sum(1 - y for _, y in rows)))


def test_single_class_and_failed_scorers(spark):
    df = spark.createDataFrame([("a", 0.2, 1), ("a", 0.9, 0), ("b", 0.5, 1), ("c", None, 1)], "model string, similarity double, label int")
    found = {r.model: r for r in ev.evaluate(df, by="model").collect()}
    assert found["a"].status == "OK" and found["a"].roc_auc == 0.0 and found["a"].threshold is None
    assert found["b"].status == found["c"].status == "ERROR" and found["b"].roc_auc is None
    assert ev.evaluate(df.limit(0)).count() == 0


def test_strict_and_inclusive(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "s double, label int")
    cells = lambda strict: tuple(ev.confusion(df, names.binarise(F.col("s"), 0.5, strict)).select("tp", "fp", "tn", "fn").first())
    assert cells(True) == (1, 0, 2, 1) and cells(False) == (2, 1, 1, 0)
    empty = ev.metrics(ev.confusion(df.limit(0), names.binarise(F.col("s"), 0.5))).first()
    assert empty.accuracy == empty.precision == empty.f1_score == 0.0


def test_sweep_and_bad_thresholds(spark):
    df = spark.createDataFrame([(60.0, 1), (40.0, 0), (None, 1)], "s double, label int")
    found = {r.threshold: r.accuracy for r in ev.threshold_sweep(df, src.parse_thresholds("50, 70"), "s").collect()}
    assert found == {50.0: 1.0, 70.0: 0.5}
    for bad in ("50,", "a", "50;60", ""):
        with pytest.raises(ValueError):
            src.parse_thresholds(bad)


def test_errors_in_homoglyph_samples(spark):
    rows = [("pаlace", "palace", 1, 0.9240105), ("verde", "verdi", 0, 0.92402387), ("r0ssо", "rosso", 1, 0.97), ("bianco", "nero", 0, 0.1), ("x", "y", 1, None)]
    df = spark.createDataFrame(rows, "fraudulent_name string, real_name string, label int, max_similarity double")
    found = ops.extract_misclassified(df, 0.92401050, "max_similarity").select("real_name", "predicted_label", "error_type").collect()
    assert sorted(map(tuple, found)) == [("palace", 0, "false_negative"), ("verdi", 1, "false_positive")]
