"""Threshold evaluation: ROC curves, areas, best thresholds and metrics, for one or many scorers.

Scored rows are first counted per model and distinct score. Cumulative counts then need an order
over all scores; to keep that off a single task, scores are cut into ranges at approximate
quantiles, the few range totals are summed up first, and each range runs its own window with the
total above it as an offset. Counts are whole numbers until one division at the end, so results do
not depend on partitions. The counts are written once; the scored rows are read once, by that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

RANGES = 64


def score_counts(scored: DataFrame, score: str = "similarity", label: str = "label", by: str | None = None) -> DataFrame:
    """(model, score, pos, neg) per distinct score; rows without score or label are left out."""
    model = F.col(by).cast("string") if by else F.lit("all")
    return _all_counts(scored.select(model.alias("model"), F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("y"))).filter("pos + neg > 0")


def _all_counts(rows: DataFrame) -> DataFrame:
    """As ``score_counts``, of (model, score, y), with no pos and neg where score or label is missing."""
    y = F.when(F.col("score").isNotNull(), F.col("y"))
    count = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return rows.groupBy("model", "score").agg(count(y).alias("pos"), count(1 - y).alias("neg"))


def cumulative(counts: DataFrame) -> DataFrame:
    """``score_counts`` plus tp, fp (at or over the score), positives, negatives, and the pos and neg of
    the next lower score (null at the last)."""
    return _cumulative(stored(counts, "score_counts"))


def _cumulative(counts: DataFrame) -> DataFrame:
    """As ``cumulative``, of a written table."""
    cuts = counts.groupBy("model").agg(F.percentile_approx("score", [k / RANGES for k in range(1, RANGES)], 1000).alias("cuts"))
    # One row a model with RANGES numbers.
    ranged = counts.join(F.broadcast(cuts), "model").withColumn("range", F.size(F.filter("cuts", lambda c: c > F.col("score")))).drop("cuts")
    totals = ranged.groupBy("model", "range").agg(
        F.sum("pos").alias("range_pos"), F.sum("neg").alias("range_neg"), F.max_by(F.struct("pos", "neg"), "score").alias("first")
    )
    order = Window.partitionBy("model").orderBy("range")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("model")
    totals = totals.select(
        "model",
        "range",
        F.coalesce(F.sum("range_pos").over(before), F.lit(0)).alias("above_pos"),
        F.coalesce(F.sum("range_neg").over(before), F.lit(0)).alias("above_neg"),
        F.sum("range_pos").over(whole).alias("positives"),
        F.sum("range_neg").over(whole).alias("negatives"),
        F.lead("first").over(order).alias("below"),
    )
    inside = Window.partitionBy("model", "range").orderBy(F.col("score").desc())
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    # At most RANGES rows a model.
    out = ranged.join(F.broadcast(totals), ["model", "range"])
    following = F.coalesce(F.lead(F.struct("pos", "neg")).over(inside), F.col("below"))
    return out.select(
        "model",
        "score",
        "pos",
        "neg",
        (F.sum("pos").over(upto) + F.col("above_pos")).alias("tp"),
        (F.sum("neg").over(upto) + F.col("above_neg")).alias("fp"),
        "positives",
        "negatives",
        following.alias("next"),
        ((F.col("above_pos") == 0) & (F.col("above_neg") == 0) & (F.row_number().over(inside) == 1)).alias("is_first"),
    )


def _stays() -> Column:
    """Whether a point of ``cumulative`` is no intermediate one."""
    same = (F.col("next.pos") == F.col("pos")) & (F.col("next.neg") == F.col("neg"))
    return F.col("is_first") | F.col("next").isNull() | ~same


def roc_points(counts: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """(model, threshold, tp, fp, pos, neg, positives, negatives) in thresholds' terms; threshold
    infinity, where nothing is predicted, comes first. ``drop_intermediate`` leaves out points whose
    steps before and after are equal; the first and the last score stay."""
    points = cumulative(counts)
    if drop_intermediate:
        points = points.filter(_stays())
    zero, kept = F.lit(0).cast("long"), ["positives", "negatives"]
    own = F.struct(F.col("score").alias("threshold"), "tp", "fp", "pos", "neg", *kept)
    start = F.struct(F.lit(float("inf")).alias("threshold"), *[zero.alias(c) for c in ("tp", "fp", "pos", "neg")], *kept)
    return points.select("model", F.inline(F.when(F.col("is_first"), F.array(start, own)).otherwise(F.array(own))))


def finite(x: Column) -> Column:
    """Null for an infinite threshold."""
    return F.when(F.abs(x) != float("inf"), x)


def roc_curve(points: DataFrame) -> DataFrame:
    return points.select("model", "threshold", "tp", "fp", F.try_divide("tp", "positives").alias("tpr"), F.try_divide("fp", "negatives").alias("fpr"))


def _area() -> Column:
    """Twice the area that a point adds under the curve of counts."""
    return F.col("neg").cast("decimal(18,0)") * (2 * F.col("tp") - F.col("pos")).cast("decimal(19,0)")


def _gain() -> Column:
    """tpr - fpr of a point times positives and negatives."""
    return (F.col("tp") * F.col("negatives")).cast("decimal(38,0)") - (F.col("fp") * F.col("positives")).cast("decimal(38,0)")


def roc_auc(counts: DataFrame) -> DataFrame:
    """(model, positives, negatives, roc_auc); null with a single class. Sums are decimals: they reach
    the square of the row count."""
    step = _area()
    twice = (F.first("positives").cast("decimal(18,0)") * F.first("negatives").cast("decimal(18,0)") * 2).cast("double")
    sums = cumulative(counts).groupBy("model").agg(F.first("positives").alias("positives"), F.first("negatives").alias("negatives"), F.sum(step).cast("double").alias("area"), twice.alias("twice"))
    return sums.select("model", "positives", "negatives", F.try_divide("area", "twice").alias("roc_auc"))


def youden_threshold(points: DataFrame) -> DataFrame:
    """(model, threshold, youden): the highest threshold at which tpr - fpr is greatest."""
    gain = _gain()
    best = points.groupBy("model").agg(
        F.max_by(F.struct("threshold", "tp", "fp", "positives", "negatives"), F.struct(gain, "threshold")).alias("b")
    )
    return best.select("model", "b.threshold", (F.try_divide("b.tp", "b.positives") - F.try_divide("b.fp", "b.negatives")).alias("youden"))


def _best(points: DataFrame, quality: Column, name: str) -> DataFrame:
    """Highest threshold with the greatest quality under ``score > threshold``; (0, 0) when no
    quality is over 0."""
    best = points.withColumn("q", quality).groupBy("model").agg(F.max("q").alias("top"), F.max_by("threshold", F.struct("q", "threshold")).alias("at"))
    some = F.col("top") > 0
    return best.select("model", F.when(some, F.col("at")).otherwise(0.0).alias("threshold"), F.when(some, F.col("top")).otherwise(0.0).alias(name))


def best_accuracy_threshold(points: DataFrame) -> DataFrame:
    """With ``>``, threshold i predicts the points before it, so its own rows count as negative."""
    right = F.col("tp") - F.col("pos") + F.col("negatives") - (F.col("fp") - F.col("neg"))
    return _best(points, F.try_divide(right, F.col("positives") + F.col("negatives")), "accuracy")


def best_precision_threshold(points: DataFrame) -> DataFrame:
    tp, fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    return _best(points, F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), "precision")


def confusion(scored: DataFrame, predicted: Column, label: str = "label", by: list[str] = ()) -> DataFrame:
    """tp, fp, tn, fn (zeros included) of rows with a label and a prediction."""
    rows = scored.select(*by, F.col(label).alias("y"), predicted.alias("p")).filter("y is not null and p is not null")
    cells = {"tp": "y = 1 and p = 1", "fp": "y = 0 and p = 1", "tn": "y = 0 and p = 0", "fn": "y = 1 and p = 0"}
    return rows.groupBy(*by).agg(*[F.count_if(F.expr(e)).alias(k) for k, e in cells.items()])


def metrics(cells: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1_score of confusion cells; a division by zero gives 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.col
    return cells.withColumns(
        {
            "accuracy": ratio(c("tp") + c("tn"), c("tp") + c("fp") + c("tn") + c("fn")),
            "precision": ratio(c("tp"), c("tp") + c("fp")),
            "recall": ratio(c("tp"), c("tp") + c("fn")),
            "f1_score": ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
        }
    )


def evaluate(scored: DataFrame, score: str = "similarity", label: str = "label", by: str | None = None, strict: bool = True, drop_intermediate: bool = True) -> DataFrame:
    """One row a model: threshold (Youden), accuracy, precision, recall, f1_score there, roc_auc,
    best_accuracy and its threshold. All models in one job; a model without both classes or without
    scores gets status ERROR and null metrics instead of failing the rest.

    Scores are counted once; the cumulative counts hold all the rest, the confusion cells at the chosen
    threshold included, so the rows are not looked at again.
    """
    model = F.col(by).cast("string") if by else F.lit("all")
    every = stored(_all_counts(scored.select(model.alias("model"), F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("y"))), "score_counts")
    kept = _stays() if drop_intermediate else F.lit(True)
    # With ">", a threshold's own rows count as negative.
    right = F.col("tp") - F.col("pos") + F.col("negatives") - (F.col("fp") - F.col("neg"))
    found = _cumulative(every.filter("pos + neg > 0")).groupBy("model").agg(
        F.sum(_area()).cast("double").alias("area"),
        F.max(F.when(kept, F.struct(_gain().alias("gain"), "score", "tp", "fp", "pos", "neg"))).alias("youden"),
        F.max(F.when(kept, F.struct(right.alias("right"), "score"))).alias("best"),
    )
    totals = every.groupBy("model").agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    # One row a model.
    out = totals.join(F.broadcast(found), "model", "left")
    c, infinite = F.col, F.lit(float("inf"))
    # The first point of a curve, at infinity, where nothing is predicted, wins ties.
    some, better = c("youden.gain") > 0, c("best.right") > c("negatives")
    tp, fp = c("youden.tp"), c("youden.fp")
    cells = {"tp": tp - c("youden.pos") if strict else tp, "fp": fp - c("youden.neg") if strict else fp}
    out = out.withColumns({k: F.when(some, v).otherwise(0) for k, v in cells.items()} | {"threshold": F.when(some, c("youden.score")).otherwise(infinite)})
    out = metrics(out.withColumns({"tn": c("negatives") - c("fp"), "fn": c("positives") - c("tp")}))
    twice = (c("positives").cast("decimal(18,0)") * c("negatives").cast("decimal(18,0)") * 2).cast("double")
    most = F.greatest(c("best.right"), c("negatives"))
    out = out.withColumns(
        {
            "roc_auc": F.try_divide("area", twice),
            "best_accuracy": F.try_divide(most, c("positives") + c("negatives")),
            "best_accuracy_threshold": F.when(most == 0, 0.0).when(better, c("best.score")).otherwise(infinite),
        }
    )
    good = F.col("roc_auc").isNotNull()
    return out.select(
        "model",
        F.when(good, "OK").otherwise("ERROR").alias("status"),
        *[F.when(good, F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1_score", "roc_auc", "best_accuracy")],
        F.when(good, finite(F.col("threshold"))).alias("threshold"),
        F.when(good, finite(F.col("best_accuracy_threshold"))).alias("best_accuracy_threshold"),
    )


def unpivot_scores(scored: DataFrame, *scores: str, keep=("label",)) -> DataFrame:
    """One row per row and scorer: model, similarity."""
    return scored.select(*keep, *[F.col(s).cast("double").alias(s) for s in scores]).unpivot(list(keep), list(scores), "model", "similarity")


def threshold_sweep(scored: DataFrame, thresholds: list[float], score: str, label: str = "label", strict: bool = False) -> DataFrame:
    """Metrics at every fixed threshold in one pass: each row is counted once per threshold list, as
    conditional sums."""
    s, y = F.col(score), F.col(label)
    rows = scored.filter(s.isNotNull() & y.isNotNull())
    cells = []
    for t in thresholds:
        hit = s > t if strict else s >= t
        cells.append(F.struct(F.lit(float(t)).alias("threshold"), *[F.count_if(e).alias(k) for k, e in (("tp", (y == 1) & hit), ("fp", (y == 0) & hit), ("tn", (y == 0) & ~hit), ("fn", (y == 1) & ~hit))]))
    return metrics(rows.agg(F.array(*cells).alias("c")).select(F.inline("c")))
