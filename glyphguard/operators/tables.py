"""Filters, deduplication, joins and counts over pair and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import binarise, error_type
from ..functions.vectors import is_finite


def with_errors(scored: DataFrame, threshold, score: str = "similarity", label: str = "label", strict: bool = True) -> DataFrame:
    """``scored`` plus predicted_label and error_type; both null without a score."""
    predicted = binarise(F.col(score), threshold, strict)
    out = scored.withColumn("predicted_label", predicted)
    return out.withColumn("error_type", F.when(F.col("predicted_label").isNotNull(), error_type(F.col(label), F.col("predicted_label"))))


def extract_misclassified(scored: DataFrame, threshold, score: str = "similarity", label: str = "label", strict: bool = True) -> DataFrame:
    return with_errors(scored, threshold, score, label, strict).filter("error_type <> 'correct'")


def match_mismatches(matches: DataFrame) -> DataFrame:
    return matches.filter("actual_real_name <> best_real_name")


def match_accuracy(matches: DataFrame) -> DataFrame:
    return matches.agg(F.avg((F.col("actual_real_name") == F.col("best_real_name")).cast("double")).alias("accuracy"))


def model_disagreement(df: DataFrame, truth: str, right: str, wrong: str) -> DataFrame:
    """Rows that one model gets right and the other wrong."""
    return df.filter((F.col(right) == F.col(truth)) & (F.col(wrong) != F.col(truth)))


def dedup_keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the least ``order`` of each key: a pre-aggregated minimum, not a sort."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def drop_missing_vectors(df: DataFrame, *vectors: str) -> DataFrame:
    return df.dropna(subset=list(vectors))


def nonfinite_vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.filter(~is_finite(F.col(vector)))


def attach_vectors(pairs: DataFrame, vectors: DataFrame, key: str = "name", vector: str = "embedding") -> DataFrame:
    """fraud_emb and real_emb by two left joins on the names; null where a name has no vector."""
    for name, out in (("fraudulent_name", "fraud_emb"), ("real_name", "real_emb")):
        side = vectors.select(F.col(key).alias("_key"), F.col(vector).alias(out))
        pairs = pairs.join(side, pairs[name] == side._key, "left").drop("_key")
    return pairs


def self_lookup_vectors(pairs: DataFrame, order: str = "pair_id") -> DataFrame:
    """real_emb from the first row whose fraudulent name is this row's real name; rows without go."""
    known = dedup_keep_first(pairs.select("fraudulent_name", order, "fraud_emb"), "fraudulent_name", order)
    side = known.select(F.col("fraudulent_name").alias("_key"), F.col("fraud_emb").alias("real_emb"))
    return pairs.join(side, pairs.real_name == side._key).drop("_key")


def unique_names(pairs: DataFrame, *columns: str) -> DataFrame:
    out = None
    for c in columns or ("fraudulent_name", "real_name"):
        side = pairs.select(F.col(c).alias("name"))
        out = side if out is None else out.union(side)
    return out.filter("name is not null").distinct()


def null_counts(df: DataFrame, *columns: str) -> DataFrame:
    """n_rows, each column's nulls and rows with any."""
    names = columns or df.columns
    some = F.greatest(*[F.col(c).isNull() for c in names]) if len(names) > 1 else F.col(names[0]).isNull()
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in names], F.count_if(some).alias("rows_with_null"))


def name_counts(pairs: DataFrame) -> DataFrame:
    """Distinct fraudulent and real names and the number of candidate pairs between them."""
    out = pairs.agg(F.countDistinct("fraudulent_name").alias("n_fraudulent"), F.countDistinct("real_name").alias("n_real"))
    return out.withColumn("n_candidates", F.col("n_fraudulent") * F.col("n_real"))


def feature_ranges(df: DataFrame, *features: str) -> DataFrame:
    """feature, least, most: one aggregate, then one row a feature."""
    cells = [F.struct(F.lit(c).alias("feature"), F.min(F.col(c).cast("double")).alias("least"), F.max(F.col(c).cast("double")).alias("most")) for c in features]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def latency_report(runs: DataFrame, model: str, order: str, latency: str, skip_first: int = 0, batch: int = 1) -> DataFrame:
    """Mean, extremes, population deviation and throughput per model, fastest first. The ``skip_first``
    warm-up runs of each model are found by a ranked limit, which Spark cuts before the shuffle."""
    if skip_first:
        from pyspark.sql import Window

        turn = F.row_number().over(Window.partitionBy(model).orderBy(order))
        # skip_first rows a model.
        warm = runs.select(model, order).withColumn("_turn", turn).filter(F.col("_turn") <= skip_first).drop("_turn")
        runs = runs.join(F.broadcast(warm), [model, order], "left_anti")
    x = F.col(latency)
    out = runs.groupBy(F.col(model).alias("model")).agg(
        F.count(x).alias("n_runs"), F.avg(x).alias("mean_ms"), F.min(x).alias("min_ms"), F.max(x).alias("max_ms"), F.stddev_pop(x).alias("std_ms")
    )
    return out.withColumn("throughput", F.try_divide(F.lit(batch * 1000.0), "mean_ms")).orderBy("mean_ms", "model")


def trial_leaderboard(trials: DataFrame, order: str = "trial_number", score: str = "test_auc", study: str | None = None) -> DataFrame:
    """Each trial with the best score up to it in its study, and the trial that reached it first."""
    from pyspark.sql import Window

    upto = Window.partitionBy(F.col(study) if study else F.lit(1)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    best = F.max_by(order, F.struct(score, -F.col(order))).over(upto)
    return trials.withColumns({"best_so_far": F.max(score).over(upto), "best_trial": best})
