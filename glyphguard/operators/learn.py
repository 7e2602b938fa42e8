"""Fitting: a contrastive projection head, its sweep, and a boosted-tree ensemble over scores."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, contrastive_loss, unit_distance
from .evaluate import evaluate, roc_auc, score_counts


@dataclass
class Head:
    """W2 relu(W1 x + b1) + b2, shared by both names of a pair."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def random(cls, dim: int, hidden: int, out: int, seed: int = 42) -> Head:
        rng = np.random.default_rng(seed)
        a, b = 1 / math.sqrt(dim), 1 / math.sqrt(hidden)
        return cls(rng.uniform(-a, a, (hidden, dim)), rng.uniform(-a, a, hidden), rng.uniform(-b, b, (out, hidden)), rng.uniform(-b, b, out))

    @classmethod
    def fixed(cls, dim: int, hidden: int, out: int) -> Head:
        """Weights by a rule, for reproducible queries: small whole numbers over 8."""
        part = lambda n, m, k: ((np.arange(n)[:, None] * 5 + np.arange(m)[None, :] * 3 + k) % 7 - 3) / 8
        return cls(part(hidden, dim, 0), part(hidden, 1, 1)[:, 0], part(out, hidden, 2), part(out, 1, 3)[:, 0])

    def arrays(self) -> list[np.ndarray]:
        return [self.w1, self.b1, self.w2, self.b2]

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1.T + self.b1, 0) @ self.w2.T + self.b2

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(n, list(a.shape), a.ravel().tolist()) for n, a in zip(("w1", "b1", "w2", "b2"), self.arrays())]
        spark.createDataFrame(rows, "name string, shape array<int>, flat array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Head:
        found = {r.name: np.array(r.flat).reshape(r.shape) for r in spark.read.parquet(path).collect()}
        return cls(*[found[n] for n in ("w1", "b1", "w2", "b2")])


def project_head(df: DataFrame, head: Head, vector: str, out: str) -> DataFrame:
    """``df`` plus the projection of a vector column: a batched matrix product per Arrow batch."""
    shared = df.sparkSession.sparkContext.broadcast(head)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        places = np.flatnonzero(x.notna().to_numpy())
        result = np.full(len(x), None, object)
        if len(places):
            for i, v in zip(places, shared.value.project(np.stack(x.to_numpy()[places]).astype(np.float64))):
                result[i] = v
        return pd.Series(result)

    return df.withColumn(out, project(F.col(vector)))


def score_with_head(pairs: DataFrame, head: Head, a: str = "fraud_emb", b: str = "real_emb") -> DataFrame:
    """``pairs`` plus similarity: cosine of the two projections; null without a vector."""
    out = project_head(project_head(pairs, head, a, "_pa"), head, b, "_pb")
    return out.withColumn("similarity", cosine(F.col("_pa"), F.col("_pb"))).drop("_pa", "_pb")


def pair_losses(margin: float = 1.0, a: str = "fraud_emb", b: str = "real_emb") -> Column:
    """Contrastive loss of each pair; its mean is the loss of a table."""
    return contrastive_loss(unit_distance(F.col(a), F.col(b)), F.col("label"), margin)


def loss_and_gradient(head: Head, x: np.ndarray, y: np.ndarray, label: np.ndarray, margin: float) -> tuple[float, list[np.ndarray]]:
    """Summed contrastive loss of unit projections and its gradient, over one batch of pairs."""
    z = np.concatenate([x, y])
    h = z @ head.w1.T + head.b1
    r = np.maximum(h, 0)
    p = r @ head.w2.T + head.b2
    n = np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    u = p / n
    diff = u[: len(x)] - u[len(x) :]
    d = np.sqrt((diff * diff).sum(1))
    apart = np.maximum(margin - d, 0)
    loss = float((label * d * d + (1 - label) * apart * apart).sum())
    by_d = 2 * label * d - 2 * (1 - label) * apart
    g = by_d[:, None] * diff / np.maximum(d, 1e-12)[:, None]
    gu = np.concatenate([g, -g])
    gp = (gu - u * (gu * u).sum(1, keepdims=True)) / n
    gr = (gp @ head.w2) * (h > 0)
    return loss, [gr.T @ z, gr.sum(0), gp.T @ r, gp.sum(0)]


@dataclass
class Optimiser:
    """adam, adamw or sgd with weight decay."""

    kind: str = "adamw"
    lr: float = 1e-3
    weight_decay: float = 0.0
    state: list = field(default_factory=list)
    step_no: int = 0

    def step(self, arrays: list[np.ndarray], gradients: list[np.ndarray]) -> None:
        if self.kind not in ("adam", "adamw", "sgd"):
            raise ValueError(f"unknown optimiser {self.kind!r}")
        self.step_no += 1
        if not self.state:
            self.state = [[np.zeros_like(a), np.zeros_like(a)] for a in arrays]
        for a, g, (m, v) in zip(arrays, gradients, self.state):
            if self.kind == "adamw":
                a *= 1 - self.lr * self.weight_decay
            else:
                g = g + self.weight_decay * a
            if self.kind == "sgd":
                a -= self.lr * g
                continue
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.lr * (m / (1 - 0.9**self.step_no)) / (np.sqrt(v / (1 - 0.999**self.step_no)) + 1e-8)


#: Weights that a row of partial sums holds.
SLOTS = 4096


@dataclass
class Fit:
    """A head in training: its settings, its losses (epoch, train loss, validation loss), and the error
    that ended it, if one did."""

    head: Head
    batches: int = 4
    margin: float = 1.0
    optimiser: Optimiser = field(default_factory=Optimiser)
    history: list[tuple[int, float, float]] = field(default_factory=list)
    error: str | None = None


def gradient_sums(pairs: DataFrame, fits: dict[int, Fit], epoch: int = 0, batch: int | None = None) -> dict[int, tuple[float, int, list[np.ndarray]]]:
    """For each fit: summed loss, rows, and gradient over its mini-batch of the epoch, in one pass over the
    table for all of them; over all rows, and without gradient, if ``batch`` is None.

    A task adds up its rows; its sums travel in pieces of SLOTS weights, which Spark adds up in two
    levels. The driver gets every weight's sum once, however many tasks there were. There are at most as
    many tasks as cores, so what travels does not grow with the table.
    """
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    salts = max(1, math.isqrt(cores))
    shared = pairs.sparkSession.sparkContext.broadcast({k: (f.head, f.margin, f.batches) for k, f in fits.items()})
    kept = pairs.select(*(["pair_id"] if batch is not None else []), "fraud_emb", "real_emb", "label").dropna()
    if batch is not None:
        share = F.xxhash64("pair_id", F.lit(epoch))
        wanted = sorted({f.batches for f in fits.values() if batch < f.batches})
        kept = kept.withColumns({f"_b{n}": F.pmod(share, F.lit(n)) == batch for n in wanted}).filter(" or ".join(f"_b{n}" for n in wanted) or "false")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for p in parts:
            if not len(p):
                continue
            x, y = np.stack(p.fraud_emb.to_numpy()).astype(np.float64), np.stack(p.real_emb.to_numpy()).astype(np.float64)
            label = p.label.to_numpy(np.float64)
            for k, (head, margin, batches) in shared.value.items():
                if batch is not None and batch >= batches:
                    continue
                mine = slice(None) if batch is None else p[f"_b{batches}"].to_numpy(bool)
                if not len(label[mine]):
                    continue
                loss, gradient = loss_and_gradient(head, x[mine], y[mine], label[mine], margin)
                flat = np.concatenate([g.ravel() for g in gradient]) if batch is not None else np.zeros(0)
                old = sums.get(k, (0.0, 0, 0.0))
                sums[k] = old[0] + loss, old[1] + len(label[mine]), old[2] + flat
        part = TaskContext.get().partitionId()
        for k, (loss, rows, flat) in sums.items():
            for at in range(0, max(len(flat), 1), SLOTS):
                yield pd.DataFrame({"fit": [k], "piece": [at // SLOTS], "part": [part], "loss": [loss], "n": [rows], "sums": [flat[at : at + SLOTS]]})

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        return pd.DataFrame({"fit": [key[0]], "piece": [key[1]], "part": [rows.part.iloc[0]], "loss": [rows.loss.sum()], "n": [rows.n.sum()], "sums": [np.sum(np.stack(rows.sums.to_numpy()), axis=0)]})

    kind = "fit int, piece int, part int, loss double, n long, sums array<double>"
    pieces = kept.coalesce(cores).mapInPandas(run, kind).groupBy("fit", "piece", F.pmod("part", F.lit(salts))).applyInPandas(total, kind)
    found = pieces.groupBy("fit", "piece").applyInPandas(total, kind).collect()
    out = {}
    for k, f in fits.items():
        mine = sorted((r for r in found if r.fit == k), key=lambda r: r.piece)
        sizes = [a.size for a in f.head.arrays()]
        flat = np.concatenate([np.array(r.sums) for r in mine]) if mine and batch is not None else np.zeros(sum(sizes))
        out[k] = mine[0].loss if mine else 0.0, mine[0].n if mine else 0, [g.reshape(a.shape) for g, a in zip(np.split(flat, np.cumsum(sizes)[:-1]), f.head.arrays())]
    return out


def train_heads(train: DataFrame, valid: DataFrame, fits: list[Fit], epochs: int = 3) -> list[Fit]:
    """Epochs of mini-batch steps for all fits at once: a step is one pass over the training table for
    every fit that has such a batch, and one pass an epoch over the validation table takes all losses. A
    batch is a hash class of pair_id, new every epoch: the same rows however the table is partitioned.
    Both tables are kept by Spark, on disk where memory is short, until training ends. A fit whose step
    fails keeps the error and takes no further part."""
    train = train.select("pair_id", "fraud_emb", "real_emb", "label").persist(StorageLevel.MEMORY_AND_DISK)
    valid = valid.select("fraud_emb", "real_emb", "label").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for epoch in range(epochs):
            loss = {k: [0.0, 0] for k in range(len(fits))}
            for batch in range(max((f.batches for f in fits if not f.error), default=0)):
                active = {k: f for k, f in enumerate(fits) if not f.error and batch < f.batches}
                for k, (total, n, sums) in gradient_sums(train, active, epoch, batch).items():
                    try:
                        if n:
                            fits[k].optimiser.step(fits[k].head.arrays(), [g / n for g in sums])
                    except Exception as e:
                        fits[k].error = f"{type(e).__name__}: {e}"[:500]
                    loss[k][0] += total
                    loss[k][1] += n
            active = {k: f for k, f in enumerate(fits) if not f.error}
            for k, (checked, n, _) in (gradient_sums(valid, active) if active else {}).items():
                fits[k].history.append((epoch, loss[k][0] / max(loss[k][1], 1), checked / max(n, 1)))
    finally:
        train.unpersist()
        valid.unpersist()
    return fits


def train_head(train: DataFrame, valid: DataFrame, head: Head, epochs: int = 3, batches: int = 4, margin: float = 1.0, optimiser: Optimiser | None = None) -> tuple[Head, list[tuple[int, float, float]]]:
    """One fit of ``train_heads``, from a copy of ``head``: the trained head and its losses."""
    fit = Fit(Head(*[a.copy() for a in head.arrays()]), batches, margin, optimiser or Optimiser())
    train_heads(train, valid, [fit], epochs)
    if fit.error:
        raise ValueError(fit.error)
    return fit.head, fit.history


def head_scores(pairs: DataFrame, heads: dict[int, Head]) -> DataFrame:
    """(model, label, similarity) of every pair under every head, in one pass; pairs without a vector are
    left out."""
    shared = pairs.sparkSession.sparkContext.broadcast(heads)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            if len(p):
                x, y = np.stack(p.fraud_emb.to_numpy()).astype(np.float64), np.stack(p.real_emb.to_numpy()).astype(np.float64)
                for k, head in shared.value.items():
                    a, b = head.project(x), head.project(y)
                    lengths = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
                    yield pd.DataFrame({"model": k, "label": p.label, "similarity": (a * b).sum(1) / np.maximum(lengths, 1e-12)})

    return pairs.select("fraud_emb", "real_emb", "label").dropna(subset=["fraud_emb", "real_emb"]).mapInPandas(run, "model int, label int, similarity double")


@dataclass
class Trial:
    trial_number: int
    lr: float
    batches: int
    hidden: int
    optimizer: str
    weight_decay: float
    margin: float


def random_trials(n: int, seed: int = 42) -> list[Trial]:
    """Seeded configurations: log-uniform rates, categorical sizes and optimisers, uniform margin."""
    rng = random.Random(seed)
    log = lambda low, high: math.exp(rng.uniform(math.log(low), math.log(high)))
    return [Trial(k, log(1e-5, 1e-2), rng.choice([2, 4]), rng.choice([64, 128, 256, 512]), rng.choice(["adam", "adamw", "sgd"]), log(1e-6, 1e-3), rng.uniform(0.1, 2.0)) for k in range(n)]


def sweep(train: DataFrame, test: DataFrame, dim: int, n_trials: int = 4, epochs: int = 5, seed: int = 42) -> DataFrame:
    """One row a trial: its settings, test_auc and test_accuracy of the head it trained. All trials are
    trained in the same passes over the data and scored in one. A trial that fails is a row with its
    error and no scores; the others go on."""
    trials = random_trials(n_trials, seed)
    fits = [Fit(Head.random(dim, t.hidden, t.hidden, seed), t.batches, t.margin, Optimiser(t.optimizer, t.lr, t.weight_decay)) for t in trials]
    train_heads(train, test, fits, epochs)
    scored = head_scores(test, {k: f.head for k, f in enumerate(fits) if not f.error})
    found = {int(r.model): r for r in evaluate(scored.withColumn("model", F.col("model").cast("string")), by="model").collect()}
    rows = [(*asdict(t).values(), *((found[k].roc_auc, found[k].accuracy) if k in found else (None, None)), f.error) for k, (t, f) in enumerate(zip(trials, fits))]
    return train.sparkSession.createDataFrame(rows, "trial_number int, lr double, batches int, hidden int, optimizer string, weight_decay double, margin double, test_auc double, test_accuracy double, error string")


FEATURES = ("similarity", "token_set_ratio", "lev_dist")


def fit_ensemble(train: DataFrame, features=FEATURES, trees: int = 100, depth: int = 6, rate: float = 0.1, seed: int = 42):
    """A boosted-tree classifier over score features (columns), label 0/1."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from ..sources.scratch import stored

    # Equal rows are one row with their number as weight: the same sums over fewer rows.
    rows = train.select("label", *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    rows = stored(rows.groupBy("label", *features).agg(F.count("*").cast("double").alias("weight")), "ensemble_rows")
    model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), model]).fit(rows)


def score_ensemble(model, df: DataFrame) -> DataFrame:
    """``df`` plus similarity: the ensemble's probability of label 1 (replaces a column of that name
    only in the result)."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df.dropna(subset=model.stages[0].getInputCols()))
    return out.withColumn("ensemble_score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")


def ensemble_report(model, test: DataFrame) -> DataFrame:
    """One row a feature with its importance, beside accuracy and roc_auc on the test rows."""
    scored = score_ensemble(model, test)
    area = roc_auc(score_counts(scored, "ensemble_score")).first()
    right = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")).first()
    importances = model.stages[1].featureImportances.toArray().tolist()
    rows = test.sparkSession.createDataFrame(list(zip(model.stages[0].getInputCols(), importances)), "feature string, importance double")
    value = lambda x: F.lit(x).cast("double")
    return rows.withColumns({"roc_auc": value(area and area.roc_auc), "accuracy": value(right.accuracy)})


def name_features(rows: DataFrame, a: str = "fraudulent_name", b: str = "real_name") -> DataFrame:
    """``strings.string_features`` of rows, worked out once per distinct pair of names."""
    from ..functions.strings import string_features
    from ..sources.scratch import stored

    found = stored(string_features(rows.select(a, b).distinct()).withColumnsRenamed({a: "_a", b: "_b"}), "name_features")
    return rows.join(found, F.col(a).eqNullSafe(F.col("_a")) & F.col(b).eqNullSafe(F.col("_b")), "left").drop("_a", "_b")


def ensemble_pipeline(train: DataFrame, test: DataFrame, path: str, run_stamp: str, trees: int = 100):
    """Scored pairs (similarity, names, label) to string features, to a fitted ensemble, to its report on
    the test pairs; model and metrics are saved under ``path``. Returns the model and the report."""
    from ..sources.tables import write_metrics

    model = fit_ensemble(name_features(train), trees=trees)
    report = ensemble_report(model, name_features(test))
    model.write().overwrite().save(f"{path}/model")
    write_metrics(report.groupBy("roc_auc", "accuracy").agg(F.map_from_entries(F.collect_list(F.struct("feature", "importance"))).alias("importance")), f"{path}/metrics", run_stamp)
    return model, report


def epoch_losses(losses: DataFrame) -> DataFrame:
    """(epoch, mean_loss, best_loss) of a table of losses (epoch, loss): the mean of each epoch and the
    least up to it. One row an epoch goes through the window."""
    means = losses.groupBy("epoch").agg(F.avg("loss").alias("mean_loss"))
    upto = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return means.withColumn("best_loss", F.min("mean_loss").over(upto))


def best_losses(history: list[tuple[int, float, float]]) -> list[tuple[int, float, float, float]]:
    """(epoch, train loss, validation loss, best train loss so far)."""
    out, best = [], math.inf
    for epoch, loss, checked in history:
        best = min(best, loss)
        out.append((epoch, loss, checked, best))
    return out
