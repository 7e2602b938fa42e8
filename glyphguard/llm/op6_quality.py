"""Quality classifier by co-training: one classifier sees the text's content, one the page's metadata;
over rounds each labels unlabelled documents it is sure of for the other; both are calibrated, and
their combined odds score every document.

The content view reads the words of the text. The metadata view reads what a crawler notes of a page
without reading it: source, language, and the page's form (length, lines, shares of digits, capitals,
marks and repeats), each figure as a range.

A view has two parts. Its tables hold, for each class, in how many documents each feature stands: exact
sums over all labelled documents and, from round to round, over all unlabelled ones that the other view
is sure of. Its logistic regression weighs what the tables say of a document and is fitted and
calibrated on a bounded sample of labelled documents, a documented parameter, chosen by hashes of ids so
that it does not depend on partitions; there, a document's own share is taken out of the tables. Features are computed once for training and kept as a table; sums are added up per task,
then by Spark, and have a fixed number of rows. Scoring is a per-row function of fixed weights.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop_cut, text_slices
from .shingles import words

#: Slots of the features: hashed words, sources and languages, and ranges of each figure of the form.
TEXT_BITS, SOURCES, LANGS = 13, 256, 64
N_SHAPE, RANGES = 16, 16
#: Figures of the form that are logarithms; the others are shares.
LOGS = [0, 6, 13]
#: Of a text's words' evidence, beside its mean, spread and number.
QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
N_TEXT = len(QUANTILES) + 3
#: Features that vary less than this are scaled as if they varied so much.
LEAST_SCALE = 0.05
SLOTS = {"text": 1 << TEXT_BITS, "meta": SOURCES + LANGS + N_SHAPE * RANGES}
HASHES = 1 << 40
#: Text bytes whose words are hashed at once.
SLICE = 1 << 20
ASCII_LETTERS = bytes(i for i in range(128) if chr(i).isalpha())
ASCII_UPPER, DIGITS, HIGH = bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(128, 256))


def shape(text: str) -> list[float]:
    """How a whole text is made: lengths, and shares of letters, marks, repeats and line ends. Letters
    are those of ASCII and all characters outside."""
    raw = text.encode("utf-8", "replace")
    size = len(raw)
    count = lambda some: size - len(raw.translate(None, some))
    found = text.split()
    n, chars = max(len(found), 1), max(len(text), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    ascii_size = size - count(HIGH)
    letters = count(ASCII_LETTERS) + len(text) - ascii_size
    counts = Counter(found)
    repeats = sum(map(str.__eq__, found, found[1:]))
    bare = count(b"|#$%&*")
    return [
        np.log1p(len(found)),
        letters / n / 10,
        1 - letters / max(chars - text.count(" ") - len(lines) + 1, 1),
        count(ASCII_UPPER) / max(letters, 1),
        count(DIGITS) / chars,
        min(1.0, bare / n),
        np.log1p(bare),
        text.count("|") / n,
        min(1.0, text.count("!") / n),
        len(counts) / n,
        repeats / n,
        max(counts.values(), default=0) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(chars / max(len(lines), 1)),
        sum(x.rstrip()[-1] in ".!?:\"')" for x in lines) / max(len(lines), 1),
        min(1.0, (text.count(".") + text.count(",")) / n),
    ]


def text_slots(texts: pa.Array) -> list[np.ndarray]:
    """Distinct hashed words of each text."""
    word, _, _, bounds = words(texts)
    slot = (word >> np.uint64(64 - TEXT_BITS)).astype(np.uint16)
    return [np.unique(slot[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


def form_slots(shapes: np.ndarray) -> np.ndarray:
    """A slot for the range that each figure of a page's form lies in: even steps of a logarithm, steps of
    a share that are finest near 0."""
    step = (RANGES - 0.001) * np.sqrt(np.clip(shapes, 0, 1))
    step[:, LOGS] = 1.2 * shapes[:, LOGS]
    return (SOURCES + LANGS + RANGES * np.arange(N_SHAPE) + np.clip(step, 0, RANGES - 1).astype(int)).astype(np.uint16)


def meta_slots(sources: list[str | None], langs: list[str | None], shapes: np.ndarray) -> list[np.ndarray]:
    """Slots of the source, the language and the form of each page; null is a value of its own."""
    place = lambda v, n: 0 if v is None else 1 + zlib.crc32(v.encode("utf-8", "replace")) % (n - 1)
    return [np.array([place(s, SOURCES), SOURCES + place(g, LANGS), *form], np.uint16) for s, g, form in zip(sources, langs, form_slots(shapes))]


def shapes_of(texts: list[str]) -> np.ndarray:
    return np.array([shape(t) for t in texts], np.float32).reshape(-1, N_SHAPE).astype(float)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Logistic:
    """Ridge logistic regression over standardised features, with a calibrated output."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        # What a document's own share changes in evidence that all have alike must not be magnified.
        mean, scale = x.mean(0), np.maximum(x.std(0), LEAST_SCALE)
        z = np.c_[np.ones(len(x)), (x - mean) / scale]
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(25):
            p = sigmoid(z @ w)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (p - y) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + (x - self.mean) / self.scale @ self.weights[1:]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt's slope and shift on labelled rows that were not fitted. Where these do not rise with
        the model's output, it says nothing: the odds are those of the rows."""
        if len(set(y.tolist())) == 2:
            fit = Logistic.fit(self.raw(x)[:, None], y, 0.1)
            if fit.weights[1] > 0:
                self.slope = float(fit.weights[1] / fit.scale[0])
                self.shift = float(fit.weights[0] - fit.weights[1] * fit.mean[0] / fit.scale[0])
            else:
                self.slope, self.shift = 0.0, float(np.log(y.mean() / (1 - y.mean())))

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log odds."""
        return np.clip(self.slope * self.raw(x) + self.shift, -12, 12)


class Tables:
    """In how many documents of each class (bad, good) each slot of a view stands, and their numbers."""

    def __init__(self, slots: int, counts: np.ndarray | None = None, n: np.ndarray | None = None):
        self.counts = np.zeros((2, slots)) if counts is None else counts
        self.n = np.zeros(2) if n is None else n

    def __add__(self, other: Tables) -> Tables:
        return Tables(self.counts.shape[1], self.counts + other.counts, self.n + other.n)

    def add(self, slots: np.ndarray, y: int) -> None:
        self.counts[y, slots] += 1
        self.n[y] += 1

    def evidence(self, slots: np.ndarray, own: float | None = None) -> np.ndarray:
        """Log odds of each slot for good; of a document that is in the tables with class ``own``,
        without its own share."""
        counts, n = self.counts[:, slots], self.n
        if own is not None:
            mine = np.array([own == 0, own == 1], float)
            counts, n = counts - mine[:, None], n - mine
        rate = (counts + 0.5) / (n + 1)[:, None]
        return np.log(rate[1] / rate[0])


def inputs(view: str, tables: Tables, slots: list[np.ndarray], own: np.ndarray | None = None) -> np.ndarray:
    """What a view's regression sees of documents: for metadata the evidence of each, for texts how the
    evidence of their words is spread, and how many there are."""
    out, every = [], tables.evidence(np.arange(tables.counts.shape[1]))
    for k, some in enumerate(slots):
        e = every[some] if own is None else tables.evidence(some, own[k])
        out.append(e if view == "meta" else [e.mean(), e.std(), *np.quantile(e, QUANTILES), np.log1p(len(e))] if len(e) else [0.0] * N_TEXT)
    return np.array(out, float).reshape(len(slots), 2 + N_SHAPE if view == "meta" else N_TEXT)


@dataclass
class CoTrained:
    """Two views; without two classes of labels, only the prior. ``received``: for each round the pseudo-
    labels (bad, good) that each view got from the other."""

    prior: float
    tables: dict[str, Tables] | None = None
    models: dict[str, Logistic] | None = None
    received: list[dict[str, list[int]]] = field(default_factory=list)
    both: Logistic | None = None

    def odds(self, slots: dict[str, list[np.ndarray]]) -> dict[str, np.ndarray]:
        return {v: m.odds(inputs(v, self.tables[v], slots[v])) for v, m in self.models.items()}

    def score(self, slots: dict[str, list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality: combined, by text, by metadata. The views' calibrated log odds are
        added with the weights that the calibration rows give them."""
        if self.models is None:
            flat = np.full(len(slots["text"]), self.prior)
            return flat, flat, flat
        odds = self.odds(slots)
        return sigmoid(self.both.raw(np.c_[odds["text"], odds["meta"]])), sigmoid(odds["text"]), sigmoid(odds["meta"])


@dataclass
class Sample:
    """Labelled documents for the regressions; a fifth is kept for calibration."""

    slots: dict[str, list[np.ndarray]]
    y: np.ndarray

    def fit(self, tables: dict[str, Tables]) -> CoTrained:
        y = self.y
        if not len(y) or len(set(y.tolist())) < 2:
            return CoTrained(float((y.sum() + 1) / (len(y) + 2)))
        held = np.arange(len(y)) % 5 == 0
        if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
            held = np.zeros(len(y), bool)
        check = held if held.any() else ~held
        models = {}
        for view, some in tables.items():
            x = inputs(view, some, self.slots[view], y)
            models[view] = Logistic.fit(x[~held], y[~held])
            models[view].calibrate(x[check], y[check])
        model = CoTrained(float(np.clip(y.mean(), 0.001, 0.999)), tables, models)
        odds = {v: m.odds(inputs(v, tables[v], self.slots[v], y)) for v, m in models.items()}
        model.both = Logistic.fit(np.c_[odds["text"], odds["meta"]][check], y[check])
        return model


COLUMNS = "doc_id long, text binary, meta binary"


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the slots of both views (16-bit numbers) of each row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text", SLICE):
                texts = batch.column("text")
                meta = meta_slots(batch.column("source").to_pylist(), batch.column("lang").to_pylist(), shapes_of([t.as_py() or "" for t in texts]))
                columns = [
                    batch.column("doc_id"),
                    pa.array([x.tobytes() for x in text_slots(texts)], pa.binary()),
                    pa.array([x.tobytes() for x in meta], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "meta"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_metadata(docs)).mapInArrow(read, COLUMNS)


def _metadata(docs: DataFrame) -> list:
    have = set(docs.columns)
    return [(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in ("source", "lang")]


def _unpacked(batch) -> dict[str, list[np.ndarray]]:
    """Slots of both views of a batch or table of feature rows."""
    return {v: [np.frombuffer(x, np.uint16) for x in batch.column(v).to_pylist()] for v in SLOTS}


def summed_tables(rows: DataFrame, model: CoTrained | None, sure: float) -> dict[str, Tables]:
    """Tables of both views over feature rows: by their labels y, or, with a model, by the other view's
    label where it is sure. Each task adds up its rows; Spark adds up the tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, given = {v: Tables(n) for v, n in SLOTS.items()}, {}
        for batch in batches:
            slots = _unpacked(batch)
            if shared.value is None:
                y = np.array(batch.column("y").to_pylist(), int)
                given = dict.fromkeys(SLOTS, (np.arange(len(y)), y))
            else:
                odds = shared.value.odds(slots)
                for view, other in (("text", "meta"), ("meta", "text")):
                    p = sigmoid(odds[other])
                    some = np.flatnonzero((p >= sure) | (p <= 1 - sure))
                    given[view] = some, (p[some] > 0.5).astype(int)
            for view, (places, y) in given.items():
                for i, label in zip(places.tolist(), y.tolist()):
                    own[view].add(slots[view][i], label)
        for view, t in own.items():
            # Slot -1 is the number of documents.
            y, slot = np.nonzero(np.c_[t.n, t.counts])
            yield pa.RecordBatch.from_arrays([pa.array([view] * len(y), pa.string()), pa.array(y, pa.int32()), pa.array(slot - 1, pa.int32()), pa.array(np.c_[t.n, t.counts][y, slot], pa.float64())], ["view", "y", "slot", "n"])

    out = {v: Tables(n) for v, n in SLOTS.items()}
    # Two classes of so many slots: a fixed number of rows.
    for r in rows.mapInArrow(read, "view string, y int, slot int, n double").groupBy("view", "y", "slot").agg(F.sum("n").alias("n")).collect():
        if r.slot < 0:
            out[r.view].n[r.y] = r["n"]
        else:
            out[r.view].counts[r.y, r.slot] = r["n"]
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, rounds: int = 2, sure: float = 0.97) -> CoTrained:
    """A model from ``docs`` (doc_id, text, and source and lang where there) and ``labels`` (doc_id,
    quality: 1 good, 0 bad; null rows are no labels, a document labelled twice counts as bad if any
    label does).

    All labelled documents fill the tables, in every round joined by all unlabelled documents on which a
    view's calibrated probability is ``sure`` either way, for the other view. Regressions are fitted on
    at most ``sample`` labelled documents, those with the smallest hashes of their ids. Rows without
    doc_id are unlabelled.
    """
    labels = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.min("quality") == 1).cast("int").alias("y"))
    found = features(docs)
    rows = cut(found.join(labels, F.col("doc_id") == F.col("_id"), "left").drop("_id"), "quality_features")
    labelled = rows.filter("y is not null")
    tables = summed_tables(labelled, None, sure)
    # The smallest hashes lie under this bound, which about 2 * sample rows meet: so few are ordered.
    order = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(HASHES))
    bound = min(HASHES, 2 * sample * HASHES // max(1, int(tables["text"].n.sum())) + 1)
    chosen = labelled.filter(order < bound).orderBy(order, "doc_id", "y", "text").limit(sample).toArrow()
    known = Sample(_unpacked(chosen), np.array(chosen.column("y").to_pylist(), float))
    model = known.fit(tables)
    for _ in range(rounds if model.models else 0):
        given, received = summed_tables(rows.filter("y is null"), model, sure), model.received
        model = known.fit({v: tables[v] + given[v] for v in SLOTS})
        model.received = [*received, {v: given[v].n.astype(int).tolist() for v in SLOTS}]
    drop_cut(rows)
    return model


def classify(docs: DataFrame, model: CoTrained, least: float = 0.5) -> DataFrame:
    """``docs`` plus quality_score, text_score, meta_score (probabilities of good quality) and
    accepted (quality_score of ``least`` or more).

    A null or empty text has scores 0 and is rejected; null or missing metadata are features of their
    own. Repeated rows and ties score alike. Input columns of the four names are replaced.
    """
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast(model)
    new = ("quality_score", "text_score", "meta_score", "accepted")

    @F.arrow_udf("struct<quality_score:double,text_score:double,meta_score:double,accepted:boolean>")
    def scored(texts: pa.Array, sources: pa.Array, langs: pa.Array) -> pa.Array:
        parts = []
        batch = pa.RecordBatch.from_arrays([texts, sources, langs], ["text", "source", "lang"])
        for part in text_slices(batch, "text", SLICE):
            plain = [t.as_py() or "" for t in part.column("text")]
            slots = {"text": text_slots(part.column("text")), "meta": meta_slots(part.column("source").to_pylist(), part.column("lang").to_pylist(), shapes_of(plain))}
            some = np.array([bool(t) for t in plain], bool)
            parts.append([np.where(some, x, 0.0) for x in shared.value.score(slots)])
        found = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0)] * 3
        filled = np.array([len(t.as_py() or "") > 0 for t in texts], bool)
        return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in found] + [pa.array(filled & (found[0] >= least))], new)

    kept = [c for c in docs.columns if c not in new]
    # Not to be evaluated twice where a filter on the result is pushed down.
    return docs.select(*kept, scored.asNondeterministic()("text", *_metadata(docs)).alias("_view")).select(*kept, *[f"_view.{c}" for c in new])


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, quality_score, text_score, meta_score, accepted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select("doc_id", "quality_score", "text_score", "meta_score", "accepted")
