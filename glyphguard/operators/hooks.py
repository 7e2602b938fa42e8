"""Pluggable encoders and extractors, run once per distinct value."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import tasks
from .tables import attach_vectors, unique_names

Encoder = Callable[[list[str]], np.ndarray]


class HashedNgramEncoder:
    """Unit vectors of character 3- to 5-grams hashed to ``dim`` signed slots: no model, no download."""

    def __init__(self, dim: int = 64, low: int = 3, high: int = 5):
        self.dim, self.low, self.high = dim, low, high

    def __call__(self, names: list[str]) -> np.ndarray:
        out = np.zeros((len(names), self.dim))
        for row, name in zip(out, names):
            text = f"^{name.lower()}$"
            for n in range(self.low, self.high + 1):
                for i in range(len(text) - n + 1):
                    h = zlib.crc32(text[i : i + n].encode("utf-8", "replace"))
                    row[(h >> 1) % self.dim] += 1 if h & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encode_names(names: DataFrame, make_encoder: Callable[[], Encoder], batch: int = 1024) -> DataFrame:
    """(name, embedding) for a table of distinct names; the encoder is built once a task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for p in parts:
            for at in range(0, len(p), batch):
                some = p.iloc[at : at + batch]
                vectors = np.asarray(encoder(some.name.tolist()), dtype=np.float32)
                yield pd.DataFrame({"name": some.name.to_numpy(), "embedding": list(vectors)})

    # Names are small and dear: Spark would fold them into a few tasks.
    return names.select("name").repartition(tasks(names)).mapInPandas(run, "name string, embedding array<float>")


def embed_names(pairs: DataFrame, make_encoder: Callable[[], Encoder], batch: int = 1024) -> DataFrame:
    """fraud_emb and real_emb of each pair; every distinct name is encoded once."""
    return attach_vectors(pairs, encode_names(unique_names(pairs), make_encoder, batch))


def extract_texts(items: DataFrame, make_extractor: Callable[[], Callable[[list[str]], list[str]]], column: str, batch: int = 256) -> DataFrame:
    """(value, extracted) for the distinct values of a column, by a pluggable extractor."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = make_extractor()
        for p in parts:
            for at in range(0, len(p), batch):
                some = p.value.iloc[at : at + batch].tolist()
                yield pd.DataFrame({"value": some, "extracted": extractor(some)})

    distinct = items.select(F.col(column).alias("value")).filter("value is not null").distinct()
    return distinct.mapInPandas(run, "value string, extracted string")
