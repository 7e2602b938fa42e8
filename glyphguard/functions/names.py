"""Name normalisation and small labels."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trim_name(x: Column, strip_com: bool | Column = True) -> Column:
    """Leading dashes off, white space off both ends, then one ``.com`` at the end, in this order:
    ``" -a"`` keeps its dash."""
    bare = F.regexp_replace(F.regexp_replace(x, "^-+", ""), "(?U)^\\s+|\\s+$", "")
    flag = F.lit(strip_com) if isinstance(strip_com, bool) else strip_com
    return F.when(flag, F.regexp_replace(bare, "(?i)\\.com$", "")).otherwise(bare)


def nfc(df: DataFrame, column: str) -> DataFrame:
    """``column`` in composed form (NFC). Composition needs Python, so only distinct names outside
    ASCII go there, and come back by a join."""
    odd = df.select(F.col(column).alias("_raw")).filter(F.col("_raw").rlike("[^\\x00-\\x7f]")).distinct()

    def compose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(_nfc=[unicodedata.normalize("NFC", x) for x in p._raw])

    table = odd.mapInPandas(compose, "_raw string, _nfc string")
    out = df.join(table, df[column] == table._raw, "left")
    return out.select(*[F.coalesce("_nfc", F.col(column)).alias(c) if c == column else F.col(c) for c in df.columns])


def normalize_names(df: DataFrame, *columns: str, strip_com: bool = True) -> DataFrame:
    """NFC, then ``trim_name``, of each column; nulls stay null."""
    for c in columns:
        df = nfc(df, c).withColumn(c, trim_name(F.col(c), strip_com))
    return df


def detect_com_suffix(df: DataFrame, *columns: str, rows: int | None = None, order: str | None = None, force: bool = False, disable: bool = False) -> DataFrame:
    """One row ``strip_com``: whether any name ends in ``.com``. ``rows`` looks at so many only (the
    first by ``order``); ``force`` and ``disable`` decide without looking."""
    if force or disable:
        return df.sparkSession.range(1).select(F.lit(force and not disable).alias("strip_com"))
    if rows is not None:
        df = (df.orderBy(order) if order else df).limit(rows)
    ends = [F.coalesce(F.lower(F.rtrim(c)).endswith(".com"), F.lit(False)) for c in columns]
    return df.agg(F.coalesce(F.bool_or(F.greatest(*ends) if len(ends) > 1 else ends[0]), F.lit(False)).alias("strip_com"))


def strip_id_suffix(x: Column, suffix: str = ".png") -> Column:
    return F.regexp_replace(x, suffix.replace(".", "\\.") + "$", "")


def decision(similarity: Column, block: float = 0.90, review: float = 0.80) -> Column:
    return F.when(similarity >= block, "block").when(similarity >= review, "review").otherwise("allow")


def binarise(score: Column, threshold: float | Column, strict: bool = True) -> Column:
    """1 where the score is over the threshold (``strict``) or at least at it."""
    return (score > threshold if strict else score >= threshold).cast("int")


def error_type(label: Column, predicted: Column) -> Column:
    return F.when(label == predicted, "correct").when(label == 1, "false_negative").otherwise("false_positive")
