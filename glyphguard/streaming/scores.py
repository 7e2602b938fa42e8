"""Row-level scoring of a stream of pairs: the expressions are stateless, so a streaming DataFrame
goes through the same projection as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import decision
from ..functions.strings import scorer


def score_stream(pairs: DataFrame, score: str = "token-set") -> DataFrame:
    """``pairs`` plus similarity and decision; both null where a name is missing."""
    out = pairs.withColumn("similarity", scorer(score)(F.col("fraudulent_name"), F.col("real_name")))
    return out.withColumn("decision", F.when(F.col("similarity").isNotNull(), decision(F.col("similarity"))))
