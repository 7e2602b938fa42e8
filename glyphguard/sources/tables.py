"""Reading and writing pair tables, vectors, metrics and trials."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRS = T.StructType([T.StructField("fraudulent_name", T.StringType()), T.StructField("real_name", T.StringType()), T.StructField("label", T.IntegerType())])
NAME_COLUMNS = ("fraudulent_name", "real_name")


def load_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A ``.csv`` path as CSV with a header (columns by ``schema``, else text), any other as Parquet."""
    if str(path).lower().endswith(".csv"):
        reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
        return (reader.schema(schema) if schema else reader).csv(str(path))
    return spark.read.parquet(str(path))


def save_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The reverse of ``load_table``."""
    if str(path).lower().endswith(".csv"):
        df.write.mode(mode).option("header", True).option("escape", '"').csv(str(path))
    else:
        df.write.mode(mode).parquet(str(path))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [c for c in names or NAME_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def canonical_columns(df: DataFrame) -> DataFrame:
    """``name1, name2`` renamed to ``fraudulent_name, real_name``; neither naming is an error."""
    if {"name1", "name2"} <= set(df.columns):
        df = df.withColumnsRenamed({"name1": "fraudulent_name", "name2": "real_name"})
    return require_columns(df, *NAME_COLUMNS, "label")


def typed_pairs(df: DataFrame) -> DataFrame:
    """Names as text, label as int by way of float; missing names stay null."""
    return df.withColumns({"fraudulent_name": F.col("fraudulent_name").cast("string"), "real_name": F.col("real_name").cast("string"), "label": F.col("label").cast("double").cast("int")})


def first_rows(df: DataFrame, n: int | None, order: str = "pair_id") -> DataFrame:
    """The first ``n`` rows in an explicit order; all of them without ``n``."""
    return df if n is None else df.orderBy(order).limit(n)


def wide_to_vectors(df: DataFrame, dim: int, prefixes=("fraud_emb_", "real_emb_"), names=("fraud_emb", "real_emb")) -> DataFrame:
    """Scalar columns gathered into array columns, by name prefix; without such names, by position
    after the three pair columns."""
    out, used = {}, set()
    for k, (prefix, name) in enumerate(zip(prefixes, names)):
        wanted = [f"{prefix}{i}" for i in range(dim)]
        if not set(wanted) <= set(df.columns):
            wanted = df.columns[3 + k * dim : 3 + (k + 1) * dim]
            if len(wanted) < dim:
                raise ValueError(f"no {dim} columns for {name}")
        out[name] = F.array(*[F.col(c).cast("float") for c in wanted])
        used |= set(wanted)
    return df.select(*[c for c in df.columns if c not in used], *[v.alias(k) for k, v in out.items()])


def vectors_to_wide(df: DataFrame, column: str, dim: int, prefix: str) -> DataFrame:
    """An array column spread into ``prefix``0 .. ``prefix``dim-1."""
    return df.select(*[c for c in df.columns if c != column], *[F.col(column)[i].alias(f"{prefix}{i}") for i in range(dim)])


def rename_columns(df: DataFrame, by_place: dict[int, str] | None = None, by_prefix: dict[str, str] | None = None) -> DataFrame:
    """Columns renamed by their place, or else by the first prefix of ``by_prefix`` that they begin with."""
    names = []
    for i, c in enumerate(df.columns):
        prefix = next((p for p in by_prefix or {} if c.startswith(p)), "")
        names.append((by_place or {}).get(i, (by_prefix or {}).get(prefix, "") + c[len(prefix) :]))
    return df.toDF(*names)


def concat_tables(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_metrics(metrics: DataFrame, path: str, run_stamp: str) -> None:
    """One JSON row a metrics record, with the run's stamp."""
    metrics.withColumn("run", F.lit(run_stamp)).write.mode("append").json(path)


def write_trials(trials: DataFrame, path: str) -> None:
    trials.write.mode("overwrite").option("header", True).csv(path)


def parse_thresholds(text: str | None) -> list[int]:
    """``"50,60,70"`` as numbers; the preset list without text. A bad format is an error."""
    if text is None:
        return [10, 30, 50, 60, 70, 80, 90]
    if not re.fullmatch(r"\s*\d+\s*(,\s*\d+\s*)*", text):
        raise ValueError(f"thresholds must be numbers with commas between: {text!r}")
    return [int(x) for x in text.split(",")]
