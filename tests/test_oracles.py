"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from glyphguard.plans.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].values.tolist())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SMALL).toPandas()) == rows_of(duck.execute(SQL[name]).df())


def test_entry_works_without_the_training_data_operators(monkeypatch, spark):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(__spark_entry__)
    assert set(alone.queries()) == set(QUERIES) and set(alone.oracle_sql()) == set(SQL)
    assert alone.entry(spark).count() == 1
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_unit_vectors_of_odd_rows_equal_their_sql(spark, tmp_path):
    """Lengths of 0 and below 1e-12, and components that round to a negative zero."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [[0.0] * 3, [1e-20, 0.0, 0.0], [-1e-9, 1.0, -0.0], [float("nan"), 1.0, 2.0], [float("inf"), 1.0, -1.0], None, []]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))}), f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    found = {r.vec_id: str(r.unit) for r in QUERIES["l2_normalize"](spark, str(tmp_path)).collect()}
    assert found == {k: str(v) for k, v in duck.execute(SQL["l2_normalize"]).fetchall()}
