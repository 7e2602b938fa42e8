"""What the operators share: tables in the shared folder, bounded batches, size-checked broadcasts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import new_path

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not a glibc system
    _trim = None

#: Text bytes that a Python worker handles at once.
SLICE_BYTES = 4 << 20
#: A side is broadcast only when its table was counted and holds at most this many bytes.
BROADCAST_BYTES = 32 << 20


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._glyphguard_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table written by ``cut`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._glyphguard_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def if_small(cut_table: DataFrame, row_bytes: int, side: DataFrame | None = None) -> DataFrame:
    """Broadcast hint on ``side`` (default: the table) when the counted table is within
    BROADCAST_BYTES at ``row_bytes`` a row; otherwise unchanged, so Spark shuffles both sides."""
    side = cut_table if side is None else side
    return F.broadcast(side) if cut_table.count() * row_bytes <= BROADCAST_BYTES else side


def bounded_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with Arrow batches of the session held to ``rows`` rows: by default 10,000 long texts
    at a time are held off-heap in the JVM and again in each Python worker. The plan is run after this
    returns, so the session keeps the setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``max_bytes`` of text (one row may exceed it alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > max_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Return memory that a worker has freed to the system: workers stay alive between tasks and stages, and
    what one stage needed once would count against all later ones."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def ascii_lower(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
