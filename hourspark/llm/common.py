"""What the operators of this subpackage share: word rules, bounded Arrow batches, written steps."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourspark.session import run_dir

# Words are runs of anything but space and \x09-\x0D; bytes.split() cuts at exactly these six.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
# Rows in an Arrow batch: texts may be long, and a batch is held whole by a Python worker.
BATCH_ROWS = 500


def raw_text(column: str | Column = "text") -> Column:
    """The UTF-8 bytes of a text; null stays null."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Python workers hold at most ``rows`` texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder.

    Lineage ends there: a lost executor costs the running step only.  Shuffle files of the steps behind
    it are given back, so that disk use follows the largest step and not their sum.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path  # for ``done_with``
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def done_with(*tables: DataFrame) -> None:
    """Delete tables of ``written`` whose readers have all been written themselves."""
    for table in tables:
        jvm, context = table.sparkSession._jvm, table.sparkSession._jsc
        path = jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def free_name(columns: list[str], wish: str) -> str:
    """``wish``, with underscores until it clashes with none of ``columns`` (case aside)."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def row_order(doc_id: str | Column = "doc_id") -> Column:
    """A never-null long that sorts as doc_id does, nulls last."""
    return F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(2**63 - 1)).cast("long")


def give_back() -> None:
    """Return a Python worker's freed memory to the system: many small native allocations else keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
