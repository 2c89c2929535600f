"""What the operators share: shipping the package, cutting lineage, Arrow batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from docstrand.llm.pieces import forget
from docstrand.operators.lineage import cut  # noqa: F401 - for the operators

#: Rows of an Arrow batch between Spark and Python. Spark's own 10,000 make batches of tens of MB where rows are texts,
#: and each task's executor holds several of them outside its heap.
BATCH_ROWS = "1000"
_BATCH, _SPARKS_OWN = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application, and the session smaller batches unless it has chosen some."""
    if spark.conf.get(_BATCH) == _SPARKS_OWN:
        spark.conf.set(_BATCH, BATCH_ROWS)
    sc = spark.sparkContext
    if getattr(sc, "_docstrand_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(), "docstrand_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("docstrand", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._docstrand_shipped = True


def parallelism(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def give_back() -> None:
    """Return freed memory to the system: a reused worker would keep what an earlier task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def pieces_of(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20, remember: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each are about `limit` bytes (one row at least). What tokenizers of
    earlier tasks remember in this worker is dropped unless the caller goes on with it."""
    if not remember:
        forget()
    give_back()
    yield from _cut_batches(batches, text, limit)
    give_back()


def _cut_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = batch.column(text)
        n = batch.num_rows
        if n == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i in range(n):
            total += int(sizes[i]) + 16
            if total >= limit:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < n:
            yield batch.slice(start, n - start)
