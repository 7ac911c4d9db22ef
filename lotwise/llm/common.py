"""Helpers of the training-data operators: Arrow columns to numpy, and small table reads."""
import ctypes
import gc
import os
import sys
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import lotwise
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SHIPPED: set[str] = set()
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package (code only), once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(lotwise.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "lotwise_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def give_back() -> None:
    """Gives memory that a task has freed back to the system; a worker stays for later stages, whose tasks may run in others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
        if trim is not None:
            trim(0)


def arrow_map(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors, and batches that stay small where texts are long."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()
    return df.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which the cluster sets to fit its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column, one by one, None for null."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py()


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose text column holds about ``most_bytes`` each; a longer single text stands alone."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, ends = 0, np.cumsum(lengths)
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
