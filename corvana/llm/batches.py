"""Arrow batches cut to bounded sizes for the Python kernels."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

MAX_BYTES = 4 << 20


def give_back() -> None:
    """Memory that the allocators hold but nothing uses goes back to the machine: workers live on after a task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def forget(spark: SparkSession) -> None:
    """Shuffle files of plans that nothing refers to any more are removed now, not when the driver next happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = MAX_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices of about max_bytes of the column, one row at least."""
    values, start, held = batch.column(column), 0, 0
    for i in range(batch.num_rows):
        value = values[i]
        n = value.as_buffer().size if value.is_valid else 0
        if held and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n + 64
    if start < batch.num_rows:
        yield batch.slice(start)


def mapper(kernel: Callable[[pa.RecordBatch], pa.RecordBatch], column: str, max_bytes: int = MAX_BYTES):
    """For mapInArrow: the kernel over bounded slices of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, max_bytes):
                done = kernel(part)
                yield done
                done = None
            batch = part = None  # else the next batch would come beside this one
            give_back()
        give_back()

    return run
