"""Tables in the cluster's shared folder, shipping of this package to executors, and their Python workers' memory."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

from ..scratch import Scratch as _Scratch

#: Rows of an Arrow batch that a function is given at once.
SLICE_ROWS = 1024


class Scratch(_Scratch):
    """Intermediate tables of one call, whose tasks can import this package."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, name)
        ship(spark)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that their Python workers can import it wherever it was installed on the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_gristmill_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    handle, at = tempfile.mkstemp(prefix="gristmill-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, p.relative_to(top.parent))
    sc.addPyFile(at)
    sc._gristmill_shipped = True


def _release() -> None:
    """Gives memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(Exception):  # not every C library has this function
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run):
    """``run``, for mapInArrow, with little memory beside its executor's heap.

    It gets batches in slices, so that what it makes of one is small, and after the last
    what it has freed goes back to the system: Spark keeps idle workers for later stages.
    """

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batch.slice(k, SLICE_ROWS) for batch in batches for k in range(0, batch.num_rows, SLICE_ROWS))
        finally:
            _release()

    return held
