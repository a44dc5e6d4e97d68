"""Make Python UDF code available on executors without installing the package.

Functions from a module registered here are pickled by value (code and
globals), so executors only need pandas/pyarrow, not ``ferrule`` itself.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle

FEW_BYTES = 4_000_000


def ship_by_value(module_name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def few_bytes(batches: Iterable[pa.RecordBatch], most: int = FEW_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``most`` bytes at most, or into single rows."""
    for batch in batches:
        lo = 0
        while lo < batch.num_rows or not batch.num_rows:
            rows = batch.num_rows - lo
            while rows > 1 and batch.slice(lo, rows).nbytes > most:
                rows = -(-rows // 2)
            yield batch.slice(lo, rows)
            lo += rows
            if not batch.num_rows:
                break


ship_by_value(__name__)
