"""Row-wise Arrow passes: bounded slices in, the input's columns plus new ones out."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

#: Rows handled at once inside a worker, and sent to it at once: long texts and id arrays make wide rows.
SLICE = 256
BATCH_ROWS = 1024
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

_KEPT: list[tuple[object, object]] = []


def forget() -> None:
    """Drops what the worker keeps and hands freed memory back, for workers live on from operator to operator."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def kept_once(key: object, build: Callable[[], object]) -> object:
    """What `build` makes for `key`, kept by the worker for its next tasks until another operator runs."""
    if not _KEPT or _KEPT[0][0] != key:
        forget()
        _KEPT.append((key, build()))
    return _KEPT[0][1]


Added = Callable[[pa.RecordBatch], list[pa.Array]]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def small_batches(df: DataFrame) -> None:
    """Lowers the session's Arrow batch to BATCH_ROWS rows."""
    if not 0 < int(df.sparkSession.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_ROWS)


def add_columns(df: DataFrame, fields: list[StructField], make: Callable[[], Added], keep: list[str] | None = None, rows: int = SLICE) -> DataFrame:
    """`df` (or its columns `keep`) with `fields` computed by the function that `make` builds once per task, `rows` rows at once.

    Columns named like a field are replaced.
    """
    small_batches(df)
    names = {f.name for f in fields}
    places = [i for i, f in enumerate(df.schema.fields) if f.name not in names and (keep is None or f.name in keep)]
    kept = [df.schema.fields[i] for i in places]
    out = [f.name for f in kept] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = make()
        for part in slices(batches, rows):
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *added(part)], names=out)

    return df.mapInArrow(run, StructType([*kept, *fields]))


def texts(column: pa.Array) -> list[str]:
    """Python strings, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def id_lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """One list of int32 for each pair of neighbouring offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32, copy=False)))


def id_slices(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of an int32 list column as views; null as the empty list."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
