"""Compression and decompression of vectors in Arrow batches.

One NumPy matrix product rotates a whole batch; the configuration, codebook
and rotation are built once and broadcast. A compressed vector is a struct
of its indices (a byte per coordinate), optional residual bytes, and what is
needed to check it against a configuration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from vecspark.config import CodecConfig
from vecspark.errors import (
    CodebookIncompatible,
    ConfigMismatch,
    DimensionMismatch,
    IndexOutOfRange,
    LengthMismatch,
)
from vecspark.operators.codebook import Codebook
from vecspark.operators.rotation import rotation

COMPRESSED = "struct<indices:binary,residual:binary,config_hash:string,dimension:int,bit_width:tinyint>"
POLICIES = ("compress", "passthrough", "fp16")

_COMPRESSED_ARROW = pa.struct(
    [("indices", pa.binary()), ("residual", pa.binary()), ("config_hash", pa.string()), ("dimension", pa.int32()), ("bit_width", pa.int8())]
)


def quantize(values: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Index of the nearest entry by float32 distance; the greater of two equally near ones."""
    above = np.minimum(np.searchsorted(entries, values), len(entries) - 1)
    below = np.maximum(above - 1, 0)
    return np.where(np.abs(values - entries[below]) < np.abs(values - entries[above]), below, above).astype(np.uint8)


def dequantize(indices: np.ndarray, entries: np.ndarray) -> np.ndarray:
    if indices.size and int(indices.max()) >= len(entries):
        raise IndexOutOfRange(f"index {int(indices.max())} is outside the {len(entries)} entries")
    return entries[indices]


@dataclass(frozen=True)
class Codec:
    """A configuration with its codebook and prepared rotation."""

    config: CodecConfig
    codebook: Codebook
    matrix: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        if self.codebook.bit_width != self.config.bit_width:
            raise CodebookIncompatible(f"codebook of {self.codebook.bit_width} bits for a codec of {self.config.bit_width}")
        object.__setattr__(self, "matrix", rotation(self.config.seed, self.config.dimension))

    def compress(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Indices, and residuals in half precision if the configuration keeps them."""
        if vectors.ndim != 2 or vectors.shape[1] != self.config.dimension:
            raise DimensionMismatch(f"{self.config.dimension} expected, got {vectors.shape[-1]}")
        rotated = (vectors.astype(np.float64) @ self.matrix.T).astype(np.float32)
        entries = self.codebook.array
        indices = quantize(rotated, entries)
        if not self.config.residual_enabled:
            return indices, None
        with np.errstate(over="ignore"):
            return indices, (rotated - entries[indices]).astype("<f2")

    def decompress(self, indices: np.ndarray, residuals: np.ndarray | None) -> np.ndarray:
        if indices.shape[1] != self.config.dimension:
            raise LengthMismatch(f"{self.config.dimension} indices expected, got {indices.shape[1]}")
        rotated = dequantize(indices, self.codebook.array)
        if residuals is not None:
            if residuals.shape != indices.shape:
                raise LengthMismatch("as many residuals as indices expected")
            rotated = rotated + residuals.astype(np.float32)
        return (rotated.astype(np.float64) @ self.matrix).astype(np.float32)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """The vectors of a list column as rows."""
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or (lengths != dimension).any():
        wrong = next((int(n) for n in lengths if n != dimension), "null")
        raise DimensionMismatch(f"{dimension} expected, got {wrong}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dimension)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows, np.float32).ravel()))


def _bytes(rows: np.ndarray) -> pa.Array:
    """One binary value per row."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(0, width * len(rows) + 1, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _rows(column: pa.Array, width: int, dtype: str) -> np.ndarray:
    """Binary values of `width` bytes each as rows of numbers."""
    values = column.to_pylist()
    if any(x is None or len(x) != width for x in values):
        raise LengthMismatch(f"{width} bytes expected")
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


def _pass(df: DataFrame, name: str, kind: str, convert: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """`df` with the column `name` set by `convert`, batch by batch."""
    kept = [f for f in df.schema.fields if f.name != name]
    schema = StructType([*kept, StructField(name, StructType.fromDDL(f"x {kind}")["x"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, convert(batch)], names=[*(f.name for f in kept), name])

    return df.mapInArrow(run, schema)


def _struct(indices: np.ndarray, residuals: np.ndarray | None, config_hash: str, bit_width: int) -> pa.Array:
    n = len(indices)
    parts = [
        _bytes(np.ascontiguousarray(indices)),
        pa.nulls(n, pa.binary()) if residuals is None else _bytes(np.ascontiguousarray(residuals)),
        pa.array([config_hash] * n),
        pa.array(np.full(n, indices.shape[1], np.int32)),
        pa.array(np.full(n, bit_width, np.int8)),
    ]
    return pa.StructArray.from_arrays(parts, fields=list(_COMPRESSED_ARROW))


def compress(df: DataFrame, codec: Codec, vector: str = "embedding", out: str = "compressed", policy: str = "compress") -> DataFrame:
    """Adds the compressed vectors. Policies other than `compress` store the values' bytes instead of indices."""
    if policy not in POLICIES:
        raise ValueError(f"policy {policy!r} is none of {POLICIES}")
    shipped = df.sparkSession.sparkContext.broadcast(codec)

    def convert(batch: pa.RecordBatch) -> pa.Array:
        own = shipped.value
        rows = _matrix(batch.column(vector), own.config.dimension)
        if policy == "compress":
            return _struct(*own.compress(rows), own.config.config_hash, own.config.bit_width)
        with np.errstate(over="ignore"):
            stored = rows.astype("<f4" if policy == "passthrough" else "<f2")
        return _struct(np.ascontiguousarray(stored).view(np.uint8), None, own.config.config_hash, 8)

    return _pass(df, out, COMPRESSED, convert)


def decompress(df: DataFrame, codec: Codec, compressed: str = "compressed", out: str = "vector", policy: str = "compress") -> DataFrame:
    """Adds the restored vectors; records of another configuration are an error."""
    shipped = df.sparkSession.sparkContext.broadcast(codec)

    def convert(batch: pa.RecordBatch) -> pa.Array:
        own, column = shipped.value, batch.column(compressed)
        config = own.config
        indices, residuals, hashes = (column.field(i) for i in range(3))
        if any(h != config.config_hash for h in hashes.to_pylist()):
            raise ConfigMismatch(f"a record's configuration is not {config.config_hash}")
        if policy != "compress":
            kind = "<f4" if policy == "passthrough" else "<f2"
            return _lists(_rows(indices, config.dimension * np.dtype(kind).itemsize, kind).astype(np.float32))
        kept = residuals.null_count == 0
        if not kept and residuals.null_count < len(residuals):
            raise LengthMismatch("some records have residuals and some have not")
        rows = _rows(indices, config.dimension, "u1")
        return _lists(own.decompress(rows, _rows(residuals, 2 * config.dimension, "<f2") if kept else None))

    return _pass(df, out, "array<float>", convert)


def split_rejects(df: DataFrame, dimension: int, vector: str = "embedding", id_col: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """Rows that can be compressed, and the others with the reason (id, error_class, detail)."""
    reason = (
        F.when(F.col(vector).isNull(), "DimensionMismatch")
        .when(F.size(vector) != dimension, "DimensionMismatch")
        .when(~F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), "NonFiniteValue")
    )
    marked = df.withColumn("_reason", reason)
    detail = F.concat(F.lit(f"{dimension} finite values expected, got "), F.coalesce(F.size(vector), F.lit(0)).cast("string"))
    rejects = marked.where("_reason IS NOT NULL").select(
        F.col(id_col).cast("string").alias("vec_id"), F.col("_reason").alias("error_class"), detail.alias("detail")
    )
    return marked.where("_reason IS NULL").drop("_reason"), rejects


def split_damaged(df: DataFrame, config: CodecConfig, compressed: str = "compressed", id_col: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """Records that `config` can restore, and the others with the reason, so that one bad record does not block the rest."""
    c = F.col(compressed)
    residual = 2 * config.dimension if config.residual_enabled else None
    right_residual = c["residual"].isNull() if residual is None else F.coalesce(F.length(c["residual"]) == residual, F.lit(False))
    reason = (
        F.when(c.isNull(), "LengthMismatch")
        .when(~c["config_hash"].eqNullSafe(config.config_hash), "ConfigMismatch")
        .when(~F.coalesce(F.length(c["indices"]) == config.dimension, F.lit(False)), "LengthMismatch")
        .when(~right_residual, "LengthMismatch")
    )
    marked = df.withColumn("_reason", reason)
    detail = F.concat(F.lit("indices and residual of "), F.coalesce(F.length(c["indices"]), F.lit(0)).cast("string"), F.lit(" and "), F.coalesce(F.length(c["residual"]), F.lit(0)).cast("string"), F.lit(" bytes"))
    rejects = marked.where("_reason IS NOT NULL").select(F.col(id_col).cast("string").alias("vec_id"), F.col("_reason").alias("error_class"), detail.alias("detail"))
    return marked.where("_reason IS NULL").drop("_reason"), rejects


def turned(df: DataFrame, matrix: np.ndarray, vector: str = "embedding", out: str = "rotated") -> DataFrame:
    """Adds matrix times vector, bit for bit as exprs.rotate: summed in double in order of the coordinates, rounded once to float.

    A vector that is null, holds a null or has another length gives nulls.
    """
    shipped = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix.T))

    def convert(batch: pa.RecordBatch) -> pa.Array:
        columns, column = shipped.value, batch.column(vector)
        n, (width, height) = len(column), columns.shape
        whole = column.is_valid().to_numpy(zero_copy_only=False) & (column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width)
        values = column.filter(pa.array(whole)).flatten()
        filled = np.zeros((n, width))
        filled[whole] = values.to_numpy(zero_copy_only=False).reshape(-1, width)
        if values.null_count:
            whole[whole] = values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width).all(axis=1)
        with np.errstate(all="ignore"):
            total = np.zeros((n, height))
            for j in range(width):
                total += filled[:, j, None] * columns[j]
            rows = np.ascontiguousarray(total, np.float32)
        offsets = pa.array(np.arange(0, rows.size + 1, height, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), mask=None if whole.all() else np.repeat(~whole, height)))

    return _pass(df, out, "array<float>", convert)


def round_trip(df: DataFrame, codec: Codec, vector: str = "embedding", out: str = "vector") -> DataFrame:
    """Compressed and restored in one pass, for quality measurements."""
    shipped = df.sparkSession.sparkContext.broadcast(codec)

    def convert(batch: pa.RecordBatch) -> pa.Array:
        own = shipped.value
        return _lists(own.decompress(*own.compress(_matrix(batch.column(vector), own.config.dimension))))

    return _pass(df, out, "array<float>", convert)
