"""Scalar codebooks: exact quantiles of all coordinates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.config import BIT_WIDTHS
from vecspark.errors import (
    CodebookDuplicate,
    CodebookEntryCount,
    CodebookNotSorted,
    InsufficientTrainingData,
    NonFiniteValue,
    UnsupportedBitWidth,
)


@dataclass(frozen=True)
class Codebook:
    """Strictly ascending entries, two to the power of the bit width."""

    bit_width: int
    entries: tuple[float, ...]

    def __post_init__(self) -> None:
        if self.bit_width not in BIT_WIDTHS:
            raise UnsupportedBitWidth(f"bit width {self.bit_width} is none of {BIT_WIDTHS}")
        values = self.array
        if len(values) != 1 << self.bit_width:
            raise CodebookEntryCount(f"{1 << self.bit_width} entries expected, {len(values)} given")
        if np.isnan(values).any() or (np.diff(values) < 0).any():
            raise CodebookNotSorted("entries must ascend")
        if (np.diff(values) == 0).any():
            raise CodebookDuplicate("entries must differ")

    @property
    def array(self) -> np.ndarray:
        return np.array(self.entries, np.float32)


def fractions(bit_width: int) -> list[float]:
    """The quantiles that become entries: from the least to the greatest value, evenly."""
    n = 1 << bit_width
    return [k / (n - 1) for k in range(n)]


def from_quantiles(bit_width: int, values: np.ndarray) -> Codebook:
    entries = np.sort(values.astype(np.float32))
    if len(np.unique(entries)) < len(entries):
        raise InsufficientTrainingData(f"the data gives fewer than {len(entries)} distinct entries")
    return Codebook(bit_width, tuple(entries.tolist()))


def quantile_column(values: Column, bit_width: int) -> Column:
    """All quantiles as one lazy aggregate over scalar `values`: array<float>, ascending."""
    exact = F.percentile(values.cast("double"), F.array(*map(F.lit, fractions(bit_width))))
    return F.transform(exact, lambda x: x.cast("float"))


#: Bits of a value's key that one pass tells apart.
DIGITS = {np.dtype(np.float32): (16, 8, 8), np.dtype(np.float64): (16, 12, 12, 12, 12)}


def _keys(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the values; both zeros are one."""
    bits = (values + values.dtype.type(0)).view(f"u{values.itemsize}")
    top = bits.dtype.type(1 << (8 * values.itemsize - 1))
    return np.where(bits & top, ~bits, bits | top)


def _values(keys: np.ndarray, kind: np.dtype) -> np.ndarray:
    keys = keys.astype(f"u{kind.itemsize}")
    top = keys.dtype.type(1 << (8 * kind.itemsize - 1))
    return np.where(keys & top, keys ^ top, ~keys).view(kind)


def _histogram(kind: np.dtype, prefixes: np.ndarray | None, known: int, digit: int):
    """Counts (code, n) of the next `digit` bits of the keys that begin with one of the sorted `prefixes` of `known` bits; code -1: not finite."""
    bits = 8 * kind.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((1 if prefixes is None else len(prefixes)) << digit, np.int64)
        broken = 0
        for batch in batches:
            values = batch.column(0).flatten().drop_null().to_numpy(zero_copy_only=False).astype(kind, copy=False)
            finite = np.isfinite(values)
            broken += len(values) - int(np.count_nonzero(finite))
            keys = _keys(values if finite.all() else values[finite]).astype(np.uint64)
            place = (keys >> np.uint64(bits - known - digit)) & np.uint64((1 << digit) - 1)
            if prefixes is not None:
                head = keys >> np.uint64(bits - known)
                at = np.minimum(np.searchsorted(prefixes, head), len(prefixes) - 1)
                wanted = prefixes[at] == head
                place = (at[wanted].astype(np.uint64) << np.uint64(digit)) | place[wanted]
            counts += np.bincount(place.astype(np.int64), minlength=len(counts))
        codes = np.flatnonzero(counts)
        if broken:
            codes, n = np.append(codes, -1), np.append(counts[codes], broken)
        else:
            n = counts[codes]
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])

    return run


def train(df: DataFrame, bit_width: int, vector: str = "embedding") -> Codebook:
    """Exact quantiles by rank, digit by digit: no value is shuffled or sorted.

    A pass counts the values by the next bits of an order-preserving key,
    among those whose earlier bits a wanted rank has, so that three scans of
    single-precision vectors (five of double precision) find the values at all
    ranks. Only counts move: at most two to the power of 17 numbers a task.
    """
    kind = np.dtype(np.float64 if df.schema[vector].dataType.elementType.typeName() == "double" else np.float32)
    vectors = df.select(vector).where(F.col(vector).isNotNull())
    prefixes: np.ndarray | None = None
    ranks = prefix_of = before = None
    known = 0
    for digit in DIGITS[kind]:
        found = vectors.mapInArrow(_histogram(kind, prefixes, known, digit), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
        codes, n = found["code"].to_numpy(), found["n"].to_numpy()
        if (codes < 0).any():
            raise NonFiniteValue("training values must be finite")
        order = np.argsort(codes)
        codes, n = codes[order], n[order]
        upto = np.cumsum(n)
        if ranks is None:
            if not len(n):
                raise InsufficientTrainingData("no values")
            total = int(upto[-1])
            places = np.array(fractions(bit_width)) * (total - 1)
            ranks = np.unique(np.concatenate([np.floor(places), np.ceil(places)]).astype(np.int64))
            prefix_of, before = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            first = np.zeros(1, np.int64)
        else:
            first = np.concatenate([[0], upto])[np.searchsorted(codes, np.arange(len(prefixes)) << digit)]
        # Where each rank falls among the codes of its prefix.
        at = np.searchsorted(upto, first[prefix_of] + ranks - before, side="right")
        before += upto[at] - n[at] - first[prefix_of]
        heads = codes[at].astype(np.uint64) & np.uint64((1 << digit) - 1)
        if prefixes is not None:
            heads |= prefixes[prefix_of] << np.uint64(digit)
        known += digit
        prefixes, prefix_of = np.unique(heads, return_inverse=True)
    values = _values(prefixes[prefix_of], kind).astype(np.float64)
    low, high = (values[np.searchsorted(ranks, x(places).astype(np.int64))] for x in (np.floor, np.ceil))
    return from_quantiles(bit_width, low + (high - low) * (places - np.floor(places)))


def train_rotated(df: DataFrame, bit_width: int, seed: int, vector: str = "embedding") -> Codebook:
    """Exact quantiles of the turned coordinates, which are what is quantized; an extension, for `train` sees the original ones."""
    from vecspark.functions.exprs import matrix_literal, rotate
    from vecspark.operators.rotation import rotation

    first = df.select(F.size(vector).alias("n")).first()
    if first is None:
        raise InsufficientTrainingData("no values")
    turned = rotate(F.col(vector), matrix_literal(rotation(seed, first["n"])))
    return train(df.select(turned.alias(vector)), bit_width, vector)


def train_approximate(df: DataFrame, bit_width: int, vector: str = "embedding", accuracy: int = 100_000) -> Codebook:
    """Quantiles by a mergeable sketch in one pass; an extension for tables whose exact sort is too dear."""
    values = df.select(F.explode(vector).alias("v"))
    row = values.agg(F.percentile_approx(F.col("v").cast("double"), fractions(bit_width), accuracy).alias("q")).first()
    return from_quantiles(bit_width, np.array(row["q"]))
