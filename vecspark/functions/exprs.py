"""Codec, wire and similarity operators as Column expressions.

They stay inside the optimizer's view and need no Python worker; the Arrow
operators in vecspark.operators.codec give the same values faster for large
dimensions.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values from here on round to infinity in half precision.
HALF_OVERFLOW = 65520.0


def matrix_literal(matrix: np.ndarray) -> Column:
    """A constant array<array<double>>."""
    return F.from_json(F.lit(json.dumps(matrix.tolist())), "array<array<double>>")


def vector_literal(values: Sequence[float], kind: str = "float") -> Column:
    return F.from_json(F.lit(json.dumps([float(x) for x in values])), "array<double>").cast(f"array<{kind}>")


def let(value: Column, body) -> Column:
    """Computes `value` once per row and hands it to `body`."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in order of the coordinates."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is zero or a value is not a number."""
    scale = norm(a) * norm(b)
    value = F.when(scale > 0, dot(a, b) / scale).otherwise(0.0)
    return F.when(F.isnan(value), 0.0).otherwise(value)


def cosine_floored(a: Column, b: Column, floor: float = 1e-12) -> Column:
    """Cosine with a floor under the product of norms, as quality metrics take it."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(floor))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def normalized(v: Column) -> Column:
    """Unit length; zero vectors stay."""
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(v.cast("array<float>")))


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def rotate(v: Column, matrix: Column) -> Column:
    """Matrix times vector, summed in double and rounded once to float."""
    return F.transform(matrix, lambda row: dot(row, v).cast("float"))


def quantize(v: Column, entries: Column) -> Column:
    """Index of the nearest entry; the greater of two equally near ones."""

    def nearest(x: Column) -> Column:
        last = F.size(entries) - 1
        above = F.least(F.size(F.filter(entries, lambda e: e < x)), last)
        below = F.greatest(above - 1, F.lit(0))
        nearer = F.abs(x - F.get(entries, below)) < F.abs(x - F.get(entries, above))
        return F.when(nearer, below).otherwise(above)

    return F.transform(v.cast("array<float>"), nearest)


def dequantize(indices: Column, entries: Column) -> Column:
    """Entries by index; an index beyond the codebook is an error."""
    return F.transform(indices, lambda i: F.element_at(entries, i + 1))


def half(x: Column) -> Column:
    """The nearest half-precision value, ties to even, as double."""
    size = F.abs(x.cast("double"))
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(-14)) - 10)
    rounded = F.rint(size / unit) * unit
    value = F.when(size == 0, 0.0).when(size >= HALF_OVERFLOW, float("inf")).otherwise(rounded)
    return F.when(x < 0, -value).otherwise(value)


def half_vector(v: Column) -> Column:
    return F.transform(v, lambda x: half(x).cast("float"))


def residual(rotated: Column, restored: Column) -> Column:
    """What quantization lost, in half precision."""
    return F.zip_with(rotated, restored, lambda a, b: half(a - b).cast("float"))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def pack(indices: Column, bit_width: int) -> Column:
    """Bytes (array<int>) of indices, the first in the lowest bits; absent ones are zero."""
    per = 8 // bit_width
    count = F.floor((F.size(indices) + F.lit(per - 1)) / per).cast("int")

    def byte(b: Column) -> Column:
        parts = [F.shiftleft(F.coalesce(F.get(indices, b * per + j), F.lit(0)), bit_width * j) for j in range(per)]
        total = parts[0]
        for part in parts[1:]:
            total = total.bitwiseOR(part)
        return total

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), byte)).otherwise(F.array().cast("array<int>"))


def unpack(packed: Column, bit_width: int, dimension: Column) -> Column:
    per = 8 // bit_width
    mask = (1 << bit_width) - 1
    shifted = lambda i: F.shiftright(F.get(packed, F.floor(i / per).cast("int")), 0)
    value = lambda i: F.floor(shifted(i) / F.pow(F.lit(2), (i % per) * bit_width)).cast("int").bitwiseAND(F.lit(mask))
    return F.transform(F.sequence(F.lit(0), dimension - 1), value)


def size_bytes(dimension: Column, bit_width: Column, residual_bytes: Column) -> Column:
    """Payload of a compressed vector: packed indices and residual."""
    return (F.ceil(dimension * bit_width / 8) + F.coalesce(residual_bytes, F.lit(0))).cast("bigint")


def byte_levels(v: Column) -> Column:
    """Per-vector least and greatest value and each coordinate's level 0..255 between, as a struct."""

    def levels(low: Column, high: Column) -> Column:
        span = F.when(high > low, high - low).otherwise(1.0)
        return F.transform(v, lambda x: F.rint((x.cast("double") - low) / span * 255).cast("int"))

    bounds = F.struct(F.array_min(v).cast("double").alias("low"), F.array_max(v).cast("double").alias("high"))
    return let(bounds, lambda b: F.struct(b["low"].alias("low"), b["high"].alias("high"), levels(b["low"], b["high"]).alias("levels")))


def from_byte_levels(coded: Column) -> Column:
    span = F.when(coded["high"] > coded["low"], coded["high"] - coded["low"]).otherwise(1.0)
    return F.transform(coded["levels"], lambda q: (coded["low"] + q / F.lit(255.0) * span).cast("float"))


def subvectors(v: Column, dimension: int, parts: int) -> Column:
    """`v` cut into `parts` equal pieces."""
    width = dimension // parts
    return F.array(*[F.slice(v, i * width + 1, width) for i in range(parts)])


def simulated_pq(v: Column, dimension: int, parts: int) -> Column:
    """Each piece through its own byte levels and back."""
    return F.flatten(F.transform(subvectors(v, dimension, parts), lambda piece: let(byte_levels(piece), from_byte_levels)))


def pgvector_text(v: Column) -> Column:
    """`[a,b,...]` with eight significant digits; values that are not finite are an error."""
    text = F.concat(F.lit("["), F.concat_ws(",", F.transform(v, lambda x: F.format_string("%.7e", x.cast("double")))), F.lit("]"))
    return F.when(finite(v), text).otherwise(F.raise_error(F.lit("NonFiniteValue: vector has a value that is not finite")))


def from_pgvector_text(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def csv_text(v: Column) -> Column:
    """Comma-separated with nine decimals."""
    return F.concat_ws(",", F.transform(v, lambda x: F.format_string("%.9f", x.cast("double"))))


def checked_dimension(v: Column, dimension: int) -> Column:
    """`v`, or an error if its length is another."""
    wrong = F.concat(F.lit(f"DimensionMismatch: {dimension} expected, got "), F.size(v).cast("string"))
    return F.when(F.size(v) == dimension, v).otherwise(F.raise_error(wrong))


def normalized_metadata(text: Column) -> Column:
    """Metadata JSON as a map of JSON values by name: objects as they are, anything else under `_value`."""
    as_map = F.from_json(text, "map<string,variant>")
    alone = F.create_map(F.lit("_value"), F.try_parse_json(text))
    return F.when(F.trim(text).startswith("{"), as_map).when(text.isNotNull(), alone)
