"""SQL functions of the engine, registered on a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from vecspark.operators import wire

_SQL = {
    "vq_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (t, x) -> t + x)",
    "vq_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": (
        "coalesce(nanvl(try_divide(vq_dot(a, b), sqrt(vq_dot(a, a)) * sqrt(vq_dot(b, b))), 0D), 0D)"
    ),
    "vq_rotate(m ARRAY<ARRAY<DOUBLE>>, v ARRAY<DOUBLE>) RETURNS ARRAY<FLOAT>": (
        "transform(m, w -> cast(aggregate(zip_with(w, v, (x, y) -> x * y), 0D, (t, x) -> t + x) AS FLOAT))"
    ),
    "vq_quantize(v ARRAY<FLOAT>, e ARRAY<FLOAT>) RETURNS ARRAY<INT>": (
        "transform(transform(v, x -> struct(x AS x, least(size(filter(e, y -> y < x)), size(e) - 1) AS i)), "
        "p -> if(abs(p.x - get(e, greatest(p.i - 1, 0))) < abs(p.x - get(e, p.i)), greatest(p.i - 1, 0), p.i))"
    ),
    "vq_dequantize(q ARRAY<INT>, e ARRAY<FLOAT>) RETURNS ARRAY<FLOAT>": "transform(q, i -> element_at(e, i + 1))",
}


@udtf(returnType="number int, config_hash string, dimension int, bit_width int, indices binary, residual binary")
class ParseRecords:
    """All records of a binary value, a row each."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        for number, r in enumerate(wire.records(data or b"")):
            yield number, r.config_hash, r.dimension, r.bit_width, r.indices, r.residual


def register(spark: SparkSession) -> None:
    """Adds vq_dot, vq_cosine, vq_rotate, vq_quantize, vq_dequantize and the table function vq_parse_records."""
    for signature, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udtf.register("vq_parse_records", ParseRecords)
