"""Simpler compression methods that quality reports compare with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.config import CodecConfig
from vecspark.functions import exprs
from vecspark.operators import metrics
from vecspark.operators.codebook import train
from vecspark.operators.codec import Codec, round_trip
from vecspark.operators.search import top_k_many

#: Pieces of the simulated product quantizer.
PQ_PARTS = 16


@dataclass(frozen=True)
class Baseline:
    method: str
    bytes_per_vector: float
    restore: Column


def baselines(dimension: int, vector: str = "embedding", parts: int = PQ_PARTS) -> list[Baseline]:
    v = F.col(vector)
    return [
        Baseline("fp32", 4.0 * dimension, v.cast("array<float>")),
        Baseline("fp16", 2.0 * dimension, exprs.half_vector(v)),
        Baseline("uint8", dimension + 8.0, exprs.let(exprs.byte_levels(v), exprs.from_byte_levels)),
        Baseline("pq", float(parts), exprs.simulated_pq(v, dimension, parts)),
    ]


def quality_report(df: DataFrame, dimension: int, k: int = 10, seed: int = 42, query_stride: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per method: bytes_per_vector, ratio, rho, recall_at_k, mse.

    Queries are the rows whose id is divisible by `query_stride`; their
    neighbours are searched in all rows, before and after compression, and
    rho correlates their scores with every other row.
    """
    rows = df.select(id_col, vector)
    is_query = F.col(id_col) % query_stride == 0
    queries, n = rows.where(is_query), rows.count()
    true = top_k_many(rows, queries, k, id_col, vector, exclude_self=True, n_rows=n).persist()
    reports: list[DataFrame] = []
    methods: list[tuple[str, int | None, bool | None, float, DataFrame]] = [
        (b.method, None, None, b.bytes_per_vector, rows.withColumn("vector", b.restore)) for b in baselines(dimension, vector)
    ]
    for bits in (2, 4, 8):
        codebook = train(rows, bits, vector)
        for residual in (False, True):
            codec = Codec(CodecConfig(bits, seed, dimension, residual), codebook)
            size = float(metrics.payload_bytes(dimension, bits, residual))
            methods.append((f"codec{bits}{'r' if residual else ''}", bits, residual, size, round_trip(rows, codec, vector)))
    for method, bits, residual, size, restored in methods:
        found = top_k_many(restored.select(id_col, F.col("vector").alias(vector)), queries, k, id_col, vector, exclude_self=True, n_rows=n)
        rho = metrics.query_correlation(restored, is_query, n, dimension, id_col, vector)
        reports.append(
            metrics.mean_squared_error(restored, vector).select(
                F.lit(method).alias("method"),
                F.lit(bits).cast("int").alias("bit_width"),
                F.lit(residual).cast("boolean").alias("residual"),
                F.lit(size).alias("bytes_per_vector"),
                F.lit(4.0 * dimension / size).alias("ratio"),
                rho.scalar().alias("rho"),
                metrics.recall(true, found, k).scalar().alias("recall_at_k"),
                "mse",
            )
        )
    report = reports[0]
    for other in reports[1:]:
        report = report.unionAll(other)
    return report
