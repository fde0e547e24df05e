"""Steps that are to be bounded in memory or spread over tasks, whatever the tables' size."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from vecspark.operators import search


def _unit(rows):
    scale = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(scale > 0, scale, 1.0)


def _lists(values):
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def test_many_queries_take_no_matrix_of_all_scores():
    rng = np.random.default_rng(5)
    asked, stored = _unit(rng.standard_normal((4000, 64))), rng.standard_normal((9000, 64))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(9000)), _lists(stored)], names=["id", "v"])
    tracemalloc.start()
    (found,) = search._against_broadcast(10, False, SimpleNamespace(value=(np.arange(4000), asked)))(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 40_000
    assert peak < 80 << 20  # the scores alone are 288 MB


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("most", [1 << 20, 0])
def test_nearest_of_odd_rows_equal_brute_force(spark, monkeypatch, kind, most):
    rng = np.random.default_rng(6)
    values = rng.standard_normal((400, 8)).astype(np.float32)
    values[60:260] = values[7]  # a common vector
    values[[20, 33, 300]] = 0.0
    values[301, 2] = np.nan
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(rng.permutation(400), values, strict=True)] + [(400, None)], f"vec_id long, embedding array<{kind}>")
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in df.where("embedding IS NOT NULL").collect()}

    def cosine(a, b):
        dot = x = y = 0.0
        for p, q in zip(a, b, strict=True):
            dot, x, y = dot + p * q, x + p * p, y + q * q
        return max(-1.0, min(1.0, dot / np.sqrt(x * y))) if x > 0 and y > 0 else 0.0

    want = set()
    for q in range(0, 400, 3):
        near = sorted((-cosine(rows[q], v), i) for i, v in rows.items() if i != q)[:5]
        want |= {(q, rank + 1, i, round(-s, 12) + 0.0) for rank, (s, i) in enumerate(near)}
    monkeypatch.setattr(search, "QUERY_BYTES", most)
    monkeypatch.setattr(search, "SHARD_BYTES", 8 * 8 * 150)
    monkeypatch.setattr(search, "TASK_PAIRS", (5000, 1 << 20))
    got = search.top_k_many(df, df.where("vec_id % 3 = 0 AND vec_id < 400"), 5, exclude_self=True)
    assert {(a, b, c, round(s, 12) + 0.0) for a, b, c, s in got.collect()} == want


def test_pairs_are_spread_over_tasks():
    for n, asked in ((102_564, 102_564), (615_384, 30_770), (615_384, 615_384), (6_000_000, 6_000_000)):
        rows, queries = search._grid(n, asked, 64)
        assert rows * queries >= 15 and n / rows * 64 * 8 <= search.SHARD_BYTES
        assert (n / rows) * (asked / queries) <= search.TASK_PAIRS[1]
    assert search._grid(100, 100, 64) == (1, 1)


def test_rotation_in_batches_equals_the_expression_bit_for_bit(spark):
    from pyspark.sql import functions as F

    from vecspark.functions import exprs
    from vecspark.operators.codec import turned
    from vecspark.operators.rotation import rotation

    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 16)).astype(np.float32))]
    rows += [(300, None), (301, [1.0] * 15), (302, [1.0] * 15 + [None]), (303, [float("nan")] + [1.0] * 15), (304, [3e38] * 16), (305, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for m in (rotation(3, 16), rotation(3, 16).T):
        want = df.withColumn("want", exprs.rotate(F.col("embedding"), exprs.matrix_literal(m)))
        both = turned(want, m, out="got").select("vec_id", "want", "got").collect()
        assert len(both) == 306 and all(repr(r["want"]) == repr(r["got"]) for r in both)


def test_rotation_queries_run_in_batches(spark, sf_dir):
    from vecspark.plans import catalog

    for name, passes in (("rotate", 1), ("rotate_inverse_roundtrip", 2), ("quantize_bw4", 1)):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == passes, name


def test_pairs_of_parts_equal_the_join(spark, monkeypatch):
    from pyspark.sql import functions as F

    from vecspark.functions import exprs
    from vecspark.operators import metrics

    rng = np.random.default_rng(8)
    rows = [(i, v.tolist(), w.tolist()) for i, (v, w) in enumerate(rng.standard_normal((90, 2, 8)).astype(np.float32))]
    rows += [(90, None, [0.0] * 8), (92, [0.0] * 8, [float("nan")] * 8), (94, [1.0] * 7 + [None], [3e38] * 8), (94, [2.0] * 8, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vector array<float>")
    half = df.where("vec_id % 2 = 0")
    left, right = (half.select(*[F.col(c).alias(p + c) for c in half.columns]) for p in "ab")
    want = left.join(right, F.col("avec_id") < F.col("bvec_id")).select(
        "avec_id", "bvec_id", exprs.cosine(F.col("aembedding"), F.col("bembedding")), exprs.cosine(F.col("avector"), F.col("bvector"))
    )
    monkeypatch.setattr(metrics, "TASK_PAIRS", (150, 1 << 20))
    monkeypatch.setattr(metrics, "BLOCK", 3)
    got = metrics.pair_scores(df, stride=2)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.rdd.getNumPartitions() > 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert metrics.pair_scores(df.where("false")).count() == 0
