from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark import errors
from vecspark.config import CodecConfig
from vecspark.operators.baselines import quality_report
from vecspark.operators.codebook import train
from vecspark.operators.corpus import Corpus
from vecspark.operators.metrics import compression_ratio, correlation, query_correlation
from vecspark.operators.search import SearchIndex, top_k, top_k_many

DIMENSION = 16


@pytest.fixture(scope="module")
def rows(spark):
    values = np.random.default_rng(5).standard_normal((60, DIMENSION)).astype(np.float32)
    return spark.createDataFrame([(f"v{i:02d}", v.tolist(), i) for i, v in enumerate(values)], "vec_id string, vector array<float>, ordinal long").cache()


@pytest.fixture(scope="module")
def book(rows):
    return train(rows, 4, "vector")


def make(spark, book, policy="compress"):
    ticks = iter(range(1_000_000_000, 10**12, 1_000_000))
    return Corpus.create(spark, "c", CodecConfig(4, 42, DIMENSION, False), book, policy, clock=lambda: next(ticks))


@pytest.mark.parametrize("policy", ["compress", "passthrough", "fp16"])
def test_single_inserts_make_an_event_each(spark, rows, book, policy):
    corpus = make(spark, book, policy)
    for row in rows.where("ordinal < 3").orderBy("ordinal").collect():
        corpus = corpus.insert(row["vec_id"], row["vector"])
    assert [e.type for e in corpus.events] == ["created", "inserted", "inserted", "inserted"]
    assert corpus.count() == 3 and corpus.contains("v01") and not corpus.contains("v09")
    limit = {"compress": 1.5, "passthrough": 0.0, "fp16": 2e-3}[policy]
    assert np.abs(np.array(corpus.decompress("v00")) - np.array(rows.where("ordinal = 0").first()["vector"])).max() <= limit


def test_batches_are_atomic(spark, rows, book):
    corpus = make(spark, book).insert_batch(rows.where("ordinal < 5"))
    assert [(e.type, e.count) for e in corpus.events] == [("created", 0), ("inserted", 5)]
    assert corpus.events[1].vector_ids == ("v00", "v01", "v02", "v03", "v04")
    assert [r["vec_id"] for r in corpus.ids().collect()] == ["v00", "v01", "v02", "v03", "v04"]
    assert corpus.insert_batch(rows.where("false")) is corpus
    with pytest.raises(errors.BatchFailure) as failure:
        corpus.insert_batch(rows.where("ordinal between 3 and 8"))
    assert (failure.value.ordinal, failure.value.error_class) == (3, "DuplicateVector")
    short = rows.where("ordinal between 10 and 12").withColumn("vector", F.when(F.col("ordinal") == 11, F.slice("vector", 1, 3)).otherwise(F.col("vector")))
    with pytest.raises(errors.BatchFailure) as failure:
        corpus.insert_batch(short)
    assert (failure.value.ordinal, failure.value.error_class) == (11, "DimensionMismatch")
    twice = rows.where("ordinal = 20").unionAll(rows.where("ordinal = 20").withColumn("ordinal", F.lit(21).cast("long")))
    with pytest.raises(errors.BatchFailure):
        corpus.insert_batch(twice)
    assert corpus.count() == 5
    kept, rejects = corpus.insert_permissive(short)
    assert kept.count() == 7 and [(r["vec_id"], r["error_class"]) for r in rejects.collect()] == [("v11", "DimensionMismatch")]
    assert kept.events[-1].type == "violation"


def test_lifecycle(spark, rows, book, tmp_path):
    corpus = make(spark, book).insert_batch(rows.where("ordinal < 6"))
    corpus, restored = corpus.decompress_all()
    assert [r["vec_id"] for r in restored.collect()] == [f"v{i:02d}" for i in range(6)]
    assert (corpus.events[-1].type, corpus.events[-1].count) == ("decompressed", 6)
    fewer = corpus.remove("v03")
    assert not fewer.contains("v03") and corpus.contains("v03")
    with pytest.raises(errors.UnknownVector):
        fewer.remove("v03")
    with pytest.raises(errors.UnknownVector):
        fewer.get("nothing")
    assert fewer.remove_all(spark.createDataFrame([("v00",), ("zz",)], "vec_id string")).count() == 4
    drained, events = corpus.drain()
    assert len(events) == 3 and drained.events == () and corpus.events_frame().count() == 3
    assert json.loads(events[1].to_json("compress")) | {"timestampMillis": 0} == {
        "type": "VectorsInserted",
        "corpusId": "c",
        "vectorIds": [f"v{i:02d}" for i in range(6)],
        "count": 6,
        "timestampMillis": 0,
    }
    empty, none = make(spark, book).decompress_all()
    assert none.count() == 0 and [e.type for e in empty.events] == ["created"]
    assert corpus.save(str(tmp_path)).count() == 6


def test_metadata_is_normalized(spark, rows, book):
    corpus = make(spark, book).insert("a", [0.0] * DIMENSION, '{"x": 1, "y": [true]}').insert("b", [1.0] * DIMENSION, "7").insert("c", [1.0] * DIMENSION)
    got = {r["vec_id"]: r for r in corpus.entries.select("vec_id", F.map_keys("metadata").alias("k")).collect()}
    assert sorted(got["a"]["k"]) == ["x", "y"] and got["b"]["k"] == ["_value"] and got["c"]["k"] is None


def test_foreign_records_are_refused(spark, rows, book):
    from vecspark.operators.codec import Codec, compress

    other = compress(rows, Codec(CodecConfig(4, 7, DIMENSION, False), book), "vector").withColumnRenamed("ordinal", "insert_seq")
    with pytest.raises(errors.ConfigMismatch):
        make(spark, book).append_compressed(other)
    own = compress(rows, Codec(CodecConfig(4, 42, DIMENSION, False), book), "vector").withColumnRenamed("ordinal", "insert_seq")
    assert make(spark, book).append_compressed(own).count() == 60


def test_search_orders_by_score_then_id(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = top_k(rows, [1.0, 0.0], 3).collect()
    assert [(r["vec_id"], round(r["score"], 6)) for r in got] == [(1, 1.0), (3, 1.0), (2, 0.0)]
    many = top_k_many(rows, rows.where("vec_id < 3"), 2, exclude_self=True).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in many] == [(1, 3), (1, 2), (2, 1), (2, 3)]
    with pytest.raises(errors.InvalidTopK):
        top_k(rows, [1.0, 0.0], 0)


def test_single_query_plan_keeps_k_rows_per_task(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label = 3")
    plan = top_k(rows, [0.1] * 64, 5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan


def test_many_queries_over_shards_equal_a_broadcast(spark, sf_dir, monkeypatch):
    from vecspark.operators import search

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = rows.where("vec_id % 50 = 0")
    key = lambda df: sorted((a, b, c, round(s, 12)) for a, b, c, s in df.collect())
    for exclude_self in (False, True):
        monkeypatch.setattr(search, "QUERY_BYTES", 32 << 20)
        whole = key(top_k_many(rows, asked, 5, exclude_self=exclude_self))
        assert len(whole) == 50
        monkeypatch.setattr(search, "QUERY_BYTES", 2000)
        monkeypatch.setattr(search, "SHARD_BYTES", 40_000)
        assert whole == key(top_k_many(rows, asked, 5, exclude_self=exclude_self))
    assert top_k_many(rows, asked.where("false"), 5).count() == 0
    with pytest.raises(errors.DimensionMismatch):
        top_k_many(rows, spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"), 5)


def test_index_upserts_and_removes(spark):
    first = spark.createDataFrame([("a", [1.0, 0.0], 0), ("b", [0.0, 1.0], 1)], "vec_id string, vector array<float>, insert_seq long")
    index = SearchIndex().ingest(first)
    second = spark.createDataFrame([("b", [1.0, 0.1], 0), ("c", [1.0, 1.0], 1)], "vec_id string, vector array<float>, insert_seq long")
    newer = index.ingest(second)
    assert index.count() == 2 and newer.count() == 3
    assert {r["vec_id"]: r["insert_seq"] for r in newer.rows.collect()} == {"a": 0, "b": 1, "c": 3}
    assert [r["vec_id"] for r in newer.search([1.0, 0.0], 2).collect()] == ["a", "b"]
    assert newer.remove(spark.createDataFrame([("a",), ("x",)], "vec_id string")).count() == 2
    with pytest.raises(errors.DimensionMismatch):
        newer.ingest(spark.createDataFrame([("d", [1.0, 0.0], 0), ("e", [1.0], 1)], "vec_id string, vector array<float>, insert_seq long"))
    with pytest.raises(errors.DimensionMismatch):
        newer.search([1.0], 1)
    assert newer.clear().count() == 0


def test_correlation_is_total(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "x double, y double")
    assert df.agg(correlation(F.col("x"), F.col("y"))).first()[0] == 0.0
    assert df.where("x < 0").agg(correlation(F.col("x"), F.col("y"))).first()[0] == 0.0
    assert df.agg(correlation(F.col("x"), F.col("x") * -2)).first()[0] == pytest.approx(-1.0)


def test_quality_gates(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = {r["method"]: r for r in quality_report(rows, 64).collect()}
    assert got["codec4r"]["rho"] >= 0.995 and got["codec2r"]["rho"] >= 0.95 and got["codec4r"]["recall_at_k"] >= 0.8
    assert got["codec4"]["ratio"] >= 7.0 and got["codec4r"]["ratio"] >= 1.5
    assert got["codec4r"]["rho"] >= got["codec4"]["rho"] and got["codec8"]["mse"] < got["codec4"]["mse"] < got["codec2"]["mse"]
    assert got["fp32"]["recall_at_k"] == 1.0 and got["fp16"]["rho"] > 0.9999
    assert compression_ratio(64, 4, True) == pytest.approx(1.6)


def test_correlation_sees_every_row(spark, monkeypatch):
    rng = np.random.default_rng(8)
    before = rng.standard_normal((90, 8))
    after = before + rng.standard_normal((90, 8)) * (np.arange(90) % 20 != 0)[:, None]  # the queries themselves are restored exactly
    before[41] = after[43] = 0.0
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(before, after, strict=True))]
    df = spark.createDataFrame([*rows, (90, None, None)], "vec_id long, embedding array<double>, vector array<double>")
    monkeypatch.setattr("vecspark.operators.metrics.BLOCK", 2)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    x, y = (unit(m)[::20] @ unit(m).T for m in (before, after))
    others = np.arange(90) != np.arange(0, 90, 20)[:, None]
    want = np.corrcoef(x[others], y[others])[0, 1]
    assert want < 0.95
    assert query_correlation(df, F.col("vec_id") % 20 == 0, 91, 8).first()["rho"] == pytest.approx(want, abs=1e-12)
    assert query_correlation(df.where("false"), F.col("vec_id") % 20 == 0, 0, 8).first()["rho"] == 0.0


def test_report_correlates_every_row(spark):
    rng = np.random.default_rng(9)
    values = rng.standard_normal((600, 64)).astype(np.float32)
    for i in (0, 200, 400):
        values[i] = np.where(rng.random(64) < 0.5, -1.0 - i / 1000, 1.0 + i / 1000)  # two levels are restored exactly
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<float>")
    report = quality_report(df, 64, query_stride=200).where("method IN ('fp32', 'uint8')").select("method", "rho")
    rho = {r["method"]: r["rho"] for r in report.collect()}
    assert rho["fp32"] == pytest.approx(1.0, abs=1e-12) and 0.99 < rho["uint8"] < 1.0 - 1e-7


def test_an_event_lists_all_ids(spark, book):
    n = 100_001
    rows = spark.range(n).selectExpr("concat('v', id) AS vec_id", "id AS ordinal").withColumn("vector", F.array_repeat(F.lit(0.5).cast("float"), DIMENSION))
    corpus = make(spark, book).insert_batch(rows)
    event = corpus.events[1]
    assert event.count == n and corpus.event_ids().count() == n
    assert event.vector_ids == tuple(f"v{i}" for i in range(n))
    listed = corpus.events_frame().where("type = 'inserted'").select(F.size("vector_ids"), F.col("vector_ids")[n - 1]).first()
    assert tuple(listed) == (n, f"v{n - 1}")


def test_an_empty_index_finds_nothing(spark):
    assert SearchIndex().search([1.0, 2.0], 3).collect() == []
