from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vecspark import streaming
from vecspark.config import CodecConfig
from vecspark.operators.codebook import train
from vecspark.operators.codec import Codec, compress


def test_streamed_compression_equals_batch(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows.write.parquet(str(tmp_path / "in"))
    own = Codec(CodecConfig(4, 42, 64, True), train(rows, 4))
    stream = streaming.compress_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), own)
    query = stream.writeStream.format("memory").queryName("coded").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda df: sorted((r["vec_id"], bytes(r["compressed"]["indices"])) for r in df.collect())
    assert key(spark.table("coded")) == key(compress(rows, own))


def test_streamed_upserts_keep_the_newest(spark, tmp_path):
    kinds = "vec_id long, v int, insert_seq long"
    for n, rows in enumerate(([(1, 10, 0), (2, 20, 1)], [(2, 21, 0), (2, 22, 1), (3, 30, 2)])):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))
        streaming.upsert_stream(stream, str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "table/latest")).first()["epoch"] == n
    got = {r["vec_id"]: r["v"] for r in spark.read.parquet(str(tmp_path / "table/1")).collect()}
    assert got == {1: 10, 2: 22, 3: 30}


def test_duplicates_and_event_log(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "vec_id long, ts string")
    rows.select("vec_id", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("vec_id long, ts timestamp").parquet(str(tmp_path / "in"))
    query = streaming.without_duplicates(stream).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["vec_id"] for r in spark.table("once").collect()) == [1, 2]
    streaming.log_stream(stream, str(tmp_path / "log"), str(tmp_path / "log_state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
    assert np.isfinite(1.0)
