"""Structured Streaming extensions: compression, upserts, duplicate rejection and an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from vecspark.operators.codec import Codec, compress
from vecspark.operators.search import upsert


def compress_stream(stream: DataFrame, codec: Codec, vector: str = "embedding") -> DataFrame:
    """Compression keeps no state: it runs on a stream as on a table."""
    return compress(stream, codec, vector)


def without_duplicates(stream: DataFrame, id_col: str = "vec_id", time_col: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The first row of each id within the watermark's delay."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, id_col: str = "vec_id", **trigger) -> StreamingQuery:
    """Keeps the newest row (by insert_seq) of each id in snapshots `table`/<epoch>; `table`/latest names the current one.

    A repeated epoch writes the same snapshot again, so the outcome is exactly once.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        newest = Window.partitionBy(id_col).orderBy(F.desc("insert_seq"))
        new = batch.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
        if epoch:
            new = upsert(spark.read.parquet(f"{table}/{epoch - 1}"), new, id_col)
        new.write.mode("overwrite").parquet(f"{table}/{epoch}")
        spark.range(1).select(F.lit(epoch).alias("epoch")).coalesce(1).write.mode("overwrite").parquet(f"{table}/latest")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def log_stream(events: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends corpus events to a table; a reader's offset in it is what it has drained."""
    out = events.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return out.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
