"""Weighted rendezvous hashing of stable record keys over shards, in DataFrame functions only.

Every shard scores every key with -ln(u) / weight, where u is a hash of key
and shard; the lowest score takes the record. A new shard only competes
for records, so growth moves records into it and nowhere else.

Defined results: a null key is hashed as the empty text, so all its rows
share a shard; repeated rows share a shard and take different slots; a null
text has size 1 and checksum 0; an empty table gives an empty table; columns
of the input do not clash, for the operator reads only the named ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecspark.llm.common import fraction, written

LAW = "key"
SHARDS = 16


def rendezvous(key: Column, weights: Sequence[float], seed: str = "") -> Column:
    """The number of the shard that takes `key`. Weights are positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))
    scores = [
        F.struct(
            (-F.log(fraction(F.concat(text, F.lit(f"/{seed}{shard}")))) / F.lit(float(weight))).alias("score"),
            F.lit(shard).alias("shard"),
        )
        for shard, weight in enumerate(weights)
    ]
    best = scores[0] if len(scores) == 1 else F.array_min(F.array(*scores))
    return best["shard"]


def shard_records(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    weights: Sequence[float] = (1.0,) * SHARDS,
    grown_weight: float = 1.0,
) -> DataFrame:
    """Per record: key, size, text_crc32, law, shard, slot, grown_shard.

    Slots number the records of a shard without gaps. They are counted in
    4096 key buckets per shard, so that no task holds a whole shard, and
    the counts, at most 4096 per shard whatever the input, give the offsets.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    narrow = df.select(
        F.col(key),
        (F.length(body) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        rendezvous(F.col(key), weights).cast("int").alias("shard"),
        rendezvous(F.col(key), [*weights, grown_weight]).cast("int").alias("grown_shard"),
    ).withColumn(
        "_bucket",
        F.substring(F.md5(F.concat_ws("/", F.col(key).cast("string"), F.col("text_crc32").cast("string")).cast("binary")), 1, 3),
    )
    rows = written(narrow, "shards")
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy("shard", "_bucket").orderBy(key, "text_crc32", "size")
    return (
        rows.withColumn("_place", F.row_number().over(within) - F.lit(1))
        .join(offsets, ["shard", "_bucket"])
        .select(
            key,
            "size",
            "text_crc32",
            F.lit(LAW).alias("law"),
            "shard",
            (F.col("_offset") + F.col("_place")).cast("bigint").alias("slot"),
            "grown_shard",
        )
    )
