"""What the corpus operators share: the shared folder, written tables, hashes and running sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are maximal runs of anything but these ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on local masters without one a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="vecspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Where the tables written in the innermost scratch() are listed.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/vecspark/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that operators wrote for themselves inside, and no others.

    For callers that store what they need before the end: results are lazy
    and read those tables. Without it the tables stay in the shared folder.
    """
    own: list[str] = []
    token = _SCRATCH.set(own)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in own:
            remove(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path whose table scratch() deletes."""
    path = new_path(spark, name)
    own = _SCRATCH.get()
    if own is not None:
        own.append(path)
    return path


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go when a job has ended; a stage that still needs them runs again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a Parquet table in the shared folder: lineage and shuffle files end there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes tables that written() returned, once nothing reads them any more."""
    for table in tables:
        remove(table.sparkSession, table._written_to)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that new_path() named."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from `names` that `df` does not have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def _rows_of_files(df: DataFrame) -> bool:
    """Whether every row of `df` is one row of a file, and always the same one: a scan that is at most filtered and projected."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias") and node.deterministic():
        node = node.child()
    return node.getClass().getSimpleName() == "LogicalRelation"


def keyed(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """`df` with columns more that together name a row, the same ones however often it is computed; and their names.

    Rows of a file are named by the file and their place in it. The rows of
    anything else are numbered and written, which fixes the numbers.
    """
    names = fresh(df, "_file", "_row")
    if _rows_of_files(df):
        try:
            return df.select("*", F.xxhash64("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])), names
        except AnalysisException:  # no Parquet files
            pass
    numbered = df.select("*", F.lit(0).cast("long").alias(names[0]), F.monotonically_increasing_id().alias(names[1]))
    return written(numbered, "numbered"), names


def joined_by_name(rows: DataFrame, found: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """`rows` and what was found for them, by the names of keyed(). `found` grows with the rows, so that it is never broadcast."""
    return rows.join(found.hint("merge"), names, how)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fraction(text: Column) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of the text's MD5, the same in any SQL engine."""
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def running_sum(df: DataFrame, key: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds `out`, the sum of `value` (never null) over the earlier rows of the same `key` (never null), in `order`.

    The rows are dealt by ranges of (key, order), so a key with most rows
    spreads over many tasks; only one number per range and key is summed
    across ranges. The ranges are written first, for a recomputed range
    boundary would change the offsets.
    """
    parts = written(
        df.repartitionByRange(F.col(key), *order).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy(key, "_part")
        .agg(F.sum(value).alias("_sum"))
        .select(key, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.withColumn("_before", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(offsets, [key, "_part"])
        .withColumn(out, F.col("_before") + F.col("_offset"))
        .drop("_before", "_offset", "_part")
    )
