"""Token ids of whole texts as ORC files: run-length encoded ids, row indexes, Bloom filters on document ids.

Documents are range-partitioned by id, sorted, encoded with the tokenizers
library and written as one ORC file per range, so the files, read in order
of their part number, hold the ids in ascending order. ORC stores integer
arrays run-length encoded in stripes; readers take stripes in parallel and
skip those whose row index or Bloom filter excludes a document id.

The library is called for distinct words only: for a tokenizer that folds
case and whose pre-tokenizer cuts at white space and around words
(`by_piece=True`), Arrow cuts a slice of texts and finds its distinct words,
and each worker remembers words up to a bound (see pieces.py). With `by_piece=False` whole texts are encoded.

Defined results: a null or blank text has the end id alone; a null document
id sorts first; rows with the same id stand together in order of their text's
hash, and their starts follow that order; an empty table gives an empty file set and no rows; extra columns are
not written.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vecspark.llm.arrow import add_columns, id_lists, id_slices, kept_once, texts
from vecspark.llm.common import new_path, written
from vecspark.llm.pieces import PieceTable

END_ID = 2
STRIPE_BYTES = 64 << 20
ROW_INDEX_STRIDE = 1000
BLOOM_FPP = 0.01

#: Words that the library encodes as one text.
JOINED = 256

#: Words that a worker remembers, and rows whose words it looks up together.
REMEMBERED = 700_000
ROWS = 512


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library, special tokens not added."""

    def __init__(self, content: bytes, by_piece: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.table = PieceTable(self.library, cores=REMEMBERED, keep_half=True) if by_piece else None

        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items() if suffix else ():
            self.ends[i] = token.endswith(suffix)

    def _each(self, items: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(items, add_special_tokens=False)]

    def library(self, items: list[str]) -> Sequence[Sequence[int]]:
        """Ids of each item. Words go to the library many at once; word ends tell their ids apart."""
        if not self.ends.any():
            return self._each(items)
        found: dict[str, Sequence[int]] = {}
        words = [x for x in items if x.isalpha()]
        for i in range(0, len(words), JOINED):
            some = words[i : i + JOINED]
            (ids,) = self._each([" ".join(some)])
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(some):  # else a letter's small form is two pre-tokens
                bounds = [0, *(last + 1).tolist()]
                found.update((w, ids[a:b]) for w, a, b in zip(some, bounds, bounds[1:], strict=False))
        rest = [x for x in items if x not in found]
        found.update(zip(rest, self._each(rest), strict=True))
        return [*map(found.__getitem__, items)]

    def encode(self, items: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each text's; null as the empty text."""
        column = items if isinstance(items, pa.Array) else pa.array(items, pa.string())
        if self.table:
            return self.table.encode_column(column)
        found = self._each(texts(column))
        return np.array([i for ids in found for i in ids], np.int32), np.cumsum([0, *map(len, found)])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", end_id: int | None = END_ID, by_piece: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Adds `ids`, the text's ids and the end id, to `df` or its columns `keep`."""
    content = Path(path).read_bytes()
    digest = hashlib.sha256(content).hexdigest()
    shipped = df.sparkSession.sparkContext.broadcast(content)
    place = df.columns.index(text)

    def make():
        encoder = kept_once(("library", digest, by_piece), lambda: LibraryEncoder(shipped.value, by_piece))

        def added(part: pa.RecordBatch) -> list[pa.Array]:
            found, offsets = encoder.encode(part.column(place))
            if end_id is not None:
                found = np.insert(found, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
            return [id_lists(found, offsets)]

        return added

    return add_columns(df, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make, keep, ROWS)


def write_orc(df: DataFrame, folder: str, path: str, id_col: str = "doc_id", text: str = "text", end_id: int | None = END_ID, by_piece: bool = True) -> str:
    """Writes (id, part, row, ids) in ascending id order, a file per part; returns the folder.

    `row` numbers the rows of a part in the order in which they stand in its file.
    """
    order = [F.col(id_col).asc_nulls_first(), F.xxhash64(F.col(text)).asc()]
    dealt = df.select(id_col, text).repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits of the increasing id are the part.
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    encoded = encode(dealt, path, text, "ids", end_id, by_piece, [id_col]).select(id_col, F.spark_partition_id().alias("part"), row.alias("row"), "ids")
    (
        encoded.write.format("orc")
        .option("orc.compress", "ZSTD")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", id_col)
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .save(folder)
    )
    return folder


def read_orc(spark: SparkSession, folder: str, id_col: str = "doc_id", ids_wanted: list[int] | None = None) -> DataFrame:
    """The files' rows; a list of ids is pushed down to the row indexes and Bloom filters."""
    df = spark.read.orc(folder)
    return df if ids_wanted is None else df.where(F.col(id_col).isin(ids_wanted))


def _ids_crc32(column: pa.ListArray) -> pa.Array:
    return pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in id_slices(column)], pa.int64())


def layout(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per stored document: id, start (ids of all documents before it), n_tokens, ids_crc32.

    Starts are summed in the order of the files: within parts, each a task's
    worth of documents, and over the parts' totals; only narrow rows move.
    """
    stored = stored.withColumn("n_tokens", F.size("ids").cast("bigint"))
    place = stored.columns.index("ids")
    summed = add_columns(stored, [T.StructField("ids_crc32", T.LongType())], lambda: lambda part: [_ids_crc32(part.column(place))], [id_col, "part", "row", "n_tokens"])
    rows = written(summed, "layout")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(offsets, "part")
        .select(id_col, (F.col("_before") + F.col("_offset")).alias("start"), "n_tokens", "ids_crc32")
    )


def tokens_written(df: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Writes the documents' ids into the shared folder and reads their layout back from the files."""
    spark = df.sparkSession
    return layout(read_orc(spark, write_orc(df, new_path(spark, "tokens"), path, id_col), id_col), id_col)
