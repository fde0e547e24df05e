"""Exact cosine search, and an index of vectors that changes by snapshots."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecspark.errors import DimensionMismatch, InvalidTopK
from vecspark.functions import exprs

#: Bytes of query vectors that are broadcast at most.
QUERY_BYTES = 1 << 20
#: Bytes of vectors in a shard, as doubles, that more queries than that are dealt to.
SHARD_BYTES = 64 << 20
#: Queries and rows whose cosines are looked at at once, pairs that are scored at once, queries whose best are held at once.
BLOCK, COLUMNS, PAIRS, ASKED = 256, 8192, 1 << 14, 4096
#: Pairs that are worth a task of their own, and pairs of a task at most; tasks that the first asks for at most.
TASK_PAIRS, MOST_TASKS = (1 << 25, 1 << 35), 48


def top_k(df: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, score) of the `k` vectors most similar to one query; ties go to the smaller id.

    Scores are column expressions, so filters on `df` reach its scan and the
    limit keeps `k` rows per task.
    """
    if k < 1:
        raise InvalidTopK(f"k must be at least 1, not {k}")
    score = exprs.cosine(F.col(vector), exprs.vector_literal(query, "double"))
    return df.select(id_col, score.alias("score")).orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    scale = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(scale > 0, scale, 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class _Vectors:
    """Ids and vectors of one length: as they are, to score by, and of length 1 in single precision, to choose by.

    Vectors without a positive finite length are zero, for they score 0 with all others.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            squares = np.zeros(len(values))
            for x in values.T:
                wide = x.astype(np.float64)
                squares += wide * wide
            self.alive = np.isfinite(squares) & (squares > 0)
            self.ids, self.squares = ids, np.where(self.alive, squares, 1.0)
            self.values = values if self.alive.all() else np.where(self.alive[:, None], values, values.dtype.type(0))
            self.units = (self.values / np.sqrt(self.squares)[:, None]).astype(np.float32)

    def __len__(self) -> int:
        return len(self.ids)


def _values(column: pa.Array, width: int | None = None) -> np.ndarray:
    """The vectors of a list column as rows of single or double precision; nulls in them are not numbers."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    width = int(lengths[0]) if width is None else width
    if (lengths != width).any():
        raise DimensionMismatch(f"{width} expected, got {int(lengths[lengths != width][0])}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _needed(ids: np.ndarray, values: np.ndarray, k: int) -> _Vectors:
    """Without those that `k` equal vectors of smaller ids precede, which no list of the `k` nearest reaches."""
    rows = _Vectors(ids, values)
    if len(ids) <= k or not values.shape[1]:
        return rows
    raw = np.ascontiguousarray(rows.values)
    _, same = np.unique(raw.view(np.dtype((np.void, raw.itemsize * raw.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    first = np.flatnonzero(np.concatenate(([True], same[order][1:] != same[order][:-1])))
    place = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    if (place < k).all():
        return rows
    kept = np.sort(order[place < k])
    return _Vectors(ids[kept], values[kept])


def _cosines(queries: _Vectors, q: np.ndarray, rows: _Vectors, r: np.ndarray) -> np.ndarray:
    """Of pairs, in double precision and in order of the coordinates, so that equal vectors score the same wherever they stand."""
    products = queries.values[q].astype(np.float64) * rows.values[r]
    dots = np.cumsum(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(q))
    a, b = queries.squares[q], rows.squares[r]
    with np.errstate(over="ignore"):
        both = a * b
    scale = np.where(np.isfinite(both) & (both > 1e-290), np.sqrt(both), np.sqrt(a) * np.sqrt(b))
    return np.clip(dots / scale, -1.0, 1.0)


def _places(marks: np.ndarray) -> np.ndarray:
    """Where few `marks` are set, eight looked at at once."""
    flat = marks.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64))
    at, inside = np.nonzero(flat.reshape(-1, 8)[eights])
    return eights[at] * 8 + inside


class _Best:
    """The k best (score, id) of each query so far; ties go to the smaller id.

    Blocks of cosines in single precision tell which pairs can be among them;
    only those are scored. Memory does not grow with the rows.
    """

    def __init__(self, queries: _Vectors, k: int, exclude_self: bool) -> None:
        self.queries, self.k, self.exclude_self = queries, k, exclude_self
        self.scores = np.full((len(queries), k), -np.inf)
        self.names = np.full((len(queries), k), np.iinfo(np.int64).max)
        #: Above the error of a cosine in single precision.
        self.error = (queries.units.shape[1] + 8) * 2.0**-23

    def add(self, rows: _Vectors) -> None:
        if rows.units.shape[1] != self.queries.units.shape[1]:
            raise DimensionMismatch(f"{self.queries.units.shape[1]} expected, got {rows.units.shape[1]}")
        if not len(rows):
            return
        dead = np.flatnonzero(~self.queries.alive)
        if len(dead):  # all rows score 0
            least = np.argsort(rows.ids, kind="stable")[: self.k + self.exclude_self]
            self._score(np.repeat(dead, len(least)), rows, np.tile(least, len(dead)))
        for a in range(0, len(self.queries), BLOCK):
            for b in range(0, len(rows), COLUMNS):
                self._block(a, rows, b)

    def _block(self, a: int, rows: _Vectors, b: int) -> None:
        own = slice(a, a + BLOCK)
        rough = self.queries.units[own] @ rows.units[b : b + COLUMNS].T
        n, wanted = rough.shape[1], self.k + self.exclude_self
        least = self.scores[own, -1] - self.error
        if n > wanted and np.isneginf(least).any():
            least = np.maximum(least, np.partition(rough, n - wanted, axis=1)[:, n - wanted] - 2 * self.error)
        least[~self.queries.alive[own]] = np.inf
        q, r = np.divmod(_places(rough >= least.astype(np.float32)[:, None]), n)
        self._score(q + a, rows, r + b)

    def _score(self, q: np.ndarray, rows: _Vectors, r: np.ndarray) -> None:
        if self.exclude_self:
            others = self.queries.ids[q] != rows.ids[r]
            q, r = q[others], r[others]
        for at in range(0, len(q), PAIRS):
            part = slice(at, at + PAIRS)
            self._merge(q[part], _cosines(self.queries, q[part], rows, r[part]), rows.ids[r[part]])

    def _merge(self, q: np.ndarray, scores: np.ndarray, names: np.ndarray) -> None:
        last, name = self.scores[q, -1], self.names[q, -1]
        better = (scores > last) | ((scores == last) & (names < name))
        q, scores, names = q[better], scores[better], names[better]
        changed = np.unique(q)
        q = np.concatenate([np.repeat(changed, self.k), q])
        scores, names = np.concatenate([self.scores[changed].ravel(), scores]), np.concatenate([self.names[changed].ravel(), names])
        order = np.lexsort((names, -scores, q))
        first = np.searchsorted(q[order], changed)
        kept = order[first[:, None] + np.arange(self.k)]
        self.scores[changed], self.names[changed] = scores[kept], names[kept]

    def rows(self) -> pa.RecordBatch:
        found = self.scores > -np.inf
        ids = np.repeat(self.queries.ids, found.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(self.names[found]), pa.array(self.scores[found])], names=["query_id", "vec_id", "score"])


def _against_broadcast(k: int, exclude_self: bool, shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values = shipped.value
        best = _Best(_Vectors(ids, values), k, exclude_self)
        for batch in batches:
            if batch.num_rows:
                best.add(_needed(batch.column(0).to_numpy(), _values(batch.column(1), values.shape[1]), k + exclude_self))
        yield best.rows()

    return run


def _within_cells(k: int, exclude_self: bool, width: int):
    """Rows (asks, id, vector) of one cell, the stored vectors before the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored: list[tuple[np.ndarray, np.ndarray]] = []
        rows: _Vectors | None = None
        for batch in batches:
            n = batch.num_rows
            own = int(np.count_nonzero(~batch.column(0).to_numpy(zero_copy_only=False).astype(bool)))
            ids, values = batch.column(1).to_numpy(), _values(batch.column(2), width) if n else None
            if own:
                stored.append((ids[:own].copy(), values[:own].copy()))
            if own == n or not (stored or rows):
                continue
            if rows is None:
                rows = _needed(*(np.concatenate(x) for x in zip(*stored, strict=True)), k + exclude_self)
                stored.clear()
            for at in range(own, n, ASKED):
                best = _Best(_Vectors(ids[at : at + ASKED], values[at : at + ASKED]), k, exclude_self)
                best.add(rows)
                yield best.rows()

    return run


def _grid(n: int, asked: int, width: int) -> tuple[int, int]:
    """How many parts the rows and the queries are cut into: a task has one of each, few copies travel, a query meets few parts, and no task is long."""
    tasks = min(MOST_TASKS, -(-n * asked // TASK_PAIRS[0]))
    queries = max(1, round((tasks * min(1.0, 4 * asked / max(n, 1))) ** 0.5))
    rows = max(1, -(-tasks // queries), -(-n * width * 8 // SHARD_BYTES))
    return rows, max(queries, -(-n * asked // (rows * TASK_PAIRS[1])))


def top_k_many(
    df: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", exclude_self: bool = False, n_rows: int | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score) for a stated set of queries (id, vector) against all rows.

    Up to QUERY_BYTES of queries are broadcast, and every task scores its rows
    with all of them. With more, rows and queries are each cut into parts, and
    a task has one of each: at most SHARD_BYTES of rows, past which its queries
    stream. Either way only k rows per query and task are shuffled, and nothing
    larger than the broadcast meets the driver. `n_rows` spares counting `df`.
    """
    if k < 1:
        raise InvalidTopK(f"k must be at least 1, not {k}")
    spark = df.sparkSession

    def named(x: DataFrame) -> DataFrame:
        kept = x.schema[vector].dataType.simpleString() == "array<float>"
        return x.select(F.col(id_col).cast("long").alias("id"), (F.col(vector) if kept else F.col(vector).cast("array<double>")).alias("v")).where("v IS NOT NULL")

    rows, asked = named(df), named(queries)
    widths = asked.groupBy(F.size("v").alias("width")).count().take(2)
    if len(widths) > 1:
        raise DimensionMismatch("queries have several lengths")
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, width = widths[0]["count"], widths[0]["width"]
    kinds = "query_id long, vec_id long, score double"
    if n * width * 8 <= QUERY_BYTES:
        held = asked.toArrow().combine_chunks()
        ids, matrix = held["id"].to_numpy(), _values(held["v"].combine_chunks(), width)
        found = rows.mapInArrow(_against_broadcast(k, exclude_self, spark.sparkContext.broadcast((ids, matrix))), kinds)
    else:
        total = rows.count() if n_rows is None else n_rows
        parts, asking = _grid(total, n, width)
        part = lambda m, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(m)).cast("int")
        each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        wide = lambda x: x if rows.schema["v"] == asked.schema["v"] else F.col("v").cast("array<double>").alias("v")
        stored = rows.select(part(parts, 1).alias("row"), each(asking).alias("asking"), F.lit(False).alias("asks"), "id", wide("v"))
        everywhere = asked.select(each(parts).alias("row"), part(asking, 2).alias("asking"), F.lit(True).alias("asks"), "id", wide("v"))
        cells = stored.unionAll(everywhere).withColumn("cell", F.col("row") * asking + F.col("asking"))
        dealt = cells.repartitionById(parts * asking, F.col("cell").cast("int")).select("asks", "id", "v").sortWithinPartitions("asks")
        found = dealt.mapInArrow(_within_cells(k, exclude_self, width), kinds)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


class SearchBackend(ABC):
    """What a store of full-precision vectors offers."""

    @abstractmethod
    def ingest(self, vectors: DataFrame) -> SearchBackend: ...

    @abstractmethod
    def search(self, query: Sequence[float], k: int) -> DataFrame: ...

    @abstractmethod
    def remove(self, ids: DataFrame) -> SearchBackend: ...

    @abstractmethod
    def count(self) -> int: ...


def upsert(old: DataFrame, new: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Rows of both; the new row wins and takes the old one's insert_seq. `new` must not repeat an id."""
    next_seq = F.coalesce(old.select(F.max("insert_seq").alias("m")).scalar(), F.lit(-1)) + 1
    values = [c for c in old.columns if c not in (id_col, "insert_seq")]
    numbered = new.select(id_col, *[F.col(c).alias(f"_new_{c}") for c in values], F.col("insert_seq").alias("_new_seq"), F.lit(True).alias("_is_new"))
    joined = old.join(numbered, id_col, "full_outer")
    picked = [F.when(F.col("_is_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return joined.select(id_col, *picked, F.coalesce(F.col("insert_seq"), next_seq + F.col("_new_seq")).alias("insert_seq"))


class SearchIndex(SearchBackend):
    """Snapshots of (vec_id, vector, insert_seq); every change returns a new index. The first batch fixes the dimension."""

    def __init__(self, rows: DataFrame | None = None, dimension: int | None = None) -> None:
        self.rows, self.dimension = rows, dimension

    def ingest(self, vectors: DataFrame) -> SearchIndex:
        """Takes (vec_id, vector [, insert_seq]); a row of another length refuses the whole batch."""
        lengths = vectors.agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
        if lengths["low"] is None:
            return self
        expected = self.dimension or lengths["low"]
        if (lengths["low"], lengths["high"]) != (expected, expected):
            raise DimensionMismatch(f"{expected} expected, got {lengths['low']} to {lengths['high']}")
        if "insert_seq" not in vectors.columns:
            vectors = vectors.withColumn("insert_seq", F.monotonically_increasing_id())
        latest = Window.partitionBy("vec_id").orderBy(F.desc("insert_seq"))
        one = vectors.withColumn("_n", F.row_number().over(latest)).where("_n = 1").select("vec_id", "vector", "insert_seq")
        return SearchIndex(one if self.rows is None else upsert(self.rows, one), expected)

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        if k < 1:
            raise InvalidTopK(f"k must be at least 1, not {k}")
        if self.rows is None:
            return SparkSession.active().createDataFrame([], "vec_id string, score double")
        if len(query) != self.dimension:
            raise DimensionMismatch(f"{self.dimension} expected, got {len(query)}")
        return top_k(self.rows, query, k, "vec_id", "vector")

    def remove(self, ids: DataFrame) -> SearchIndex:
        """Without the given vec_ids; unknown ones are passed over."""
        return self if self.rows is None else SearchIndex(self.rows.join(ids.select("vec_id").distinct(), "vec_id", "left_anti"), self.dimension)

    def clear(self) -> SearchIndex:
        return SearchIndex()

    def count(self) -> int:
        return 0 if self.rows is None else self.rows.count()
