"""Approximate nearest neighbours by a hash-prefix forest.

The distinct vectors are dealt over shards of bounded size. In a shard every
tree hashes every vector to a long string of hyperplane signs (hyperplanes
orthogonal within a tree, thresholds at the shard's medians) and keeps the
sorted array of the strings. A query descends every tree to its longest
matching prefix, then all trees ascend together, one letter at a time, until
their ranges hold enough entries; the rows that were met most often, over trees
and letters, are the candidates, and are scored exactly. How many are needed
for a recall is fitted in each shard, on a few of its rows, so recall does not
fall as tables grow or where vectors lie evenly. Nearness is the inner product,
so vectors are hashed with one coordinate more that makes their lengths equal.
Every shard sees every query class, in blocks, and keeps the best few per
query; a hot vector is one row with the few ids that can be of use.

Defined results: rows with a null id, and vectors that are null, empty, zero
or hold null or non-finite components, take no part, nor do those of another
length than the commonest (the shorter of equally common ones); repeated rows
count once; ties go to the smaller id; with fewer candidates than `k` all
those found are returned; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecspark.llm.arrow import small_batches
from vecspark.llm.common import written

NEAREST = 20
TREES = 128
LETTERS = 32
#: Entries of the trees' ranges to reach for each row of a shard, and letters below the last one that count.
MET = 6
DEEP = 4
#: Candidates: so many that RECALL of the nearest of TUNED rows of the shard are among them, this share of the rows at most, and so many for each neighbour at least.
RECALL = 0.975
TUNED = 32
SHARE = 0.75
EACH = 16
#: Vectors in a shard at most; small tables are split down to SPLIT vectors over MIN_SHARDS shards.
SHARD = 1 << 15
SPLIT = 1 << 10
MIN_SHARDS = 8
SEED = 7
#: Queries handled at once, and vectors that fit the thresholds of a shard.
BLOCK = 128
FITTED = 4096

RESULT = "query_id long, rank int, vec_id long, score double"


def hyperplanes(dimension: int, tree: int, letters: int = LETTERS) -> np.ndarray:
    """`letters` unit normals as columns, orthogonal in groups of at most `dimension`."""
    rng = np.random.default_rng([SEED, tree])
    groups = []
    while sum(g.shape[1] for g in groups) < letters:
        groups.append(np.linalg.qr(rng.standard_normal((dimension, dimension)))[0])
    return np.concatenate(groups, axis=1)[:, :letters].astype(np.float32)


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.linalg.norm(vectors, axis=1, keepdims=True)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled by the greatest length, and one coordinate more that makes all of length 1: angles to `flat` queries then order them by inner product."""
    scaled = vectors / np.abs(vectors).max()
    scaled /= _lengths(scaled).max()
    return np.hstack([scaled, np.sqrt(np.maximum(0.0, 1.0 - _lengths(scaled) ** 2))]).astype(np.float32)


def flat(queries: np.ndarray) -> np.ndarray:
    """Rows of length 1, the coordinate more being zero."""
    scaled = queries / np.abs(queries).max(axis=1, keepdims=True)
    return np.hstack([scaled / _lengths(scaled), np.zeros((len(queries), 1))]).astype(np.float32)


class Forest:
    """The sorted hash strings of one shard's vectors, a row for each tree."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, letters: int = LETTERS) -> None:
        self.vectors, self.letters = vectors, letters
        small, n = lifted(vectors), len(vectors)
        self.planes, self.middles = [], []
        self.strings, self.rows = np.empty((trees, n), np.uint32), np.empty((trees, n), np.int32)
        for tree in range(trees):
            planes = hyperplanes(small.shape[1], tree, letters)
            projected = small @ planes
            middle = np.median(projected[:FITTED], axis=0)
            strings = self._strings(projected, middle)
            self.rows[tree] = order = np.argsort(strings)
            self.strings[tree] = strings[order]
            self.planes.append(planes)
            self.middles.append(middle)

    def _strings(self, projected: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """The signs as integers, the first letter in the highest bit."""
        bits = np.zeros((len(projected), 32), bool)
        bits[:, 32 - self.letters :] = projected > middle
        return np.packbits(bits, axis=1).view(">u4").ravel().astype(np.uint32)

    def _ranges(self, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By query, letters left out and tree: the range of rows that share the other letters."""
        rest = np.arange(self.letters + 1, dtype=np.uint64)
        low = np.empty((len(small), self.letters + 1, len(self.planes)), np.int32)
        high = np.empty_like(low)
        for tree, (planes, middle) in enumerate(zip(self.planes, self.middles, strict=True)):
            own = self._strings(small @ planes, middle).astype(np.uint64)[:, None] >> rest << rest
            low[:, :, tree] = np.searchsorted(self.strings[tree], own.astype(np.uint32))
            high[:, :, tree] = np.searchsorted(self.strings[tree], (own + ((np.uint64(1) << rest) - np.uint64(1))).astype(np.uint32), side="right")
        return low, high

    def _met(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """How often each row is met on each query's ascent: once for every tree and for every letter of the last few.

        All trees ascend until their ranges hold MET entries for each row of the shard and `enough` different rows.
        """
        n = len(self.vectors)
        low, high = self._ranges(flat(queries))
        found = (high - low).sum(axis=2, dtype=np.int64)
        rows, first = self.rows.ravel(), np.arange(len(self.rows), dtype=np.int64) * n
        for q in range(len(queries)):
            up = int(np.argmax(found[q] >= min(MET * n, found[q, -1])))
            while True:
                levels = slice(max(0, up - DEEP), up + 1)
                starts, sizes = (low[q, levels] + first).ravel(), (high[q, levels] - low[q, levels]).ravel()
                ends = np.cumsum(sizes)
                times = np.bincount(rows[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])], minlength=n)
                if up == self.letters or np.count_nonzero(times) >= enough:
                    break
                up += 1
            yield times

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """The `enough` different rows that each query meets most often; all rows if there are fewer."""
        n = len(self.vectors)
        if enough >= n:
            yield from (np.arange(n) for _ in queries)
            return
        for times in self._met(queries, enough):
            yield np.argpartition(-times, enough - 1)[:enough]

    def needed(self, k: int, share: float = SHARE, recall: float = RECALL) -> int:
        """How many candidates hold this share of the `k` nearest, by a few of the rows as queries; `share` of the rows at most."""
        n = len(self.vectors)
        asked = self.vectors[:: -(-n // TUNED)]
        places = []
        for own, times in zip(asked, self._met(asked, 1), strict=True):
            scores = self.vectors @ own
            near = np.argpartition(-scores, min(k, n - 1))[: min(k, n)]
            behind = np.sort(-times)
            places.append(np.searchsorted(behind, -times[near], side="right"))
        fitted = int(np.quantile(np.concatenate(places), recall)) + 1
        return max(min(n, EACH * k), min(int(share * n), fitted))


def _search(k: int, trees: int, letters: int, share: float):
    def best(forest: Forest, ids: list[list[int]], vector: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[float]]:
        scores = forest.vectors[rows] @ vector
        if len(rows) > k:
            cut = np.partition(scores, len(rows) - k)[len(rows) - k]
            rows, scores = rows[scores >= cut], scores[scores >= cut]
        pairs = sorted((-s, i) for r, s in zip(rows.tolist(), scores.tolist(), strict=True) for i in ids[r])[:k]
        return [i for _, i in pairs], [-s for s, _ in pairs]

    def answered(forest: Forest, ids: list[list[int]], keys: list[tuple[int, int]], vectors: np.ndarray, enough: int) -> pa.RecordBatch:
        found = [best(forest, ids, v, rows) for v, rows in zip(vectors, forest.candidates(vectors, enough), strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([a for a, _ in keys], pa.int64()),
                pa.array([b for _, b in keys], pa.int64()),
                pa.array([i for i, _ in found], pa.list_(pa.int64())),
                pa.array([s for _, s in found], pa.list_(pa.float64())),
            ],
            names=["k1", "k2", "ids", "scores"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, forest, enough = None, None, 0
        ids: list[list[int]] = []
        data: list[np.ndarray] = []
        for batch in batches:
            shards, queries = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(queries.astype(np.int8)) != 0)) + 1
            bounds = [0, *cuts.tolist(), len(shards)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                part = batch.slice(a, b - a)
                column = part.column(4)
                matrix = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
                if shards[a] != shard:
                    shard, forest, ids, data = shards[a], None, [], []
                if not queries[a]:
                    data.append(matrix)
                    ids += part.column(5).to_pylist()
                elif data or forest:
                    if forest is None:
                        forest, data = Forest(np.concatenate(data), trees, letters), []
                        enough = forest.needed(k, share)
                    keys = list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
                    for s in range(0, len(part), BLOCK):
                        yield answered(forest, ids, keys[s : s + BLOCK], matrix[s : s + BLOCK], enough)

    return run


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, k1, k2, v): the rows that take part, with two hashes of the vector."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    rows = written(rows.select("id", F.xxhash64(v).alias("k1"), F.xxhash64(F.lit(SEED), v).alias("k2"), "v"), "vectors")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def nearest(
    df: DataFrame,
    is_query: Column | None = None,
    id_col: str = "vec_id",
    vector: str = "embedding",
    k: int = NEAREST,
    trees: int = TREES,
    letters: int = LETTERS,
    share: float = SHARE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` best found for each row that `is_query` (on column id) admits."""
    spark = df.sparkSession
    small_batches(df)
    rows = usable(df, id_col, vector)
    is_query = F.col("id") % 20 == 0 if is_query is None else is_query
    # Of equal vectors the k + 1 smallest ids suffice: a query leaves out its own.
    few = rows.select("id", "k1", "k2").distinct().withColumn("n", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))).where(F.col("n") <= k + 1)
    ids = few.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    vectors = rows.groupBy("k1", "k2").agg(F.first("v").alias("v"))
    classes = written(vectors.join(ids, ["k1", "k2"]), "classes")
    n = classes.count()
    shards = max(1, min(MIN_SHARDS, n // SPLIT), -(-n // SHARD))
    asked = rows.where(is_query).groupBy("k1", "k2").agg(F.first("v").alias("v"))
    placed = classes.select(F.pmod(F.xxhash64("k2", "k1"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("query"), "k1", "k2", "v", "ids")
    everywhere = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"), "k1", "k2", "v", F.lit(None).cast("array<long>").alias("ids")
    )
    dealt = placed.unionAll(everywhere).repartition(shards, "shard").sortWithinPartitions("shard", "query")
    found = dealt.mapInArrow(_search(k + 1, trees, letters, share), "k1 long, k2 long, ids array<long>, scores array<double>")
    pairs = F.transform(F.arrays_zip("scores", "ids"), lambda p: F.struct((-p["scores"]).alias("s"), p["ids"].alias("id")))
    merged = found.groupBy("k1", "k2").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k + 1).alias("best"))
    queries = rows.where(is_query).select(F.col("id").alias("query_id"), "k1", "k2").distinct()
    own = F.slice(F.filter("best", lambda p: p["id"] != F.col("query_id")), 1, k)
    return queries.join(merged, ["k1", "k2"]).select("query_id", F.posexplode(own).alias("at", "p")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("p.id").alias("vec_id"), (-F.col("p.s")).alias("score")
    )
