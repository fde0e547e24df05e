"""How much compression costs: correlation, recall, overlap, error and ratio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.errors import DimensionMismatch
from vecspark.operators.search import SHARD_BYTES, _matrix, _unit

#: Shards at least, and queries that are scored at once.
MIN_SHARDS = 8
BLOCK = 256
#: Pairs that are worth a task of their own, and pairs of a task at most; parts that the first asks for at most.
TASK_PAIRS, MOST_PARTS = (1 << 22, 1 << 32), 16


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; 0 for fewer than two rows or a constant side, and within -1 and 1."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    value = F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def _cosine_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """exprs.cosine of all pairs of rows, bit for bit: summed in order of the coordinates."""
    with np.errstate(all="ignore"):
        dots, xx, yy = np.zeros((len(x), len(y))), np.zeros(len(x)), np.zeros(len(y))
        for a, b in zip(x.T, y.T, strict=True):
            dots += a[:, None] * b
            xx += a * a
            yy += b * b
        scale = np.sqrt(xx)[:, None] * np.sqrt(yy)
        value = np.where(scale > 0, dots / scale, 0.0)
    return np.where(np.isnan(value), 0.0, value)


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; null ones are not numbers."""
    lengths = column.value_lengths().fill_null(width).to_numpy(zero_copy_only=False)
    if (lengths != width).any():
        raise DimensionMismatch(f"{width} expected, got {int(lengths[lengths != width][0])}")
    rows = np.full((len(column), width), np.nan)
    rows[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return rows


def _paired(width: int, sides: list[str]):
    """Rows (diagonal, second, id, vectors) of one cell, the first part's before the second's, to the pairs of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[np.ndarray]]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            own = int(np.count_nonzero(~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)))
            diagonal, ids = batch.column(0)[0].as_py(), batch.column(2).to_numpy()
            vectors = [_padded(batch.column(3 + i), width) for i in range(len(sides))]
            if own:
                held.append((ids[:own].copy(), [v[:own].copy() for v in vectors]))
            for names, stored in held if own < len(ids) else []:
                for at in range(own, len(ids), BLOCK):
                    for on in range(0, len(names), BLOCK):
                        mine, theirs = slice(at, at + BLOCK), slice(on, on + BLOCK)
                        b, a = np.broadcast_arrays(ids[mine], names[theirs, None])
                        wanted = a < b if diagonal else np.ones(a.shape, bool)
                        scores = [_cosine_block(s[theirs], v[mine])[wanted] for s, v in zip(stored, vectors, strict=True)]
                        columns = [np.minimum(a, b)[wanted], np.maximum(a, b)[wanted], *scores]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", *sides])

    return run


def _parts(n: int, width: int) -> int:
    """How many parts `n` rows are cut into whose pairs are tasks."""
    pairs = n * n
    return max(1, min(MOST_PARTS, round((pairs / TASK_PAIRS[0]) ** 0.5)), round((pairs / TASK_PAIRS[1]) ** 0.5), -(-n * width * 16 // SHARD_BYTES))


def pair_scores(rows: DataFrame, id_col: str = "vec_id", original: str = "embedding", restored: str | None = "vector", stride: int = 1) -> DataFrame:
    """(a, b, original, restored): cosines of the pairs a < b of ids divisible by `stride`, before and, if there are such vectors, after.

    The rows are cut into parts, and each two parts meet in a task of their own.
    """
    names = {"original": original} | ({} if restored is None else {"restored": restored})
    picked = rows.where(F.col(id_col) % stride == 0).select(F.col(id_col).cast("long").alias("id"), *[F.col(v).cast("array<double>").alias(n) for n, v in names.items()])
    size = picked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("original")).alias("width")).first()
    width = max(0, size["width"] or 0)
    parts = _parts(size["n"], width)
    place = lambda i, j, second: F.struct((i * parts + j).cast("int").alias("cell"), (i == j).alias("diagonal"), F.lit(second).alias("second"))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    cells = F.concat(F.transform(F.sequence(part, F.lit(parts - 1)), lambda j: place(part, j, False)), F.transform(F.sequence(F.lit(0), part), lambda i: place(i, part, True)))
    # Cells i <= j are numbered without gaps.
    number = F.expr(f"CAST((cell div {parts}) * {parts} - (cell div {parts}) * ((cell div {parts}) - 1) / 2 + cell % {parts} - cell div {parts} AS INT)")
    placed = picked.select(F.explode(cells).alias("at"), "id", *names).select("at.*", "id", *names)
    dealt = placed.repartitionById(parts * (parts + 1) // 2, number).sortWithinPartitions("second").select("diagonal", "second", "id", *names)
    return dealt.mapInArrow(_paired(width, list(names)), ", ".join(["a long", "b long", *[f"{n} double" for n in names]]))


def _row_moments(x: np.ndarray, y: np.ndarray, kept: np.ndarray) -> list[tuple[int, float, float, float, float, float]]:
    """Moments of each row of scores over the places that are `kept`."""
    n = kept.sum(axis=1)
    x, y = np.where(kept, x, 0.0), np.where(kept, y, 0.0)
    mx, my = x.sum(axis=1) / np.maximum(n, 1), y.sum(axis=1) / np.maximum(n, 1)
    dx, dy = np.where(kept, x - mx[:, None], 0.0), np.where(kept, y - my[:, None], 0.0)
    return [*zip(n.tolist(), mx.tolist(), my.tolist(), (dx * dx).sum(axis=1).tolist(), (dy * dy).sum(axis=1).tolist(), (dx * dy).sum(axis=1).tolist(), strict=True)]


def _moments(x: np.ndarray, y: np.ndarray) -> tuple[int, float, float, float, float, float]:
    mx, my = float(x.mean()), float(y.mean())
    x, y = x - mx, y - my
    return len(x), mx, my, float(x @ x), float(y @ y), float(x @ y)


def _scored(batches: Iterator[pa.RecordBatch], per_query: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (shard, asks, id, original, restored), a shard's rows before its queries, to moments of the two scores, by query or block of queries."""
    shard: int | None = None
    stored: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        shards, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
        bounds = [0, *cuts.tolist(), len(shards)]
        out, names_out = [], []
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            ids, original, restored = part.column(2).to_numpy(), _unit(_matrix(part.column(3))), _unit(_matrix(part.column(4)))
            if shards[a] != shard:
                shard, stored = shards[a], []
            if not asks[a]:
                stored.append((ids, original, restored))
                continue
            for at in range(0, len(ids), BLOCK):
                own = slice(at, at + BLOCK)
                for names, before, after in stored:
                    others = ids[own, None] != names
                    if others.any():
                        x, y = original[own] @ before.T, restored[own] @ after.T
                        x, y = np.nan_to_num(x, nan=0.0), np.nan_to_num(y, nan=0.0)
                        out += _row_moments(x, y, others) if per_query else [_moments(x[others], y[others])]
                        names_out += ids[own].tolist() if per_query else [0]
        if out:
            n, *rest = zip(*out, strict=True)
            columns = [pa.array(names_out, pa.int64()), pa.array(n, pa.int64()), *(pa.array(v, pa.float64()) for v in rest)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "n", "mx", "my", "xx", "yy", "xy"])


def query_correlation(rows: DataFrame, is_query: Column, n: int, width: int, id_col: str = "vec_id", original: str = "embedding", restored: str = "vector", per_query: bool = False) -> DataFrame:
    """One row, rho of the cosines of each query with every other row, before and after, for `n` rows of length `width`;
    or (query_id, rho) for each query.

    The rows are dealt to shards, every shard sees all queries, in blocks, and
    only moments leave it. As `correlation`, 0 for a constant side.
    """
    shards = max(MIN_SHARDS, -(-n * width * 16 // SHARD_BYTES))
    named = rows.where(F.col(original).isNotNull() & F.col(restored).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
        F.col(original).cast("array<double>").alias("o"),
        F.col(restored).cast("array<double>").alias("r"),
    )
    place = lambda shard, asks: F.struct(shard.cast("int").alias("shard"), F.lit(asks).alias("asks"))
    stored = F.array(place(F.pmod(F.xxhash64("id"), F.lit(shards)), False))
    everywhere = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: place(s, True))
    placed = named.select(F.explode(F.when(F.col("is_query"), F.concat(stored, everywhere)).otherwise(stored)).alias("at"), "id", "o", "r")
    dealt = placed.select("at.shard", "at.asks", "id", "o", "r").repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    found = dealt.mapInArrow(lambda batches: _scored(batches, per_query), "query_id long, n long, mx double, my double, xx double, yy double, xy double")
    total = lambda within, a, b: F.sum(within) + F.sum(F.col("n") * F.col(a) * F.col(b)) - F.sum(F.col("n") * F.col(a)) * F.sum(F.col("n") * F.col(b)) / F.sum("n")
    keys = ["query_id"] if per_query else []
    sums = found.where("n > 0").groupBy(*keys).agg(total("xx", "mx", "mx").alias("xx"), total("yy", "my", "my").alias("yy"), total("xy", "mx", "my").alias("xy"))
    spread = F.sqrt("xx") * F.sqrt("yy")
    value = F.when(spread > 0, F.try_divide(F.col("xy"), spread))
    return sums.select(*keys, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0)))).alias("rho"))


def recall(true: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """One row: the mean share of each query's true neighbours (query_id, vec_id) that were found."""
    hits = true.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    each = true.select("query_id").distinct().join(hits, "query_id", "left")
    return each.agg(F.avg(F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("recall"))


def jaccard(true: DataFrame, found: DataFrame) -> DataFrame:
    """One row: the mean overlap of the two neighbour sets of each query."""
    sets = lambda df, name: df.groupBy("query_id").agg(F.collect_set("vec_id").alias(name))  # noqa: E731  at most k ids each
    both = sets(true, "t").join(sets(found, "f"), "query_id")
    return both.agg(F.avg(F.size(F.array_intersect("t", "f")) / F.size(F.array_union("t", "f"))).alias("jaccard"))


def mean_squared_error(rows: DataFrame, original: str = "embedding", restored: str = "vector") -> DataFrame:
    """One row: over all coordinates."""
    squares = F.zip_with(original, restored, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    per_row = F.aggregate(squares, F.lit(0.0), lambda t, x: t + x)
    return rows.agg((F.sum(per_row) / F.sum(F.size(original))).alias("mse"))


def payload_bytes(dimension: int, bit_width: int, residual: bool) -> int:
    return -(-dimension * bit_width // 8) + residual * 2 * dimension


def compression_ratio(dimension: int, bit_width: int, residual: bool) -> float:
    return 4.0 * dimension / payload_bytes(dimension, bit_width, residual)


def latency_summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Median, 95th percentile and mean of timings by `keys`."""
    at = F.percentile(F.col(value), F.array(F.lit(0.5), F.lit(0.95)))
    summed = df.groupBy(*keys).agg(at.alias("_p"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return summed.select(*keys, "n", F.col("_p")[0].alias("median"), F.col("_p")[1].alias("p95"), "mean")
