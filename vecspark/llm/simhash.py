"""SimHash near-duplicates: tiled exact comparison of fingerprints and their components.

A fingerprint bit is set if over half of the text's 4-word shingle hashes
(XXH64, seed 42) set it. Distinct fingerprints are ordered by the population
counts of their four 16-bit words and packed into blocks; every pair of
blocks whose counts lie within the radius meets in one task, which compares
tiles by numpy exclusive-or and bit counts. The Hamming distance is at least the sum over the words of the
differences of their population counts, so tile pairs whose counts differ
beyond the radius are skipped. A task returns a spanning forest of the links
it found, not the links: a group of near copies never makes all its pairs.
All comparisons together are quadratic in the number of distinct fingerprints.

Defined results: a null or blank text has fingerprint zero and links like
any other; fewer than four words are one shingle; equal texts and repeated
rows share a fingerprint; a component of rows whose ids are all null has a
null id; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import starmap

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.arrow import add_columns, forget, texts
from vecspark.llm.common import joined_by_name, keyed, written
from vecspark.llm.components import components

#: Fixed values of the fingerprint.
SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints in a block (a megabyte), in a tile, and in the tiles compared with one tile at once.
BLOCK = 1 << 17
TILE = 128
STRIP = 1024
#: Blocks at least, so that small inputs use several tasks too.
MIN_BLOCKS = 8
#: Hashes whose bits are unpacked at once.
UNPACKED = 1 << 16


def shingle_hashes(text: str, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, in order, repeats included."""
    words = text.encode().lower().split()
    joined = b" ".join(words)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - width]
    spans = zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter(starmap(lambda a, b: digest(joined[a:b], seed), spans), np.uint64, len(starts))


def fingerprint(text: str) -> int:
    hashes = shingle_hashes(text)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), UNPACKED):
        part = hashes[i : i + UNPACKED]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", name: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """Adds the fingerprint as a signed 64-bit integer to `df` or its columns `keep`."""
    place = df.columns.index(text)

    def added(part: pa.RecordBatch) -> list[pa.Array]:
        found = np.array([fingerprint(x) for x in texts(part.column(place))], np.uint64)
        return [pa.array(found.view(np.int64))]

    def make():
        forget()
        return added

    return add_columns(df, [T.StructField(name, T.LongType())], make, keep)


def word_counts(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit words of each fingerprint."""
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _sorted(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints in order of their word counts, and the bounds of each tile's counts."""
    counts = word_counts(fps)
    order = np.lexsort(counts.T[::-1])
    fps, counts = fps[order], counts[order]
    at = np.arange(0, len(fps), TILE)
    return fps, np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)


class Forest:
    """Union-find over the nodes of one task."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        found = self.parent[nodes]
        while (above := self.parent[found]) is not None and not np.array_equal(above, found):
            found = above
        self.parent[nodes] = found
        return found

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.roots(a), self.roots(b)
        if not (new := a != b).any():
            return
        parent = self.parent
        pairs = np.unique(np.stack([np.minimum(a[new], b[new]), np.maximum(a[new], b[new])], axis=1), axis=0)
        for x, y in pairs.tolist():
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            parent[max(x, y)] = min(x, y)


def linked(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of the links within `a`, or between `a` and `b`."""
    left, low_a, high_a = _sorted(a)
    right, low_b, high_b = (left, low_a, high_a) if b is None else _sorted(b)
    nodes = left if b is None else np.concatenate([left, right])
    shift = 0 if b is None else len(left)
    forest = Forest(len(nodes))
    tiles = np.arange(len(low_b))
    inside = np.arange(TILE)
    for t in range(len(low_a)):
        gap = np.maximum(0, np.maximum(low_a[t] - high_b, low_b - high_a[t])).sum(axis=1)
        near = tiles[(gap <= radius) & ((tiles >= t) if b is None else True)]
        rows = left[t * TILE : (t + 1) * TILE, None]
        for s in range(0, len(near), STRIP // TILE):
            columns = (near[s : s + STRIP // TILE, None] * TILE + inside).ravel()
            columns = columns[columns < len(right)]
            hit = np.bitwise_count(rows ^ right[columns]) <= radius
            if hit.any():
                i, j = np.nonzero(hit)
                i, j = i + t * TILE, columns[j] + shift
                forest.join(i[i != j], j[i != j])
    everything = np.arange(len(nodes))
    roots = forest.roots(everything)
    moved = roots != everything
    return nodes[moved], nodes[roots[moved]]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most BLOCK fingerprints, as bytes, named by their first one, with the bounds of their word counts."""
    held: list[np.ndarray] = []
    size = 0

    def block() -> pa.RecordBatch:
        fps = np.concatenate(held)
        counts = word_counts(fps.view(np.uint64))
        columns = [pa.array([int(fps[0])], pa.int64()), pa.array([fps.tobytes()], pa.binary())]
        columns += [pa.array([x.tolist()], pa.list_(pa.int32())) for x in (counts.min(axis=0), counts.max(axis=0))]
        return pa.RecordBatch.from_arrays(columns, names=["id", "block", "low", "high"])

    for batch in batches:
        fps = batch.column(0).to_numpy()
        while len(fps):
            part, fps = fps[: BLOCK - size], fps[BLOCK - size :]
            held.append(part)
            size += len(part)
            if size == BLOCK:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def _compare(radius: int):
    """Rows (i, j, id, block), both blocks of a pair behind each other, to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(i: int, j: int, blocks: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
            x, y = (np.frombuffer(blocks[k], np.uint64) for k in (i, j))
            u, v = linked(x, None if i == j else y, radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        key, blocks = None, {}
        for batch in batches:
            for i, j, name, block in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if key is not None and (i, j) != key:
                    yield from links(*key, blocks)
                    blocks = {}
                key = (i, j)
                blocks[name] = block
        if key is not None:
            yield from links(*key, blocks)

    return run


def block_pairs(blocks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(i, j), i <= j: the blocks (id, low, high) whose word counts allow links between them. Blocks meet by their first word's count."""
    left = blocks.select(F.col("id").alias("i"), F.col("low").alias("al"), F.col("high").alias("ah"), F.explode(F.sequence(F.col("low")[0], F.col("high")[0])).alias("count"))
    right = blocks.select(
        F.col("id").alias("j"), F.col("low").alias("bl"), F.col("high").alias("bh"), F.explode(F.sequence(F.col("low")[0] - radius, F.col("high")[0] + radius)).alias("count")
    )
    gap = sum((F.greatest(F.lit(0), F.col("al")[k] - F.col("bh")[k], F.col("bl")[k] - F.col("ah")[k]) for k in range(4)), F.lit(0))
    return left.join(right, "count").where((F.col("i") <= F.col("j")) & (gap <= radius)).select("i", "j").distinct()


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints `fp` within `radius` as the full links would."""
    grid = max(MIN_BLOCKS, -(-distinct.count() // BLOCK))
    quarter = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)))
    ordered = distinct.repartitionByRange(grid, *(quarter(k) for k in range(4)), "fp")
    blocks = written(ordered.select("fp").mapInArrow(_pack, "id long, block binary, low array<int>, high array<int>"), "blocks")
    pairs = written(block_pairs(blocks.drop("block"), radius), "pairs")
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("id"))
    met = sides.join(blocks.select("id", "block"), "id").select("i", "j", "id", "block")
    dealt = met.repartition(min(grid * (grid + 1) // 2, 20_000), "i", "j").sortWithinPartitions("i", "j")
    return written(dealt.mapInArrow(_compare(radius), "u long, v long"), "links")


def fingerprint_groups(rows: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) for every distinct `fp` of `rows`."""
    distinct = written(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprints")
    roots = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per document: id, fingerprint (16 hex digits), component_id."""
    rows = written(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), keep=["id"]), "simhash")
    groups = fingerprint_groups(rows, "id", radius).select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(groups, "fp").select(F.col("id").alias(id_col), digits, "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows with the least id of each component, one per component, in the input's columns."""
    rows, names = keyed(df)
    named = rows.select(*[F.col(n).alias(k) for n, k in zip(names, ("file", "row"), strict=True)], F.col(id_col).alias("id"), F.col(text).alias("text"))
    narrow = written(fingerprints(named, keep=["file", "row", "id"]), "simhash")
    groups = fingerprint_groups(narrow, "id", radius).select("fp", "root")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "file", "row"))
    firsts = narrow.join(groups, "fp").groupBy("root").agg(first.alias("first"))
    kept = written(firsts.select(F.col("first.file").alias(names[0]), F.col("first.row").alias(names[1])), "kept")
    return joined_by_name(rows, kept, names, "left_semi").select(*df.columns)
