"""Every named query of the engine with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.config import BIT_WIDTHS, CodecConfig, config_hash
from vecspark.functions import exprs
from vecspark.operators import baselines, metrics, wire
from vecspark.operators.codebook import Codebook, fractions, quantile_column, train
from vecspark.operators.codec import Codec, compress, decompress, round_trip, split_rejects, turned
from vecspark.operators.codec import quantize as quantize_values
from vecspark.operators.rotation import rotation
from vecspark.operators.search import top_k, top_k_many, upsert
from vecspark.plans import twins
from vecspark.plans.twins import DIMENSION, SEED

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

K = 10
STRIDE = 20
CODECS = [(bits, residual) for bits in BIT_WIDTHS for residual in (False, True)]
LINEITEM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def first_vector(spark: SparkSession, d: str) -> list[float]:
    return embeddings(spark, d).where("vec_id = 0").select("embedding").first()[0]


def codec(df: DataFrame, bits: int, residual: bool) -> Codec:
    return Codec(CodecConfig(bits, SEED, DIMENSION, residual), train(df, bits))


def entries(codebook: Codebook) -> Column:
    return exprs.vector_literal(codebook.entries)


def turn(df: DataFrame, vector: str = "embedding", out: str = "r", transposed: bool = False) -> DataFrame:
    m = rotation(SEED, DIMENSION)
    return turned(df, m.T if transposed else m, vector, out)


def rounded(value: Column, digits: int = 6) -> Column:
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def exploded(df: DataFrame, vector: Column) -> DataFrame:
    return df.select("vec_id", F.posexplode(vector).alias("pos", "x")).select("vec_id", "pos", rounded(F.col("x")).alias("value"))


def joined(indices: Column) -> Column:
    return F.array_join(indices.cast("array<string>"), ",")


# Sources and configuration


@query("scan_embeddings", "SELECT vec_id, label, len(embedding)::INTEGER AS dimension FROM embeddings")
def scan_embeddings(spark, d):
    return embeddings(spark, d).select("vec_id", "label", F.size("embedding").alias("dimension"))


@query(
    "config_hashes",
    """SELECT b::INTEGER AS bit_width, s::BIGINT AS seed, n::INTEGER AS dimension, r AS residual_enabled,
      sha256('CodecConfig(bit_width=' || b || ',seed=' || s || ',dimension=' || n || ',residual_enabled=' || CASE WHEN r THEN 'True' ELSE 'False' END || ')') AS config_hash
    FROM (VALUES (2), (4), (8)) b(b), (VALUES (0), (1), (42), (999)) s(s), (VALUES (1), (64), (768)) n(n), (VALUES (true), (false)) r(r)""",
)
def config_hashes(spark, d):
    rows = [(b, s, n, r) for b in BIT_WIDTHS for s in (0, 1, 42, 999) for n in (1, 64, 768) for r in (True, False)]
    grid = spark.createDataFrame(rows, "bit_width int, seed long, dimension int, residual_enabled boolean")
    return grid.withColumn("config_hash", config_hash(*(F.col(c) for c in grid.columns)))


# Codebooks


def _codebook_rows(spark: SparkSession, codebook: Codebook) -> DataFrame:
    return spark.createDataFrame([(i, round(e, 6) + 0.0) for i, e in enumerate(codebook.array.astype(float).tolist())], "entry int, value double")


for _bits in BIT_WIDTHS:

    @query(
        f"codebook_bw{_bits}",
        f"WITH {twins.codebook(_bits)} SELECT (i - 1)::INTEGER AS entry, {twins.rounded('cb[i]::DOUBLE')} AS value FROM (SELECT cb, unnest(range(1, {(1 << _bits) + 1})) AS i FROM cb)",
    )
    def codebook(spark, d, bits=_bits):
        return _codebook_rows(spark, train(embeddings(spark, d), bits))


@query(
    "codebook_by_label",
    f"""SELECT label, (i - 1)::INTEGER AS entry, {twins.rounded('q[i]::FLOAT::DOUBLE')} AS value FROM (SELECT label, q, unnest(range(1, 5)) AS i
    FROM (SELECT label, quantile_cont(v::DOUBLE, {fractions(2)}) AS q FROM (SELECT label, unnest(embedding) AS v FROM embeddings) GROUP BY label))""",
)
def codebook_by_label(spark, d):
    values = embeddings(spark, d).select("label", F.explode("embedding").alias("v"))
    books = values.groupBy("label").agg(quantile_column(F.col("v"), 2).alias("q"))
    return books.select("label", F.posexplode("q").alias("entry", "x")).select("label", "entry", rounded(F.col("x")).alias("value"))


# Codec, expression by expression


@query("rotate", f"WITH {twins.ROTATED} {twins.exploded('rot', 'r')}")
def rotate(spark, d):
    return exploded(turn(embeddings(spark, d).select("vec_id", "embedding")).select("vec_id", "r"), F.col("r"))


@query(
    "rotate_inverse_roundtrip",
    f"""WITH {twins.ROTATED}, b AS (SELECT vec_id, embedding, {twins.turned('r', 'm')} AS b FROM rot, (SELECT {twins.matrix(transposed=True)} AS m))
    SELECT vec_id, list_max(list_transform(list_zip(embedding, b), lambda p: abs(p[1] - p[2]))) <= 1e-5 AS close FROM b""",
)
def rotate_inverse_roundtrip(spark, d):
    rows = turn(turn(embeddings(spark, d).select("vec_id", "embedding")), "r", "b", transposed=True)
    return rows.select("vec_id", (F.array_max(F.zip_with("embedding", "b", lambda x, y: F.abs(x - y))) <= 1e-5).alias("close"))


@query(
    "rotation_orthogonality",
    f"""WITH m AS (SELECT m[i] AS row, i - 1 AS i FROM (SELECT {twins.matrix()} AS m), range(1, {DIMENSION + 1}) r(i))
    SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, {twins.rounded('list_dot_product(a.row, b.row)', 9)} AS product FROM m a, m b""",
)
def rotation_orthogonality(spark, d):
    m = rotation(SEED, DIMENSION)
    rows = spark.createDataFrame([(i, row) for i, row in enumerate(m.tolist())], "i int, row array<double>")
    other = rows.select(F.col("i").alias("j"), F.col("row").alias("other"))
    return rows.join(other, F.col("i") >= 0).select("i", "j", rounded(exprs.dot(F.col("row"), F.col("other")), 9).alias("product"))


def _indices(spark: SparkSession, d: str, bits: int) -> DataFrame:
    rows = embeddings(spark, d)
    book = entries(train(rows, bits))
    rotated = turn(rows.select("vec_id", "embedding"))
    return rotated.withColumn("q", exprs.quantize(F.col("r"), book)).withColumn("s", exprs.dequantize(F.col("q"), book))


for _bits in BIT_WIDTHS:

    @query(f"quantize_bw{_bits}", f"WITH {twins.quantized(_bits)} SELECT vec_id, array_to_string(q, ',') AS indices FROM q")
    def quantize(spark, d, bits=_bits):
        return _indices(spark, d, bits).select("vec_id", joined(F.col("q")).alias("indices"))


@query("code_histogram", f"WITH {twins.quantized(4)} SELECT code::INTEGER AS code, count(*) AS n FROM (SELECT unnest(q) AS code FROM q) GROUP BY code")
def code_histogram(spark, d):
    return _indices(spark, d, 4).select(F.explode("q").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("dequantize_bw4", f"WITH {twins.dequantized(4)} {twins.exploded('s', 's')}")
def dequantize_bw4(spark, d):
    return exploded(_indices(spark, d, 4), F.col("s"))


@query("residual_bw4", f"WITH {twins.residuals(4)} {twins.exploded('e', 'e')}")
def residual_bw4(spark, d):
    return exploded(_indices(spark, d, 4), exprs.residual(F.col("r"), F.col("s")))


for _bits, _residual in CODECS:

    @query(f"decompress_bw{_bits}{'_residual' if _residual else ''}", f"WITH {twins.restored(_bits, _residual)} {twins.exploded('v', 'vector', 5)}")
    def restore(spark, d, bits=_bits, residual=_residual):
        rows = embeddings(spark, d).select("vec_id", "embedding")
        own = codec(rows, bits, residual)
        back = decompress(compress(rows, own).select("vec_id", "compressed"), own)
        return back.select("vec_id", F.posexplode("vector").alias("pos", "x")).select("vec_id", "pos", rounded(F.col("x"), 5).alias("value"))


@query("fp16_roundtrip", f"WITH h AS (SELECT vec_id, list_transform(embedding, lambda x: ({twins.half('x::DOUBLE')})::FLOAT) AS h FROM embeddings) {twins.exploded('h', 'h')}")
def fp16_roundtrip(spark, d):
    return exploded(embeddings(spark, d), exprs.half_vector(F.col("embedding")))


_LEVELS = """list_transform({v}, lambda x: round_even((x::DOUBLE - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END) * 255, 0)::INTEGER)"""


@query(
    "uint8_minmax",
    f"SELECT vec_id, {twins.rounded('lo')} AS low, {twins.rounded('hi')} AS high, array_to_string({_LEVELS.format(v='embedding')}, ',') AS levels "
    "FROM (SELECT *, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)",
)
def uint8_minmax(spark, d):
    coded = embeddings(spark, d).select("vec_id", exprs.byte_levels(F.col("embedding")).alias("c"))
    return coded.select("vec_id", rounded(F.col("c.low")).alias("low"), rounded(F.col("c.high")).alias("high"), joined(F.col("c.levels")).alias("levels"))


_WIDTH = DIMENSION // baselines.PQ_PARTS


@query(
    "pq_sim",
    f"""WITH p AS (SELECT vec_id, i, embedding[i * {_WIDTH} + 1:(i + 1) * {_WIDTH}] AS v FROM embeddings, range({baselines.PQ_PARTS}) r(i)),
    l AS (SELECT *, list_min(v)::DOUBLE AS lo, list_max(v)::DOUBLE AS hi FROM p), c AS (SELECT *, {_LEVELS.format(v='v')} AS q FROM l),
    x AS (SELECT vec_id, i, unnest(range({_WIDTH})) AS j, lo, hi, q FROM c)
    SELECT vec_id, (i * {_WIDTH} + j)::INTEGER AS pos, {twins.rounded('(lo + q[j + 1] / 255.0::DOUBLE * (CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END))::FLOAT::DOUBLE')} AS value FROM x""",
)
def pq_sim(spark, d):
    return exploded(embeddings(spark, d), exprs.simulated_pq(F.col("embedding"), DIMENSION, baselines.PQ_PARTS))


def _packed_sql(bits: int) -> str:
    per = 8 // bits
    parts = " | ".join(f"(q[b * {per} + {j + 1}] << {bits * j})" for j in range(per))
    return f"list_transform(range({DIMENSION // per}), lambda b: {parts})"


for _bits in BIT_WIDTHS:

    @query(f"pack_bw{_bits}", f"WITH {twins.quantized(_bits)} SELECT vec_id, array_to_string({_packed_sql(_bits)}, ',') AS bytes FROM q")
    def pack(spark, d, bits=_bits):
        return _indices(spark, d, bits).select("vec_id", joined(exprs.pack(F.col("q"), bits)).alias("bytes"))


@query("unpack_roundtrip", f"WITH {twins.quantized(2)} SELECT vec_id, array_to_string(q, ',') AS indices FROM q")
def unpack_roundtrip(spark, d):
    rows = _indices(spark, d, 2).withColumn("p", exprs.pack(F.col("q"), 2))
    return rows.select("vec_id", joined(exprs.unpack(F.col("p"), 2, F.lit(DIMENSION))).alias("indices"))


@query(
    "serialize_sizes",
    f"""SELECT vec_id, b::INTEGER AS bit_width, r AS residual, ceil(len(embedding) * b / 8.0)::BIGINT + CASE WHEN r THEN 2 * len(embedding) ELSE 0 END AS size_bytes,
    71 + ceil(len(embedding) * b / 8.0)::BIGINT + CASE WHEN r THEN 4 + 2 * len(embedding) ELSE 0 END AS record_bytes
    FROM embeddings, (VALUES (2), (4), (8)) b(b), (VALUES (true), (false)) r(r)""",
)
def serialize_sizes(spark, d):
    grid = F.explode(F.array(*[F.struct(F.lit(b).alias("bit_width"), F.lit(r).alias("residual")) for b, r in CODECS]))
    rows = embeddings(spark, d).select("vec_id", F.size("embedding").alias("n"), grid.alias("g")).select("vec_id", "n", "g.*")
    extra = F.when(F.col("residual"), 2 * F.col("n")).otherwise(0)
    size = exprs.size_bytes(F.col("n"), F.col("bit_width"), extra)
    return rows.select("vec_id", "bit_width", "residual", size.alias("size_bytes"), (71 + size + F.when(F.col("residual"), 4).otherwise(0)).alias("record_bytes"))


_LITTLE = "lpad(lower(to_hex({v} & 255)), 2, '0') || lpad(lower(to_hex(({v} >> 8) & 255)), 2, '0') || lpad(lower(to_hex(({v} >> 16) & 255)), 2, '0') || lpad(lower(to_hex(({v} >> 24) & 255)), 2, '0')"


@query(
    "level1_records",
    f"""WITH {twins.quantized(4)}, p AS (SELECT vec_id, list_transform(range({DIMENSION // 2}), lambda b: q[b * 2 + 1] | (q[b * 2 + 2] << 4)) AS packed FROM q)
    SELECT vec_id, '01' || lower(hex('{CodecConfig(4, SEED, DIMENSION, False).config_hash}')) || {_LITTLE.format(v=DIMENSION)} || '04'
      || array_to_string(list_transform(packed, lambda b: lpad(lower(to_hex(b)), 2, '0')), '') || '00' AS record, true AS same FROM p""",
)
def level1_records(spark, d):
    """The bytes of every record of 4-bit codes without residuals, and whether they parse to the record again."""
    rows = embeddings(spark, d).select("vec_id", "embedding")

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            records = [wire.Record(c["config_hash"], c["dimension"], c["bit_width"], c["indices"], c["residual"]) for c in batch.column(1).to_pylist()]
            data = [wire.encode(r) for r in records]
            same = [wire.decode(x) == r for x, r in zip(data, records, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.hex() for x in data]), pa.array(same)], names=["vec_id", "record", "same"])

    coded = compress(rows, codec(rows, 4, False)).select("vec_id", "compressed")
    return coded.mapInArrow(check, "vec_id long, record string, same boolean")


# Scalar functions


@query("norms", f"SELECT vec_id, {twins.rounded('sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))')} AS norm FROM embeddings")
def norms(spark, d):
    return embeddings(spark, d).select("vec_id", rounded(exprs.norm(F.col("embedding"))).alias("norm"))


@query(
    "normalize",
    "WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))::FLOAT) AS n FROM embeddings) "
    + twins.exploded("n", "n"),
)
def normalize(spark, d):
    return exploded(embeddings(spark, d), exprs.normalized(F.col("embedding")))


@query("pgvector_text", f"SELECT vec_id, len(embedding)::INTEGER AS n, {twins.rounded('list_sum(embedding::DOUBLE[])', 4)} AS total FROM embeddings")
def pgvector_text(spark, d):
    back = exprs.from_pgvector_text(exprs.pgvector_text(F.col("embedding")))
    total = F.aggregate("v", F.lit(0.0), lambda t, x: t + x)
    return embeddings(spark, d).select("vec_id", back.alias("v")).select("vec_id", F.size("v").alias("n"), rounded(total, 4).alias("total"))


# Search


@query("topk_cosine", twins.top_k("embeddings", "embedding", K))
def topk_cosine(spark, d):
    found = top_k(embeddings(spark, d), first_vector(spark, d), K)
    return found.select("vec_id", rounded(F.col("score")).alias("score"))


@query("topk_distance", f"SELECT vec_id, {twins.rounded('1 - score')} AS distance FROM ({twins.top_k('embeddings', 'embedding', K)})")
def topk_distance(spark, d):
    found = topk_cosine(spark, d)
    return found.select("vec_id", rounded(1 - F.col("score")).alias("distance"))


@query("topk_filtered_label", twins.top_k("embeddings", "embedding", K, "label = 3"))
def topk_filtered_label(spark, d):
    found = top_k(embeddings(spark, d).where("label = 3"), first_vector(spark, d), K)
    return found.select("vec_id", rounded(F.col("score")).alias("score"))


def _neighbours(rows: DataFrame, queries: DataFrame, stride: int, vector: str = "embedding", n_rows: int | None = None) -> DataFrame:
    named = rows.select("vec_id", F.col(vector).alias("embedding"))
    return top_k_many(named, queries.where(F.col("vec_id") % stride == 0).select("vec_id", "embedding"), K, exclude_self=True, n_rows=n_rows)


@query("topk_multi_query", f"WITH {twins.neighbours('embeddings', 'embedding', K, STRIDE, 'n')} SELECT query_id, rank, vec_id, {twins.rounded('score')} AS score FROM n")
def topk_multi_query(spark, d):
    rows = embeddings(spark, d)
    return _neighbours(rows, rows, STRIDE).withColumn("score", rounded(F.col("score")))


@query("pairwise_topk_self_excluded", f"WITH {twins.neighbours('embeddings', 'embedding', K, 1, 'n')} SELECT query_id, rank, vec_id, {twins.rounded('score')} AS score FROM n")
def pairwise_topk_self_excluded(spark, d):
    rows = embeddings(spark, d)
    return _neighbours(rows, rows, 1).withColumn("score", rounded(F.col("score")))


for _bits, _residual in CODECS:

    @query(f"topk_after_{_bits}bit{'_residual' if _residual else ''}", f"WITH {twins.restored(_bits, _residual)} {twins.top_k('v', 'vector', K)}")
    def topk_after(spark, d, bits=_bits, residual=_residual):
        rows = embeddings(spark, d).select("vec_id", "embedding")
        found = top_k(round_trip(rows, codec(rows, bits, residual)), first_vector(spark, d), K, vector="vector")
        return found.select("vec_id", rounded(F.col("score")).alias("score"))


# Quality

#: Every stride-th vector as a query against all other rows, before and after.
_PAIRS = f"""pairs AS (SELECT a.vec_id AS query_id, {twins.cosine('a.embedding', 'b.embedding')} AS x, {twins.cosine('a.vector', 'b.vector')} AS y
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {STRIDE} = 0)"""

for _bits, _residual in CODECS:
    _name = f"bw{_bits}{'_residual' if _residual else ''}"
    _v = twins.restored(_bits, _residual)

    @query(f"pearson_rho_{_name}", f"WITH {_v}, {_PAIRS} SELECT {twins.rounded('corr(x, y)')} AS rho FROM pairs")
    def pearson_rho(spark, d, bits=_bits, residual=_residual):
        rows = embeddings(spark, d).select("vec_id", "embedding")
        rho = metrics.query_correlation(round_trip(rows, codec(rows, bits, residual)), F.col("vec_id") % STRIDE == 0, rows.count(), DIMENSION)
        return rho.select(rounded(F.col("rho")).alias("rho"))

    @query(f"mean_rho_{_name}", f"WITH {_v}, {_PAIRS} SELECT {twins.rounded('avg(r)')} AS rho FROM (SELECT corr(x, y) AS r FROM pairs GROUP BY query_id)")
    def mean_rho(spark, d, bits=_bits, residual=_residual):
        rows = embeddings(spark, d).select("vec_id", "embedding")
        each = metrics.query_correlation(round_trip(rows, codec(rows, bits, residual)), F.col("vec_id") % STRIDE == 0, rows.count(), DIMENSION, per_query=True)
        return each.agg(rounded(F.avg("rho")).alias("rho"))

    @query(
        f"recall_at_10_{_name}",
        f"WITH {_v}, {twins.neighbours('embeddings', 'embedding', K, STRIDE, 'near')}, {twins.neighbours('v', 'vector', K, STRIDE, 'got')} "
        f"SELECT {twins.rounded('avg(h)')} AS recall FROM (SELECT near.query_id, count(got.vec_id) / {K}.0 AS h FROM near LEFT JOIN got USING (query_id, vec_id) GROUP BY near.query_id)",
    )
    def recall_at_10(spark, d, bits=_bits, residual=_residual):
        rows = embeddings(spark, d).select("vec_id", "embedding")
        found = _neighbours(round_trip(rows, codec(rows, bits, residual)), rows, STRIDE, "vector", rows.count())
        return metrics.recall(_neighbours(rows, rows, STRIDE), found, K).select(rounded(F.col("recall")).alias("recall"))

    @query(
        f"mse_{_name}",
        f"WITH {_v} SELECT {twins.rounded('avg(pow(a::DOUBLE - b::DOUBLE, 2))', 9)} AS mse FROM (SELECT unnest(embedding) AS a, unnest(vector) AS b FROM v)",
    )
    def mse(spark, d, bits=_bits, residual=_residual):
        rows = embeddings(spark, d).select("vec_id", "embedding")
        return metrics.mean_squared_error(round_trip(rows, codec(rows, bits, residual))).select(rounded(F.col("mse"), 9).alias("mse"))


@query(
    "jaccard_at_10_bw4",
    f"""WITH {twins.restored(4, False)}, {twins.neighbours('embeddings', 'embedding', K, STRIDE, 'near')}, {twins.neighbours('v', 'vector', K, STRIDE, 'got')},
    a AS (SELECT query_id, list(vec_id) AS t FROM near GROUP BY query_id), b AS (SELECT query_id, list(vec_id) AS f FROM got GROUP BY query_id)
    SELECT {twins.rounded('avg(len(list_intersect(t, f))::DOUBLE / len(list_distinct(list_concat(t, f))))')} AS jaccard FROM a JOIN b USING (query_id)""",
)
def jaccard_at_10_bw4(spark, d):
    """Queries as they are against restored rows."""
    rows = embeddings(spark, d).select("vec_id", "embedding")
    found = _neighbours(round_trip(rows, codec(rows, 4, False)), rows, STRIDE, "vector", rows.count())
    return metrics.jaccard(_neighbours(rows, rows, STRIDE), found).select(rounded(F.col("jaccard")).alias("jaccard"))


_RESTORED_PAIRS = f"SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {twins.cosine('a.vector', 'b.vector')} AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {STRIDE} = 0"


@query(
    "jaccard_at_10_bw4_compressed_queries",
    f"""WITH {twins.restored(4, False)}, {twins.neighbours('embeddings', 'embedding', K, STRIDE, 'near')},
    got AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({_RESTORED_PAIRS})) WHERE rank <= {K}),
    a AS (SELECT query_id, list(vec_id) AS t FROM near GROUP BY query_id), b AS (SELECT query_id, list(vec_id) AS f FROM got GROUP BY query_id)
    SELECT {twins.rounded('avg(len(list_intersect(t, f))::DOUBLE / len(list_distinct(list_concat(t, f))))')} AS jaccard FROM a JOIN b USING (query_id)""",
)
def jaccard_at_10_bw4_compressed_queries(spark, d):
    """Queries and rows both restored."""
    rows = embeddings(spark, d).select("vec_id", "embedding")
    restored = round_trip(rows, codec(rows, 4, False)).select("vec_id", F.col("vector").alias("embedding"))
    return metrics.jaccard(_neighbours(rows, rows, STRIDE), _neighbours(restored, restored, STRIDE, n_rows=rows.count())).select(rounded(F.col("jaccard")).alias("jaccard"))


@query(
    "compression_ratio_report",
    """SELECT b::INTEGER AS bit_width, r AS residual, (sum(4 * len(embedding))::DOUBLE / sum(ceil(len(embedding) * b / 8.0) + CASE WHEN r THEN 2 * len(embedding) ELSE 0 END)) AS ratio
    FROM embeddings, (VALUES (2), (4), (8)) b(b), (VALUES (true), (false)) r(r) GROUP BY b, r""",
)
def compression_ratio_report(spark, d):
    rows = serialize_sizes(spark, d).groupBy("bit_width", "residual").agg(F.sum("size_bytes").alias("stored"), F.count(F.lit(1)).alias("n"))
    return rows.select("bit_width", "residual", (F.col("n") * 4 * DIMENSION / F.col("stored")).alias("ratio"))


@query("quality_report")
def quality_report(spark, d):
    """Every method side by side."""
    return baselines.quality_report(embeddings(spark, d), DIMENSION, K, SEED, STRIDE)


@query(
    "latency_percentiles",
    f"""SELECT event_type, count(*) AS n, {twins.rounded('quantile_cont(value, 0.5)')} AS median, {twins.rounded('quantile_cont(value, 0.95)')} AS p95
    FROM events WHERE value IS NOT NULL GROUP BY event_type""",
)
def latency_percentiles(spark, d):
    timings = spark.read.parquet(f"{d}/events.parquet").where("value IS NOT NULL")
    found = metrics.latency_summary(timings, "value", "event_type")
    return found.select("event_type", "n", rounded(F.col("median")).alias("median"), rounded(F.col("p95")).alias("p95"))


for _policy in ("passthrough", "fp16"):
    _kept = "x" if _policy == "passthrough" else f"({twins.half('x::DOUBLE')})::FLOAT"

    @query(f"policy_{_policy}", f"WITH h AS (SELECT vec_id, list_transform(embedding, lambda x: {_kept}) AS h FROM embeddings) {twins.exploded('h', 'h')}")
    def policy(spark, d, policy=_policy):
        rows = embeddings(spark, d).select("vec_id", "embedding")
        own = codec(rows, 4, False)
        back = decompress(compress(rows, own, policy=policy).select("vec_id", "compressed"), own, policy=policy)
        return exploded(back, F.col("vector"))


@query(
    "strided_pairs",
    f"""SELECT a.vec_id AS a, b.vec_id AS b, {twins.rounded(twins.cosine('a.embedding', 'b.embedding'))} AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE a.vec_id % {STRIDE} = 0 AND b.vec_id % {STRIDE} = 0""",
)
def strided_pairs(spark, d):
    return metrics.pair_scores(embeddings(spark, d), restored=None, stride=STRIDE).select("a", "b", rounded(F.col("original")).alias("score"))


@query("finite_check", "SELECT vec_id, len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AS finite FROM embeddings")
def finite_check(spark, d):
    return embeddings(spark, d).select("vec_id", exprs.finite(F.col("embedding")).alias("finite"))


@query("point_lookup", f"SELECT vec_id, label, {twins.rounded('embedding[1]::DOUBLE')} AS first FROM embeddings WHERE vec_id = 7")
def point_lookup(spark, d):
    return embeddings(spark, d).where("vec_id = 7").select("vec_id", "label", rounded(F.col("embedding")[0]).alias("first"))


# Corpus changes

#: All rows are stored already; the new ones have the same ids moved up by half the table, so half of them replace a row and half are new.
_OLD = "SELECT vec_id, label, vec_id AS insert_seq FROM embeddings"
_NEW = "SELECT vec_id + (SELECT count(*) // 2 FROM embeddings) AS vec_id, label + 100 AS label, vec_id AS insert_seq FROM embeddings"


@query(
    "upsert_latest_wins",
    f"""SELECT vec_id, coalesce(n.label, o.label)::INTEGER AS label, coalesce(o.insert_seq, (SELECT max(insert_seq) + 1 FROM ({_OLD})) + n.insert_seq) AS insert_seq
    FROM ({_OLD}) o FULL JOIN ({_NEW}) n USING (vec_id)""",
)
def upsert_latest_wins(spark, d):
    rows = embeddings(spark, d).select("vec_id", "label")
    half = rows.select(F.floor(F.count(F.lit(1)) / 2).alias("half")).scalar()
    old = rows.withColumn("insert_seq", F.col("vec_id"))
    new = rows.select((F.col("vec_id") + half).alias("vec_id"), (F.col("label") + 100).alias("label"), F.col("vec_id").alias("insert_seq"))
    return upsert(old, new)


@query("remove_anti", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 5)")
def remove_anti(spark, d):
    rows = embeddings(spark, d).select("vec_id", "label")
    return rows.join(rows.where("label = 5").select("vec_id"), "vec_id", "left_anti")


@query("contains_semi", "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT o_orderkey FROM orders)")
def contains_semi(spark, d):
    asked = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("vec_id"))
    return embeddings(spark, d).select("vec_id").join(asked, "vec_id", "left_semi")


@query("dup_detect", "SELECT l_orderkey AS vec_id, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def dup_detect(spark, d):
    ids = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("vec_id"))
    return ids.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    "dim_reject",
    """SELECT vec_id::VARCHAR AS vec_id, 'DimensionMismatch' AS error_class, '64 finite values expected, got 32' AS detail FROM embeddings WHERE label = 1""",
)
def dim_reject(spark, d):
    rows = embeddings(spark, d).select("vec_id", F.when(F.col("label") == 1, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"))
    return split_rejects(rows, DIMENSION)[1]


@query("ids_in_insertion_order", "SELECT label, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS ids FROM embeddings GROUP BY label")
def ids_in_insertion_order(spark, d):
    ordered = F.array_sort(F.collect_list("vec_id"))
    return embeddings(spark, d).groupBy("label").agg(joined(ordered).alias("ids"))


@query(
    "label_centroids",
    f"SELECT label, (i - 1)::INTEGER AS pos, {twins.rounded('avg(embedding[i]::DOUBLE)')} AS mean FROM embeddings, range(1, {DIMENSION + 1}) r(i) GROUP BY label, i",
)
def label_centroids(spark, d):
    values = embeddings(spark, d).select("label", F.posexplode("embedding").alias("pos", "x"))
    return values.groupBy("label", "pos").agg(rounded(F.avg(F.col("x").cast("double"))).alias("mean"))


_FOUR = f"[{', '.join(f'{c}::FLOAT' for c in LINEITEM)}]"


@query(
    "quantize_lineitem_4d",
    f"""WITH {twins.codebook(4, f'SELECT unnest({_FOUR}) AS v FROM lineitem')} SELECT array_to_string(q, ',') AS indices, count(*) AS n
    FROM (SELECT {twins.nearest(_FOUR)} AS q FROM lineitem, cb) GROUP BY q""",
)
def quantize_lineitem_4d(spark, d):
    """Codes of four coordinates make one number, which is what is counted."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").select(F.array(*[F.col(c).cast("float") for c in LINEITEM]).alias("v"))
    book = train(items, 4, "v").array

    def coded(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            codes = quantize_values(batch.column(0).flatten().to_numpy(zero_copy_only=False), book).reshape(-1, 4).astype(np.int32)
            found, n = np.unique(codes @ np.array([1, 16, 256, 4096], np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["code", "n"])

    counts = items.mapInArrow(coded, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    digits = [F.shiftright("code", 4 * i).bitwiseAND(F.lit(15)).cast("string") for i in range(4)]
    return counts.select(F.concat_ws(",", *digits).alias("indices"), "n")
