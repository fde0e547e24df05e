"""DuckDB SQL of the codec's steps, from which the queries' twins are put together."""

from __future__ import annotations

from vecspark.operators.codebook import fractions
from vecspark.operators.rotation import rotation

SEED = 42
DIMENSION = 64


def matrix(transposed: bool = False, seed: int = SEED, dimension: int = DIMENSION) -> str:
    m = rotation(seed, dimension)
    return str((m.T if transposed else m).tolist()) + "::DOUBLE[][]"


def rounded(value: str, digits: int = 6) -> str:
    return f"round({value}, {digits}) + 0.0"


def cosine(a: str, b: str) -> str:
    return f"coalesce(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 0.0)"


def half(x: str) -> str:
    """Half precision of a double expression, ties to even."""
    unit = f"pow(2.0, greatest(floor(log2(abs({x}))), -14) - 10)"
    return f"CASE WHEN {x} = 0 THEN 0.0 WHEN abs({x}) >= 65520 THEN sign({x}) * 'inf'::DOUBLE ELSE round_even({x} / {unit}, 0) * {unit} END"


def codebook(bit_width: int, values: str = "SELECT unnest(embedding) AS v FROM embeddings") -> str:
    return f"cb AS (SELECT list_transform(quantile_cont(v::DOUBLE, {fractions(bit_width)}), lambda x: x::FLOAT) AS cb FROM ({values}))"


def nearest(vector: str, entries: str = "cb") -> str:
    """Indices of the nearest entries."""
    first = f"list_transform({vector}, lambda x: {{'x': x, 'i': least(len(list_filter({entries}, lambda e: e < x)), len({entries}) - 1)}})"
    nearer = f"abs(p.x - {entries}[greatest(p.i - 1, 0) + 1]) < abs(p.x - {entries}[p.i + 1])"
    return f"list_transform({first}, lambda p: CASE WHEN {nearer} THEN greatest(p.i - 1, 0) ELSE p.i END)"


def turned(vector: str, m: str) -> str:
    return f"list_transform({m}, lambda w: list_dot_product(w, {vector}::DOUBLE[])::FLOAT)"


ROTATED = f"rot AS (SELECT vec_id, embedding, {turned('embedding', 'm')} AS r FROM embeddings, (SELECT {matrix()} AS m))"


def quantized(bit_width: int) -> str:
    return f"{codebook(bit_width)}, {ROTATED}, q AS (SELECT vec_id, embedding, r, cb, {nearest('r')} AS q FROM rot, cb)"


def dequantized(bit_width: int) -> str:
    return f"{quantized(bit_width)}, s AS (SELECT vec_id, embedding, r, list_transform(q, lambda i: cb[i + 1]) AS s FROM q)"


def residuals(bit_width: int) -> str:
    lost = f"list_transform(list_zip(r, s), lambda p: ({half('(p[1] - p[2])::DOUBLE')})::FLOAT)"
    return f"{dequantized(bit_width)}, e AS (SELECT vec_id, embedding, s, {lost} AS e FROM s)"


def restored(bit_width: int, residual: bool) -> str:
    """CTEs that end in v (vec_id, embedding, vector)."""
    if residual:
        steps = f"{residuals(bit_width)}, t AS (SELECT vec_id, embedding, list_transform(list_zip(s, e), lambda p: p[1] + p[2]) AS t FROM e)"
    else:
        steps = f"{dequantized(bit_width)}, t AS (SELECT vec_id, embedding, s AS t FROM s)"
    return f"{steps}, v AS (SELECT vec_id, embedding, {turned('t', 'm')} AS vector FROM t, (SELECT {matrix(transposed=True)} AS m))"


def exploded(table: str, vector: str, digits: int = 6) -> str:
    """(vec_id, pos, value) of a vector column."""
    return (
        f"SELECT vec_id, (pos - 1)::INTEGER AS pos, {rounded(f'{vector}[pos]::DOUBLE', digits)} AS value "
        f"FROM (SELECT vec_id, {vector}, unnest(range(1, len({vector}) + 1)) AS pos FROM {table})"
    )


def top_k(table: str, vector: str, k: int, where: str = "true") -> str:
    """The most similar to the original vector of id 0."""
    score = cosine(vector, "(SELECT embedding FROM embeddings WHERE vec_id = 0)")
    return f"SELECT vec_id, {rounded('score')} AS score FROM (SELECT vec_id, {score} AS score FROM {table} WHERE {where}) ORDER BY score DESC, vec_id LIMIT {k}"


def neighbours(table: str, vector: str, k: int, stride: int, name: str) -> str:
    """CTE `name` (query_id, rank, vec_id, score): the nearest of every stride-th original vector, itself left out."""
    pairs = f"SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {cosine('a.embedding', f'b.{vector}')} AS score FROM embeddings a JOIN {table} b ON a.vec_id <> b.vec_id WHERE a.vec_id % {stride} = 0"
    return f"{name} AS (SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM ({pairs})) WHERE rank <= {k})"
