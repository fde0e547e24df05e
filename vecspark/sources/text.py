"""Vectors in CSV and JSON lines, and as pgvector text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.errors import InvalidIdentifier, NonFiniteValue
from vecspark.functions import exprs

#: Fixed value: names that may stand in a statement.
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}")


def _same_width(v: Column, width: int | None) -> Column:
    return v if width is None else exprs.checked_dimension(v, width)


def read_csv(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """(vector) of headerless lines of numbers; blank lines are skipped. The first line's width is expected unless given."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    vector = F.transform(F.split("value", ","), lambda x: F.trim(x).cast("float"))
    if width is None:
        first = lines.first()
        width = len(first["value"].split(",")) if first else None
    return lines.select(_same_width(vector, width).alias("vector"))


def write_csv(df: DataFrame, path: str, vector: str = "vector") -> None:
    df.select(exprs.csv_text(F.col(vector)).alias("value")).write.text(path)


def read_jsonl(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """(id, vector, metadata) of JSON lines; blank lines are skipped; metadata stays JSON text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(
        F.from_json("value", "id string, vector array<float>", {"mode": "FAILFAST"}).alias("r"), F.get_json_object("value", "$.metadata").alias("metadata")
    )
    if width is None:
        first = parsed.select(F.size("r.vector").alias("n")).first()
        width = first["n"] if first else None
    return parsed.select(F.col("r.id").alias("id"), _same_width(F.col("r.vector"), width).alias("vector"), "metadata")


def write_jsonl(df: DataFrame, path: str, id_col: str = "id", vector: str = "vector") -> None:
    df.select(F.to_json(F.struct(F.col(id_col).cast("string").alias("id"), F.col(vector).alias("vector"))).alias("value")).write.text(path)


def checked_identifier(name: str) -> str:
    if not IDENTIFIER.fullmatch(name):
        raise InvalidIdentifier(name)
    return name


def pgvector_ddl(table: str, dimension: int, lists: int = 100) -> list[str]:
    """Statements that create a vector table and its cosine index."""
    name = checked_identifier(table)
    if dimension < 1 or lists < 1:
        raise ValueError("dimension and lists must be positive")
    return [
        "CREATE EXTENSION IF NOT EXISTS vector",
        f"CREATE TABLE IF NOT EXISTS {name} (id TEXT PRIMARY KEY, embedding vector({dimension}))",
        f"CREATE INDEX IF NOT EXISTS {name}_cosine ON {name} USING ivfflat (embedding vector_cosine_ops) WITH (lists = {lists})",
    ]


def pgvector_upsert(table: str) -> str:
    """The statement for one row; parameters are id and vector text."""
    name = checked_identifier(table)
    return f"INSERT INTO {name} (id, embedding) VALUES (%s, %s::vector) ON CONFLICT (id) DO UPDATE SET embedding = EXCLUDED.embedding"


def pgvector_query(table: str, query: list[float], k: int) -> str:
    """A search that the database answers, for spark.read.jdbc(query=...)."""
    text = "[" + ",".join(f"{float(x):.7e}" for x in query) + "]"
    return f"SELECT id, 1 - (embedding <=> '{text}') AS score FROM {checked_identifier(table)} ORDER BY embedding <=> '{text}' LIMIT {int(k)}"


def read_pgvector(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def write_pgvector(df: DataFrame, connect, table: str, id_col: str = "vec_id", vector: str = "vector", batch: int = 1000) -> None:
    """Upserts (id, vector) in batches of statements; `connect` opens a DB-API connection in each task.

    All vectors are checked to be finite before any connection is opened.
    """
    statement = pgvector_upsert(table)
    if not df.where(~exprs.finite(F.col(vector))).isEmpty():
        raise NonFiniteValue("a vector has a value that is not finite")
    rows = df.select(F.col(id_col).cast("string"), exprs.pgvector_text(F.col(vector)))

    def send(part) -> None:
        held: list[tuple] = []
        link = None
        for row in part:
            held.append(tuple(row))
            if len(held) == batch:
                link = link or connect()
                link.cursor().executemany(statement, held)
                held = []
        if held:
            link = link or connect()
            link.cursor().executemany(statement, held)
        if link:
            link.commit()
            link.close()

    rows.foreachPartition(send)


def formatted_results(df: DataFrame, kind: str) -> DataFrame:
    """Search results (vec_id, score) as lines (value) of `json` or `csv`."""
    if kind == "json":
        return df.select(F.to_json(F.struct("vec_id", "score")).alias("value"))
    if kind == "csv":
        return df.select(F.concat_ws(",", F.col("vec_id").cast("string"), F.format_string("%.9f", "score")).alias("value"))
    raise ValueError(f"format {kind!r} is neither json nor csv")
