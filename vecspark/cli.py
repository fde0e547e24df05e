"""Command line: info, codec train|compress|decompress, corpus ingest|decompress|search, verify.

Exit codes: 0 done, 2 bad arguments, 3 input or output, 4 damaged or mismatched data, 70 internal.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark import __version__
from vecspark.config import BIT_WIDTHS, MAX_DIMENSION, CodecConfig
from vecspark.errors import FormatError, VecsparkError
from vecspark.operators.codebook import train
from vecspark.operators.codec import Codec, compress, decompress
from vecspark.operators.search import top_k
from vecspark.session import session
from vecspark.sources import binary, text

OK, USAGE, IO, DATA, INTERNAL = 0, 2, 3, 4, 70


def _matrix(spark: SparkSession, path: str, args: argparse.Namespace) -> DataFrame:
    """(row, vector) of a matrix file of any format."""
    if path.endswith(".csv"):
        rows = text.read_csv(spark, path)
    elif path.endswith((".jsonl", ".json")):
        rows = text.read_jsonl(spark, path)
    else:
        options = {"path": path} | ({"cols": args.cols} if args.cols else {}) | ({"rows": args.rows} if args.rows else {})
        return spark.read.format("f32").options(**options).load()
    return rows.withColumn("row", F.monotonically_increasing_id()).select("row", "vector")


def _codec(args: argparse.Namespace) -> Codec:
    return Codec(binary.read_config(args.config), binary.read_codebook(args.codebook))


def _write_matrix(df: DataFrame, path: str) -> None:
    if path.endswith(".csv"):
        text.write_csv(df, path)
    elif path.endswith((".jsonl", ".json")):
        text.write_jsonl(df.withColumnRenamed("record", "id"), path)
    else:
        out = df.select(F.col("record").alias("row"), "vector").write.format("f32").mode("overwrite")
        out.options(path=path, **({"layout": "npy"} if path.endswith("npy") else {})).save()


def _info(spark, args) -> None:
    print(json.dumps({"version": __version__, "spark": spark.version, "bit_widths": BIT_WIDTHS, "max_dimension": MAX_DIMENSION}))


def _train(spark, args) -> None:
    rows = _matrix(spark, args.input, args)
    dimension = rows.select(F.size("vector").alias("n")).first()["n"]
    config = CodecConfig(args.bit_width, args.seed, dimension, not args.no_residual)
    binary.write_codebook(args.codebook, train(rows, args.bit_width, "vector"))
    binary.write_config(args.config, config)


def _compress(spark, args) -> None:
    coded = compress(_matrix(spark, args.input, args), _codec(args), "vector", policy=args.policy)
    ordered = coded.select(F.col("row").alias("record"), "compressed")
    metadata = json.dumps({"policy": args.policy})
    ordered.write.format("tqcv").mode("overwrite").option("path", args.output).option("metadata", metadata).save()


def _restored(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """(record, vector) of a corpus, by the policy that its header names."""
    stored = spark.read.format("tqcv").option("path", args.input).load()
    policy = json.loads(binary.corpus_metadata(args.input) or b"{}").get("policy", "compress")
    return decompress(stored, _codec(args), policy=policy).select("record", "vector")


def _decompress(spark, args) -> None:
    _write_matrix(_restored(spark, args), args.output)


def _search(spark, args) -> None:
    rows = _restored(spark, args).select(F.col("record").cast("string").alias("vec_id"), "vector")
    found = top_k(rows, binary.read_vector(args.query).tolist(), args.k, vector="vector")
    if args.format == "table":
        found.show(args.k, truncate=False)
    else:
        for row in text.formatted_results(found, args.format).collect():
            print(row["value"])


def _verify(spark, args) -> None:
    print(json.dumps(binary.verify(args.input)))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vecspark")
    top.add_argument("--master")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("info").set_defaults(run=_info)

    def command(group, name: str, run, *names: str) -> argparse.ArgumentParser:
        found = group.add_parser(name)
        found.set_defaults(run=run)
        for n in names:
            found.add_argument(f"--{n}", required=True)
        found.add_argument("--rows", type=int)
        found.add_argument("--cols", type=int)
        found.set_defaults(policy="compress")
        if run is _compress:
            found.add_argument("--policy", choices=["compress", "passthrough", "fp16"], default="compress")
        return found

    codec = commands.add_parser("codec").add_subparsers(dest="step", required=True)
    trained = command(codec, "train", _train, "input", "codebook", "config")
    trained.add_argument("--bit-width", type=int, choices=BIT_WIDTHS, default=4)
    trained.add_argument("--seed", type=int, default=42)
    trained.add_argument("--no-residual", action="store_true")
    command(codec, "compress", _compress, "input", "codebook", "config", "output")
    command(codec, "decompress", _decompress, "input", "codebook", "config", "output")
    corpus = commands.add_parser("corpus").add_subparsers(dest="step", required=True)
    command(corpus, "ingest", _compress, "input", "codebook", "config", "output")
    command(corpus, "decompress", _decompress, "input", "codebook", "config", "output")
    search = command(corpus, "search", _search, "input", "codebook", "config", "query")
    search.add_argument("-k", type=int, default=10)
    search.add_argument("--format", choices=["json", "csv", "table"], default="json")
    command(commands, "verify", _verify, "input")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as stop:
        return int(stop.code or 0)
    try:
        spark = spark or session(args.master)
        binary.register(spark)
        args.run(spark, args)
    except OSError as failed:
        print(failed, file=sys.stderr)
        return IO
    except (FormatError, VecsparkError) as failed:
        print(f"{type(failed).__name__}: {failed}", file=sys.stderr)
        return DATA
    except Exception as failed:
        print(failed, file=sys.stderr)
        return INTERNAL
    return OK


if __name__ == "__main__":
    sys.exit(main())
