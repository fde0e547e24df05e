"""Spark data sources for raw float matrices, .npy files and corpus files.

    spark.dataSource.register(MatrixSource)      # format("f32") and, by its suffix, .npy
    spark.dataSource.register(CorpusSource)      # format("tqcv")

Matrices are read by ranges of rows, corpus files by ranges of records, so
that one large file feeds many tasks. A write makes a file per task and, on
commit, the index file that names them; a failed write leaves no index.
Paths are those of a file system that all executors mount.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from vecspark.errors import InvalidHeader, LengthMismatch
from vecspark.operators import wire
from vecspark.operators.codebook import Codebook
from vecspark.config import CodecConfig

INDEX = "_files.json"
#: Rows or records in a task, unless the option rows_per_task says otherwise.
ROWS_PER_TASK = 65_536
#: Rows that a writer holds.
WRITTEN = 1024
#: Fixed value: bytes of a .npy header, a multiple of 64.
NPY_HEAD = 128
#: Fixed values of the codebook file.
CODEBOOK_MAGIC = b"TQCB"
_CODEBOOK = struct.Struct("<4sBBHI")


def _files(path: str) -> list[str]:
    """The files that a finished write left, or the one file."""
    if not os.path.isdir(path):
        return [path]
    names = json.loads(Path(path, INDEX).read_text())
    return [os.path.join(path, name) for name in names]


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    last: int
    begin: int = 0


@dataclass
class _Part(WriterCommitMessage):
    name: str
    rows: int


class _FolderWriter(DataSourceWriter):
    suffix = ""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder, self.options, self.overwrite = options["path"], options, overwrite
        os.makedirs(self.folder, exist_ok=True)

    def head(self, rows: int, columns: int) -> bytes:
        """What a file of so many rows begins with; as long for any number of them."""
        return b""

    def write(self, iterator: Iterator) -> _Part:
        """Vectors in batches; the beginning is put right once their number is known."""
        name = f"part-{uuid.uuid4().hex}{self.suffix}"
        try:
            count = self._written(Path(self.folder, name), iterator)
        except BaseException:
            Path(self.folder, name).unlink(missing_ok=True)
            raise
        return _Part(name, count)

    def _written(self, path: Path, iterator: Iterator) -> int:
        count, columns = 0, 0
        with open(path, "wb") as file:
            while some := [row["vector"] for row in islice(iterator, WRITTEN)]:
                block = np.array(some, "<f4")
                if not count:
                    columns = block.shape[1]
                    file.write(self.head(0, columns))
                elif block.shape[1] != columns:
                    raise LengthMismatch(f"{columns} values expected, got {block.shape[1]}")
                file.write(block.tobytes())
                count += len(block)
            file.seek(0)
            file.write(self.head(count, columns) if count else b"")
        if not count:
            path.unlink()
        return count

    def commit(self, messages: list) -> None:
        """The index changes at once; only then do the files go that an overwrite replaces."""
        index = Path(self.folder, INDEX)
        known = json.loads(index.read_text()) if index.exists() else []
        new = [m.name for m in messages if m and m.rows]
        temporary = index.with_suffix(".new")
        temporary.write_text(json.dumps(new if self.overwrite else known + new))
        os.replace(temporary, index)
        for name in known if self.overwrite else ():
            Path(self.folder, name).unlink(missing_ok=True)

    def abort(self, messages: list) -> None:
        for message in messages:
            if message:
                Path(self.folder, message.name).unlink(missing_ok=True)


def _shape(path: str, options: dict) -> tuple[int, int, int]:
    """Rows, columns and where the data begins."""
    if path.endswith(".npy"):
        stored = np.load(path, mmap_mode="r")
        if stored.ndim != 2 or stored.dtype != np.dtype("<f4") or not stored.flags.c_contiguous:
            raise InvalidHeader(f"{path} is no two-dimensional float32 matrix in C order")
        return *stored.shape, stored.offset
    columns, size = int(options["cols"]), os.path.getsize(path)
    rows = int(options.get("rows", size // (4 * columns)))
    if rows * columns * 4 != size:
        raise LengthMismatch(f"{rows * columns * 4} bytes expected, {path} has {size}")
    return rows, columns, 0


class _MatrixReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        parts, before, step = [], 0, int(self.options.get("rows_per_task", ROWS_PER_TASK))
        for path in _files(self.options["path"]):
            rows = _shape(path, self.options)[0]
            parts += [_Range(path, i, min(rows, i + step), before) for i in range(0, rows, step)]
            before += rows
        return parts or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part.last == part.first:
            return
        rows, columns, offset = _shape(part.path, self.options)
        matrix = np.memmap(part.path, "<f4", "r", offset, (rows, columns))[part.first : part.last]
        offsets = pa.array(np.arange(0, matrix.size + 1, columns, dtype=np.int32))
        vectors = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part.begin + np.arange(part.first, part.last)), vectors], names=["row", "vector"])


class _MatrixWriter(_FolderWriter):
    """Raw values."""


class _NpyWriter(_FolderWriter):
    suffix = ".npy"

    def head(self, rows: int, columns: int) -> bytes:
        described = f"{{'descr': '<f4', 'fortran_order': False, 'shape': ({rows}, {columns}), }}"
        return b"\x93NUMPY\x01\x00" + struct.pack("<H", NPY_HEAD - 10) + described.ljust(NPY_HEAD - 11).encode() + b"\n"


class MatrixSource(DataSource):
    """(row, vector). Options: path; for raw files cols and perhaps rows. Written as raw files, or .npy with layout=npy."""

    @classmethod
    def name(cls) -> str:
        return "f32"

    def schema(self) -> str:
        return "row long, vector array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _MatrixReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return (_NpyWriter if self.options.get("layout") == "npy" else _MatrixWriter)(self.options, overwrite)


class _CorpusReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """Ranges of records, which are all as long as the header says; none is read here."""
        parts, before, step = [], 0, int(self.options.get("rows_per_task", ROWS_PER_TASK))
        for path in _files(self.options["path"]):
            with open(path, "rb") as file:
                header, at = wire.read_header(file.read(wire.MAX_METADATA + 4096))
            size, held = 4 + header.record_limit, os.path.getsize(path) - at
            if held < header.count * size:
                raise wire.Truncated("the file ends before its last record")
            if held > header.count * size:
                raise LengthMismatch(f"{path} does not end with its last record")
            parts += [_Range(path, before + n, before + min(header.count, n + step), at + n * size) for n in range(0, header.count, step)]
            before += header.count
        return parts or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        if part.last == part.first:
            return
        with open(part.path, "rb") as file:
            header, _ = wire.read_header(file.read(wire.MAX_METADATA + 4096))
            file.seek(part.begin)
            for number in range(part.first, part.last):
                (size,) = struct.unpack("<I", file.read(4))
                if size > header.record_limit:
                    raise wire.TooLarge(f"record of {size} bytes")
                r = header.admit(wire.decode(file.read(size)))
                yield number, (r.indices, r.residual, r.config_hash, r.dimension, r.bit_width)


class _CorpusWriter(_FolderWriter):
    suffix = ".tqcv"

    def write(self, iterator: Iterator) -> _Part:
        """Records behind a header marked unfinished, which is put right once the count is known and all is on disk."""
        name, count, header = f"part-{uuid.uuid4().hex}{self.suffix}", 0, None
        metadata = self.options.get("metadata", "").encode()
        with open(os.path.join(self.folder, name), "wb") as file:
            for row in iterator:
                c = row["compressed"]
                residual = None if c["residual"] is None else bytes(c["residual"])
                record = wire.Record(c["config_hash"], c["dimension"], c["bit_width"], bytes(c["indices"]), residual)
                if header is None:
                    header = wire.CorpusHeader(0, record.dimension, record.bit_width, residual is not None, record.config_hash, metadata)
                    file.write(header.to_bytes(finished=False))
                body = wire.encode(header.admit(record))
                file.write(struct.pack("<I", len(body)) + body)
                count += 1
            if header:
                file.flush()
                os.fsync(file.fileno())
                file.seek(8)
                file.write(struct.pack("<Q", count))
                file.flush()
                os.fsync(file.fileno())
                file.seek(0)
                file.write(wire.MAGIC)
                file.flush()
                os.fsync(file.fileno())
        if not count:
            os.unlink(os.path.join(self.folder, name))
        return _Part(name, count)


class CorpusSource(DataSource):
    """(record, compressed). Options: path, and for writing perhaps metadata."""

    @classmethod
    def name(cls) -> str:
        return "tqcv"

    def schema(self) -> str:
        return "record long, compressed struct<indices:binary,residual:binary,config_hash:string,dimension:int,bit_width:tinyint>"

    def reader(self, schema) -> DataSourceReader:
        return _CorpusReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _CorpusWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatrixSource)
    spark.dataSource.register(CorpusSource)


def read_vector(path: str) -> np.ndarray:
    """One query vector: a raw float file or a .npy of one row."""
    stored = np.load(path) if path.endswith(".npy") else np.fromfile(path, "<f4")
    if stored.ndim == 2 and len(stored) == 1:
        stored = stored[0]
    if stored.ndim != 1 or stored.dtype != np.dtype("<f4"):
        raise InvalidHeader(f"{path} holds no single float32 vector")
    return stored


def write_codebook(path: str, codebook: Codebook) -> None:
    head = _CODEBOOK.pack(CODEBOOK_MAGIC, wire.VERSION, codebook.bit_width, 0, len(codebook.entries))
    Path(path).write_bytes(head + codebook.array.astype("<f4").tobytes())


def read_codebook(path: str) -> Codebook:
    data = Path(path).read_bytes()
    if len(data) < _CODEBOOK.size:
        raise wire.Truncated("the file ends within its header")
    magic, version, bit_width, reserved, count = _CODEBOOK.unpack_from(data)
    if magic != CODEBOOK_MAGIC or reserved:
        raise InvalidHeader("no codebook file")
    if version != wire.VERSION:
        raise wire.UnknownVersion(f"codebook version {version}")
    if len(data) != _CODEBOOK.size + 4 * count:
        raise LengthMismatch(f"{count} entries expected")
    return Codebook(bit_width, tuple(np.frombuffer(data, "<f4", offset=_CODEBOOK.size).tolist()))


def write_config(path: str, config: CodecConfig) -> None:
    names = ("bit_width", "seed", "dimension", "residual_enabled", "config_hash")
    Path(path).write_text(json.dumps({n: getattr(config, n) for n in names}))


def read_config(path: str) -> CodecConfig:
    stored = json.loads(Path(path).read_text())
    return CodecConfig(stored["bit_width"], int(stored["seed"]), stored["dimension"], stored["residual_enabled"])


def corpus_metadata(path: str) -> bytes:
    """What the writer of a corpus put into its header; nothing for an empty corpus."""
    files = _files(path)
    if not files:
        return b""
    with open(files[0], "rb") as file:
        return wire.read_header(file.read(wire.MAX_METADATA + 4096))[0].metadata


def verify(path: str) -> dict:
    """What a corpus, codebook or configuration file holds; raises if it is damaged."""
    data = Path(path).read_bytes()
    if data[:4] == CODEBOOK_MAGIC:
        return {"kind": "codebook", "bit_width": read_codebook(path).bit_width}
    if data[:4] in (wire.MAGIC, wire.UNFINISHED):
        header, at = wire.read_header(data)
        return {"kind": "corpus", "records": sum(1 for _ in wire.corpus_records(data, header, at)), "config_hash": header.config_hash}
    return {"kind": "config", "config_hash": read_config(path).config_hash}
