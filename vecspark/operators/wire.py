"""Bytes of compressed vectors: bit packing, single records and corpus file headers.

A record is: version, configuration hash (64 bytes, NUL padded), dimension,
bit width, packed indices, residual flag and, if set, the residual's length
and bytes. Integers are little-endian. A corpus file is a header followed by
length-prefixed records.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from vecspark.config import BIT_WIDTHS, MAX_DIMENSION
from vecspark.errors import (
    InvalidBitWidth,
    InvalidHeader,
    InvalidResidualFlag,
    InvalidText,
    LengthMismatch,
    TooLarge,
    Truncated,
    UnknownVersion,
)

#: Fixed values of the formats.
VERSION = 1
HASH_BYTES = 64
MAGIC = b"TQCV"
UNFINISHED = b"TQCX"
MAX_HASH = 256
MAX_METADATA = 16 << 20
MAX_RECORD = 4 << 20
ALIGNMENT = 8

_FRAME = struct.Struct("<B64sIB")
_HEADER = struct.Struct("<4sB3xQIBBH")


def packed_size(dimension: int, bit_width: int) -> int:
    return -(-dimension * bit_width // 8)


def pack(indices: np.ndarray, bit_width: int) -> bytes:
    """Indices in bytes, the first in the lowest bits."""
    if indices.size and int(indices.max()) >= 1 << bit_width:
        raise InvalidBitWidth(f"index {int(indices.max())} does not fit {bit_width} bits")
    per = 8 // bit_width
    padded = np.zeros(-(-len(indices) // per) * per, np.uint8)
    padded[: len(indices)] = indices
    shifts = np.arange(per, dtype=np.uint8) * bit_width
    return np.bitwise_or.reduce(padded.reshape(-1, per) << shifts, axis=1).astype(np.uint8).tobytes()


def unpack(data: bytes, dimension: int, bit_width: int) -> np.ndarray:
    if len(data) != packed_size(dimension, bit_width):
        raise LengthMismatch(f"{packed_size(dimension, bit_width)} packed bytes expected, got {len(data)}")
    shifts = np.arange(8 // bit_width, dtype=np.uint8) * bit_width
    spread = np.frombuffer(data, np.uint8)[:, None] >> shifts
    return (spread & np.uint8((1 << bit_width) - 1)).ravel()[:dimension]


@dataclass(frozen=True)
class Record:
    config_hash: str
    dimension: int
    bit_width: int
    indices: bytes
    residual: bytes | None = None

    @property
    def size_bytes(self) -> int:
        return packed_size(self.dimension, self.bit_width) + len(self.residual or b"")


def encode(record: Record) -> bytes:
    name = record.config_hash.encode()
    if len(name) > HASH_BYTES:
        raise InvalidHeader(f"the configuration hash has {len(name)} bytes")
    if len(record.indices) != record.dimension:
        raise LengthMismatch(f"{record.dimension} indices expected, got {len(record.indices)}")
    if record.residual is not None and len(record.residual) != 2 * record.dimension:
        raise LengthMismatch(f"{2 * record.dimension} residual bytes expected, got {len(record.residual)}")
    packed = pack(np.frombuffer(record.indices, np.uint8), record.bit_width)
    tail = b"\0" if record.residual is None else b"\1" + struct.pack("<I", len(record.residual)) + record.residual
    return _FRAME.pack(VERSION, name, record.dimension, record.bit_width) + packed + tail


def decode_first(data: bytes | memoryview) -> tuple[Record, int]:
    """The record at the beginning of `data`, and its length."""
    view = memoryview(data)
    if len(view) < _FRAME.size:
        raise Truncated(f"{_FRAME.size} bytes of frame expected, got {len(view)}")
    version, name, dimension, bit_width = _FRAME.unpack_from(view)
    if version != VERSION:
        raise UnknownVersion(f"record version {version}")
    if bit_width not in BIT_WIDTHS:
        raise InvalidBitWidth(f"bit width {bit_width}")
    try:
        config_hash = name.rstrip(b"\0").decode()
    except UnicodeDecodeError as bad:
        raise InvalidText("the configuration hash is not UTF-8") from bad
    flag_at = _FRAME.size + packed_size(dimension, bit_width)
    if len(view) <= flag_at:
        raise Truncated("the record ends within its indices")
    indices = unpack(bytes(view[_FRAME.size : flag_at]), dimension, bit_width).tobytes()
    flag = view[flag_at]
    if flag == 0:
        return Record(config_hash, dimension, bit_width, indices), flag_at + 1
    if flag != 1:
        raise InvalidResidualFlag(f"residual flag {flag}")
    if len(view) < flag_at + 5:
        raise Truncated("the record ends before its residual's length")
    (size,) = struct.unpack_from("<I", view, flag_at + 1)
    end = flag_at + 5 + size
    if len(view) < end:
        raise Truncated("the record ends within its residual")
    if size != 2 * dimension:
        raise LengthMismatch(f"{2 * dimension} residual bytes expected, got {size}")
    return Record(config_hash, dimension, bit_width, indices, bytes(view[flag_at + 5 : end])), end


def decode(data: bytes) -> Record:
    record, size = decode_first(data)
    if size != len(data):
        raise LengthMismatch(f"{len(data) - size} bytes after the record")
    return record


def records(data: bytes):
    """All records of concatenated bytes, one after the other."""
    view = memoryview(data)
    while len(view):
        record, size = decode_first(view)
        yield record
        view = view[size:]


@dataclass(frozen=True)
class CorpusHeader:
    count: int
    dimension: int
    bit_width: int
    residual: bool
    config_hash: str
    metadata: bytes = b""

    def to_bytes(self, finished: bool = True) -> bytes:
        name = self.config_hash.encode()
        if len(name) > MAX_HASH or len(self.metadata) > MAX_METADATA:
            raise TooLarge("configuration hash or metadata")
        magic = MAGIC if finished else UNFINISHED
        fixed = _HEADER.pack(magic, VERSION, self.count, self.dimension, self.bit_width, self.residual, len(name))
        body = fixed + name + struct.pack("<I", len(self.metadata)) + self.metadata
        return body + b"\0" * (-len(body) % ALIGNMENT)

    @property
    def record_limit(self) -> int:
        """The most bytes that a record of this file can have."""
        size = _FRAME.size + packed_size(self.dimension, self.bit_width) + 1 + self.residual * (4 + 2 * self.dimension)
        return min(size, MAX_RECORD)

    def admit(self, record: Record) -> Record:
        """`record`, if it agrees with the header."""
        own = (self.config_hash, self.dimension, self.bit_width, self.residual)
        if own != (record.config_hash, record.dimension, record.bit_width, record.residual is not None):
            raise InvalidHeader("a record differs from its file's header")
        return record


def read_header(data: bytes) -> tuple[CorpusHeader, int]:
    """The header of a corpus file, and where the records begin."""
    if len(data) < _HEADER.size:
        raise Truncated("the file ends within its header")
    magic, version, count, dimension, bit_width, residual, name_size = _HEADER.unpack_from(data)
    if magic == UNFINISHED:
        raise Truncated("the file was not finished")
    if magic != MAGIC:
        raise InvalidHeader("no corpus file")
    if version != VERSION:
        raise UnknownVersion(f"file version {version}")
    if data[5:8] != b"\0\0\0" or residual > 1 or not 1 <= dimension <= MAX_DIMENSION:
        raise InvalidHeader("reserved bytes, residual flag or dimension")
    if bit_width not in BIT_WIDTHS:
        raise InvalidBitWidth(f"bit width {bit_width}")
    if name_size > MAX_HASH:
        raise TooLarge(f"configuration hash of {name_size} bytes")
    at = _HEADER.size + name_size
    if len(data) < at + 4:
        raise Truncated("the file ends within its header")
    (meta_size,) = struct.unpack_from("<I", data, at)
    if meta_size > MAX_METADATA:
        raise TooLarge(f"metadata of {meta_size} bytes")
    end = at + 4 + meta_size
    start = end + -end % ALIGNMENT
    if len(data) < start:
        raise Truncated("the file ends within its header")
    try:
        name = data[_HEADER.size : at].decode()
    except UnicodeDecodeError as bad:
        raise InvalidText("the configuration hash is not UTF-8") from bad
    return CorpusHeader(count, dimension, bit_width, bool(residual), name, data[at + 4 : end]), start


def corpus_records(data: bytes, header: CorpusHeader, at: int):
    """The records behind a header; the count, sizes and fields must agree with it."""
    for _ in range(header.count):
        if len(data) < at + 4:
            raise Truncated("the file ends before its last record")
        (size,) = struct.unpack_from("<I", data, at)
        if size > header.record_limit:
            raise TooLarge(f"record of {size} bytes")
        if len(data) < at + 4 + size:
            raise Truncated("the file ends within a record")
        yield header.admit(decode(data[at + 4 : at + 4 + size]))
        at += 4 + size
    if at != len(data):
        raise LengthMismatch(f"{len(data) - at} bytes after the last record")
