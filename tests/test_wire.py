from __future__ import annotations

import hashlib
import struct

import numpy as np
import pytest

from vecspark import errors
from vecspark.config import CodecConfig
from vecspark.functions import exprs
from vecspark.operators import wire

# Records of default_rng(42) indices and residuals.
RECORDS = [
    (4, 768, True, 1995, "b564564aad95b4ed5862b4b882fd6d87aa6efec5d55a02cbdcc018014693d4a7"),
    (2, 768, False, 263, "e758a5c3ffed50692a1335db168a453fb16a6b27b9a251223cdda13df33012b0"),
    (8, 768, False, 839, "02e448be9fe74bb9fb4b77417f0ebfc7c3d51c812c5f7e6355b198b914ecacca"),
    (4, 1, False, 72, "e06b5e3255749da45b9d6cf8e41c5e949fa712384435e050dc4bdc7a0e5acfec"),
    (2, 17, True, 114, "8f19371a52ef0ddb17169406e19ba111283c42257a65ce175ae22d9dfa367f1b"),
    (4, 15, False, 79, "632d66e429e54d9b0190a58dad3c87be2dddd7849b32cb4b5d61282918162709"),
    (8, 1536, True, 4683, "dc15be245fa991c3d48eccb03a0070734294e37a357f8de161257b80ad57e840"),
    (4, 768, False, 455, "874257fea50bd924c992e5e5ef9050064f941fdbaf7dca1bd69c7cb79d980725"),
    (2, 16, False, 75, "abc245cd76254dd5387bd823f38f74a82356d4766fadc612954fedd43d593d4b"),
    (4, 16, True, 115, "209103e798ed92c7267c3c2a4845b843a8683a6dc0d1498bb7b398e94747673a"),
]


def record(bits: int, dimension: int, residual: bool) -> wire.Record:
    rng = np.random.default_rng(42)
    indices = rng.integers(0, 1 << bits, size=dimension, dtype=np.uint8).tobytes()
    return wire.Record(CodecConfig(bits, 42, dimension, residual).config_hash, dimension, bits, indices, rng.bytes(2 * dimension) if residual else None)


@pytest.mark.parametrize("bits,dimension,residual,size,digest", RECORDS)
def test_records(bits, dimension, residual, size, digest):
    own = record(bits, dimension, residual)
    data = wire.encode(own)
    assert (len(data), hashlib.sha256(data).hexdigest()) == (size, digest)
    assert wire.decode(data) == own


def test_packing_order():
    assert wire.pack(np.array([0, 15, 5, 10], np.uint8), 4) == bytes([0xF0, 0xA5])
    assert wire.pack(np.array([0, 1, 2, 3], np.uint8), 2) == bytes([0xE4])


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_native_packing_agrees(spark, bits):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(bits)
    rows = [rng.integers(0, 1 << bits, size=n).tolist() for n in (1, 2, 3, 7, 8, 64)]
    df = spark.createDataFrame([(r,) for r in rows], "q array<int>").withColumn("p", exprs.pack(F.col("q"), bits))
    for row in df.withColumn("u", exprs.unpack(F.col("p"), bits, F.size("q"))).collect():
        assert bytes(row["p"]) == wire.pack(np.array(row["q"], np.uint8), bits)
        assert row["u"] == row["q"]


def damaged():
    good = wire.encode(record(4, 16, True))
    yield "short", good[:40], errors.Truncated
    yield "version", b"\x02" + good[1:], errors.UnknownVersion
    yield "width", good[:69] + b"\x03" + good[70:], errors.InvalidBitWidth
    yield "text", good[:1] + b"\xff" * 64 + good[65:], errors.InvalidText
    yield "flag", good[:78] + b"\x02" + good[79:], errors.InvalidResidualFlag
    yield "residual", good[:-1], errors.Truncated
    yield "length", good[:79] + struct.pack("<I", 30) + good[83:113], errors.LengthMismatch
    yield "tail", good + b"x", errors.LengthMismatch


@pytest.mark.parametrize("name,data,error", list(damaged()), ids=lambda x: x if isinstance(x, str) else "")
def test_damaged_records(name, data, error):
    with pytest.raises(error):
        wire.decode(data)


def test_record_cursor():
    own = [record(4, 16, True), record(4, 16, False), record(2, 17, True)]
    assert list(wire.records(b"".join(map(wire.encode, own)))) == own


def corpus_file(header: wire.CorpusHeader, own: list[wire.Record], finished: bool = True) -> bytes:
    bodies = [wire.encode(r) for r in own]
    return header.to_bytes(finished) + b"".join(struct.pack("<I", len(b)) + b for b in bodies)


def test_corpus_file_checks():
    own = record(4, 16, True)
    header = wire.CorpusHeader(2, 16, 4, True, own.config_hash, b'{"a":1}')
    data = corpus_file(header, [own, own])
    read, at = wire.read_header(data)
    assert read == header and at % 8 == 0 and list(wire.corpus_records(data, read, at)) == [own, own]
    for bad, error in (
        (corpus_file(header, [own, own], finished=False), errors.Truncated),
        (b"XXXX" + data[4:], errors.InvalidHeader),
        (data[:5] + b"\1" + data[6:], errors.InvalidHeader),
        (data[:16] + struct.pack("<I", 0) + data[20:], errors.InvalidHeader),
        (data[:-3], errors.Truncated),
        (data + b"x", errors.LengthMismatch),
        (data[:20], errors.Truncated),
    ):
        with pytest.raises(error):
            found, start = wire.read_header(bad)
            list(wire.corpus_records(bad, found, start))
    foreign = corpus_file(header, [own, record(4, 16, False)])
    with pytest.raises(errors.InvalidHeader):
        list(wire.corpus_records(foreign, read, at))
    with pytest.raises(errors.TooLarge):
        list(wire.corpus_records(data[:at] + struct.pack("<I", 1 << 30) + data[at + 4 :], read, at))
