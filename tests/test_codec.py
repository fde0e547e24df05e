from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from vecspark import errors
from vecspark.config import CodecConfig
from vecspark.functions import exprs
from vecspark.operators import codec as c
from vecspark.operators.codebook import Codebook, fractions, train, train_approximate, train_rotated
from vecspark.operators.rotation import is_orthogonal, rotation

# Configuration hashes.
HASHES = [
    (2, 0, 1, False, "335c7708f196aa2c9c06d9d111201297c14cc1cf51e10bb010352042724c9039"),
    (2, 42, 1, True, "1ed563582d92fec2f727bf99f65418c19535cce6d65bc8909e5bd993b7de74e1"),
    (2, 18446744073709551615, 32, False, "854f168e7487184457b2160d0655ccb15283681369b433f8bb0ba7f8da7cea60"),
    (4, 1, 32, True, "d4ff9dd43b6276712637bebce4fdc209593213df7e98ac30da0e63eb848d09b7"),
    (4, 999, 768, False, "1a690e47da5a292b89079b6995acd5995947559fd3998363f455a352742624ec"),
    (8, 0, 768, True, "e46ad724774d0650dad8be6f322d46774ad999dc1c5cb109b0b435ee909e6f71"),
    (8, 42, 1536, False, "2b9888165666a10e3563dffaf8d681622a43402b08176da1a101a928af4d5897"),
]


@pytest.mark.parametrize("bits,seed,dimension,residual,expected", HASHES)
def test_config_hash(bits, seed, dimension, residual, expected):
    assert CodecConfig(bits, seed, dimension, residual).config_hash == expected


@pytest.mark.parametrize(
    "bits,seed,dimension,error",
    [(3, 0, 4, errors.UnsupportedBitWidth), (4, -1, 4, errors.InvalidSeed), (4, 2**64, 4, errors.InvalidSeed), (4, 0, 0, errors.InvalidDimension), (4, 0, 16385, errors.InvalidDimension)],
)
def test_config_limits(bits, seed, dimension, error):
    with pytest.raises(error):
        CodecConfig(bits, seed, dimension)


def test_rotation_is_seeded_and_orthogonal():
    assert is_orthogonal(rotation(1, 48))
    assert not np.allclose(rotation(1, 8), rotation(2, 8))
    assert not is_orthogonal(rotation(1, 8) * 1.1)


@pytest.mark.parametrize(
    "entries,error",
    [([0, 1, 2], errors.CodebookEntryCount), ([0, 2, 1, 3], errors.CodebookNotSorted), ([0, 1, 1, 3], errors.CodebookDuplicate), ([0, 1, 2, float("nan")], errors.CodebookNotSorted)],
)
def test_codebook_limits(entries, error):
    with pytest.raises(error):
        Codebook(2, tuple(entries))


@pytest.fixture(scope="module")
def vectors(spark):
    rows = np.random.default_rng(11).standard_normal((300, 16)).astype(np.float32)
    return rows, spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(rows)], "vec_id long, embedding array<float>").repartition(5)


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_training_equals_numpy(vectors, bits):
    rows, df = vectors
    expected = np.quantile(rows.astype(np.float64), fractions(bits)).astype(np.float32)
    assert np.array_equal(train(df, bits).array, expected)


def test_approximate_training_is_near(vectors):
    rows, df = vectors
    expected = np.quantile(rows.astype(np.float64), fractions(4))
    assert np.abs(train_approximate(df, 4).array - expected).max() < 0.01


def test_training_needs_distinct_finite_values(spark):
    few = spark.createDataFrame([([1.0, 1.0, 2.0, 2.0],)], "embedding array<float>")
    with pytest.raises(errors.InsufficientTrainingData):
        train(few, 2)
    with pytest.raises(errors.InsufficientTrainingData):
        train(few.limit(0), 2)
    with pytest.raises(errors.NonFiniteValue):
        train(spark.createDataFrame([([1.0, float("nan"), 3.0, 4.0],)], "embedding array<float>"), 2)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-3, 3, width=32), min_size=1, max_size=20), st.sets(st.floats(-2, 2, width=32), min_size=4, max_size=4))
def test_quantize_is_nearest_and_ties_go_up(values, entries):
    book = np.sort(np.array(list(entries), np.float32))
    for value, index in zip(np.array(values, np.float32), c.quantize(np.array(values, np.float32), book), strict=True):
        distance = np.abs(value - book)
        assert distance[index] == distance.min() or abs(distance[index] - distance.min()) < 1e-6
        if index + 1 < 4 and book[0] <= value <= book[-1]:
            assert not distance[index + 1] < distance[index]


def test_tie_takes_the_greater_entry():
    assert c.quantize(np.array([0.5], np.float32), np.array([0, 1, 2, 3], np.float32)).tolist() == [1]


@pytest.mark.parametrize("bits", [2, 4, 8])
@pytest.mark.parametrize("residual", [False, True])
def test_arrow_and_native_paths_agree(spark, vectors, bits, residual):
    rows, df = vectors
    own = c.Codec(CodecConfig(bits, 42, 16, residual), train(df, bits))
    coded = c.compress(df, own)
    stored = {r["vec_id"]: r["compressed"] for r in coded.select("vec_id", "compressed").collect()}
    book, turn = exprs.vector_literal(own.codebook.entries), exprs.matrix_literal(own.matrix)
    native = df.withColumn("r", exprs.rotate(F.col("embedding"), turn)).withColumn("q", exprs.quantize(F.col("r"), book))
    native = native.withColumn("s", exprs.dequantize(F.col("q"), book)).withColumn("e", exprs.residual(F.col("r"), F.col("s")))
    for row in native.collect():
        assert list(stored[row["vec_id"]]["indices"]) == row["q"]
        if residual:
            assert np.array_equal(np.frombuffer(stored[row["vec_id"]]["residual"], "<f2"), np.array(row["e"], "<f2"))
    back = {r["vec_id"]: r["vector"] for r in c.decompress(coded, own).collect()}
    limit = 2e-3 if residual else {2: 4.0, 4: 1.5, 8: 1.0}[bits]
    assert max(np.abs(np.array(back[i]) - rows[i]).max() for i in back) < limit
    once = {r["vec_id"]: r["vector"] for r in c.round_trip(df, own).collect()}
    assert once == back


def test_results_do_not_depend_on_partitions(vectors):
    _, df = vectors
    own = c.Codec(CodecConfig(4, 1, 16, True), train(df, 4))
    key = lambda frame: sorted((r["vec_id"], bytes(r["compressed"]["indices"])) for r in c.compress(frame, own).collect())
    assert key(df) == key(df.coalesce(1)) == key(df.repartition(9))


def test_policies_store_bytes(vectors):
    rows, df = vectors
    own = c.Codec(CodecConfig(4, 1, 16), train(df, 4))
    for policy, tolerance in (("passthrough", 0.0), ("fp16", 2e-3)):
        back = c.decompress(c.compress(df, own, policy=policy), own, policy=policy).collect()
        assert max(np.abs(np.array(r["vector"]) - rows[r["vec_id"]]).max() for r in back) <= tolerance
    with pytest.raises(ValueError):
        c.compress(df, own, policy="zip")


def test_foreign_and_wrong_records_are_refused(spark, vectors):
    _, df = vectors
    book = train(df, 4)
    own, other = c.Codec(CodecConfig(4, 1, 16), book), c.Codec(CodecConfig(4, 2, 16), book)
    with pytest.raises(PythonException, match="ConfigMismatch"):
        c.decompress(c.compress(df, own), other).count()
    with pytest.raises(PythonException, match="DimensionMismatch"):
        c.compress(spark.createDataFrame([([1.0],)], "embedding array<float>"), own).collect()
    with pytest.raises(errors.CodebookIncompatible):
        c.Codec(CodecConfig(2, 1, 16), book)
    with pytest.raises(errors.IndexOutOfRange):
        c.dequantize(np.array([16], np.uint8), book.array)


def test_rejects_are_set_aside(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, float("inf")])]
    good, bad = c.split_rejects(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 2)
    assert [r["vec_id"] for r in good.collect()] == [1]
    assert {r["vec_id"]: r["error_class"] for r in bad.collect()} == {"2": "DimensionMismatch", "3": "DimensionMismatch", "4": "NonFiniteValue"}


def test_half_precision_equals_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.standard_normal(2000), rng.standard_normal(500) * 1e-6, [0, 65519, 65520, 1e6, -65520, 2**-24, 2**-25, 1.0]]).astype(np.float32)
    df = spark.createDataFrame([(values.tolist(),)], "v array<float>")
    with np.errstate(over="ignore"):
        expected = values.astype("<f2").astype(np.float32)
    assert np.array_equal(np.array(df.select(exprs.half_vector(F.col("v"))).first()[0], np.float32), expected)


def test_scalar_expressions(spark):
    rows = [([1.0, 0.0], [0.0, 2.0]), ([3.0, 4.0], [6.0, 8.0]), ([0.0, 0.0], [1.0, 1.0]), ([float("nan"), 1.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = df.select(exprs.cosine(F.col("a"), F.col("b")).alias("c"), exprs.normalized(F.col("a")).alias("n"), exprs.finite(F.col("a")).alias("f")).collect()
    assert [round(r["c"], 9) for r in got] == [0.0, 1.0, 0.0, 0.0]
    assert got[1]["n"] == pytest.approx([0.6, 0.8]) and got[2]["n"] == [0.0, 0.0]
    assert [r["f"] for r in got] == [True, True, True, False]
    coded = spark.createDataFrame([([0.0, 0.5, 1.0],)], "v array<float>").select(exprs.byte_levels(F.col("v")).alias("x")).first()["x"]
    assert coded["levels"] == [0, 128, 255]


def test_damaged_records_are_set_aside(spark, vectors):
    _, df = vectors
    own = c.Codec(CodecConfig(4, 1, 16, True), train(df, 4))
    coded = c.compress(df, own).select("vec_id", "compressed")
    cut = F.struct(F.substring("compressed.indices", 1, 3).alias("indices"), *[F.col(f"compressed.{n}") for n in ("residual", "config_hash", "dimension", "bit_width")])
    foreign = F.col("compressed").withField("config_hash", F.lit("other"))
    bare = F.col("compressed").withField("residual", F.lit(None).cast("binary"))
    damaged = F.when(F.col("vec_id") == 1, cut).when(F.col("vec_id") == 2, foreign).when(F.col("vec_id") == 3, bare).otherwise(F.col("compressed"))
    good, bad = c.split_damaged(coded.withColumn("compressed", damaged), own.config)
    assert {r["vec_id"]: r["error_class"] for r in bad.collect()} == {"1": "LengthMismatch", "2": "ConfigMismatch", "3": "LengthMismatch"}
    assert c.decompress(good, own).count() == 297


def test_training_on_rotated_vectors(vectors):
    rows, df = vectors
    turned = (rows.astype(np.float64) @ rotation(42, 16).T).astype(np.float32)
    expected = np.quantile(turned.astype(np.float64), fractions(4)).astype(np.float32)
    assert np.allclose(train_rotated(df, 4, 42).array, expected, atol=1e-6)
