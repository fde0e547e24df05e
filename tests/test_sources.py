from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from vecspark import cli, errors
from vecspark.config import CodecConfig
from vecspark.functions import register as register_functions
from vecspark.operators import wire
from vecspark.operators.codebook import train
from vecspark.operators.codec import Codec, compress, decompress
from vecspark.sources import binary, text


@pytest.fixture(scope="module")
def values():
    return np.random.default_rng(9).standard_normal((50, 8)).astype(np.float32)


@pytest.fixture(scope="module")
def frame(spark, values):
    binary.register(spark)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "row long, vector array<float>").repartition(3)


def as_matrix(df):
    return np.array([r["vector"] for r in df.orderBy("row").collect()], np.float32)


def test_matrix_files(spark, values, frame, tmp_path):
    values.tofile(tmp_path / "m.f32")
    np.save(tmp_path / "m.npy", values)
    raw = spark.read.format("f32").options(path=str(tmp_path / "m.f32"), cols=8, rows_per_task=7).load()
    assert raw.rdd.getNumPartitions() == 8 and np.array_equal(as_matrix(raw), values)
    assert np.array_equal(as_matrix(spark.read.format("f32").option("path", str(tmp_path / "m.npy")).load()), values)
    np.save(tmp_path / "wrong.npy", values.astype(np.float64))
    for path, more in (("m.f32", {"cols": 7}), ("wrong.npy", {})):
        with pytest.raises(Exception, match="expected|no two-dimensional"):
            spark.read.format("f32").options(path=str(tmp_path / path), **more).load().count()


@pytest.mark.parametrize("layout", ["raw", "npy"])
def test_matrix_round_trip(spark, values, frame, tmp_path, layout):
    frame.write.format("f32").mode("append").options(path=str(tmp_path / "out"), layout=layout).save()
    back = spark.read.format("f32").options(path=str(tmp_path / "out"), **({} if layout == "npy" else {"cols": 8})).load()
    assert sorted(map(tuple, as_matrix(back).tolist())) == sorted(map(tuple, values.tolist()))


def test_text_files(spark, values, frame, tmp_path):
    text.write_csv(frame, str(tmp_path / "csv"))
    back = text.read_csv(spark, str(tmp_path / "csv")).collect()
    assert len(back) == 50 and len(back[0]["vector"]) == 8
    (tmp_path / "bad.csv").write_text("1, 2\n\n3,4,5\n")
    with pytest.raises(Exception, match="DimensionMismatch"):
        text.read_csv(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "x.jsonl").write_text('{"id":"a","vector":[1,2],"metadata":{"k":1}}\n\n{"id":"b","vector":[3,4]}\n')
    got = text.read_jsonl(spark, str(tmp_path / "x.jsonl")).orderBy("id").collect()
    assert [(r["id"], r["vector"], r["metadata"]) for r in got] == [("a", [1.0, 2.0], '{"k":1}'), ("b", [3.0, 4.0], None)]
    text.write_jsonl(frame.withColumnRenamed("row", "id"), str(tmp_path / "j"))
    assert text.read_jsonl(spark, str(tmp_path / "j")).count() == 50


def test_corpus_files(spark, frame, tmp_path):
    own = Codec(CodecConfig(4, 42, 8, True), train(frame, 4, "vector"))
    coded = compress(frame, own, "vector").select("compressed")
    coded.write.format("tqcv").mode("append").options(path=str(tmp_path / "c"), metadata='{"a": 1}').save()
    stored = spark.read.format("tqcv").options(path=str(tmp_path / "c"), rows_per_task=4).load()
    assert stored.rdd.getNumPartitions() > 12 and stored.count() == 50 and stored.select("record").distinct().count() == 50
    key = lambda df: sorted(bytes(r["compressed"]["indices"]) for r in df.collect())
    assert key(stored) == key(coded)
    assert decompress(stored, own).count() == 50
    part = binary._files(str(tmp_path / "c"))[0]
    assert binary.verify(part)["kind"] == "corpus"
    data = open(part, "rb").read()
    (tmp_path / "cut.tqcv").write_bytes(data[:-2])
    with pytest.raises(errors.Truncated):
        binary.verify(str(tmp_path / "cut.tqcv"))
    with pytest.raises(Exception, match="Truncated|LengthMismatch|end"):
        spark.read.format("tqcv").option("path", str(tmp_path / "cut.tqcv")).load().count()


def test_sidecars(frame, tmp_path):
    book, config = train(frame, 4, "vector"), CodecConfig(4, 42, 8, True)
    binary.write_codebook(str(tmp_path / "b"), book)
    binary.write_config(str(tmp_path / "c.json"), config)
    assert np.array_equal(binary.read_codebook(str(tmp_path / "b")).array, book.array)
    assert binary.read_config(str(tmp_path / "c.json")) == config and binary.verify(str(tmp_path / "b")) == {"kind": "codebook", "bit_width": 4}
    data = (tmp_path / "b").read_bytes()
    for bad, error in ((b"XXXX" + data[4:], errors.InvalidHeader), (data[:9], errors.Truncated), (data[:-4], errors.LengthMismatch), (data[:4] + b"\2" + data[5:], errors.UnknownVersion)):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(error):
            binary.read_codebook(str(tmp_path / "bad"))


def test_pgvector_statements(spark):
    assert "vector(8)" in text.pgvector_ddl("items", 8)[1] and "lists = 100" in text.pgvector_ddl("items", 8)[2]
    assert "ON CONFLICT" in text.pgvector_upsert("_t1") and text.pgvector_query("t", [1.0], 3).endswith("LIMIT 3")
    for name in ("1a", "a-b", "a;drop", "", "x" * 64):
        with pytest.raises(errors.InvalidIdentifier):
            text.checked_identifier(name)
    df = spark.createDataFrame([("a", [1.0, -0.25])], "vec_id string, vector array<float>")
    from vecspark.functions import exprs

    assert df.select(exprs.pgvector_text(F.col("vector"))).first()[0] == "[1.0000000e+00,-2.5000000e-01]"
    with pytest.raises(errors.NonFiniteValue):
        text.write_pgvector(spark.createDataFrame([("a", [float("nan")])], "vec_id string, vector array<float>"), None, "t")
    scored = spark.createDataFrame([("a", 0.5)], "vec_id string, score double")
    assert text.formatted_results(scored, "csv").first()[0] == "a,0.500000000" and json.loads(text.formatted_results(scored, "json").first()[0])["score"] == 0.5


def test_sql_functions(spark, frame):
    register_functions(spark)
    assert spark.sql("SELECT vq_cosine(array(3D, 4D), array(6D, 8D)), vq_cosine(array(0D), array(1D))").first()[:] == (1.0, 0.0)
    assert spark.sql("SELECT vq_quantize(array(0.5F, 9F, -1F), array(0F, 1F, 2F, 3F))").first()[0] == [1, 3, 0]
    assert spark.sql("SELECT vq_dequantize(array(1, 3), array(0F, 1F, 2F, 3F))").first()[0] == [1.0, 3.0]
    assert spark.sql("SELECT vq_rotate(array(array(0D, 1D), array(1D, 0D)), array(5D, 7D))").first()[0] == [7.0, 5.0]
    record = wire.encode(wire.Record("h", 2, 4, b"\1\2"))
    spark.createDataFrame([(record * 3,)], "data binary").createOrReplaceTempView("blobs")
    got = spark.sql("SELECT p.* FROM blobs, LATERAL vq_parse_records(data) p").collect()
    assert [r["number"] for r in got] == [0, 1, 2] and bytes(got[0]["indices"]) == b"\1\2"


def test_command_line(spark, values, tmp_path, capsys):
    np.save(tmp_path / "m.npy", values)
    np.save(tmp_path / "q.npy", values[3:4])
    files = ["--codebook", str(tmp_path / "b"), "--config", str(tmp_path / "c.json")]
    run = lambda *a: cli.main([*map(str, a)], spark)
    assert run("info") == 0
    assert run("codec", "train", "--input", tmp_path / "m.npy", *files) == 0
    assert run("corpus", "ingest", "--input", tmp_path / "m.npy", "--output", tmp_path / "corpus", *files) == 0
    capsys.readouterr()
    assert run("corpus", "search", "--input", tmp_path / "corpus", "--query", tmp_path / "q.npy", "-k", 2, *files) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["score"] > 0.999
    assert run("codec", "decompress", "--input", tmp_path / "corpus", "--output", tmp_path / "back.npy", *files) == 0
    assert run("verify", "--input", tmp_path / "b") == 0
    assert run("verify", "--input", tmp_path / "missing") == 3
    (tmp_path / "bad").write_bytes(b"TQCV")
    assert run("verify", "--input", tmp_path / "bad") == 4
    assert run("nothing") == 2


@pytest.mark.parametrize("policy", ["compress", "passthrough", "fp16"])
def test_the_command_line_reads_every_policy_back(spark, tmp_path, capsys, policy):
    rng = np.random.default_rng(21)
    vectors = rng.standard_normal((40, 8)).astype("<f4")
    vectors.tofile(tmp_path / "in.f32")
    vectors[3].tofile(tmp_path / "query.f32")
    run = lambda *a: cli.main([*map(str, a)], spark)
    names = ["--codebook", tmp_path / "book", "--config", tmp_path / "config"]
    assert run("codec", "train", "--input", tmp_path / "in.f32", "--cols", 8, *names) == 0
    assert run("corpus", "ingest", "--input", tmp_path / "in.f32", "--cols", 8, *names, "--output", tmp_path / "stored", "--policy", policy) == 0
    assert run("corpus", "decompress", "--input", tmp_path / "stored", *names, "--output", tmp_path / "out") == 0
    back = spark.read.format("f32").options(path=str(tmp_path / "out"), cols=8).load().collect()
    got = np.array(sorted((r["vector"] for r in back)))
    want = np.array(sorted(vectors.astype("<f2").astype("<f4").tolist() if policy == "fp16" else vectors.tolist()))
    assert got.shape == want.shape and (policy == "compress" or np.array_equal(got, want))
    capsys.readouterr()
    assert run("corpus", "search", "--input", tmp_path / "stored", *names, "--query", tmp_path / "query.f32", "-k", 1) == 0
    assert '"vec_id":"3"' in capsys.readouterr().out


def test_a_failed_overwrite_keeps_the_old_data(spark, tmp_path):
    folder = str(tmp_path / "m")
    old = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "row long, vector array<float>")
    write = lambda df: df.write.format("f32").mode("overwrite").option("path", folder).save()
    read = lambda: sorted(r["vector"] for r in spark.read.format("f32").options(path=folder, cols=2).load().collect())
    write(old)
    broken = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0])], "row long, vector array<float>").coalesce(1)
    with pytest.raises(Exception):  # noqa: B017
        write(broken)
    assert read() == [[1.0, 2.0], [3.0, 4.0]]
    write(old.where("row = 1"))
    assert read() == [[3.0, 4.0]] and len([x for x in (tmp_path / "m").iterdir() if x.name.startswith("part-")]) == 1


def test_many_rows_as_npy(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id AS row", "array(cast(id AS float), cast(1 AS float)) AS vector").coalesce(1)
    rows.write.format("f32").mode("overwrite").options(path=str(tmp_path / "n"), layout="npy").save()
    (part,) = (tmp_path / "n").glob("*.npy")
    assert np.array_equal(np.load(part)[:, 0], np.arange(3000, dtype="<f4"))
    assert spark.read.format("f32").options(path=str(tmp_path / "n")).load().count() == 3000
