"""The stages of the pipeline, each on its own input."""

from __future__ import annotations

from types import SimpleNamespace

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from vecspark.llm import bpe, common, langid, mixing, queries, simhash, suffix_dedup
from vecspark.llm.common import written

#: Names that the operators use themselves, and what they make of names that are taken.
INNER = (
    "_key _rank _one _copy _copies _number copies taken target source_size _offset _part _before _sum _n _w _limit _level _rate _id _class _whole _spans "
    "_file _row _fp _lang_pred _lang_score _text id class body check hits route start end spans whole least u v node root fp size ids carry0 file row _ID __id _file_ _copies_"
).split()


@pytest.fixture(scope="module")
def crowded(odd):
    """The odd rows with every inner name as a column more."""
    base = odd.select("doc_id", "text", "lang", "source", "n_chars")
    return base.select("*", *[F.lit(i).alias(n) for i, n in enumerate(dict.fromkeys(n for n in INNER))])


@pytest.fixture(autouse=True)
def exact_names(spark):
    """Names that differ by case alone are names of their own."""
    spark.conf.set("spark.sql.caseSensitive", "true")
    yield
    spark.conf.unset("spark.sql.caseSensitive")


@pytest.mark.parametrize("stored", [False, True])
def test_stages_keep_columns_of_any_name(spark, sf_dir, crowded, odd, stored):
    docs = written(crowded, "crowded") if stored else crowded
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        rows = after.collect()
        assert all(r[n] == i for r in rows for i, n in enumerate(INNER))
        expected = stage(spark, written(plain, "plain"), sf_dir)
        assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
        docs, plain = written(after, "stage"), written(expected, "stage")
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_results_outlive_a_pipeline(spark, sf_dir, documents):
    live = [simhash.near_duplicates(documents), suffix_dedup.removed(documents), mixing.decisions(documents)]
    before = [sorted(map(tuple, df.collect()), key=repr) for df in live]
    pipeline.run(spark, sf_dir).collect()
    assert [sorted(map(tuple, df.collect()), key=repr) for df in live] == before


def test_scratch_deletes_its_own_tables(spark):
    kept = written(spark.range(3), "t")
    with common.scratch(spark):
        gone = written(spark.range(4), "t")
        with common.scratch(spark):
            inner = written(spark.range(5), "t")
        assert gone.count() == 4
        with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
            inner.count()
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        gone.count()


def test_a_cluster_must_name_its_shared_folder():
    unset = SimpleNamespace(get=lambda name, default: default, set=lambda *a: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_folder(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master)))
    assert common.shared_folder(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="local[2]"))).startswith("file:///")


def test_stages(spark, sf_dir, odd):
    docs, counts = odd, []
    for name, stage in pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, sf_dir), name)
        assert sorted(after.columns) == sorted(odd.columns)
        counts.append(after.count())
        docs = after
    last = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == counts[-1]


def test_stages_of_an_empty_table(spark, sf_dir, empty):
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_run_applies_all_stages(spark, sf_dir, documents):
    got = pipeline.run(spark, sf_dir)
    kept = langid.confident(documents, langid.train(documents, ~langid.held_out()), pipeline.LEAST_SCORE)
    assert kept.count() == documents.where(documents.text.rlike(r"\p{L}")).count()
    alone = simhash.one_of_each(written(kept, "t"))
    groups = simhash.near_duplicates(kept)
    assert alone.count() == groups.select("component_id").distinct().count()
    clean = written(suffix_dedup.deduplicated(written(alone, "t")), "t")
    expected = bpe.encode(mixing.mixed_rows(clean), queries.word_bpe())
    key = lambda rows: sorted(rows)
    assert key((r["doc_id"], r["n_tokens"]) for r in got.collect()) == key((r["doc_id"], len(r["ids"])) for r in expected.collect())


def test_clean_documents_stay_whole(spark, sf_dir):
    words = "river stone cloud garden window lantern copper meadow harbor thunder velvet marble".split()
    texts = [" ".join(f"{words[(i * 7 + j * j) % 12]}{i}x{j}" for j in range(60)) for i in range(30)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = df
    for _, stage in pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, df.collect()))
