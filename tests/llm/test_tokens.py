"""Token files, BPE and token counts against the library and brute force."""

from __future__ import annotations

import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecspark.llm import bpe, pieces, queries, token_files, trie_counts

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoders():
    content = open(PATH, "rb").read()
    return [bpe.Vocabulary(content), token_files.LibraryEncoder(content, True), token_files.LibraryEncoder(content, False)]


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def encoded_alike(library, encoders, items):
    want = [e.ids for e in library.encode_batch_fast(items, add_special_tokens=False)]
    for encoder in encoders:
        ids, offsets = encoder.encode(items)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == want


#: Letters whose small or composed form ends in a mark, letters newer than Python's tables, and what often stands beside them.
ODD_LETTERS = ["İ", "\u0345", "Σ", "ΐ", "\u0307", "\u1c89", "\ua7cb", "\U000105c0", "\U00010d4a", "ﬁ", "²", "Ⅷ", "'s", "!", ".", ",", ")", " ", "\x1c", "A", "b", "<|endoftext|>"]


@settings(max_examples=250, deadline=None)
@given(st.lists(st.lists(st.characters(codec="utf-8", exclude_categories=["Cs"]) | st.sampled_from(ODD_LETTERS), max_size=30).map("".join), max_size=4))
def test_encoders_equal_the_library(library, encoders, items):
    encoded_alike(library, encoders, items)


def test_every_code_point_beside_letters_and_punctuation(library, encoders):
    for form in ("{}", "a{}.", "İ{}, A{}b!"):
        items = [form.replace("{}", chr(c)) for c in range(0x20000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c >= 0xA000) and not 0xAC00 <= c < 0xD7A0]
        for i in range(0, len(items), 4096):
            encoded_alike(library, encoders, items[i : i + 4096])


@pytest.mark.parametrize("text", ["AKADEMİ.", "İ,", "Üniversitesİ!", "(İ)", "x\u0345.", "\u1c89\u1c8a.", "ab\ua7cbcd!", "\U00010d4a\U00010d4b?"])
def test_letters_that_fold_into_marks(library, encoders, text):
    encoded_alike(library, encoders, [text, f"see {text} and {text.lower()}"])


def test_very_long_texts(library, encoders):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeé"), n)) for n in rng.integers(1, 12, 500)]
    long = " ".join(words[i] for i in rng.integers(0, 500, 60_000))
    encoded_alike(library, encoders, [long, "q" * 100_000, "é" * 20_000 + "."])


def test_a_small_memory_changes_nothing(library, encoders):
    table = pieces.PieceTable(encoders[1].library, pieces=5, cores=7)
    for text in ["some words, some more.", "other words; some (again)", "T̈ ẗ x"] * 3:
        assert table.encode([text])[0].tolist() == ids_of(library, text)


def test_words_are_looked_up_once_a_slice(library, encoders, monkeypatch):
    """Over 300 CPU seconds a GB went into looking up each word of each text, most of which are the same few."""

    class Counted(pieces._Index):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    monkeypatch.setattr(pieces, "_Index", Counted)
    encoder = token_files.LibraryEncoder(open(PATH, "rb").read(), True)
    items = ["  The cat, the Dog. the cat? " * 400, "", " \n", "Élan (élan) the cat.\u2003été,\x85.\tdog\x1c." * 50, "<|endoftext|> The cat <|x" * 20, "\x1cthe\x1d cat", "!"]
    assert [ids_of(library, x) for x in items] == [ids.tolist() for ids in np.split(*(lambda ids, offsets: (ids, offsets[1:-1]))(*encoder.encode(items)))]
    assert Counted.asked < 100
    no_words = encoder.encode(["", " ", "\t"])
    assert len(no_words[0]) == 0 and no_words[1].tolist() == [0, 0, 0, 0]


def test_a_small_memory_of_cores_changes_nothing(library, encoders):
    for keep_half in (False, True):
        table = pieces.PieceTable(encoders[1].library, cores=7, keep_half=keep_half)
        for text in ["some words, some more.", "other words; some (again)", "T̈ ẗ x"] * 3:
            assert table.encode_column(pa.array([None, text, ""]).slice(1))[0].tolist() == ids_of(library, text)


def test_texts_are_not_handed_back(odd):
    assert token_files.encode(odd.select("doc_id", "text"), PATH, keep=["doc_id"]).columns == ["doc_id", "ids"]


def test_long_and_short_merges_agree(encoders):
    vocabulary = encoders[0]
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 40, 90):
        letters = "".join(rng.choice(list("aeinrstho"), size))
        symbols = [*letters[:-1], letters[-1] + vocabulary.suffix]
        assert vocabulary._scan(symbols) == vocabulary._heap(symbols)


def test_round_trip_of_odd_rows(library, odd, odd_rows, empty):
    got = bpe.decode(bpe.encode(odd, PATH), PATH)
    assert set(got.columns) == {*odd.columns, "decoded"}
    found = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got.collect()), key=repr)
    want = sorted(((i, ids_of(library, t), library.decode(ids_of(library, t), skip_special_tokens=False)) for i, t, *_ in odd_rows), key=repr)
    assert found == want
    assert bpe.encode(empty, PATH).count() == 0


def test_one_pass_there_and_back(odd, empty):
    """Two passes in a task left each executor with four workers for two cores, to the end of the pipeline."""
    twice = bpe.decode(bpe.encode(odd, PATH), PATH)
    once = bpe.round_trip(odd, PATH)
    assert sorted(once.columns) == sorted(twice.columns)
    assert sorted(map(tuple, once.select(*twice.columns).collect()), key=repr) == sorted(map(tuple, twice.collect()), key=repr)
    assert bpe.round_trip(empty, PATH).count() == 0
    assert passes(twice) == 2 and passes(queries.bpe_digests(odd)) == 1


def passes(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def layout_of(library, rows):
    start, want = 0, []
    for i, text in sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*ids_of(library, text), token_files.END_ID], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return want


def test_token_files(spark, library, odd, odd_rows, empty, tmp_path):
    got = sorted(map(tuple, token_files.tokens_written(odd, PATH).collect()), key=lambda r: r[1])
    assert got == layout_of(library, odd_rows)
    assert token_files.tokens_written(empty, PATH).count() == 0


def test_starts_follow_the_files_for_equal_ids(spark, library, tmp_path):
    texts = [" ".join(["word"] * n) for n in (4, 2, 7, 1, 3)]
    rows = [(7, t) for t in texts] + [(7, texts[0]), (3, "a b"), (9, "c"), (None, "d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = token_files.write_orc(docs, f"file://{tmp_path}/orc", PATH)
    stored = sorted(spark.read.orc(folder).collect(), key=lambda r: (r["part"], r["row"]))
    starts = np.cumsum([0, *(len(r["ids"]) for r in stored)])[:-1].tolist()
    want = [(r["doc_id"], s, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r, s in zip(stored, starts, strict=True)]
    assert sorted(map(tuple, token_files.layout(spark.read.orc(folder)).collect()), key=lambda r: r[1]) == want
    assert [r["doc_id"] for r in stored] == [None, 3, *[7] * 6, 9]


def orc_streams(spark, path):
    """Of each stripe the kinds of its streams, and the rows to an index entry, as the format's own reader sees them."""
    jvm = spark._jvm
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    rows = reader.rows()
    kinds = [{(str(s.getKind()), s.getColumn()) for s in rows.readStripeFooter(stripe).getStreamsList()} for stripe in reader.getStripes()]
    rows.close()
    return kinds, reader.getRowIndexStride()


def test_orc_stripes_indexes_and_bloom_filters(spark, tmp_path, monkeypatch):
    import glob

    monkeypatch.setattr(token_files, "STRIPE_BYTES", 200_000)
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id"), F.col("id") * 7919, F.md5(F.col("id").cast("string"))).alias("text"))
    folder = token_files.write_orc(docs.coalesce(1), f"file://{tmp_path}/orc", PATH)
    files = glob.glob(f"{tmp_path}/orc/*.orc")
    seen = [orc_streams(spark, f"file://{f}") for f in files]
    assert sum(len(kinds) for kinds, _ in seen) > len(files)  # several stripes in a file
    for kinds, stride in seen:
        assert stride == token_files.ROW_INDEX_STRIDE
        assert all(("BLOOM_FILTER_UTF8", 1) in k and ("ROW_INDEX", 1) in k and ("ROW_INDEX", 4) in k for k in kinds)
    for wanted in ([123], [5, 39_990]):
        one = token_files.read_orc(spark, folder, ids_wanted=wanted)
        plan = one._jdf.queryExecution().executedPlan()
        assert sorted(r["doc_id"] for r in one.collect()) == wanted
        leaves = plan.collectLeaves()
        read = leaves.head().metrics().apply("numOutputRows").value()
        assert 0 < read <= 2 * len(wanted) * token_files.ROW_INDEX_STRIDE  # row groups that the indexes exclude are not read


def test_orc_files_prune_by_id(spark, library, documents, tmp_path):
    import glob

    import pyarrow.orc as orc

    folder = token_files.write_orc(documents, f"file://{tmp_path}/orc", PATH)
    one = token_files.read_orc(spark, folder, ids_wanted=[5])
    assert "EqualTo(doc_id,5)" in one._jdf.queryExecution().toString() or "In(doc_id" in one._jdf.queryExecution().toString()
    text = documents.where("doc_id = 5").first()["text"]
    assert one.first()["ids"] == [*ids_of(library, text), token_files.END_ID]
    ranges = []
    for path in glob.glob(f"{tmp_path}/orc/*.orc"):
        ids = orc.ORCFile(path).read(columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids)
        ranges.append((ids[0], ids[-1]))
    ranges.sort()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert sorted(map(tuple, token_files.layout(spark.read.orc(folder)).collect())) == layout_of(library, documents.select("doc_id", "text").collect())


SCORES = trie_counts.zipf_scores(["a", "b", "ab", "▁", "▁a", "bab", "c", "▁ab", "é"])


def brute(word: str) -> int:
    states = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        top = (-math.inf, 0)
        for begin in range(end):
            if (score := SCORES.get(word[begin:end])) is not None and states[begin][0] + score > top[0]:
                top = (states[begin][0] + score, states[begin][1] + 1)
        if word[end - 1] not in SCORES and (low := states[-1][0] + min(SCORES.values()) - 10) > top[0]:
            top = (low, states[-1][1] + len(word[end - 1].encode()))
        states.append(top)
    return states[-1][1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcé日x", min_size=1, max_size=12), max_size=20))
def test_trie_counts_equal_brute_force(words):
    counts = trie_counts.Counts(SCORES)
    assert counts.count(" ".join(words)) == (len(words), sum(brute("▁" + w) for w in words))
    small = trie_counts.Trie(SCORES, nodes=6)
    assert [small.count("▁" + w) for w in words] == [brute("▁" + w) for w in words]


def test_shared_prefixes_are_computed_once():
    trie = trie_counts.Trie(SCORES)
    trie.count("▁abab")
    before = len(trie.best)
    trie.count("▁ababc")
    assert len(trie.best) == before + 1


def test_token_counts_of_odd_rows(odd, odd_rows, empty):
    scores = trie_counts.vocabulary(str(public_tokenizers.path("piece_bpe_32k.model")))
    got = sorted(((r["doc_id"], r["n_words"], r["n_tokens"]) for r in trie_counts.token_counts(odd, scores).collect()), key=repr)
    counts = trie_counts.Counts(scores)
    assert got == sorted(((i, *counts.count(t or "")) for i, t, *_ in odd_rows), key=repr)
    assert trie_counts.token_counts(empty, scores).count() == 0
