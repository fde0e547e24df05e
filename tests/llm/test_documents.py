"""Quality rules, mixing, sharding, language identification and neighbours."""

from __future__ import annotations

import math
import zlib

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from vecspark.llm import common, langid, lsh_forest, mixing, oracle, quality, queries, sharding


def against_sql(rows, name, columns):
    link = duckdb.connect()
    link.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    link.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r[:5] for r in rows]) if rows else None
    return sorted(link.sql(f"SELECT {', '.join(columns)} FROM ({oracle.SQL[name]})").fetchall(), key=repr)


def of(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_quality_of_odd_rows(odd, odd_rows, empty):
    assert of(quality.judged(odd), BASE) == against_sql(odd_rows, "op5_quality_rules", BASE)
    assert quality.judged(empty).count() == 0


def test_bad_hosts_lose_all_documents(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good, "fine") for i in range(40)] + [(100 + i, bad if i < 38 else good, "farm") for i in range(40)] + [(200, good, None)]
    got = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] for i in range(40)) and not any(got[100 + i] for i in range(40)) and got[200]


def test_small_hosts_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(h * 100 + i, bad if i < h % 3 else good, f"h{h}") for h in range(12) for i in range(30)] + [(9000, bad, "tiny"), (9001, good, "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rates = {r["_host"]: r["rate"] for r in quality.host_verdicts(quality.base_rules(df)).collect()}
    assert rates["tiny"] < 0.5 and {r["doc_id"]: r["kept"] for r in quality.judged(df).collect()}[9001]


def test_quality_runs_no_python(documents):
    plan = quality.base_rules(documents)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_repeats_of_any_window_width(spark):
    rng = np.random.default_rng(3)
    lists = [[f"w{x}" for x in rng.integers(0, 3, n)] for n in (0, 1, 4, 8, 9, 40, 200)] + [[f"w{x % 50}" for x in range(70)], [f"w{x}" for x in range(90)]]
    df = spark.createDataFrame([(x,) for x in lists], "words array<string>")
    for width in (1, 2, 3, 5, 8, 11):
        for words, got in df.select("words", quality.repeated_words(F.col("words"), width)).collect():
            windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
            places = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + width)}
            assert got == len(places)


def test_quality_puts_no_windows_together(spark, tmp_path):
    """What the tasks allocate decides how far an executor's memory grows: 329 bytes a letter with each window put together, 123 without."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"{x:x}" for x in rng.integers(0, 1 << 24, 2000)), "a") for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "texts"))
    rules = quality.base_rules(spark.read.parquet(str(tmp_path / "texts")))
    threads = spark._jvm.java.lang.management.ManagementFactory.getThreadMXBean()

    def allocated():
        return {i: threads.getThreadAllocatedBytes(i) for i in threads.getAllThreadIds()}

    rules.write.format("noop").mode("overwrite").save()
    before = allocated()
    rules.write.format("noop").mode("overwrite").save()
    more = sum(max(0, n - before.get(i, 0)) for i, n in allocated().items())
    assert more < 200 * sum(len(t) for _, t, _ in rows)


MIX = ["doc_id", "size", "source_size", "target", "taken"]


def test_mixing_of_odd_rows(odd, odd_rows, empty):
    got = of(mixing.systematic_mix(odd), MIX)
    want = against_sql(odd_rows, "op7_source_mixing", MIX)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want]) and [r[4] for r in got] == [r[4] for r in want]
    assert mixing.systematic_mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_mix_reaches_its_targets(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(n), "abcdef"[min(5, int(rng.exponential(1.2)))]) for i, n in enumerate(rng.integers(0, 60, 2500))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.systematic_mix(df)
    assert of(mix, MIX) == of(mixing.systematic_mix(df.repartition(7)), MIX)
    sources = mix.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    assert sum(r["target"] for r in sources) == pytest.approx(sum(r["size"] for r in sources))
    for r in sources:
        assert abs(r["taken"] - r["target"]) <= 60 and r["target"] <= 3 * r["size"] + 1e-6
    assert mix.where("taken > 3 * size").count() == 0
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns and mixed.count() == mix.agg(F.sum("copies")).first()[0]


def test_running_sums_cross_ranges(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", (i * 37) % 101, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {r["v"]: r["s"] for r in common.running_sum(df, "k", [F.col("o"), F.col("v")], "v", "s").collect()}
    totals: dict[str, int] = {}
    for k, _, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        assert got[v] == totals.get(k, 0)
        totals[k] = totals.get(k, 0) + v


SHARDS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_sharding_of_odd_rows(odd, odd_rows, empty):
    got = of(sharding.shard_records(odd), SHARDS)
    assert got == against_sql(odd_rows, "op9_sharding", SHARDS)
    crc = {i: zlib.crc32((t or "").encode()) for i, t, *_ in odd_rows}
    assert all(r[2] == crc[r[0]] for r in got)
    assert sharding.shard_records(empty).count() == 0


def test_growth_moves_rows_into_the_new_shard_only(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.shard_records(df)
    assert got.where("grown_shard <> shard AND grown_shard <> 16").count() == 0
    moved = got.where("grown_shard = 16").count()
    assert 0.8 * 20_000 / 17 < moved < 1.2 * 20_000 / 17
    for r in got.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("d")).collect():
        assert (r["a"], r["b"], r["d"]) == (0, r["n"] - 1, r["n"]) and 1000 < r["n"] < 1500
    weighted = sharding.shard_records(df, weights=(1.0, 3.0)).groupBy("shard").count().collect()
    assert {r["shard"]: round(r["count"] / 20_000, 1) for r in weighted} == {0: 0.2, 1: 0.8} or {r["shard"]: round(r["count"] / 20_000, 2) for r in weighted}[1] == pytest.approx(0.75, abs=0.02)
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [1.0, 0.0])


def test_language_of_held_out_documents(spark, sf_dir, documents):
    got = queries.op6_language_id(spark, sf_dir).join(documents.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out")
    assert held.count() > 20
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()
    assert got.where("score < 0 OR score > 1").count() == 0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.collect())


def test_language_of_odd_rows(spark, odd, odd_rows, empty):
    model = langid.train(odd, ~langid.held_out())
    got = langid.identify(odd, model)
    assert got.count() == len(odd_rows)
    undetermined = {r["doc_id"] for r in got.where("lang_pred = 'und'").collect()}
    assert undetermined == {i for i, t, *_ in odd_rows if not any(c.isalpha() for c in t or "")}
    assert {r["lang_pred"] for r in got.collect()} <= {"en", "de", "und"}
    nothing = langid.train(empty)
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(odd, nothing).collect()} == {("und", 0.0)}
    assert langid.identify(empty, model).count() == 0
    kept = langid.confident(odd, model, 0.0)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows) - len([1 for i, *_ in odd_rows if i in undetermined])


def test_backoff_goes_from_words_to_letters():
    model = langid.build_model([("x", "abcd", 5), ("y", "efgh", 5), ("y", "z", 1)])
    scorer = langid.Scorer(model)
    assert np.array_equal(scorer.word("abcd"), model.table[model.words["abcd"]])
    assert np.array_equal(scorer.word("zabcq"), model.table[model.grams["abc"]])
    assert np.array_equal(scorer.word("qqaqq"), model.table[model.grams["a"]]) and scorer.word("q") is None
    assert scorer.predict("zabcq")[0] == "x" and scorer.predict("qqq")[0] == "x" and scorer.predict("12")[0] == "und"


def brute_nearest(rows, k):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            scored = sorted((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def test_neighbours_of_small_tables_are_exact(spark):
    rng = np.random.default_rng(12)
    values = rng.standard_normal((300, 12)).astype(np.float32)
    values[40:120] = values[40]
    rows = [(int(i), v.tolist()) for i, v in enumerate(values)]
    bad = [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] + [1.0] * 11), (1060, [1.0] * 5), (1080, [float("inf")] + [0.0] * 11), (1100, [None] + [1.0] * 11), (None, [1.0] * 12), (1120, [])]
    df = spark.createDataFrame([*rows, *bad, rows[7]], "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got: dict[int, list] = {}
    for r in lsh_forest.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_nearest(rows, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for q, found in got.items():
        assert [s for _, s in found] == pytest.approx([s for _, s in want[q]], abs=1e-12)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert lsh_forest.nearest(few).count() == 2
    assert lsh_forest.nearest(few.where("false")).count() == 0


def test_recall_of_the_forest():
    rng = np.random.default_rng(13)
    rows = rng.standard_normal((6000, 64))
    forest = lsh_forest.Forest(rows)
    asked = rows[:40]
    hit = 0
    for q, found in enumerate(forest.candidates(asked, int(lsh_forest.SHARE * len(rows)))):
        scores = rows @ asked[q]
        scores[q] = -np.inf
        hit += np.isin(np.argsort(-scores)[:20], found).sum()
        assert q in found
    assert hit / (20 * len(asked)) >= 0.9


@pytest.mark.parametrize("dimension", [64, 384])
def test_recall_by_inner_product_of_unequal_lengths(dimension):
    rng = np.random.default_rng(14)
    rows = rng.standard_normal((6000, dimension)) * rng.lognormal(0.0, 1.0, (6000, 1))
    asked, enough, hit = rows[:40], int(lsh_forest.SHARE * len(rows)), 0
    for q, found in enumerate(lsh_forest.Forest(rows).candidates(asked, enough)):
        assert len(found) >= enough
        scores = rows @ asked[q]
        scores[q] = -np.inf
        hit += np.isin(np.argsort(-scores)[:20], found).sum()
    assert hit / (20 * len(asked)) >= 0.9


def recall_and_share(rows, asked, k=20):
    forest = lsh_forest.Forest(rows)
    enough, hit, scored = forest.needed(k), 0, 0
    for q, found in zip(asked, forest.candidates(rows[asked], enough), strict=True):
        scores = rows @ rows[q]
        scores[q] = -np.inf
        hit += np.isin(np.argpartition(-scores, k)[:k], found).sum()
        scored += len(found)
    return hit / (k * len(asked)), scored / (len(asked) * len(rows))


def test_candidates_are_few_and_good():
    """The tables' vectors and a full shard like them; then vectors that no index can prune, where more are scored instead of recall lost."""
    import pyarrow.parquet as pq

    stored = pq.read_table("/root/testdata/sf0.1/embeddings.parquet", columns=["embedding"])["embedding"].to_pylist()
    rng = np.random.default_rng(15)
    full = rng.standard_normal((lsh_forest.SHARD, 64))
    for rows in (np.array(stored, np.float64), full / np.linalg.norm(full, axis=1, keepdims=True)):
        recall, share = recall_and_share(rows, rng.choice(len(rows), 40, replace=False))
        assert recall >= 0.95 and share <= 0.35, (recall, share)
    for rows in (rng.standard_normal((3000, 384)), rng.standard_normal((3000, 64)) * rng.lognormal(0.0, 1.0, (3000, 1))):
        assert recall_and_share(rows, rng.choice(len(rows), 40, replace=False))[0] >= 0.9


def test_recall_of_nearest(spark):
    rng = np.random.default_rng(16)
    values = rng.standard_normal((4000, 64)).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in enumerate(values)]
    got: dict[int, set] = {}
    for r in lsh_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    matrix = values.astype(np.float64)
    hit = 0
    for q in range(0, 4000, 20):
        scores = matrix @ matrix[q]
        scores[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-scores)[:20].tolist()))
    assert len(got) == 200 and hit / (200 * 20) >= 0.95


def plain_language(counts, text):
    """Words first, else the mean over the longest known n-grams, written down anew."""
    languages = sorted({lang for lang, _, _ in counts})
    levels = [{}, {}, {}, {}, {}]
    for lang, word, n in counts:
        for size in range(5):
            framed = f" {word} " if size > 1 else word
            for key in [word] if size == 0 else [framed[i : i + size] for i in range(len(framed) - size + 1)]:
                levels[size].setdefault(key, {}).setdefault(lang, 0)
                levels[size][key][lang] += n

    def log(size, key, lang):
        total = sum(x.get(lang, 0) for x in levels[size].values())
        return math.log((levels[size][key].get(lang, 0) + 0.5) / (total + 0.5 * len(levels[size])))

    cache = {}
    sums, n = dict.fromkeys(languages, 0.0), 0
    for word in regex.findall(r"\p{L}+", (text or "").lower()):
        if word not in cache:
            keys = [(0, word)] if word in levels[0] else []
            for size in (4, 3, 2, 1):
                framed = f" {word} " if size > 1 else word
                keys = keys or [(size, g) for i in range(len(framed) - size + 1) if (g := framed[i : i + size]) in levels[size]]
            cache[word] = {lang: sum(log(*k, lang) for k in keys) / len(keys) for lang in languages} if keys else None
        if cache[word]:
            n += 1
            for lang in languages:
                sums[lang] += cache[word][lang]
    if not regex.search(r"\p{L}", text or ""):
        return "und", 0.0
    scaled = {lang: s / max(1, n) * min(20, max(1, n)) for lang, s in sums.items()}
    top = max(scaled.values())
    best = min(lang for lang in languages if scaled[lang] == top)
    return best, 1.0 / sum(math.exp(x - top) for x in scaled.values())


def test_language_equals_a_plain_scorer(spark, odd, odd_rows, documents):
    some = spark.createDataFrame(odd_rows[8:20], "doc_id long, text string, lang string, source string, n_chars long")
    for learnt in (some, documents.where("length(text) < 400").limit(60)):
        counts = [tuple(r) for r in langid.training_counts(learnt, F.lit(True)).collect()]
        for r in langid.identify(odd, langid.build_model(counts)).collect():
            lang, score = plain_language(counts, r["text"])
            assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-5)


def test_all_words_of_the_sample_are_kept(spark):
    words = [f"w{''.join(chr(97 + int(d)) for d in str(i))}" for i in range(40_000)]
    df = spark.createDataFrame([(1, " ".join(words), "xx"), (2, "other words", "yy")], "doc_id long, text string, lang string")
    model = langid.train(df)
    assert len(model.words) == 40_002 and len(model.table.logs) < 40_002 + 2 * len(model.grams)


def test_ngrams_counted_by_spark_are_those_counted_here(spark, documents):
    learnt = documents.limit(50)
    counts = langid.training_counts(learnt, F.lit(True))
    here, there = langid.build_model([tuple(r) for r in counts.collect()]), langid.train(learnt)
    assert here.words.keys() == there.words.keys() and here.grams.keys() == there.grams.keys()
    assert all(np.array_equal(here.table[i], there.table[there.grams[g]]) for g, i in here.grams.items())
