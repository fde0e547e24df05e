"""SimHash, components and suffix arrays against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecspark.llm import simhash, suffix_array, suffix_dedup
from vecspark.llm.components import components


def components_of(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["random", "path", "star", "loops"])
def test_components(spark, shape):
    rng = np.random.default_rng(2)
    names = rng.permutation(400).tolist()
    edges = {
        "random": [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))],
        "path": list(zip(names, names[1:], strict=False)),
        "star": [(5, x) for x in range(300)],
        "loops": [(1, 1), (2, 2)],
    }[shape]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == components_of(nodes, [e for e in edges if e[0] != e[1]])


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def expected_groups(rows):
    prints = [fingerprint(t) for _, t in rows]
    array = np.array(prints, np.uint64)
    edges = [(i, j) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(array[i] ^ array) <= 4).tolist() if i < j]
    roots = components_of(range(len(rows)), edges)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[roots[i]] = min(least.get(roots[i], doc), doc)
    return sorted(((doc, f"{prints[i]:016x}", least.get(roots[i])) for i, (doc, _) in enumerate(rows)), key=repr)


def test_near_duplicates_of_odd_rows(odd, odd_rows, empty):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()), key=repr)
    assert got == expected_groups([(r[0], r[1]) for r in odd_rows])
    assert simhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_documents(documents, monkeypatch):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.near_duplicates(documents).collect()), key=repr) == expected_groups(rows)


def test_spark_hash_is_the_same(spark):
    df = spark.createDataFrame([("four words of text",)], "t string")
    assert df.select(F.xxhash64("t")).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"four words of text", 42)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.integers(0, 2**32), st.booleans())
def test_linked_spans_all_links(base, seed, two):
    rng = np.random.default_rng(seed)
    near = [x ^ (1 << int(b)) ^ (1 << int(c)) for x in base for b, c in rng.integers(0, 64, (6, 2))]
    fps = np.array(sorted({*base, *near}), np.uint64)
    sides = (fps[::2].copy(), fps[1::2].copy()) if two and len(fps) > 1 else (fps, None)
    u, v = simhash.linked(*sides)
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 4]
    if sides[1] is not None:
        links = [(i, j) for i, j in links if i % 2 != j % 2]
    place = {int(x): i for i, x in enumerate(fps)}
    found = [(place[int(a)], place[int(b)]) for a, b in zip(u, v, strict=True)]
    assert components_of(range(len(fps)), found) == components_of(range(len(fps)), links)
    assert len(found) < max(1, len(fps))


def test_one_of_each_keeps_one(odd, odd_rows, empty):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    groups = expected_groups([(r[0], r[1]) for r in odd_rows])
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted({g[2] for g in groups}, key=repr)
    assert simhash.one_of_each(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=200) | st.lists(st.integers(0, 255), max_size=200), st.sampled_from([1, 3, 10**9]), st.sampled_from([0, 1, 100]))
def test_suffix_array_and_prefixes(letters, crowded, rounds):
    text, suffix_array.CROWDED, suffix_array.ROUNDS = np.array(letters, np.int64), crowded, rounds
    order = suffix_array.suffix_array(text)
    data = bytes(letters)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    shared = suffix_array.common_prefixes(text, order)
    for a, b in zip(order.tolist(), order[1:].tolist(), strict=False):
        n = 0
        while max(a, b) + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        assert shared[b] == n


def test_recursion_is_reached():
    text = np.frombuffer(b"the cat sat on the mat and the cat sat on the hat " * 400, np.uint8)
    for crowded, rounds in ((1, 8), (256, 8), (10**9, 8), (10**9, 0)):
        suffix_array.CROWDED, suffix_array.ROUNDS = crowded, rounds
        order = suffix_array.suffix_array(text)
        assert sorted(order.tolist()) == list(range(len(text)))
        data = text.tobytes()
        assert all(data[a:] < data[b:] for a, b in zip(order[::97].tolist(), order[1::97].tolist(), strict=False))
    suffix_array.CROWDED, suffix_array.ROUNDS = 256, 8


def covered(rows, length):
    first = {}
    for doc, text in rows:
        body = (text or "").encode()
        for i in range(len(body) - length + 1):
            if doc is not None:
                first[body[i : i + length]] = min(first.get(body[i : i + length], doc), doc)
    out = []
    for doc, text in rows:
        body = (text or "").encode()
        gone = np.zeros(len(body) + 2, bool)
        for i in range(len(body) - length + 1):
            if doc is not None and first[body[i : i + length]] < doc:
                gone[i + 1 : i + 1 + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        left = bytes(b for b, g in zip(body, gone[1:], strict=False) if not g)
        out.append((doc, len(body), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [16, 50])
def test_removed_bytes_of_odd_rows(odd, odd_rows, empty, length):
    got = sorted(map(tuple, suffix_dedup.removed(odd, length=length).collect()), key=repr)
    assert got == covered([(r[0], r[1]) for r in odd_rows], length)
    assert suffix_dedup.removed(empty, length=length).count() == 0


def test_removed_bytes_of_documents(documents, monkeypatch):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert sorted(map(tuple, suffix_dedup.removed(documents).collect()), key=repr) == covered(rows, 50)


def test_random_texts_of_few_letters(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), "".join(rng.choice(list("ab "), rng.integers(0, 300), p=[0.48, 0.48, 0.04]))) for i in rng.permutation(30)]
    rows += [(90, "abc " * 400 + "x" + "abc " * 300), (91, "abc " * 200)]
    rows += [(100 + i, rows[i][1][20:] + rows[i + 1][1][:100]) for i in range(8)] + [(200, "ab" * 300), (201, "ba" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (16, 50):
        assert sorted(map(tuple, suffix_dedup.removed(df, length=length).collect()), key=repr) == covered(rows, length)


def test_equal_ids_with_different_texts(spark):
    rng = np.random.default_rng(7)
    old, other, clean = ("".join(rng.choice(list("abcdefgh"), n)) for n in (200, 300, 120))
    rows = [(1, old), (2, other), (5, clean + old), (5, other[100:] + clean), (5, clean)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.removed(df).collect()), key=repr) == covered(rows, 50)


def test_routes_do_not_matter(documents):
    key = lambda df: sorted((r["id"], r["class"], r["whole"], suffix_dedup.united([tuple(x) for x in r["spans"] or []])) for r in df.collect())
    whole = key(suffix_dedup.covered_spans(documents))
    assert len(whole) > 20
    bodies = [r["text"].encode() for r in documents.where("text IS NOT NULL").select("text").collect()]
    keys, n = np.unique(suffix_dedup.Units(bodies, 50, np.empty(0, np.uint64)).key, return_counts=True)
    common = keys[n >= 3].tolist()
    for options in ({"routed": 0, "split": []}, {"routed": 200, "split": common[::2]}, {"split": common}, {"routed": 0, "split": keys.tolist()}):
        assert whole == key(suffix_dedup.covered_spans(documents, **options))


def test_a_passage_in_thousands_of_surroundings_spreads(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij"), n)) for n in rng.integers(2, 9, 3000)]
    some = lambda n: " ".join(words[i] for i in rng.integers(0, 3000, n))
    passage = some(80)
    rows = [(int(i), f"{some(30)} {passage} {some(30)}") for i in rng.permutation(5000)]
    rows += [(5000 + i, some(90)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert sorted(map(tuple, suffix_dedup.removed(df).collect()), key=repr) == covered(rows, 50)
    docs = df.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("body")).select("id", F.xxhash64("body").alias("class"), "body")
    split = suffix_dedup._crowded(docs, 6000, 24, 50)
    assert 1 < len(split) < 40  # near the ends of the passage
    shipped = spark.sparkContext.broadcast(split)
    hits = suffix_dedup._hits(docs, 24, 50, suffix_dedup.ROUTED, shipped)
    kinds = "route long, id long, at int, windows int, region binary, class long, more binary"
    routed = docs.join(hits, "class").select("id", "body", "hits", "class").mapInArrow(suffix_dedup._regions(50, shipped), kinds)
    routes = [r["count"] for r in routed.groupBy("route").count().collect()]
    assert max(routes) < sum(routes) / 100  # no route has more than a hundredth of the rows


def test_cleaned_texts_keep_columns(odd, odd_rows):
    got = suffix_dedup.deduplicated(odd)
    assert got.columns == odd.columns and got.count() == len(odd_rows)
    assert {r["doc_id"]: r["text"] for r in got.collect()}[0] is None
