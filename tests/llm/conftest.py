from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, ids string, score string"


def odd_texts() -> list[str | None]:
    """Null, empty, blank, short, long, repeated, accented and broken-up texts, with copies and shared passages."""
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "delta,", "épée", "straße", "don't", "x1y2", "###", "日本", "ét", "ΣΑΣ", "naïve."]
    passage = " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(40))
    texts: list[str | None] = [None, "", "  \n\t ", "a", "Z", "one two three", "<|endoftext|> mid <|startoftext|>x", "\x1c\x1d odd \x85 blanks here"]
    texts += ["of " * 300, "q" * 5000, "line one\nline one\n\nline two\nline one", "\U0001f600 emoji \U0001f468‍\U0001f469 text"]
    for i in range(12):
        body = " ".join(rng.choice(words) + str(rng.randrange(200)) for _ in range(rng.randrange(5, 120)))
        texts.append(body + (f" {passage} " if i % 3 == 0 else " ") + str(i))
    texts += [texts[-1], texts[-1], texts[-2].upper(), texts[-3] + " tail", passage]
    return texts


@pytest.fixture(scope="session")
def odd_rows():
    rows = []
    for i, text in enumerate(odd_texts()):
        rows.append((i * 3, text, ["en", "de", None][i % 3], ["b", "a", None][i % 3], len(text or "")))
    return [*rows, rows[15], (None, "a row without an id, and long enough to be of some use to the suffix array", "en", "a", 3)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 7, 8, "x", "y") for r in odd_rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
