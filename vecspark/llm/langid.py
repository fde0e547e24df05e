"""Language identification by words first, backing off to ever shorter character n-grams.

The model holds per-language log frequencies of words, and of character
n-grams of words (a blank at either end) for words it has not seen. A word
that the model knows in any language is scored by its word frequencies; else
by the mean over those of its 4-grams that are known, else its 3-grams, and
so on down to single letters; else it says nothing. The language with the
largest sum is predicted; the score is the softmax of the mean per word,
times at most EVIDENCE words.

The model is fitted on at most about DOCS_PER_LANGUAGE labelled documents of
each language, chosen by a hash of the id, and keeps all their words; a word or
n-gram takes room for the languages that have it only.

Defined results: a text that is null or without letters gets `und` and score
0, as does every text if nothing was learned; ties go to the language whose
code sorts first; rows with a null label are not learned from; repeated rows
are predicted alike; an empty table gives an empty table; other columns pass
through, and columns named like a result are replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.arrow import add_columns, kept_once, texts
from vecspark.llm.common import drop, fresh, written

UNDETERMINED = "und"
DOCS_PER_LANGUAGE = 2000
LONGEST = 4
SMOOTHING = 0.5
EVIDENCE = 20
#: Pieces of text remembered per worker.
REMEMBERED = 200_000

_LETTERS = regex.compile(r"\p{L}+")


class Table:
    """Log frequencies, a row for each word or n-gram: those of the languages that have it, and by level what the others get."""

    def __init__(self, languages: int) -> None:
        self.firsts: list[int] = []
        self.defaults = np.empty((0, languages), np.float32)
        self.ends, self.at, self.logs = np.zeros(1, np.int64), np.empty(0, np.int32), np.empty(0, np.float32)

    def add_level(self, rows: np.ndarray, languages: np.ndarray, counts: np.ndarray, n: int) -> None:
        """`n` rows from entries (row, language, count), each pair once."""
        if not n:
            return
        order = np.lexsort((languages, rows))
        rows, languages, counts = rows[order], languages[order], counts[order]
        total = np.bincount(languages, counts, minlength=self.defaults.shape[1]) + SMOOTHING * n
        self.firsts.append(len(self.ends) - 1)
        self.defaults = np.vstack([self.defaults, np.log(SMOOTHING / total).astype(np.float32)])
        self.logs = np.concatenate([self.logs, np.log((counts + SMOOTHING) / total[languages]).astype(np.float32)])
        self.at = np.concatenate([self.at, languages.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.bincount(rows, minlength=n))])

    def __getitem__(self, row: int) -> np.ndarray:
        out = self.defaults[bisect_right(self.firsts, row) - 1].astype(np.float64)
        begin, end = self.ends[row : row + 2]
        out[self.at[begin:end]] = self.logs[begin:end]
        return out

    def means(self, groups: list[list[int]], levels: list[int]) -> np.ndarray:
        """The mean of each group of rows, all rows of a group being of its level."""
        lengths = np.fromiter(map(len, groups), np.int64, len(groups))
        rows = np.fromiter(chain.from_iterable(groups), np.int64, int(lengths.sum()))
        begin = self.ends[rows]
        sizes = self.ends[rows + 1] - begin
        held = np.arange(int(sizes.sum())) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)
        shape = (len(groups), self.defaults.shape[1])
        place = np.repeat(np.repeat(np.arange(len(groups)), lengths), sizes) * shape[1] + self.at[held]
        sums = np.bincount(place, self.logs[held], minlength=shape[0] * shape[1]).reshape(shape)
        counts = np.bincount(place, minlength=shape[0] * shape[1]).reshape(shape)
        share = lengths[:, None]
        return self.defaults[levels] * (1.0 - counts / share) + sums / share


@dataclass(frozen=True)
class Model:
    """Log frequencies by language, in order of `languages`: a row of the table for each word or n-gram."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: Table


def grams(word: str, n: int) -> list[str]:
    framed = f" {word} " if n > 1 else word
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


def build_model(counts: list[tuple[str, str, int]], gram_counts: list[tuple[int, str, str, int]] | None = None) -> Model:
    """From (language, word, count) and (size, language, n-gram, count), which is counted here if it is not given."""
    if gram_counts is None:
        found: Counter = Counter()
        for lang, word, n in counts:
            for size in range(1, LONGEST + 1):
                for gram in grams(word, size):
                    found[size, lang, gram] += n
        gram_counts = [(*key, n) for key, n in found.items()]
    languages = sorted({lang for lang, _, _ in counts})
    place = {lang: i for i, lang in enumerate(languages)}
    table = Table(len(languages))

    def level(rows: list[tuple[str, str, int]]) -> dict[str, int]:
        known: dict[str, int] = {}
        at = np.fromiter((known.setdefault(key, len(known)) for _, key, _ in rows), np.int64, len(rows))
        of = np.fromiter((place[lang] for lang, _, _ in rows), np.int64, len(rows))
        table.add_level(at, of, np.fromiter((n for _, _, n in rows), np.float64, len(rows)), len(known))
        return known

    words = level(counts)
    first, numbers = len(words), {}
    for size in range(1, LONGEST + 1):
        known = level([(lang, gram, n) for s, lang, gram, n in gram_counts if s == size])
        numbers |= {gram: first + i for gram, i in known.items()}
        first += len(known)
    return Model(languages, words, numbers, table)


class Scorer:
    """Scores texts, remembering the sums of a bounded number of pieces between blanks."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}
        self.sums = np.zeros((1 << 12, len(model.languages) + 1))

    def _rows(self, word: str) -> tuple[int, list[int]]:
        """The level and rows that stand for a word."""
        if (row := self.model.words.get(word)) is not None:
            return 0, [row]
        get = self.model.grams.get
        for n in range(LONGEST, 0, -1):
            if known := [row for g in grams(word, n) if (row := get(g)) is not None]:
                return n, known
        return 0, []

    def word(self, word: str) -> np.ndarray | None:
        level, rows = self._rows(word)
        return self.model.table.means([rows], [level])[0] if rows else None

    def _learn(self, pieces: list[str]) -> None:
        at, n = len(self.known), len(pieces)
        while at + n > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[at : at + n] = 0
        groups, levels, owners = [], [], []
        for i, piece in enumerate(pieces, at):
            self.known[piece] = i
            for word in _LETTERS.findall(piece):
                level, rows = self._rows(word)
                if rows:
                    groups.append(rows)
                    levels.append(level)
                    owners.append(i)
        if groups:
            np.add.at(self.sums[:, :-1], owners, self.model.table.means(groups, levels))
            np.add.at(self.sums[:, -1], owners, 1.0)

    def predict(self, text: str) -> tuple[str, float]:
        if not self.model.languages or not _LETTERS.search(text):
            return UNDETERMINED, 0.0
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        pieces = Counter(text.lower().split())
        if new := [p for p in pieces if p not in self.known]:
            self._learn(new)
        at = [*map(self.known.__getitem__, pieces)]
        sums = np.fromiter(pieces.values(), np.float64, len(pieces)) @ self.sums[at]
        mean = sums[:-1] / max(1.0, sums[-1]) * min(float(EVIDENCE), max(1.0, sums[-1]))
        best = int(np.argmax(mean))
        return self.model.languages[best], float(1.0 / np.exp(mean - mean[best]).sum())


def training_counts(df: DataFrame, allowed: Column, id_col: str = "doc_id", text: str = "text", label: str = "lang", docs: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """(lang, word, n): the words of the bounded sample of each language."""
    labelled = df.where(allowed & F.col(label).isNotNull() & F.col(text).isNotNull())
    narrow = labelled.select(F.col(label).alias("lang"), F.col(text).alias("body"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)).alias("place"))
    sizes = narrow.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    chance = F.col("place") / F.lit(float(1 << 30)) < F.lit(float(docs)) / F.col("docs")
    picked = narrow.join(F.broadcast(sizes), "lang").where(chance).select("lang", "body")
    found = picked.select("lang", F.explode(F.regexp_extract_all(F.lower("body"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return found.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def gram_counts(counts: DataFrame) -> DataFrame:
    """(size, lang, gram, n): the n-grams of counted words."""

    def of_size(size: int) -> Column:
        framed = F.concat(F.lit(" "), "word", F.lit(" ")) if size > 1 else F.col("word")
        last = F.length(framed) - (size - 1)
        cut = lambda i: F.struct(F.lit(size).alias("size"), F.substring(framed, i, F.lit(size)).alias("gram"))
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), cut))

    parts = [of_size(size) for size in range(1, LONGEST + 1)]
    every = F.concat(*[F.coalesce(p, F.array().cast("array<struct<size:int,gram:string>>")) for p in parts])
    found = counts.select("lang", "n", F.explode(every).alias("g"))
    return found.groupBy("g.size", "lang", "g.gram").agg(F.sum("n").alias("n"))


def train(df: DataFrame, allowed: Column | None = None, **options) -> Model:
    """Fits on the rows of `df` that `allowed` admits; the model, of bounded size, comes to the driver."""
    counts = written(training_counts(df, F.lit(True) if allowed is None else allowed, **options), "words")
    rows = lambda found, *names: [*zip(*(found[c].to_pylist() for c in names), strict=True)]
    model = build_model(rows(counts.toArrow(), "lang", "word", "n"), rows(gram_counts(counts).toArrow(), "size", "lang", "gram", "n"))
    drop(counts)
    return model


def identify(
    df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, out: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """Adds the predicted language and the score to `df` or its columns `keep`."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    key = ("langid", shipped._jbroadcast.id())
    place = df.columns.index(text)

    def make():
        scorer = kept_once(key, lambda: Scorer(shipped.value))

        def added(part: pa.RecordBatch) -> list[pa.Array]:
            found = [scorer.predict(x) for x in texts(part.column(place))]
            return [pa.array([lang for lang, _ in found], pa.string()), pa.array([score for _, score in found], pa.float64())]

        return added

    fields = [T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())]
    return add_columns(df, fields, make, keep)


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that no model may learn from."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(4)) == 2


def confident(df: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows whose language is determined with a score of at least `least`, in the input's columns."""
    language, score = names = fresh(df, "_lang_pred", "_lang_score")
    found = identify(df, model, text, out=(language, score))
    return found.where((F.col(language) != UNDETERMINED) & (F.col(score) >= least)).drop(*names).select(*df.columns)
