"""Byte-pair encoding and decoding of whole texts, equal to the tokenizers library's for the same file.

A text is cut at white space and around words (see pieces.py); each distinct
piece is normalised, cut into pre-tokens and merged once per worker and then
remembered, up to a bound. A short pre-token is merged in a contiguous rank array:
part boundaries and the ranks of adjacent pairs stand in two lists, the
least rank is found by scanning, one boundary is deleted and the two
neighbouring ranks are refreshed. Long pre-tokens, where scanning would be
quadratic, take the same merges from a heap.

Defined results: a null text is encoded as the empty one, giving no ids;
null ids decode to the empty text; repeated rows are encoded alike; an empty
table gives an empty table; other columns pass through, and a column named
like a result is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vecspark.llm.arrow import add_columns, id_lists, id_slices, kept_once, texts
from vecspark.llm.pieces import PieceTable

#: Pre-tokens longer than this are merged with a heap.
SHORT = 96
#: Words remembered per worker; of pieces with their punctuation, half as many.
REMEMBERED = 400_000


def byte_letters() -> str:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in printable else chr(next(spare)) for b in range(256))


class Vocabulary:
    """A tokenizer file's word-end byte-level BPE."""

    def __init__(self, content: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part
        from tokenizers import Tokenizer

        spec = json.loads(content)
        library = Tokenizer.from_str(content.decode())
        self.normal, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.names = [""] * size
        for name, i in chain(self.ids.items(), self.special.items()):
            self.names[i] = name
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pre_token = regex.compile(pattern)
        self.is_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters = dict(enumerate(byte_letters()))
        self.table = PieceTable(lambda pieces: [*map(self.piece, pieces)], REMEMBERED // 2, REMEMBERED, keep_half=True)

    def parts(self, letters: str) -> list[str]:
        """The final parts of one pre-token, whose last letter carries the word end."""
        symbols = [*letters[:-1], letters[-1] + self.suffix]
        return self._scan(symbols) if len(symbols) <= SHORT else self._heap(symbols)

    def _scan(self, symbols: list[str]) -> list[str]:
        rank, none = self.ranks.get, 1 << 30
        word = "".join(symbols)
        bounds = [*range(len(symbols)), len(word)]
        ranks = [rank(pair, none) for pair in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            here = word[bounds[i] : bounds[i + 1]]
            if i:
                ranks[i - 1] = rank((word[bounds[i - 1] : bounds[i]], here), none)
            if i < len(ranks):
                ranks[i] = rank((here, word[bounds[i + 1] : bounds[i + 2]]), none)
        return [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _heap(self, symbols: list[str]) -> list[str]:
        rank = self.ranks.get
        parts: list[str | None] = list(symbols)
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(r, i, i + 1, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if parts[i] != a or after[i] != j or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := rank((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, right, parts[left], parts[right]))
        return [p for p in parts if p is not None]

    def _word(self, letters: str) -> list[int]:
        return [self.ids[p] for p in self.parts(letters) if p in self.ids]

    def _plain(self, piece: str) -> list[int]:
        """Which letters there are, and their small forms, is what the file's normalizer and pre-tokenizer say; ASCII needs neither."""
        if piece.isascii():
            cut = [word.translate(self.letters) for word in self.pre_token.findall(piece.lower())]
        else:
            cut = [letters for letters, _ in self.cut(self.normal(piece))]
        return [*chain.from_iterable(map(self._word, cut))]

    def piece(self, piece: str) -> list[int]:
        """The ids of a piece without white space."""
        if self.is_special is None or "<" not in piece:
            ids = self._plain(piece)
        else:
            ids = []
            for part in self.is_special.split(piece):
                ids += [self.special[part]] if part in self.special else self._plain(part)
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the offsets of each text's."""
        return self.table.encode(texts)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


def ship(spark: SparkSession, path: str) -> tuple[str, Broadcast]:
    """The tokenizer file (a few MB) for the executors, with its digest."""
    content = Path(path).read_bytes()
    return hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)


def loaded(digest: str, content: Broadcast) -> Vocabulary:
    return kept_once(("bpe", digest), lambda: Vocabulary(content.value))


def _encoded(vocabulary: Vocabulary, column: pa.Array) -> pa.ListArray:
    return id_lists(*vocabulary.encode(texts(column)))


def _decoded(vocabulary: Vocabulary, column: pa.ListArray) -> pa.Array:
    return pa.array([vocabulary.decode(x.tolist()) for x in id_slices(column)], pa.string())


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds `ids`, an array of int, to every row of `df` or its columns `keep`."""
    digest, content = ship(df.sparkSession, path)
    place = df.columns.index(text)

    def make():
        vocabulary = loaded(digest, content)
        return lambda part: [_encoded(vocabulary, part.column(place))]

    return add_columns(df, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make, keep)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds `text`, what the ids stand for, special tokens included, to `df` or its columns `keep`."""
    digest, content = ship(df.sparkSession, path)
    place = df.columns.index(ids)

    def make():
        vocabulary = loaded(digest, content)
        return lambda part: [_decoded(vocabulary, part.column(place))]

    return add_columns(df, [T.StructField(text, T.StringType())], make, keep)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """encode and decode in one pass: two passes in a task need two workers at once, each with a vocabulary, which the executor keeps."""
    digest, content = ship(df.sparkSession, path)
    place = df.columns.index(text)

    def make():
        vocabulary = loaded(digest, content)

        def added(part: pa.RecordBatch) -> list[pa.Array]:
            found = _encoded(vocabulary, part.column(place))
            return [found, _decoded(vocabulary, found)]

        return added

    return add_columns(df, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())], make, keep)
