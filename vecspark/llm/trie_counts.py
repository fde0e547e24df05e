"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

A pre-token (a word with its word-begin mark) has as many tokens as its best
segmentation into vocabulary pieces, by the largest sum of log probabilities.
The best score up to a letter depends only on the letters before it, so it
is computed once per trie node and shared by all pre-tokens with that prefix;
a pre-token's own node stores its count. Tries start anew beyond a bounded
number of nodes.

Probabilities follow Zipf's law on a piece's rank in the vocabulary file. A
letter that no piece covers becomes its UTF-8 bytes, one token each, at a
score below every piece's. Of equal sums the one with the longer last piece
is taken.

Defined results: a null or blank text has no words and no tokens; repeated
rows are counted alike; an empty table gives an empty table; other columns
pass through, and columns named like a result are replaced.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vecspark.llm.arrow import add_columns, kept_once, texts
from vecspark.llm.common import WORDS

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Trie nodes and words held per worker.
NODES = 500_000
REMEMBERED = 400_000


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    """Log probability of each piece, 1 / (rank + 1) up to a constant."""
    whole = math.log(sum(1.0 / (rank + 1) for rank in range(len(pieces))))
    return {piece: -math.log(rank + 1) - whole for rank, piece in enumerate(pieces)}


def vocabulary(path: str) -> dict[str, float]:
    """Scores of the ordinary pieces of a sentencepiece file, in its order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
    ids = range(model.get_piece_size())
    return zipf_scores([model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])


class Trie:
    """Forward scores by prefix. Node 0 is the empty prefix.

    The pieces that end at a letter are found in a trie of reversed pieces,
    walked back from that letter until no piece goes on.
    """

    def __init__(self, scores: dict[str, float], nodes: int = NODES) -> None:
        self.most = nodes
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.back: dict[int, int] = {}
        self.ends: list[float | None] = [None]
        for piece, score in scores.items():
            state = 0
            for letter in reversed(piece):
                key = state << 21 | ord(letter)
                if key not in self.back:
                    self.back[key] = len(self.ends)
                    self.ends.append(None)
                state = self.back[key]
            self.ends[state] = score
        self._clear()

    def _clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best, self.tokens = array("d", [0.0]), array("q", [0])

    def count(self, word: str) -> int:
        """Tokens of the best segmentation of `word`."""
        if len(self.best) >= self.most:
            self._clear()
        children = self.children
        letters = [*map(ord, word)]
        node, path = 0, [0]
        for end, letter in enumerate(letters):
            key = node << 21 | letter
            node = children.get(key, -1)
            if node < 0:
                node = children[key] = len(self.best)
                self._add(letters, end, path)
            path.append(node)
        return self.tokens[node]

    def _add(self, letters: list[int], end: int, path: list[int]) -> None:
        """Appends the node of the prefix up to and with `end`."""
        best, back, ends = self.best, self.back, self.ends
        top, last, state = -math.inf, 0, 0
        for begin in range(end, -1, -1):
            state = back.get(state << 21 | letters[begin], 0)
            if not state:
                break
            if (score := ends[state]) is not None and (total := best[path[begin]] + score) >= top:
                top, last = total, begin
        count = 1
        if ends[back.get(letters[end], 0)] is None and (total := best[path[end]] + self.unknown) > top:
            top, last, count = total, end, len(chr(letters[end]).encode())
        best.append(top)
        self.tokens.append(self.tokens[path[last]] + count)


class Counts:
    """Counts of texts, remembering a bounded number of words."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.trie, self.known = Trie(scores), {}
        self.words = re.compile(WORDS)

    def count(self, text: str) -> tuple[int, int]:
        words = Counter(self.words.findall(text))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        known = self.known
        for word in sorted(w for w in words if w not in known):
            known[word] = self.trie.count(MARK + word)
        return words.total(), sum(known[w] * n for w, n in words.items())


def token_counts(df: DataFrame, scores: dict[str, float], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_words and n_tokens to `df` or its columns `keep`. The vocabulary is broadcast; its size is the tokenizer's."""
    shipped = df.sparkSession.sparkContext.broadcast(scores)
    key = ("counts", shipped._jbroadcast.id())
    place = df.columns.index(text)

    def make():
        counts = kept_once(key, lambda: Counts(shipped.value))

        def added(part: pa.RecordBatch) -> list[pa.Array]:
            found = [counts.count(x) for x in texts(part.column(place))]
            return [pa.array([n for n, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())]

        return added

    return add_columns(df, [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())], make, keep)
