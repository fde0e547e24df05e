"""A bounded memory of text pieces and their token ids, from which whole texts are put together by numpy.

For tokenizers that fold case (or whose case is left alone) and whose
pre-tokenizer cuts at white space and between letters or digits and other
characters, the ids of a text are those of its pieces one after the other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters at a word's end that always stand in a pre-token of their own after letters or digits.
TAIL = frozenset(".,;:!?)")
#: Texts with these are neither case-folded beforehand (a special token, two letters whose lower case depends on more than themselves) ...
UNFOLDED = ("<|", "Σ", "İ")
#: ... nor, with these, split by str.split, which takes them for blanks.
_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
_PIECES = re.compile(f"[^{WHITE}]+")
_TAIL_BYTES, _ALNUM_BYTES = (np.array([i < 128 and is_in(chr(i)) for i in range(256)]) for is_in in (TAIL.__contains__, str.isalnum))


def ends_alone(core: str) -> bool:
    """Whether a tail after `core` is a pre-token of its own: the core's normal form must end in a letter or digit.

    Dotted capital I ends in a combining dot once it is folded, which joins the punctuation after it.
    """
    return core.isalnum() and (core.isascii() or unicodedata.normalize("NFC", core).lower()[-1].isalnum())


def _strings(column: pa.Array) -> list[str]:
    """The strings of a column, none of which is null or has a blank: one long string is handed over and cut."""
    if not len(column):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column.cast(pa.string())), " ")[0].as_py().split(" ")


class _Index(dict):
    """Numbers its keys from 0 and lists the new ones."""

    def __init__(self, known: Iterable[tuple[str, int]] = ()) -> None:
        super().__init__(known)
        self.new: list[str] = []

    def first(self, n: int) -> _Index:
        """Of the keys only the `n` oldest, which keep their numbers."""
        return _Index(islice(self.items(), n))

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


class _Lists:
    """Growing lists of ids in one flat array."""

    def __init__(self) -> None:
        self.flat, self.used = np.empty(1 << 18, np.int32), 0
        self.starts, self.lengths, self.n = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64), 0

    def add(self, lists: Sequence[Sequence[int]]) -> None:
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        end, n = self.used + int(lengths.sum()), self.n + len(lists)
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.empty_like(self.lengths)])
        self.flat[self.used : end] = np.fromiter(chain.from_iterable(lists), np.int32, end - self.used)
        self.starts[self.n : n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.n : n] = lengths
        self.used, self.n = end, n

    def shorten(self, n: int) -> None:
        """Keeps the `n` oldest lists."""
        self.n, self.used = n, int(self.starts[n - 1] + self.lengths[n - 1]) if n else 0

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of `numbers` one after the other, and the length of each."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        places = np.repeat(self.starts[numbers] - (ends - lengths), lengths)
        places += np.arange(len(places))
        return self.flat[places], lengths


class PieceTable:
    """Encodes texts through `encode`, which is asked for each distinct word or other piece once while it is remembered.

    A piece is a core and perhaps a tail character; pieces are numbered
    apart from cores, for there are more of them. When the memory is full the
    older half stays, among which the common ones are, or (keep_half=False)
    nothing, which suits memories that are seldom full.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], pieces: int = 500_000, cores: int = 1_000_000, keep_half: bool = False) -> None:
        self.keep_half = keep_half
        self.encode_new, self.most_pieces, self.most_cores = encode, pieces, cores
        self.cores, self.lists = _Index(), _Lists()
        self.index, self.parts = _Index(), np.empty((1 << 16, 2), np.int32)

    def _make_room(self) -> None:
        if not self.keep_half:
            if len(self.cores) >= self.most_cores:
                self.cores, self.lists, self.index = _Index(), _Lists(), _Index()
            elif len(self.index) >= self.most_pieces:
                self.index = _Index()
            return
        if len(self.cores) >= self.most_cores:
            left = self.most_cores // 2
            self.cores = self.cores.first(left)
            self.lists.shorten(left)
            kept = np.flatnonzero((self.parts[: len(self.index)] < left).all(axis=1))
            whole = np.zeros(len(self.index), bool)
            whole[kept] = True
            self.parts[: len(kept)] = self.parts[kept]
            self.index = _Index((key, i) for i, key in enumerate(compress(self.index, whole.tolist())))
        if len(self.index) >= self.most_pieces:
            self.index = self.index.first(self.most_pieces // 2)

    def cut(self, text: str) -> list[str]:
        if text.isascii():
            text = text if "<|" in text else text.lower()
        elif not any(x in text for x in UNFOLDED) and unicodedata.is_normalized("NFC", text):
            folded = text.lower()
            text = folded if unicodedata.is_normalized("NFC", folded) else text
        for control in _CONTROLS:  # four scans for one byte are faster than one for a class
            if control in text:
                return _PIECES.findall(text)
        return text.split()

    def _learn(self, first: int) -> None:
        """Takes in the pieces numbered from `first` on."""
        new, self.index.new = self.index.new, []
        core = self.cores.__getitem__
        tails = [p[-1] if p[-1] in TAIL and ends_alone(p[:-1]) else "" for p in new]
        end = first + len(new)
        while end > len(self.parts):
            self.parts = np.concatenate([self.parts, np.empty_like(self.parts)])
        self.parts[first:end, 0] = np.fromiter((core(p[:-1] if t else p) for p, t in zip(new, tails, strict=True)), np.int32, len(new))
        self.parts[first:end, 1] = np.fromiter((core(t) if t else -1 for t in tails), np.int32, len(new))
        self._learn_cores()

    def _learn_cores(self) -> None:
        if self.cores.new:
            unknown, self.cores.new = self.cores.new, []
            self.lists.add(self.encode_new(unknown))

    def _joined(self, pairs: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces given as core and tail, and the offsets among them of the texts, whose pieces stand between `bounds`."""
        cores = pairs.ravel()[(pairs >= 0).ravel()]
        ids, lengths = self.lists.gather(cores)
        per_core = np.concatenate([[0], np.cumsum(lengths)])
        cores_before = np.concatenate([[0], np.cumsum(1 + (pairs[:, 1] >= 0))])
        return ids, per_core[cores_before[bounds]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the offsets of each text's."""
        self._make_room()
        known = len(self.index)
        cut = [*map(self.cut, texts)]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        numbers = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        if self.index.new:
            self._learn(known)
        return self._joined(self.parts[numbers], np.concatenate([[0], np.cumsum(sizes)]))

    def cut_column(self, column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The pieces of the texts of a string column one after the other, and the bounds of each text's; null as the empty text.

        ASCII texts are folded and cut by Arrow; others are cut by cut(), and their pieces joined by single blanks first.
        """
        column = column.fill_null("")
        lines = pc.ascii_lower(column)
        other = pc.invert(pc.and_not(pc.string_is_ascii(column), pc.match_substring(column, "<|")))
        rest = column.filter(other)
        if len(rest):
            lines = pc.replace_with_mask(lines, other, pa.array([" ".join(self.cut(x)) for x in rest.to_pylist()], lines.type))
        lines = pc.ascii_trim_whitespace(lines)  # else there are empty pieces at its ends
        lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(lines, ""), pa.scalar(None, lines.type), lines))
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
        return lists.flatten().dictionary_encode(), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    def _pairs(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of each piece's core and tail (-1: none), without a memory of the pieces."""
        width = np.int64 if pa.types.is_large_string(pieces.type) else np.int32
        _, offsets, data = pieces.buffers()
        offsets = np.frombuffer(offsets, width)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.frombuffer(data, np.uint8)
        starts, ends = offsets[:-1], offsets[1:] - 1
        last = data[ends]
        tailed = _TAIL_BYTES[last] & (starts < ends)
        before = np.concatenate([[0], np.cumsum(~_ALNUM_BYTES[data])])
        plain = before[ends] == before[starts]
        before = np.concatenate([[0], np.cumsum(data >= 128)])
        unsure = np.flatnonzero(tailed & ~plain & (before[ends] > before[starts]))
        tailed &= plain
        tailed[unsure] = [ends_alone(p[:-1]) for p in _strings(pieces.take(pa.array(unsure)))]
        cores = pc.if_else(pa.array(tailed), pc.utf8_slice_codeunits(pieces, 0, -1), pieces).dictionary_encode()
        distinct = _strings(cores.dictionary)
        pairs = np.full((len(pieces), 2), -1, np.int32)
        pairs[:, 0] = np.fromiter(map(self.cores.__getitem__, distinct), np.int32, len(distinct))[cores.indices.to_numpy()]
        tails = np.full(256, -1, np.int32)
        for x in np.unique(last[tailed]).tolist():
            tails[x] = self.cores[chr(x)]
        pairs[tailed, 1] = tails[last[tailed]]
        self._learn_cores()
        return pairs

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), of a string column: each of its distinct cores is looked up once."""
        self._make_room()
        pieces, bounds = self.cut_column(column)
        if not len(pieces):
            return np.empty(0, np.int32), bounds
        return self._joined(self._pairs(pieces.dictionary)[pieces.indices.to_numpy()], bounds)
