"""Errors of the engine, and the schema of rows that permissive operators set aside."""

from __future__ import annotations


class VecsparkError(Exception):
    """Base of all errors raised by this engine."""


class CodecError(VecsparkError, ValueError):
    """A configuration, codebook or vector that the codec cannot work with."""


class UnsupportedBitWidth(CodecError):
    pass


class InvalidDimension(CodecError):
    pass


class InvalidSeed(CodecError):
    pass


class DimensionMismatch(CodecError):
    pass


class CodebookIncompatible(CodecError):
    pass


class CodebookEntryCount(CodecError):
    pass


class CodebookNotSorted(CodecError):
    pass


class CodebookDuplicate(CodecError):
    pass


class InsufficientTrainingData(CodecError):
    pass


class NonFiniteValue(CodecError):
    pass


class ConfigMismatch(CodecError):
    pass


class IndexOutOfRange(CodecError):
    pass


class LengthMismatch(CodecError):
    pass


class InvalidResidualFlag(CodecError):
    pass


class CorpusError(VecsparkError):
    """A corpus operation that was refused; the corpus is as before."""


class DuplicateVector(CorpusError):
    pass


class UnknownVector(CorpusError, KeyError):
    pass


class BatchFailure(CorpusError):
    """The first row, by ordinal, that made a batch fail."""

    def __init__(self, ordinal: int, error_class: str, detail: str) -> None:
        super().__init__(f"row {ordinal}: {error_class}: {detail}")
        self.ordinal, self.error_class, self.detail = ordinal, error_class, detail


class SearchError(VecsparkError):
    """A search backend cannot take the request."""


class InvalidTopK(SearchError, ValueError):
    pass


class FormatError(VecsparkError, ValueError):
    """Bytes that are no valid record or file."""


class Truncated(FormatError):
    pass


class UnknownVersion(FormatError):
    pass


class InvalidBitWidth(FormatError):
    pass


class InvalidText(FormatError):
    pass


class InvalidHeader(FormatError):
    pass


class TooLarge(FormatError):
    pass


class InvalidIdentifier(VecsparkError, ValueError):
    """A table name that may not stand in a statement."""


REJECTS = "vec_id string, ordinal long, error_class string, detail string"
