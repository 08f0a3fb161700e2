"""What can go wrong, by kind. Nothing undefined is answered with an empty result."""

from __future__ import annotations


class StrideError(Exception):
    """Base of all errors of this library."""


class QuerySyntaxError(StrideError):
    """The text is no query; ``line`` and ``column`` say where."""

    def __init__(self, message: str, line: int = 1, column: int = 0):
        super().__init__(f"{message} (line {line}, column {column})")
        self.line, self.column = line, column


class QueryError(StrideError):
    """The query can't be answered on this corpus."""


class CorpusError(StrideError):
    """The data breaks the order contract."""


class ConfigError(StrideError):
    """A configuration names something unknown."""


class PositionalUnsupported(QueryError):
    """A construct that has no meaning along the order axis."""
