"""Errors that this package raises on the driver."""

from __future__ import annotations

from pyspark.errors import PySparkException


class ParseError(PySparkException):
    """A file breaks a rule of the format; ``line_no`` is the line, ``file`` the file's name."""

    def __init__(self, message: str, line_no: int | None = None, file: str | None = None):
        super().__init__(message=message if line_no is None else f"{message} Error detected on line {line_no}.")
        self.line_no, self.file = line_no, file


class InvalidStateError(PySparkException, ValueError):
    """An operation would leave tables that contradict one another, or names what is not there."""

    def __init__(self, message: str):
        super().__init__(message=message)


class MissingError(InvalidStateError, KeyError):
    """What an operation names is not there."""

    def __str__(self) -> str:
        return PySparkException.__str__(self)
