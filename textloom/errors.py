"""Errors of the engine. In executors they surface as Spark's PythonException."""


class TextloomError(Exception):
    """Any error of the engine."""


class InvalidInputError(TextloomError, ValueError):
    """An argument out of its range, or of the wrong type."""


class MissingTokenCounterError(InvalidInputError):
    """A token limit without anything to count tokens with."""

    def __init__(self, message: str = "max_tokens needs a token counter"):
        super().__init__(message)


class FileProcessingError(TextloomError):
    """A file that can't be read or converted."""


class UnsupportedFileTypeError(FileProcessingError):
    """A file of a kind that no reader takes."""


class TokenLimitError(TextloomError):
    """A block of code that is longer than strict limits allow."""


class CallbackError(TextloomError):
    """A user's function that failed, or gave back something of the wrong type."""
