"""What can go wrong, and the status that a service would answer with."""

from __future__ import annotations

from quillmine.functions.config import InvalidSettings


class CorpusError(RuntimeError):
    """Anything that the caller can't mend by asking otherwise."""

    status = 503


class UnreadableDocument(CorpusError):
    """A file's text can't be extracted."""


class IndexUnavailable(CorpusError):
    """There is no index to answer from."""


class GenerationUnavailable(CorpusError):
    """The chat model can't be reached or isn't configured."""


def status_of(error: Exception) -> int:
    """503 for known failures, 422 for values out of range, 500 for the rest."""
    if isinstance(error, CorpusError):
        return error.status
    return 422 if isinstance(error, (InvalidSettings, ValueError)) else 500
