"""Expected failures: what went wrong, what to do about it, and details for debugging."""

from __future__ import annotations


class ReviewError(Exception):
    """A failure that a user can act on."""

    def __init__(self, message: str, recovery: str = "", details: str = ""):
        super().__init__(message)
        self.message, self.recovery, self.details = message, recovery, details

    def rendered(self) -> str:
        """All parts, each on a line of its own."""
        return "\n".join(x for x in (self.message, self.recovery, self.details) if x)


#: A failure as a value in a table.
FAILURE = "struct<error: string, message: string, recovery: string, details: string>"


def failure_row(e: ReviewError) -> dict[str, str]:
    return {"error": type(e).__name__, "message": e.message, "recovery": e.recovery, "details": e.details}


def raised(row) -> ReviewError:
    """The error of a row with the fields of FAILURE."""
    kinds = {k.__name__: k for k in ReviewError.__subclasses__()}
    return kinds.get(row["error"], ReviewError)(row["message"], row["recovery"] or "", row["details"] or "")


class NotARepository(ReviewError):
    pass


class DetachedHead(ReviewError):
    pass


class GitFailed(ReviewError):
    pass


class BaseNotFound(ReviewError):
    pass


class CollectionFailed(ReviewError):
    pass


class IdsDiffer(ReviewError):
    pass


class ConfigError(ReviewError):
    pass


class ReportWriteFailed(ReviewError):
    pass
