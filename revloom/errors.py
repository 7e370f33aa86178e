"""Errors with the codes callers see."""

from __future__ import annotations


class RevloomError(Exception):
    code, exit_code = "ERROR", 1


class NoData(RevloomError):
    code = "NO_DATA"


class NotFound(RevloomError):
    code = "NOT_FOUND"


class InvalidDiff(RevloomError):
    code = "INVALID_DIFF"


class Forbidden(RevloomError):
    code = "REPO_FORBIDDEN"


class InvalidInput(RevloomError):
    code, exit_code = "INVALID_INPUT", 2


class AccessFailed(RevloomError):
    """A remote source refused or did not answer; ``kind`` is unauthorized, not_found, rate_limited or exhausted."""

    code, exit_code = "ACCESS", 3

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind
