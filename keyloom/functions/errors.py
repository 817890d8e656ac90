"""Errors of the namespace API."""

from __future__ import annotations


class KeyloomError(Exception):
    """Base of all errors raised here."""


class KeyPathError(KeyloomError, ValueError):
    """A path segment breaks the segment rules."""


class KeyTooLong(KeyloomError, ValueError):
    pass


class ValueTooLong(KeyloomError, ValueError):
    pass


class ReadOnly(KeyloomError):
    pass


class NotFound(KeyloomError, LookupError):
    pass


class DstExists(KeyloomError):
    pass


class TreeExists(KeyloomError):
    pass


class TreeNotFound(KeyloomError, LookupError):
    pass


class TreeDropped(KeyloomError):
    pass


class OutsideViewScope(KeyloomError):
    def __init__(self, requested: bytes, scope: bytes):
        super().__init__(f"a request of {len(requested)} bytes lies outside the view's scope of {len(scope)} bytes")
        self.requested_len, self.scope_len = len(requested), len(scope)


class GcRequiresStandaloneTree(KeyloomError):
    pass


class JournalError(KeyloomError):
    pass


class JournalPositionExpired(JournalError):
    pass


class JournalAnchorMismatch(JournalError):
    pass


class JournalEnvelopeError(JournalError, ValueError):
    pass


class CorruptImage(KeyloomError):
    pass


class OutcomeUnknown(KeyloomError):
    """A commit that broke off while its manifest was being created: it may stand or not."""


class AtomicError(KeyloomError):
    """A batch that failed; ``kind`` says whether it can have been applied."""

    def __init__(self, kind: str, cause: Exception):
        super().__init__(f"{kind}: {cause}")
        self.kind, self.cause = kind, cause
