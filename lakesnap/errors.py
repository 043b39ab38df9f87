"""Errors that callers can tell apart."""


class LakesnapError(Exception):
    """Any failure of the engine."""


class NotFound(LakesnapError):
    """A table, snapshot, backup or file that does not exist."""


class Conflict(LakesnapError):
    """Something is there already, or changed meanwhile."""


class CopyFailed(LakesnapError):
    """More files failed than the policy allows."""


class SnapshotWarning(UserWarning):
    """Something odd that does not stop the work."""
