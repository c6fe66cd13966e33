"""Errors of the table format."""


class AlreadyExists(Exception):
    """A table with this name is there."""


class NoSuchTable(Exception):
    """No table with this name is there."""


class CommitFailed(Exception):
    """Another writer committed first; the change can be applied again."""


class ValidationError(Exception):
    """Metadata, an argument or a state doesn't allow the operation."""


class SimulatedCrash(Exception):
    """Raised on purpose before a version is published, to see that the table stays as it was."""
