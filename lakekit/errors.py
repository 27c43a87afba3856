"""Exceptions raised by the library."""


class LakeError(Exception):
    """Base class."""


class ValidationError(LakeError):
    """Arguments or columns do not fit the operation."""


class NoColumnsError(LakeError, LookupError):
    """An operation that needs columns was given none, or unknown ones."""


class VersionNotFoundError(LakeError):
    """A version that the log cannot (re)create was asked for."""

    def __init__(self, requested, earliest, latest):
        self.requested, self.earliest, self.latest = requested, earliest, latest
        super().__init__(f"Cannot find version {requested}; available versions: [{earliest}, {latest}]")


class TableNotFoundError(LakeError):
    """No table at the path or under the name."""


class TableExistsError(LakeError):
    """A table is already there."""


class MultipleMatchError(LakeError):
    """More than one source row would change the same target row."""


class ChangeFeedError(LakeError):
    """The change feed of a version range cannot be read."""


class ConcurrentCommitError(LakeError):
    """Another writer published a conflicting version first."""
