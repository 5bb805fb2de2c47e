"""Exceptions raised when a job is asked for something its data does not allow."""


class SiltstoneError(Exception):
    """Base class; ``details`` carries the values that explain the failure."""

    def __init__(self, message: str, **details: object) -> None:
        super().__init__(message)
        self.details = details


class ConfigurationError(SiltstoneError):
    """A setting is missing or has a value that cannot be used."""


class ValidationError(SiltstoneError):
    """Input rows or arguments break a rule."""


class DimensionMismatchError(ValidationError):
    """An embedding has another length than the collection it is used with."""


class NotFoundError(SiltstoneError):
    """A row looked up or updated by key does not exist."""


class IntegrityError(SiltstoneError):
    """A key or a unique column would occur twice."""


class GitError(SiltstoneError):
    """A git command failed, could not be started or ran out of time."""


class ConflictError(SiltstoneError):
    """Another writer committed first, so a change was checked against rows that are no longer current."""
