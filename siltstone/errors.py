"""What can go wrong in storage, by kind."""


class StoreError(Exception):
    """Base of all errors of this library."""


class CorruptionError(StoreError):
    """Stored bytes fail their checksum or break off."""


class StorageError(StoreError):
    """A file could not be written, renamed or removed."""


class ConflictError(StoreError):
    """Another writer committed first, as often as the commit was tried."""


class RecoveryError(StoreError):
    """The manifest names files that are not there."""


class ClosedError(StoreError):
    """The table or snapshot has been closed."""


class LockError(StoreError):
    """Another process holds the table for itself."""
