"""Exceptions of the engine."""


class StratumError(Exception):
    pass


class MetadataError(StratumError):
    pass


class ShardNotFound(StratumError):
    pass


class RoutingError(StratumError):
    """A row has no shard that may take it."""


class ReadOnlyShard(RoutingError):
    pass


class TemporalError(StratumError):
    pass


class VersionConflict(TemporalError):
    pass


class TransactionError(StratumError):
    pass


class NestedTransaction(TransactionError):
    pass


class CommitFailed(TransactionError):
    pass


class TransactionTimeout(TransactionError):
    pass
