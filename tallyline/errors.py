"""Errors a job can end with. Each one leaves the last good result in place."""


class ContractViolation(RuntimeError):
    """A gate found rows that must not be published."""


class ResultNotFound(LookupError):
    """No successfully published result matches the request."""


class ResultReadError(RuntimeError):
    """Published results exist but cannot be trusted as they are."""


class PositionMismatch(RuntimeError):
    """Stream progress and the ledger's own position disagree."""


class EventConflict(RuntimeError):
    """One event id arrived with different content; its partition stops there."""
