"""Exceptions raised by guards; data errors become rows instead."""


class TaskFormatError(ValueError):
    """Task records break the contract and the caller asked for strict loading."""


class SplitError(ValueError):
    """Leakage-free splits cannot be built from these tasks or parameters."""
