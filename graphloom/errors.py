"""Statuses, failures and exit codes."""

from __future__ import annotations

# Exit codes by class of outcome.
EXIT_OK, EXIT_USAGE, EXIT_DATA, EXIT_RESOURCE, EXIT_NON_CONVERGED, EXIT_NUMERICAL = 0, 2, 3, 4, 5, 6
EXIT_PUBLICATION, EXIT_DURABILITY, EXIT_SYSTEM, EXIT_INTERNAL = 7, 8, 9, 10


class EngineError(Exception):
    """A failure with its class and exit code."""

    kind, code = "internal", EXIT_INTERNAL


class UsageError(EngineError):
    kind, code = "usage", EXIT_USAGE


class ConfigError(EngineError):
    kind, code = "configuration", EXIT_USAGE


class DataError(EngineError):
    kind, code = "data", EXIT_DATA


class EdgeCsvError(DataError):
    """A malformed edge CSV; ``line`` is the 1-based physical line."""

    def __init__(self, line: int, message: str):
        super().__init__(message)
        self.line = line


class VertexLimitError(DataError):
    pass


class ResourceError(EngineError):
    kind, code = "resource", EXIT_RESOURCE


class NonConverged(EngineError):
    kind, code = "non-convergence", EXIT_NON_CONVERGED


class NumericalError(EngineError):
    kind, code = "numerical", EXIT_NUMERICAL


class PublicationError(EngineError):
    """``state``: not_published, target_exists or no_replace_unsupported; nothing stands under the name in any of them."""

    kind, code = "publication", EXIT_PUBLICATION

    def __init__(self, message: str, state: str = "not_published"):
        super().__init__(message)
        self.state = state


class DurabilityError(EngineError):
    """The file is published, but its folder could not be synced."""

    kind, code, state = "durability", EXIT_DURABILITY, "durability_uncertain"
