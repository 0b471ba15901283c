"""One hierarchy for what can go wrong (API6)."""


class EngineError(Exception):
    """Base of all errors raised here."""


class GraphError(EngineError):
    """Duplicate ids, dangling edges, unknown nodes."""


class IdError(GraphError, ValueError):
    """A node id or one of its parts is malformed."""


class EdgeError(GraphError, ValueError):
    """An edge type does not fit its ends."""


class FilterError(EngineError, LookupError):
    """A service or environment that was asked for does not exist."""


class ConfigError(EngineError, ValueError):
    """The configuration is invalid."""


class ParseError(EngineError, ValueError):
    """A source file cannot be read."""


class StateError(EngineError):
    """Survey state is missing or of another version."""


class ProviderError(EngineError):
    """A text provider is unknown or failed."""
