"""Exceptions raised by the engine."""


class QuadlakeError(Exception):
    """Base class of all errors of this package."""


class TransactionError(QuadlakeError):
    """commit or rollback without begin, or begin inside a transaction."""


class ConfigError(QuadlakeError):
    """A store configuration that cannot be used."""


class SparqlSyntaxError(QuadlakeError):
    """Query text that is not in the supported grammar."""


class TurtleSyntaxError(QuadlakeError):
    """A document that is neither Turtle nor TriG."""
