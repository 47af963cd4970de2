"""What the library refuses, and how: always when a plan is built, before any job runs, where that can be told."""


class LoomError(Exception):
    """Any refusal of this library."""


class SchemaError(LoomError, ValueError):
    """A table lacks a column or cell that an operator needs."""


class PlanError(LoomError, ValueError):
    """Operators that don't make a plan."""


class AmbiguousNodeError(PlanError):
    """More than one operator answers to a node."""


class IngestError(LoomError, ValueError):
    """A recording, log or instrument file that can't be trusted."""


class ParameterError(LoomError, ValueError):
    """Latents, blocks or bindings that don't fit together."""


class MissingSeedError(LoomError, RuntimeError):
    """A random operator without a seed."""
