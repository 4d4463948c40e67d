"""One base class, one class per area."""


class EngineError(Exception):
    """Base of all errors the engine raises itself."""


class SpecError(EngineError):
    """A spec is not valid; `errors` lists everything found."""

    def __init__(self, errors: list[str] | str):
        self.errors = [errors] if isinstance(errors, str) else list(errors)
        super().__init__("; ".join(self.errors))


class ShapeError(EngineError):
    """Column shaping can't be done on this frame."""


class QualityError(EngineError):
    """A data-quality rule with the action `fail` was violated."""


class LoadError(EngineError):
    """A load strategy can't be applied."""


class DecodeError(EngineError):
    """Binary input or its schema can't be understood."""


class PlanError(EngineError):
    """Reads and flows can't be put in an order."""
