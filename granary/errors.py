"""Errors of the engine, by what a caller can do about them."""

from __future__ import annotations


class EngineError(Exception):
    """Anything the engine refuses."""


class ParseError(EngineError):
    """The text is not a statement."""


class BindError(EngineError):
    """A statement names something unknown or mixes types that do not go together."""


class NotFound(BindError):
    """A relation, index or sequence does not exist."""


class AlreadyExists(EngineError):
    """A name is taken."""


class ConstraintViolation(EngineError):
    """Rows break a rule of their table."""

    def __init__(self, message: str, kind: str, columns: tuple[str, ...] = ()):
        super().__init__(message)
        self.kind, self.columns = kind, columns


class TransactionError(EngineError):
    """A transaction statement at the wrong time, or a write in a read-only one."""


def translated(error: Exception) -> Exception:
    """A run-time error of Spark as one of ours, told apart by its condition."""
    said = {
        "DIVIDE_BY_ZERO": "division by zero",
        "ARITHMETIC_OVERFLOW": "integer out of range",
        "BINARY_ARITHMETIC_OVERFLOW": "integer out of range",
        "CAST_OVERFLOW": "integer out of range",
        "CAST_INVALID_INPUT": "invalid input syntax",
        "USER_RAISED_EXCEPTION": None,
    }
    condition = getattr(error, "getCondition", lambda: None)() or ""
    head = condition.split(".")[0]
    if head == "USER_RAISED_EXCEPTION":
        return EngineError((getattr(error, "getMessageParameters", lambda: {})() or {}).get("errorMessage", str(error)))
    return EngineError(said[head]) if head in said else error
