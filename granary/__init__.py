"""A small SQL engine on Spark: its own dialect, native plans."""

from importlib import import_module
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from .errors import AlreadyExists, BindError, ConstraintViolation, EngineError, NotFound, ParseError, TransactionError
    from .session import Connection, Database, Prepared, Result, connect

__version__ = "0.1.0"
__all__ = [
    "AlreadyExists", "BindError", "Connection", "ConstraintViolation", "Database", "EngineError", "NotFound", "ParseError",
    "Prepared", "Result", "TransactionError", "connect",
]


def __getattr__(name: str) -> object:
    """Names are loaded when they are first used, so that Python workers don't load the engine."""
    if name in __all__:
        home = "session" if name in ("Connection", "Database", "Prepared", "Result", "connect") else "errors"
        return getattr(import_module(f".{home}", __name__), name)
    raise AttributeError(name)
