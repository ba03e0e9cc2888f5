"""Error classes, and how failures of backends and providers map onto them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.errors import PySparkException


class EngineError(Exception):
    """Base of all errors raised here; its subclasses are independent of each other."""


class InvalidArgument(EngineError):
    pass


class Unsupported(EngineError):
    pass


class ProtocolError(EngineError):
    pass


class Unavailable(EngineError):
    pass


class MissingID(EngineError):
    pass


class MissingSourceID(EngineError):
    pass


class EmptyText(EngineError):
    pass


class EmptyVector(EngineError):
    pass


class InvalidPage(EngineError):
    pass


class InvalidGraph(EngineError):
    pass


class Cancelled(EngineError):
    """The caller gave up; never reclassified."""


#: Bytes of a provider's error body that are kept.
BODY_BYTES = 4096


def from_status(status: int, body: bytes | str = b"") -> EngineError:
    """The error of an HTTP response that wasn't a success."""
    raw = body.encode() if isinstance(body, str) else body
    text = f"status {status}: {raw[:BODY_BYTES].decode('utf-8', 'replace').strip()}"
    if status == 429 or status >= 500:
        return Unavailable(text)
    return InvalidArgument(text) if 400 <= status < 500 else ProtocolError(text)


def classified(error: BaseException) -> BaseException:
    """Errors of this package and cancellations as they are, anything else as Unavailable."""
    if isinstance(error, EngineError | KeyboardInterrupt):
        return error
    return Unavailable(f"{type(error).__name__}: {str(error)[:BODY_BYTES]}")


def backend_call(action: Callable) -> Callable:
    """Classify what an action on Spark or a provider raises."""

    @wraps(action)
    def run(*args, **kwargs):
        try:
            return action(*args, **kwargs)
        except (PySparkException, OSError, TimeoutError, ConnectionError) as e:
            raise classified(e) from e

    return run
