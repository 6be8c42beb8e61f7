"""Opt-in logging: silent until enabled, with a level of its own for tool calls."""

from __future__ import annotations

import logging
import sys
import threading

TOOL_CALL = 25
PACKAGE = "tablewright"
logging.addLevelName(TOOL_CALL, "TOOL_CALL")
logger = logging.getLogger(PACKAGE)
logger.addHandler(logging.NullHandler())
logger.propagate = False
logger.disabled = True


class LoggingHandle:
    """One enabled sink. The package falls silent when the last handle is disabled; use it as a context if you like."""

    _lock = threading.Lock()
    _active: list[LoggingHandle] = []

    def __init__(self, handler: logging.Handler) -> None:
        self._handler: logging.Handler | None = handler
        with self._lock:
            logger.addHandler(handler)
            self._active.append(self)
            logger.disabled = False
            logger.setLevel(min(h._handler.level for h in self._active if h._handler))

    def disable(self) -> None:
        """Remove the sink; more than once does no harm."""
        with self._lock:
            if self._handler is None:
                return
            logger.removeHandler(self._handler)
            self._handler = None
            self._active.remove(self)
            logger.disabled = not self._active
            if self._active:
                logger.setLevel(min(h._handler.level for h in self._active if h._handler))

    def __enter__(self) -> LoggingHandle:
        return self

    def __exit__(self, *_: object) -> None:
        self.disable()

    @classmethod
    def get_active_handle_count(cls) -> int:
        return len(cls._active)


def enable_logging(level: int | str = TOOL_CALL, sink: object = None, format: str = "%(asctime)s %(levelname)s %(message)s") -> LoggingHandle:
    """Send the package's records of at least ``level`` to a stream, file path or logging handler (default: stderr)."""
    if isinstance(sink, logging.Handler):
        handler = sink
    elif isinstance(sink, str):
        handler = logging.FileHandler(sink)
    else:
        handler = logging.StreamHandler(sink if sink is not None else sys.stderr)
    handler.setLevel(level)
    handler.setFormatter(logging.Formatter(format))
    return LoggingHandle(handler)
