"""Logging, set up once."""

from __future__ import annotations

import logging
import sys

FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def setup(level: str = "INFO", file: str | None = None) -> logging.Logger:
    """Sends the library's messages to stderr, and to file if given. Calling it again replaces the handlers."""
    log = logging.getLogger("lakesnap")
    value = logging.getLevelName(level.upper())
    if not isinstance(value, int):
        raise ValueError(f"unknown log level {level!r}")
    log.setLevel(value)
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    for h in [logging.StreamHandler(sys.stderr), *([logging.FileHandler(file)] if file else [])]:
        h.setFormatter(logging.Formatter(FORMAT))
        log.addHandler(h)
    return log


def get(name: str = "") -> logging.Logger:
    return logging.getLogger(f"lakesnap.{name}" if name else "lakesnap")
