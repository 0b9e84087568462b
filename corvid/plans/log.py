"""The engine's loggers: to the console, to a file, to several, from a least level on."""

from __future__ import annotations

import logging
import sys
from collections.abc import Mapping
from typing import Any, Protocol, TextIO

LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warning": logging.WARNING, "error": logging.ERROR}


class Log(Protocol):
    def write(self, level: str, text: str, **fields: Any) -> None: ...


def _line(text: str, fields: Mapping[str, Any]) -> str:
    return " ".join([text, *(f"{k}={v}" for k, v in sorted(fields.items()))])


class HandlerLog:
    """Writes through a handler of the standard library."""

    def __init__(self, handler: logging.Handler, least: str = "info") -> None:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        self.handler, self.least = handler, LEVELS[least]

    def write(self, level: str, text: str, **fields: Any) -> None:
        if LEVELS[level] >= self.least:
            self.handler.handle(logging.LogRecord("corvid", LEVELS[level], "", 0, _line(text, fields), None, None))

    def close(self) -> None:
        self.handler.close()


def console(least: str = "info", stream: TextIO | None = None) -> HandlerLog:
    return HandlerLog(logging.StreamHandler(stream or sys.stderr), least)


def to_file(path: str, least: str = "info") -> HandlerLog:
    return HandlerLog(logging.FileHandler(path, delay=True), least)


class AllOf:
    """Each of several; one that fails doesn't keep the others from writing."""

    def __init__(self, *logs: Log) -> None:
        self.logs = logs

    def write(self, level: str, text: str, **fields: Any) -> None:
        for log in self.logs:
            try:
                log.write(level, text, **fields)
            except OSError as e:
                print(f"a log can't be written: {e}", file=sys.stderr)
