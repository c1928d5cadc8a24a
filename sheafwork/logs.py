"""Logging of the driver side: one logger, with colours on a terminal and without in files."""

from __future__ import annotations

import logging
import sys

logger = logging.getLogger("sheafwork")
DATES = "%Y-%m-%d %H:%M:%S"
#: ANSI codes by level.
COLOURS = {"DEBUG": "36", "INFO": "32", "WARNING": "33", "ERROR": "31", "CRITICAL": "35"}


class PlainFormatter(logging.Formatter):
    def __init__(self) -> None:
        super().__init__("%(asctime)s | %(levelname)-8s | %(name)s:%(funcName)s:%(lineno)d - %(message)s", DATES)


class ColourFormatter(PlainFormatter):
    def format(self, record: logging.LogRecord) -> str:
        return f"\x1b[{COLOURS.get(record.levelname, '0')}m{super().format(record)}\x1b[0m"


def configure_logger(level: str = "INFO", format: str | None = None, sink: str | None = None) -> None:  # noqa: A002
    """Replaces the logger's handlers: a file for ``sink``, else stderr. ``format`` replaces the line's layout."""
    logger.handlers.clear()
    known = level.upper() if level.upper() in COLOURS else "INFO"
    handler = logging.FileHandler(sink, encoding="utf-8") if sink else logging.StreamHandler(sys.stderr)
    plain = sink or not sys.stderr.isatty()
    handler.setFormatter(logging.Formatter(format, DATES) if format else PlainFormatter() if plain else ColourFormatter())
    handler.setLevel(known)
    logger.setLevel(known)
    logger.addHandler(handler)
