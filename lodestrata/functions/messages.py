"""Numbered messages of a run: errors as '00042! text', warnings as '00042: text', each with a count of its own."""

from __future__ import annotations

import logging

_LOG = logging.getLogger("lodestrata")


class Messages:
    """What a run has to say; on the driver, where a run is steered."""

    def __init__(self) -> None:
        self.errors = self.warnings = 0

    def error(self, text: str) -> str:
        self.errors += 1
        line = f"{self.errors:05d}! {text}"
        _LOG.error(line)
        return line

    def warning(self, text: str) -> str:
        self.warnings += 1
        line = f"{self.warnings:05d}: {text}"
        _LOG.warning(line)
        return line
