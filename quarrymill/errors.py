"""Errors that say what to do."""

from __future__ import annotations


class EngineError(Exception):
    """A message and a hint."""

    def __init__(self, message: str, hint: str = ""):
        super().__init__(message)
        self.hint = hint

    def render(self) -> str:
        return f"{self}\n  hint: {self.hint}" if self.hint else str(self)


class ConnectionFailed(EngineError):
    pass


class BadDocument(EngineError):
    pass


class MissingAnswer(EngineError):
    pass
