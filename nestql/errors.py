"""Errors of the engine; messages are part of the API."""

from __future__ import annotations


class EngineError(Exception):
    """A failure of one root field: the field becomes null and the message is reported."""

    def __init__(self, message: str, location: tuple[int, int] | None = None):
        super().__init__(message)
        self.message, self.location = message, location


class ArgumentError(EngineError):
    def __init__(self, location: tuple[int, int] | None = None):
        super().__init__("Could not build filter from arguments", location)


class UnknownField(EngineError):
    def __init__(self, name: str, location: tuple[int, int] | None = None):
        super().__init__(f"Unknown database field {name}", location)


class NoPrimaryKey(EngineError):
    def __init__(self, location: tuple[int, int] | None = None):
        super().__init__("No primary key argument found", location)


class Conflict(EngineError):
    """Another transaction committed since this one began; it may be tried again."""

    def __init__(self, location: tuple[int, int] | None = None):
        super().__init__("Another transaction was faster", location)


class DocumentError(Exception):
    """The document is malformed or doesn't fit the schema; nothing is executed."""

    def __init__(self, message: str, location: tuple[int, int] | None = None):
        super().__init__(message)
        self.message, self.location = message, location
